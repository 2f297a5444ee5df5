"""The corpus queries that SQL can express, for an independent engine to run on the same tables."""

from __future__ import annotations

from moodstream.llm.mixing import MARKS, MAX_EPOCHS
from moodstream.llm.shared import WORD

_WHOLE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOP5 = f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
    FROM embeddings WHERE {_WHOLE}),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank, vec_id, score FROM (SELECT *,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
WHERE rank <= 5"""

VECTOR_GROUPS = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_WHOLE}),
u AS (SELECT vec_id, list_transform(x, lambda c: c / sqrt(list_inner_product(x, x))) AS x FROM v
    WHERE list_inner_product(x, x) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b
    ON a.vec_id <> b.vec_id AND list_inner_product(a.x, b.x) >= 0.9),
reached(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION
    SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id)::BIGINT AS n_links, component_id,
    vec_id = component_id AS kept FROM (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY 1)"""

_CAP = f"{MAX_EPOCHS} * source_size"
_FILL = f"ORDER BY ({_CAP})::DOUBLE / w, source NULLS LAST"
_U = "(('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT + 0.5) / 281474976710656.0"

MIX = f"""WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
    CASE WHEN length(text) > 0 THEN greatest(0.05,
        1 - (4 * (length(text) - length(translate(text, '{MARKS}', ''))))::DOUBLE / length(text))
        ELSE 0.05 END::DOUBLE AS weight FROM documents),
keyed AS (SELECT doc_id, source, size, -ln(({_U})::DOUBLE) / weight AS key FROM sized),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
    FROM (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY 1)),
filled AS (SELECT *, (sum(source_size) OVER () - coalesce(sum({_CAP}) OVER (
        {_FILL} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER ({_FILL} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share FROM weighed),
budgets AS (SELECT source, source_size, least(({_CAP})::DOUBLE, coalesce(
    (SELECT max(share) FROM filled WHERE ({_CAP})::DOUBLE / w > share), 0.0) * w)::DOUBLE AS target FROM filled),
placed AS (SELECT k.doc_id, k.source, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, size, source_size, target, (epochs * size
    + least(greatest(floor(target) - epochs * source_size - before, 0), size))::BIGINT AS taken FROM placed"""

_ITEM_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

RANKED = f"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '{_ITEM_TERM}')) AS term FROM documents),
tfs AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tfs GROUP BY 1),
every AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sizes),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM tfs, every GROUP BY 1),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (
    SELECT item_id, unnest(regexp_extract_all({_LOWER}, '{_ITEM_TERM}')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf
        + 8 * (25 + (75 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN tfs USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), every GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
WHERE rank <= 10"""

_WINDOW = 35

REPEATS = f"""WITH cut AS (SELECT doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - {_WINDOW} + 2)) AS i, words FROM cut),
windows AS (SELECT doc_id, i, sha256(array_to_string(words[i : i + {_WINDOW} - 1], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
hits AS (SELECT doc_id, list(i) AS places FROM windows JOIN twice USING (h) GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {_WINDOW})) AS i FROM (SELECT doc_id, unnest(places) AS i FROM hits)),
gaps AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY 1),
kept AS (SELECT doc_id, list(word ORDER BY i) AS words FROM (
        SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM cut SEMI JOIN gaps USING (doc_id))
    ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT cut.doc_id, len(cut.words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(CASE WHEN gone IS NULL THEN cut.words ELSE coalesce(kept.words, []) END, ' ')) AS kept_sha256
FROM cut LEFT JOIN gaps USING (doc_id) LEFT JOIN kept USING (doc_id)"""

ORACLES = {"op2_impact_top5": TOP5, "op4_vector_groups": VECTOR_GROUPS, "op9_mix_sources": MIX,
           "op12_repeated_passages": REPEATS, "op13_ranked_items": RANKED}
