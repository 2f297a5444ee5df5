"""The registered queries as SQL over the same tables, for an independent engine to run."""

from __future__ import annotations

import string

from moodstream.functions import text as tx
from moodstream.functions.wordlists import NEGATIVE_WORDS, POSITIVE_WORDS, stop_words
from moodstream.operators.ingest import MAX_TEXT, SAMPLE_FRACTION
from moodstream.plans.table_queries import (
    AFTER_LAST_EVENT, BATCHES, KEPT_POSTS, LATE_DELAY, MONTH_LATER, RULES, SKETCH, WINDOW_STEP, WINDOW_WORDS,
)

STOPS = ", ".join(f"'{word}'" for word in stop_words())


def _r6(value: str) -> str:
    return f"(round({value}, 6) + 0.0)"


def _r4(value: str) -> str:
    return f"(round({value}, 4) + 0.0)"


def _lean(text: str) -> str:
    def hits(words):
        return " + ".join(f"contains(lower({text}), '{w}')::INTEGER" for w in words)

    return f"sign(({hits(POSITIVE_WORDS)}) - ({hits(NEGATIVE_WORDS)}))::INTEGER"


def _named(lean: str) -> str:
    return f"CASE {lean} WHEN 1 THEN 'positive' WHEN -1 THEN 'negative' ELSE 'neutral' END"


def _threshold(value: str, limit: float) -> str:
    return (
        f"CASE WHEN {value} > {limit} THEN 'positive' WHEN {value} < -{limit} THEN 'negative' "
        "ELSE 'neutral' END"
    )


def _blank(text: str) -> str:
    return f"NOT coalesce(regexp_matches({text}, '{tx.NOT_SPACE}'), false)"


def _clean(text: str, strict: bool = False) -> str:
    cleaned = f"coalesce({text}, '')"
    cleaned = f"regexp_replace({cleaned}, '{tx.URL}', '', 'g')"
    cleaned = f"regexp_replace({cleaned}, '{tx.MENTION}', '', 'g')"
    cleaned = f"regexp_replace({cleaned}, '{tx.HASHTAG}', '{'' if strict else chr(92) + '1'}', 'g')"
    if strict:
        cleaned = f"regexp_replace({cleaned}, '{tx.NUMBER}', '', 'g')"
        marks = string.punctuation.replace("'", "''")
        cleaned = f"translate({cleaned}, '{marks}', '')"
    return f"trim(regexp_replace(lower({cleaned}), '{tx.SPACES}', ' ', 'g'))"


def _words(text: str) -> str:
    letters = rf"regexp_replace({text}, '[^a-zA-Z\s]', '', 'g')"
    return rf"string_split_regex(lower({letters}), '\s+')"


def _kept(word: str = "word") -> str:
    return f"length({word}) > 4 AND {word} NOT IN ({STOPS})"


def _preview(text: str) -> str:
    return f"CASE WHEN length({text}) > 200 THEN substr({text}, 1, 200) || '...' ELSE {text} END"


LEAN = _lean("text")
LABEL = _named(LEAN)
POLARITY = "(value / 251 - 1)"
DOC_COUNTS = f"""SELECT count(*)::BIGINT AS total, {", ".join(
    f"count(*) FILTER (label = '{n}')::BIGINT AS {n}" for n in ("positive", "negative", "neutral"))}
FROM (SELECT {LABEL} AS label FROM documents)"""

EPOCH = "epoch_us(ts) / 1e6"
CREATED = "strftime(ts, '%Y-%m-%dT%H:%M:%S')"
POSTS = f"""SELECT doc_id::VARCHAR AS id, 'u' || user_id AS did, source, {EPOCH} AS timestamp, text,
{CREATED} AS created_at FROM documents JOIN events ON doc_id = event_id"""

NESTED = f"""SELECT CASE WHEN event_type = 'error' THEN 'identity' ELSE 'commit' END AS kind,
CASE WHEN event_type = 'signup' THEN 'delete' ELSE 'create' END AS operation,
'u' || user_id AS did, doc_id::VARCHAR AS id, {EPOCH} AS timestamp, {CREATED} AS created_at,
CASE WHEN doc_id % 17 <> 0 THEN [lang] END AS langs,
CASE WHEN doc_id % 13 = 0 THEN '' ELSE text END AS text
FROM documents JOIN events ON doc_id = event_id"""
ENGLISH = "coalesce(list_contains(langs, 'en'), false)"
NEW_POSTS = f"""SELECT id, did, 'bluesky' AS source, timestamp, text, created_at FROM ({NESTED})
WHERE kind = 'commit' AND operation = 'create' AND {ENGLISH} AND text <> ''"""

MINUTE = "strftime(ts + INTERVAL 19800 SECOND, '%Y-%m-%d %H:%M')"
HOUR = "strftime(date_trunc('hour', ts + INTERVAL 19800 SECOND), '%Y-%m-%d %H:%M')"
HOURLY = f"SELECT {HOUR} AS time, avg({POLARITY}) AS avg_score, count(*) AS count FROM events GROUP BY 1"
MINUTELY = f"""SELECT {MINUTE} AS time, {_r6(f"avg({LEAN} * 0.3)")} AS avg_score, count(*) AS count
FROM documents JOIN events ON doc_id = event_id GROUP BY 1"""
HOURLY_ROUNDED = f"SELECT time, {_r6('avg_score')} AS avg_score, count FROM ({HOURLY})"


def _cutoff(hours: int) -> str:
    seconds = AFTER_LAST_EVENT + 19800 - hours * 3600
    return f"strftime(make_timestamp({seconds}000000), '%Y-%m-%d %H:%M')"


LAST_WEEK = f"SELECT * FROM ({HOURLY}) WHERE time >= {_cutoff(168)}"


def _direction(series: str) -> str:
    return f"""SELECT CASE WHEN d > 0.05 THEN 'rising' WHEN d < -0.05 THEN 'falling' ELSE 'stable' END
AS trend_direction, coalesce(avg_score, 0.0) AS avg_score FROM (
SELECT avg_score, avg_score - lag(avg_score) OVER (ORDER BY time) AS d, time FROM ({series}))
ORDER BY time DESC LIMIT 1"""


GAUGE = "floor((coalesce(avg_score, 0.0) + 1) * 50 + 0.5)::BIGINT"
CHART = f"""SELECT time, strftime(strptime(time, '%Y-%m-%d %H:%M'), '%I:%M %p') AS clock,
{GAUGE} AS score,
CASE WHEN {GAUGE} >= 65 THEN 'positive' WHEN {GAUGE} <= 40 THEN 'negative' ELSE 'neutral' END AS band,
count FROM ({HOURLY})"""

WORDS = f"""SELECT doc_id, label, word FROM (
WITH scored AS MATERIALIZED (SELECT doc_id, {LABEL} AS label, {_words("text")} AS words FROM documents)
SELECT doc_id, label, unnest(words) AS word FROM scored) WHERE {_kept()}"""
COUNTS = f"SELECT word, label, count(*) AS count FROM ({WORDS}) GROUP BY 1, 2"
TOP100 = f"SELECT * FROM ({COUNTS}) ORDER BY count DESC, word, label LIMIT 100"
TOPICS = f"""SELECT word, count, label AS sentiment_association FROM (SELECT *,
row_number() OVER (PARTITION BY word ORDER BY count DESC, label) AS r FROM ({TOP100})) WHERE r = 1"""
SERVED_TOPICS = f"SELECT * FROM ({TOPICS}) ORDER BY count DESC, word LIMIT 20"

PAGE_TEXTS = """SELECT 'd' || doc_id AS id, text FROM documents
UNION ALL SELECT 'p' || page_id, concat_ws(' ', url, html) FROM pages"""

RECENT = f"""SELECT id, source, timestamp, text, {LABEL} AS label,
({LEAN} * 3)::DOUBLE / 10 AS score, created_at
FROM ({POSTS}) ORDER BY timestamp DESC, id LIMIT 50"""
SERVED = f"""SELECT id, text AS title, source AS subreddit, label, score FROM ({RECENT})
ORDER BY timestamp DESC, id LIMIT 20"""

BY_BATCH = ", ".join(
    f"sum({value}) OVER (ORDER BY batch_id)::BIGINT AS {name}"
    for name, value in (("total", "n"), ("positive", "pos"), ("negative", "neg"), ("neutral", "neu"))
)
RUNNING = f"""SELECT batch_id, {BY_BATCH} FROM (SELECT doc_id % {BATCHES} AS batch_id, count(*) AS n,
{", ".join(f"count(*) FILTER ({LABEL} = '{n}') AS {n[:3]}" for n in ("positive", "negative", "neutral"))}
FROM documents GROUP BY 1)"""

WHOLE = ", ".join(
    f"(CASE WHEN total > 0 THEN floor({n}::DOUBLE / total * 100 + 0.5) ELSE 0 END)::BIGINT AS {n}_percent"
    for n in ("positive", "negative", "neutral")
)
CARDS = f"SELECT total, {WHOLE} FROM ({DOC_COUNTS})"

LEXICON = f"""SELECT word, avg(lean) AS polarity, avg(abs(lean)) AS subjectivity FROM (
SELECT quality - toxic AS lean, unnest({_words("text")}) AS word FROM documents JOIN labels USING (doc_id))
WHERE length(word) > 4 GROUP BY 1"""

KINDS = "['negative', 'neutral', 'positive']"


def _outcome(step: int) -> str:
    return f"{KINDS}[((event_id + floor(value) * {step}) % 3 + 1)::INTEGER]"


VOTES = f"""SELECT doc_id, (doc_id % 13 = 0 OR {_blank("text")}) AS blank,
{_outcome(1)} AS bert, value / 503 AS bert_c, {LABEL} AS lstm, 0.5 AS lstm_c,
CASE WHEN event_type <> 'error' THEN {_outcome(2)} END AS rf,
CASE WHEN event_type <> 'error' THEN value / 503 END AS rf_c
FROM documents LEFT JOIN events ON doc_id = event_id"""


def _num(label: str) -> str:
    return f"CASE {label} WHEN 'positive' THEN 1.0 WHEN 'negative' THEN -1.0 ELSE 0.0 END::DOUBLE"


VOTE_SCORE = f"({_num('bert')} * 0.5 + {_num('lstm')} * 0.3 + {_num('rf')} * 0.2)"
VOTE_SURE = "(coalesce(bert_c, 0) * 0.5 + coalesce(lstm_c, 0) * 0.3 + coalesce(rf_c, 0) * 0.2)"



def _analyzed(weights: dict[str, float], longest: int) -> str:
    """The vote of keyword models: stars (bert), keywords (lstm) and a sure stand-in (rf)."""
    sure = {"bert": "CASE lean WHEN 0 THEN 0.63 ELSE 0.9 END", "lstm": "0.5", "rf": "0.7"}
    confidence = " + ".join(f"{sure[model]} * {w}" for model, w in weights.items())
    whole = sum(weights.values())
    return f"""SELECT doc_id, {_preview("text")} AS original_text, {_preview("cleaned")} AS cleaned_text,
        CASE WHEN refused THEN 'neutral' ELSE {_named("lean")} END AS label,
        CASE WHEN refused THEN 0.0 ELSE {_r4(f"({confidence}) / {whole}")} END::DOUBLE AS confidence,
        CASE WHEN refused THEN 0.0 ELSE lean END::DOUBLE AS score,
        CASE WHEN NOT fits THEN 'Text out of bounds' WHEN refused THEN 'Empty text' END AS error,
        CASE WHEN NOT refused THEN '' END AS warnings FROM (
        SELECT *, NOT fits OR {_blank("cleaned")} AS refused, {_lean("cleaned")} AS lean FROM (
        SELECT doc_id, text, {_clean("text")} AS cleaned,
        coalesce(length(text) BETWEEN 1 AND {longest}, false) AS fits FROM documents))"""


TERMS = f"""SELECT doc_id, list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS terms
FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
lambda x: x NOT IN ({STOPS})) AS w FROM documents JOIN labels USING (doc_id))"""

TF = f"SELECT doc_id, word, count(*) AS tf FROM ({WORDS}) GROUP BY 1, 2"


def _run(n: int) -> str:
    joined = " || ' ' || ".join(f"w[i + {k}]" for k in range(n))
    return f"""SELECT {n} AS n, {joined} AS ngram FROM (
SELECT w, unnest(range(1, len(w) - {n} + 2)) AS i FROM kept)"""


_BATCHED = f"SELECT *, id::INTEGER % {BATCHES} AS batch, {LABEL} AS label FROM ({POSTS})"
_WHOLE = f"SELECT v.version, p.* FROM ({_BATCHED}) p JOIN (VALUES ({BATCHES - 2}), (0)) AS v(version) ON p.batch <= v.version"
_WORDS_OF = f"""SELECT * EXCLUDE (word), word FROM (
    SELECT * EXCLUDE (text), unnest({_words("text")}) AS word FROM posts) WHERE {_kept()}"""

SNAPSHOT = f"""WITH posts AS ({_WHOLE}), words AS ({_WORDS_OF})
SELECT 'posts' AS "table", label, count(*)::BIGINT AS n, version::INTEGER AS version FROM posts GROUP BY ALL
UNION ALL SELECT 'trend', '', count(*)::BIGINT, version FROM posts GROUP BY version
UNION ALL SELECT 'words', label, count(*)::BIGINT, version FROM words GROUP BY ALL
UNION ALL SELECT 'cold', '', count(*)::BIGINT, version FROM posts GROUP BY version
UNION ALL SELECT 'latest', '', least(count(*), 50)::BIGINT, version FROM posts GROUP BY version"""

SKETCHED = f"""WITH posts AS (SELECT * FROM ({_BATCHED}) WHERE batch < {BATCHES - 1}), words AS ({_WORDS_OF}),
counts AS (SELECT batch, word, label, count(*) AS n FROM words GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, word, label) AS r FROM counts),
cuts AS (SELECT batch, coalesce(max(n) FILTER (r = {SKETCH + 1}), 0) AS cut FROM ranked GROUP BY 1),
held AS (SELECT word, label, sum(n - cut) AS low FROM ranked JOIN cuts USING (batch)
    WHERE r <= {SKETCH} AND n > cut GROUP BY ALL),
again AS (SELECT *, row_number() OVER (ORDER BY low DESC, word, label) AS r FROM held),
last_cut AS (SELECT coalesce(max(low) FILTER (r = {SKETCH + 1}), 0) AS cut FROM again),
exact AS (SELECT word, label, sum(n)::BIGINT AS exact FROM counts GROUP BY ALL)
SELECT word, label, (low - cut)::BIGINT AS low, (low + (SELECT sum(cut) FROM cuts))::BIGINT AS high,
    (SELECT sum(n) FROM counts)::BIGINT AS total, exact, true AS inside
FROM again JOIN exact USING (word, label), last_cut WHERE r <= {SKETCH} AND low > cut"""

CHANGES = f"""WITH RECURSIVE series AS (SELECT row_number() OVER (ORDER BY time) AS i, time, avg_score FROM ({HOURLY})),
sums AS (SELECT i, time, avg_score, greatest(0, avg_score - 0.02)::DOUBLE AS upper, greatest(0, -avg_score - 0.02)::DOUBLE AS lower,
    0.0::DOUBLE AS before_upper, 0.0::DOUBLE AS before_lower,
    CASE WHEN avg_score <= 0.02 THEN time END AS zero_upper, CASE WHEN avg_score >= -0.02 THEN time END AS zero_lower
    FROM series WHERE i = 1
  UNION ALL SELECT s.i, s.time, s.avg_score, greatest(0, p.upper + s.avg_score - 0.02), greatest(0, p.lower - s.avg_score - 0.02),
    p.upper, p.lower,
    CASE WHEN p.upper + s.avg_score - 0.02 <= 0 THEN s.time ELSE p.zero_upper END,
    CASE WHEN p.lower - s.avg_score - 0.02 <= 0 THEN s.time ELSE p.zero_lower END
    FROM sums p JOIN series s ON s.i = p.i + 1)
SELECT time, {_r6("avg_score")} AS avg_score, {_r6("upper")} AS upper, {_r6("lower")} AS lower,
    CASE WHEN upper > 0.15 AND before_upper <= 0.15 THEN 'up' WHEN lower > 0.15 AND before_lower <= 0.15 THEN 'down' END AS alarm,
    CASE WHEN upper > 0.15 AND before_upper <= 0.15 THEN zero_upper
        WHEN lower > 0.15 AND before_lower <= 0.15 THEN zero_lower END AS since FROM sums"""

_RULES = ", ".join(
    [f"('{w}', 'negation', -0.5)" for w in RULES[0]] + [f"('{w}', 'intensifier', {x})" for w, x in RULES[1].items()])

RULED = f"""WITH rules AS (SELECT * FROM (VALUES {_RULES}) AS v(word, kind, weight)),
listed AS (SELECT word, kind, weight::DOUBLE AS weight FROM rules UNION ALL
    SELECT word, 'word', polarity FROM ({LEXICON}) ANTI JOIN rules USING (word)),
cut AS (SELECT doc_id, {_words("text")} AS words FROM documents),
hits AS (SELECT doc_id, pos, kind, weight FROM (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM cut) JOIN listed USING (word)),
seen AS (SELECT *, lag(pos) OVER w AS p, lag(kind) OVER w AS k, lag(weight) OVER w AS x,
    max(pos) FILTER (kind = 'negation') OVER b AS negation, max(pos) FILTER (kind = 'word') OVER b AS earlier FROM hits
    WINDOW w AS (PARTITION BY doc_id ORDER BY pos),
        b AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
valued AS (SELECT doc_id, negation > coalesce(earlier, 0) AND pos - negation <= 3 AS flip,
    weight * CASE WHEN k = 'intensifier' AND p = pos - 1 THEN x ELSE 1.0 END AS value FROM seen WHERE kind = 'word'),
means AS (SELECT doc_id, count(*)::BIGINT AS hits, count(*) FILTER (flip)::BIGINT AS negated,
    avg(greatest(-1.0, least(1.0, value * CASE WHEN flip THEN -0.5 ELSE 1.0 END))) AS polarity FROM valued GROUP BY 1)
SELECT doc_id, {_r6("coalesce(polarity, 0.0)")} AS polarity, coalesce(hits, 0) AS hits, coalesce(negated, 0) AS negated
FROM documents LEFT JOIN means USING (doc_id)"""

LATE = f"""WITH posts AS ({POSTS}), mark AS (
    SELECT max(timestamp) - {LATE_DELAY} AS w FROM posts WHERE id::BIGINT % 2 = 0)
SELECT id, id::BIGINT % 2 = 1 AND timestamp < w AS late,
    CASE WHEN id::BIGINT % 2 = 1 AND timestamp < w THEN round(w - timestamp, 3) END AS seconds_late FROM posts, mark"""

WINDOWS = rf"""WITH cut AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{tx.SPACES}'), lambda w: w <> '') AS words
    FROM documents),
parts AS (SELECT doc_id, words[i * {WINDOW_STEP} + 1 : i * {WINDOW_STEP} + {WINDOW_WORDS}] AS part FROM (
    SELECT doc_id, words, unnest(range(0, greatest(ceil((len(words) - {WINDOW_WORDS}) / {WINDOW_STEP}), 0)::BIGINT + 1)) AS i
    FROM cut WHERE len(words) > 0)),
scored AS (SELECT doc_id, len(part) AS n, len(list_filter(part, lambda w: contains(w, 'e')))::DOUBLE / len(part) AS score FROM parts),
merged AS (SELECT doc_id, sum(score * n) / sum(n) AS score, min(score) AS lowest, max(score) AS highest, count(*)::BIGINT AS windows
    FROM scored GROUP BY 1)
SELECT doc_id, round(score, 12) + 0.0 AS score, round(lowest, 12) + 0.0 AS lowest, round(highest, 12) + 0.0 AS highest, coalesce(windows, 0) AS windows
FROM documents LEFT JOIN merged USING (doc_id)"""


def _em_round(k: int) -> str:
    """Shares and confusion from the probabilities ``p{k}``, and from them ``p{k + 1}``."""
    return f"""
share{k} AS (SELECT c, (sum(p) + 1) / (sum(sum(p)) OVER () + 3) AS share FROM p{k} GROUP BY c),
cell{k} AS (SELECT j, l, c, coalesce(sum(p), 0) AS s FROM (SELECT DISTINCT j FROM votes) CROSS JOIN kinds AS a(l) CROSS JOIN kinds AS b(c)
    LEFT JOIN votes USING (j, l) LEFT JOIN p{k} USING (doc_id, c) GROUP BY ALL),
conf{k} AS (SELECT j, l, c, (s + 1) / (sum(s) OVER (PARTITION BY j, c) + 3) AS q FROM cell{k}),
log{k} AS (SELECT doc_id, c, ln(any_value(share)) + sum(ln(q)) AS x FROM votes JOIN conf{k} USING (j, l) JOIN share{k} USING (c) GROUP BY ALL),
p{k + 1} AS (SELECT doc_id, c, exp(x) / sum(exp(x)) OVER (PARTITION BY doc_id) AS p FROM log{k})"""


PREDICTED = f"""SELECT event_id AS doc_id, 'bert' AS j, {_outcome(1)} AS l FROM events
    UNION ALL SELECT event_id, 'rf', {_outcome(2)} FROM events WHERE event_type <> 'error'
    UNION ALL SELECT doc_id, 'lstm', {LABEL} FROM documents"""

LABEL_MODEL = f"""WITH kinds AS (SELECT unnest({KINDS}) AS c), raw AS ({PREDICTED}),
votes AS (SELECT DISTINCT doc_id, j, l FROM raw WHERE l IN (SELECT c FROM kinds)),
p0 AS (SELECT doc_id, c, (count(*) FILTER (l = c))::DOUBLE / count(*) AS p FROM votes CROSS JOIN kinds GROUP BY ALL),
{_em_round(0)}, {_em_round(1)}
SELECT doc_id, arg_max(c, p) AS label, {_r6("max(p)")} AS confidence FROM p2 GROUP BY 1"""

ORACLES: dict[str, str] = {
    "ingest_events": NEW_POSTS,
    "quarantine": f"""SELECT count(*) FILTER (operation = 'delete')::BIGINT AS corrupt,
        count(*) FILTER (operation <> 'delete')::BIGINT AS good FROM ({NESTED})""",
    "lang_filter": f"SELECT id FROM ({NESTED}) WHERE {ENGLISH}",
    "sample_hash": f"""SELECT doc_id::VARCHAR AS id, source FROM documents
        WHERE '0' || substr(md5(doc_id::VARCHAR), 1, 8) < '{int(SAMPLE_FRACTION * 2**32):09x}'""",
    "text_bounds": f"""SELECT doc_id, coalesce(length(text) BETWEEN 1 AND {MAX_TEXT}, false) AS in_bounds
        FROM documents""",
    "jsonl_roundtrip": POSTS,
    "cold_history": f"""SELECT strftime(ts, '%Y-%m-%d') AS date, {LABEL} AS label, count(*) AS posts
        FROM documents JOIN events ON doc_id = event_id GROUP BY 1, 2""",
    "batch_dedup": f"SELECT did, id, timestamp FROM ({POSTS})",
    "clean_text": f"SELECT id, {_clean('text')} AS cleaned FROM ({PAGE_TEXTS})",
    "clean_text_strict": f"SELECT id, {_clean('text', strict=True)} AS cleaned FROM ({PAGE_TEXTS})",
    "preview_text": f"SELECT doc_id, {_preview('text')} AS preview FROM documents",
    "word_tokens": f"SELECT doc_id, word, count(*) AS occurrences FROM ({WORDS}) GROUP BY 1, 2",
    "keyword_sentiment": f"""SELECT doc_id, CASE WHEN blank THEN 'neutral' ELSE {_named("lean")} END AS label,
        CASE WHEN blank THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
        CASE WHEN blank THEN 0 ELSE lean * 3 END::DOUBLE / 10 AS polarity,
        CASE WHEN blank THEN 0.0 ELSE 0.5 END::DOUBLE AS subjectivity
        FROM (SELECT doc_id, {_blank("text")} AS blank, {LEAN} AS lean FROM documents)""",
    "polarity_label": f"""SELECT event_id, {_threshold("p", 0.1)} AS label, {_r6("p")} AS score FROM (
        SELECT event_id, CASE WHEN event_type = 'error' OR coalesce(props, '') = '' THEN 0.0
        ELSE {POLARITY} END AS p FROM events)""",
    "polarity_confidence": f"""SELECT event_id, CASE WHEN usable THEN {_threshold("p", 0.1)} ELSE 'neutral' END AS label,
        CASE WHEN usable THEN {_r4("least(abs(p) * s + 0.3, 1.0)")} ELSE 0.0 END::DOUBLE AS confidence,
        CASE WHEN usable THEN {_r4("p")} ELSE 0.0 END::DOUBLE AS polarity,
        CASE WHEN usable THEN {_r4("s")} ELSE 0.0 END::DOUBLE AS subjectivity,
        CASE WHEN blank THEN 'Empty text' WHEN NOT usable THEN 'No polarity' END AS error,
        CASE WHEN usable THEN {_r4("p")} ELSE 0.0 END::DOUBLE AS numeric
        FROM (SELECT *, NOT blank AND p IS NOT NULL AND s IS NOT NULL AS usable FROM (
        SELECT event_id, event_id % 10 = 0 OR {_blank("props")} AS blank,
        CASE WHEN event_type <> 'error' THEN {POLARITY} END AS p,
        CASE WHEN event_type <> 'login' THEN json_extract_string(props, '$.k')::DOUBLE / 100 END AS s FROM events))""",
    "polarity_lexicon": f"""WITH lexicon AS ({LEXICON}),
        found AS (SELECT doc_id, avg(polarity) AS p, avg(subjectivity) AS s FROM (
            SELECT doc_id, unnest({_words("text")}) AS word FROM documents) JOIN lexicon USING (word) GROUP BY 1)
        SELECT doc_id, {_r6("coalesce(p, 0.0)")} AS polarity, {_r6("coalesce(s, 0.0)")} AS subjectivity,
        {_threshold("round(coalesce(p, 0.0), 6)", 0.1)} AS label
        FROM documents LEFT JOIN found USING (doc_id)""",
    "star_sentiment": f"""SELECT event_id,
        CASE WHEN stars IS NULL THEN 'neutral' WHEN stars <= 2 THEN 'negative' WHEN stars = 3 THEN 'neutral'
        ELSE 'positive' END AS label,
        {_r4("coalesce(score * (0.7 + 0.3 * abs(stars - 3) / 2), 0.0)")} AS confidence,
        coalesce(stars, 3)::INTEGER AS raw_stars,
        {_r4("CASE WHEN stars IS NULL THEN 0.0 ELSE score END")} AS raw_score,
        (coalesce(stars, 3) - 3)::DOUBLE / 2 AS numeric FROM (SELECT event_id, value / 503 AS score,
        CASE WHEN event_type <> 'error' THEN event_id % 5 + 1 END AS stars FROM events)""",
    "prob_score": f"""SELECT event_id, {_r4('''CASE WHEN event_type = 'error' THEN 0.33 ELSE value / 503 END
        - (1 - value / 503)''')} AS score FROM events""",
    "ensemble_vote": f"""SELECT doc_id,
        CASE WHEN blank THEN 'neutral' ELSE {_threshold("score", 0.33)} END AS label,
        CASE WHEN blank THEN 0.0 ELSE {_r4("sure")} END::DOUBLE AS confidence,
        CASE WHEN blank THEN 0.0 ELSE {_r4("score")} END::DOUBLE AS score,
        CASE WHEN blank THEN 'Empty text' END AS error,
        CASE WHEN NOT blank THEN concat_ws('; ', CASE WHEN bert IS NULL THEN 'bert: no prediction' END,
            CASE WHEN rf IS NULL THEN 'rf: no prediction' END) END AS warnings
        FROM (SELECT *, {VOTE_SCORE} AS score, {VOTE_SURE} AS sure FROM ({VOTES}))""",
    "ensemble_breakdown": f"""SELECT doc_id, {", ".join(
        f'''CASE WHEN NOT blank THEN coalesce({m}, 'error') END AS {m}_label,
        CASE WHEN NOT blank THEN {_r4(f"coalesce({m}_c, 0.0)")} END::DOUBLE AS {m}_confidence,
        CASE WHEN NOT blank THEN {w} END::DOUBLE AS {m}_weight'''
        for m, w in (("bert", 0.5), ("lstm", 0.3), ("rf", 0.2)))} FROM ({VOTES})""",
    "analyze_posts": _analyzed({"bert": 0.5, "lstm": 0.3, "rf": 0.2}, MAX_TEXT),
    "analyze_default": _analyzed({"lstm": 0.3}, 2**31 - 1),
    "model_scorer": f"""SELECT doc_id, {_named("lean")} AS label,
        CASE WHEN blank THEN 0.0 WHEN lean = 0 THEN 0.63 ELSE 0.9 END::DOUBLE AS confidence,
        CASE WHEN blank THEN 3 ELSE 3 + 2 * lean END::INTEGER AS raw_stars,
        CASE WHEN blank THEN 0.0 ELSE 0.9 END::DOUBLE AS raw_score,
        CASE WHEN blank THEN 'Empty text' END AS error
        FROM (SELECT doc_id, {_blank("text")} AS blank, {LEAN} AS lean FROM documents)""",
    "label_distribution": DOC_COUNTS,
    "label_percent": f"""SELECT *, {", ".join(
        f"{_r6(f'CASE WHEN total > 0 THEN {n}::DOUBLE / total * 100 ELSE 0.0 END')} AS {n}_pct"
        for n in ("positive", "negative", "neutral"))} FROM ({DOC_COUNTS})""",
    "stats_cumulative": RUNNING,
    "stats_latest": f"SELECT * FROM ({RUNNING}) ORDER BY batch_id DESC LIMIT 1",
    "api_stats": DOC_COUNTS,
    "stat_cards": CARDS,
    "dominant_mood": f"""SELECT *, CASE
        WHEN positive_percent > negative_percent AND positive_percent > neutral_percent THEN 'Mostly Positive'
        WHEN negative_percent > positive_percent AND negative_percent > neutral_percent THEN 'Mostly Negative'
        ELSE 'Neutral' END AS mood FROM ({CARDS})""",
    "trend_minute": MINUTELY,
    "trend_hour": HOURLY_ROUNDED,
    "trend_merge": HOURLY_ROUNDED,
    "trends_period": f"SELECT time, {_r6('avg_score')} AS avg_score, count FROM ({LAST_WEEK})",
    "trends_period_fallback": f"""WITH series AS ({HOURLY}), recent AS (SELECT * FROM series WHERE
        {MONTH_LATER} - (epoch(strptime(time, '%Y-%m-%d %H:%M')) - 19800) <= 24 * 3600)
        SELECT time, {_r6("avg_score")} AS avg_score, count FROM (
        SELECT * FROM recent UNION ALL SELECT * FROM series WHERE (SELECT count(*) FROM recent) = 0)""",
    "trend_direction": f"SELECT trend_direction, {_r6('avg_score')} AS avg_score FROM ({_direction(HOURLY)})",
    "chart_series": CHART,
    "chart_trend": f"""SELECT change, CASE WHEN change > 3 THEN 'Rising' WHEN change < -3 THEN 'Falling'
        ELSE 'Stable' END AS trend FROM (
        SELECT coalesce(max_by(score, time) - min_by(score, time), 0) AS change FROM ({CHART}))""",
    "trend_rolling": f"""SELECT time, {_r6("avg_score")} AS avg_score, count, {_r6("m")} AS rolling_avg,
        {_r6("CASE WHEN s > 0 THEN (avg_score - m) / s END")} AS z_score FROM (
        SELECT *, avg(avg_score) OVER w AS m, stddev_samp(avg_score) OVER w AS s FROM (
        SELECT *, (epoch(strptime(time, '%Y-%m-%d %H:%M')) / 3600)::BIGINT AS step FROM ({HOURLY}))
        WINDOW w AS (ORDER BY step RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING))""",
    "trend_summary": f"""SELECT (SELECT trend_direction FROM ({_direction(LAST_WEEK)})) AS trend_direction,
        {_r6("max_by(avg_score, time)")} AS latest_avg, {_r6("min(avg_score)")} AS min_avg,
        {_r6("max(avg_score)")} AS max_avg, count(*)::BIGINT AS buckets, sum(count)::BIGINT AS posts
        FROM ({LAST_WEEK})""",
    "recent_posts": RECENT,
    "recent_posts_distinct": RECENT,
    "latest_posts": SERVED,
    "post_feed": f"""SELECT id, coalesce(nullif(subreddit, 'src1'), 'bluesky') AS source,
        coalesce(label, 'neutral') AS label,
        CASE WHEN id::BIGINT % 3 = 0 THEN 'No content' ELSE title END AS content FROM ({SERVED})""",
    "topic_counts": COUNTS,
    "topic_counts_cleaned": f"""WITH scored AS MATERIALIZED (
        SELECT {LABEL} AS label, {_words(_clean("text"))} AS words FROM ({PAGE_TEXTS}))
        SELECT word, label, count(*) AS count FROM (SELECT label, unnest(words) AS word FROM scored)
        WHERE {_kept()} GROUP BY 1, 2""",
    "topics_top100": TOP100,
    "topics_dedup": TOPICS,
    "api_topics": SERVED_TOPICS,
    "topic_bars": f"""SELECT word, count, sentiment_association,
        floor(count::DOUBLE / greatest(max(count) OVER (), 1) * 100 + 0.5)::BIGINT AS width
        FROM (SELECT * FROM ({SERVED_TOPICS}) ORDER BY count DESC, word LIMIT 12)""",
    "word_cloud": f"""SELECT word, count, {_r6("count::DOUBLE / max(count) OVER ()")} AS weight FROM (
        SELECT word, count(*) AS count FROM ({WORDS}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)""",
    "ngram_counts": f"""WITH kept AS (SELECT list_filter({_words("text")},
        lambda x: length(x) > 4 AND x NOT IN ({STOPS})) AS w FROM documents)
        SELECT n, ngram, count(*) AS count FROM ({" UNION ALL ".join(_run(n) for n in (1, 2, 3))}) GROUP BY 1, 2""",
    "tfidf_keywords": f"""WITH tf AS ({TF}), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
        ranked AS (SELECT doc_id, word, tf, df, {_r6(
            "tf * ln(((SELECT count(*) FROM documents) + 1) / (df + 1))")} AS tfidf FROM tf JOIN df USING (word))
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tfidf DESC, word)::INTEGER AS rank
        FROM ranked) WHERE rank <= 5""",
    "stream_ingest": NEW_POSTS,
    "stream_totals": DOC_COUNTS,
    "stream_trend": MINUTELY,
    "stream_windows": MINUTELY,
    "stream_quarantine": """SELECT * FROM (VALUES ('corrupt', 2), ('no id', 2), ('no time', 1)) AS v(reason, lines)
        UNION ALL SELECT 'kept', count(*) FROM documents JOIN events ON doc_id = event_id""",
    "stream_lexicon_totals": f"""WITH lexicon AS ({LEXICON}), found AS (SELECT doc_id, avg(polarity) AS p FROM (
            SELECT doc_id, unnest({_words("text")}) AS word FROM documents) JOIN lexicon USING (word) GROUP BY 1)
        SELECT count(*)::BIGINT AS total, {", ".join(
            f"count(*) FILTER (label = '{n}')::BIGINT AS {n}" for n in ("positive", "negative", "neutral"))}
        FROM (SELECT {_threshold("round(coalesce(p, 0.0), 6)", 0.1)} AS label
        FROM documents JOIN events ON doc_id = event_id LEFT JOIN found USING (doc_id))""",
    "served_posts": SERVED,
    "served_topics": SERVED_TOPICS,
    "served_stats": f"""SELECT total AS total_count, {", ".join(
        f"{_r6(f'CASE WHEN total > 0 THEN {n}::DOUBLE / total * 100 ELSE 0.0 END')} AS {n}_pct"
        for n in ("positive", "negative", "neutral"))}, true AS stamped FROM ({DOC_COUNTS})""",
    "served_trends": f"SELECT * FROM ({MINUTELY}) WHERE time >= {_cutoff(168)}",
    "served_summary": f"""WITH week AS (SELECT * FROM ({MINUTELY}) WHERE time >= {_cutoff(168)})
        SELECT coalesce((SELECT trend_direction FROM ({_direction("SELECT * FROM week")})), 'stable') AS trend_direction,
        coalesce(max_by(avg_score, time), 0.0) AS latest_avg, min(avg_score) AS min_avg, max(avg_score) AS max_avg,
        count(*)::BIGINT AS buckets, coalesce(sum(count), 0)::BIGINT AS posts FROM week""",
    "stream_dedup": f"SELECT did, id, source FROM ({POSTS})",
    "stream_dedup_run": f"SELECT DISTINCT did, id, source, text FROM ({POSTS})",
    "snapshot_state": SNAPSHOT,
    "trend_changes": CHANGES,
    "polarity_rules": RULED,
    "stream_late": LATE,
    "stream_keyed_state": f"""SELECT source, count(*)::BIGINT AS total, {", ".join(
        f"count(*) FILTER (label = '{n}')::BIGINT AS {n}" for n in ("positive", "negative", "neutral"))},
        {_r6("sum(lean * 0.3)::DOUBLE")} AS sum_score,
        array_to_string(list(id ORDER BY timestamp DESC, id DESC)[1:{KEPT_POSTS}], ',') AS newest
        FROM (SELECT coalesce(source, '') AS source, id, timestamp, {LEAN} AS lean, {LABEL} AS label FROM ({POSTS})) GROUP BY 1""",
    "model_windows": WINDOWS,
    "label_model": LABEL_MODEL,
    "topic_sketch": SKETCHED,
    "empty_batches": f"SELECT 1::BIGINT AS batch, total AS posts, * FROM ({DOC_COUNTS})",
    "rf_reload": "SELECT doc_id, true AS same FROM documents",
    "hot_sql": f"SELECT * FROM ({MINUTELY}) WHERE count >= 2",
    "weak_labels": f"SELECT doc_id, {LABEL} AS label FROM documents",
    "labelled_texts": """SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
        ELSE 'neutral' END AS label, length(text) AS n_chars FROM documents JOIN labels USING (doc_id)""",
    "tfidf_features": f"""SELECT term, count(*) AS df,
        {_r6("ln(((SELECT count(*) FROM documents JOIN labels USING (doc_id)) + 1) / (count(*) + 1))")} AS idf
        FROM (SELECT doc_id, unnest(list_distinct(terms)) AS term FROM ({TERMS})) GROUP BY 1 HAVING count(*) >= 2""",
    "rf_train_metrics": f"""SELECT (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS samples,
        least(count(*), 5000)::BIGINT AS features, true AS beats_commonest FROM (
        SELECT term FROM (SELECT doc_id, unnest(list_distinct(terms)) AS term FROM ({TERMS}))
        GROUP BY 1 HAVING count(*) >= 2)""",
    "rf_predict": """SELECT doc_id, true AS label_known, true AS adds_up, true AS surest, true AS score_in_range,
        CASE WHEN doc_id % 13 = 0 THEN 'Empty text' END AS error,
        CASE WHEN doc_id % 13 = 0 THEN 'neutral' END AS blank_label FROM documents""",
    "lda_topics": """SELECT topic::INTEGER AS topic, 10::BIGINT AS terms, 10::BIGINT AS known, true AS ordered
        FROM range(5) AS t(topic)""",
}
