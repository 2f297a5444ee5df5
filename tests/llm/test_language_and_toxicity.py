"""Learned operators: exact code lengths and marginals by brute force, accuracy on held-out rows."""

import math
from itertools import product

import numpy as np
import pandas as pd
import pytest

from moodstream.llm import language_id, toxicity
from moodstream.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def _trees(texts):
    rows = {}
    for lang, text in texts:
        data = language_id.PAD + language_id.plain(text)
        for i in range(3, len(data)):
            gram = int.from_bytes(data[i - 3 : i + 1], "big")
            rows[lang, gram] = rows.get((lang, gram), 0) + 1
    counts = pd.DataFrame([(lang, gram, n) for (lang, gram), n in rows.items()], columns=["lang", "gram", "n"])
    return language_id.ContextTrees(counts), rows


def _brute_bits(rows, lang, text):
    """Code length by walking from the longest context down, straight from the counts."""
    counts = {}
    for (own, gram), n in rows.items():
        if own == lang:
            data = gram.to_bytes(4, "big")
            for depth in range(4):
                context, byte = data[3 - depth : 3], data[3]
                counts.setdefault(context, {}).setdefault(byte, 0)
                counts[context][byte] += n
    data, bits = language_id.PAD + language_id.plain(text), 0.0
    for i in range(3, len(data)):
        for depth in (3, 2, 1, 0):
            seen = counts.get(data[i - depth : i])
            if not seen:
                continue
            total, kinds = sum(seen.values()), len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


@pytest.mark.parametrize("dense", [True, False])
@pytest.mark.parametrize("window", [7, 1 << 19])
def test_code_lengths_equal_a_walk_through_the_contexts(monkeypatch, dense, window):
    monkeypatch.setattr(language_id, "WINDOW", window)
    monkeypatch.setattr(language_id, "DENSE_PAIRS", 6000 if dense else 0)
    trees, rows = _trees([("en", "the cat sat on the mat and that was it"), ("fr", "le chat était là, où est-il donc")])
    texts = ["the hat", "où là", "", "zzz qqq", "thé", "a", "the cat sat on the mat and the dog came to the house"]
    got = trees.text_lengths([language_id.plain(t) for t in texts])
    for row, text in zip(got, texts):
        for k, lang in enumerate(trees.langs):
            assert row[k] == pytest.approx(_brute_bits(rows, lang, text), rel=1e-5, abs=1e-4)


def test_languages_of_odd_rows(spark):
    rows = [(1, "the cat sat on the mat", "en", "x"), (2, "le chat est sur la table", "fr", "y"),
            (None, "the mat", "en", None), (5, None, "en", None), (6, "", None, None), (7, "1234 !!", "fr", None),
            (8, "the cat " * 20000, None, None), (2, "le chat est sur la table", "fr", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    trees = language_id.fit(docs)
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in language_id.identify(docs, trees).collect()}
    assert got[1, rows[0][1]][0] == "en" and got[2, rows[1][1]][0] == "fr" and got[8, rows[6][1]][0] == "en"
    assert got[5, None] == got[6, ""] == got[7, "1234 !!"] == ("und", 0.0)
    assert all(0 <= score <= 1 for _, score in got.values())
    nothing = language_id.fit(docs.where("lang = 'xx'"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.limit(0), trees).count() == 0


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    got = QUERIES["op1_language_ppm"](spark, FOLDER).join(docs, "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98


def test_marginals_equal_sums_over_all_taggings():
    model = toxicity.ToxicSpans()
    model.moves = np.array([[0.3, -1.0], [-0.5, 0.8]])
    emissions = np.array([[0.5, -1.0, 2.0, 0.1], [1.5, 0.2, 0.0, 0.0]])
    filled = np.array([[True] * 4, [True, True, False, False]])
    got, pairs = model.marginals(emissions, filled, moves=True)
    expected_pairs = np.zeros((2, 2))
    for row in range(2):
        n = filled[row].sum()
        total, ones, moves = 0.0, np.zeros(n), np.zeros((2, 2))
        for tags in product((0, 1), repeat=int(n)):
            weight = math.exp(sum(emissions[row, k] for k in range(n) if tags[k])
                              + sum(model.moves[a, b] for a, b in zip(tags, tags[1:])))
            total += weight
            ones += weight * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                moves[a, b] += weight
        assert np.allclose(got[row, :n], ones / total)
        expected_pairs += moves / total
    assert np.allclose(pairs, expected_pairs) and not got[~filled].any()


def test_toxicity_of_odd_rows(spark):
    bad, good = "what a lovely day it is here said the fool", "what a lovely day it is here said the man"
    rows = [(i, bad if i % 2 else good + " friend" * i) for i in range(60)]
    rows += [(None, bad), (100, None), (101, ""), (102, "123 ..."), (103, "İ fool İ"), (104, good + " fine" * 30000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = {(r.doc_id, r.text): r for r in toxicity.tag(docs, model).collect()}
    assert got[1, bad].score > 0.7 > 0.3 > got[0, good].score
    assert [bad[s.start : s.start + s.length] for s in got[None, bad].spans][-1] == "fool"
    assert got[100, None].spans == [] and got[100, None].score == got[101, ""].score < 0.5
    assert got[104, rows[-1][1]].score < 0.5
    assert toxicity.tag(docs.limit(0), model).count() == 0
    untaught = toxicity.fit(docs, labels.where("toxic = 1"))
    assert toxicity.tag(docs, untaught).where("score >= 0.7").count() == 0


def test_sample_is_bounded_where_ids_repeat(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity.ToxicSpans, "fit", lambda self, texts, toxic, prior: seen.append(list(toxic)) or self)
    rows = [(i, f"text {i} {copy}") for i in range(40) for copy in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    toxicity.fit(docs, labels, rows=15)
    assert [sum(seen[0]), len(seen[0])] == [15, 30]


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = QUERIES["op8_toxic_spans"](spark, FOLDER).join(labels, "doc_id").where("held_out").toPandas()
    hits = ((got.predicted == 1) & (got.toxic == 1)).sum()
    # some labels mark texts without any toxic word
    assert hits >= 0.7 * got.toxic.sum() and hits >= 0.95 * got.predicted.sum()
    assert got.score.between(0, 1).all()


def test_a_rare_language_keeps_its_tree(spark):
    """The bound on nodes is shared out by language, not taken by the frequent ones."""
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    many = [(i, lang, " ".join(rng.choice(words, 40))) for i in range(60) for lang in ("aa", "bb")]
    rows = many + [(1000, "zz", "qu xyqu wyx quw")]
    labelled = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    trees = language_id.fit(labelled, nodes=300)
    assert "zz" in trees.langs
    asked = spark.createDataFrame([(1, "quw xyqu"), (2, words[0] + " " + words[1])], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in language_id.identify(asked, trees).collect()}
    assert got[1] == "zz" and got[2] in ("aa", "bb")


@pytest.mark.parametrize("sizes, total, bound", [([], 9, 0), ([3, 5], 9, 5), ([1, 10, 10], 9, 4), ([10, 10], 7, 3)])
def test_common_bound(sizes, total, bound):
    assert language_id._common_bound(sizes, total) == bound
    assert sum(min(s, bound) for s in sizes) <= total
