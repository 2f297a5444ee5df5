import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from moodstream.operators import explore, learn, models, topic_model
from moodstream.plans.analyze import analyze

SMALL = learn.ForestSettings(trees=5, depth=4)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [f"good happy sunshine holiday number {i % 4}" for i in range(12)]
    rows += [f"terrible awful rainstorm delay number {i % 4}" for i in range(12)]
    rows += [f"plain ordinary notice board number {i % 4}" for i in range(12)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "id int, text string")


@pytest.fixture(scope="module")
def model(texts):
    return learn.bootstrap_train(texts, SMALL)


def test_forest_learns_weak_labels(spark, texts, model):
    labelled = learn.weak_labels(texts)
    metrics = learn.training_metrics(model, labelled).first()
    assert metrics.samples == 36 and metrics.training_accuracy == 1.0 and metrics.features > 10


def test_prediction_shape_and_blank_text(spark, model):
    frame = spark.createDataFrame([(1, "good happy sunshine holiday number 2", "own"), (2, " ", "own"), (3, None, "own")],
                                  "id int, text string, label string")
    got = {r.id: r for r in learn.probability_scores(learn.predict(model, frame)).collect()}
    assert got[1].rf.label == "positive" and got[1].label == "own"
    assert set(got[1].rf.probabilities) == {"negative", "neutral", "positive"}
    assert sum(got[1].rf.probabilities.values()) == pytest.approx(1.0, abs=1e-3)
    assert got[1].score == pytest.approx(got[1].rf.probabilities["positive"] - got[1].rf.probabilities["negative"])
    for blank in (2, 3):
        assert (got[blank].rf.label, got[blank].rf.confidence, got[blank].rf.error) == ("neutral", 0.0, "Empty text")
        assert got[blank].rf.probabilities == {"negative": 0.33, "neutral": 0.34, "positive": 0.33}
    assert got[3].text is None


def test_saved_model_predicts_the_same(spark, texts, model, tmp_path):
    learn.save(model, str(tmp_path / "forest"))
    again = learn.load(str(tmp_path / "forest"))
    mine = learn.predict(model, texts).select("id", "rf.label", "rf.confidence")
    assert mine.exceptAll(learn.predict(again, texts).select("id", "rf.label", "rf.confidence")).isEmpty()


def test_forest_joins_the_vote(spark, texts, model):
    ready = learn.predict(model, texts)
    got = analyze(ready, weights={"rf": 0.5, "lstm": 0.5}).select("id", "label", "warnings").orderBy("id").collect()
    assert got[0].label == "positive" and got[12].label == "negative" and got[30].label == "neutral"
    assert got[0].warnings == []


def test_model_hook_isolates_failures(spark):
    def make():
        def rate(texts):
            if any("boom" in t for t in texts):
                raise ValueError("no rating")
            return [("5 stars", 0.8) for _ in texts]

        return rate

    rows = [(i, "boom" if i == 5 else None if i == 6 else " " if i == 7 else "fine") for i in range(20)]
    frame = spark.createDataFrame(rows, "id int, text string").coalesce(1)
    got = {r.id: r.bert for r in models.score_with_model(frame, make, batch_size=8).collect()}
    assert (got[5].label, got[5].confidence, got[5].error) == ("neutral", 0.0, "no rating")
    assert got[6].error == got[7].error == "Empty text"
    rest = [got[i] for i in range(20) if i not in (5, 6, 7)]
    assert {(r.label, r.confidence, r.error) for r in rest} == {("positive", 0.8, None)}


def test_topic_model_lists_terms(spark, texts):
    got = explore.lda_topics(texts, topics=2, terms=3, iterations=5).collect()
    assert len(got) == 6 and {r["rank"] for r in got} == {1, 2, 3}


def test_keywords_against_plain_python(spark):
    import math
    from collections import Counter

    rows = [("a", "planets planets galaxies"), ("b", "planets rising"), ("c", "rising rising rising moons")]
    frame = spark.createDataFrame(rows, "id string, text string")
    words = {i: Counter(w for w in t.split() if len(w) > 4) for i, t in rows}
    df = Counter(w for c in words.values() for w in c)
    want = {
        (i, w, round(n * math.log(4 / (df[w] + 1)), 6)) for i, c in words.items() for w, n in c.items()
    }
    got = {(r.id, r.word, r.tfidf) for r in explore.tfidf_keywords(frame, 9).collect()}
    assert got == want


def test_every_text_comes_back(spark):
    rows = [(1, "x" * 5001), (2, "good great happy"), (3, ""), (4, None), (5, "  "), (6, "terrible")]
    frame = spark.createDataFrame(rows, "id int, text string")
    got = {r.id: (r.label, r.error) for r in analyze(frame).collect()}
    assert got == {
        1: ("neutral", "Text out of bounds"), 2: ("positive", None), 3: ("neutral", "Text out of bounds"),
        4: ("neutral", "Text out of bounds"), 5: ("neutral", "Empty text"), 6: ("negative", None)}
    unbounded = {r.id: r.error for r in analyze(frame, longest=None).collect()}
    assert unbounded[1] is None and unbounded[3] == "Text out of bounds"
    given = analyze(frame, weights={"bert": 0.5, "lstm": 0.3, "rf": 0.2}).where("id = 2").first()
    assert given.label == "neutral" and len(given.warnings) == 2  # silent models keep a stated weight
    with pytest.raises(ValueError):
        analyze(frame, {})


def test_forest_is_bootstrapped_when_there_is_none(spark):
    rows = [(i, ["good great day", "terrible awful day", "plain day"][i % 3]) for i in range(30)]
    frame = spark.createDataFrame(rows, "id int, text string")
    got = {r.text: r.rf.label for r in learn.predict_or_bootstrap(frame).collect()}
    assert got == {"good great day": "positive", "terrible awful day": "negative", "plain day": "neutral"}


def test_model_giving_too_few_ratings_spoils_no_row(spark):
    def load():
        return lambda texts: [("5 stars", 0.9)] * (1 if len(texts) == 1 else len(texts) - 1)

    frame = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "id int, text string")
    assert {r.bert.label for r in models.score_with_model(frame, load).collect()} == {"positive"}


def test_term_weights_need_no_vocabulary(texts, monkeypatch):
    def fail(*_):
        raise AssertionError("a vocabulary is fitted")

    monkeypatch.setattr(learn.CountVectorizer, "_fit", fail)
    got = {r.term: (r.df, round(r.idf, 9)) for r in learn.term_weights(texts, stop=["number"]).collect()}
    assert got["sunshine holiday"] == got["good"] == (12, round(math.log(37 / 13), 9))
    assert not any("number" in term for term in got) and len(got) == 21


def test_topic_vocabulary_is_counted(texts, monkeypatch):
    sizes = []

    class Counter(explore.CountVectorizer):
        def __init__(self, **options):
            sizes.append(options["vocabSize"])
            super().__init__(**options)

    monkeypatch.setattr(explore, "CountVectorizer", Counter)
    assert explore.lda_topics(texts, topics=2, terms=3, iterations=2).count() == 6
    words = texts.select(F.explode(F.array_distinct(explore.topic_tokens("text", explore.stop_words()))).alias("w"))
    assert sizes == [words.groupBy("w").count().where("count >= 2").count()]


@pytest.mark.parametrize("common", [1, 2, 200])
def test_keyword_rows_do_not_grow_with_the_partitions(spark, monkeypatch, common):
    monkeypatch.setattr(explore, "COMMON", common, raising=False)
    rows = [(i % 9, f"{'planets ' * (i % 3 + 1)}{'galaxies ' * (i % 2)}single{'abcdefghij'[i]}") for i in range(10)]
    rows += [(None, "planets nobodys"), (20, None)]
    posts = spark.createDataFrame(rows, "id int, text string")
    found = explore.tfidf_keywords(posts, 9)
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no frequency is repeated
    got = {(r.id, r.word, r.tf, r.df, r.tfidf) for r in found.collect()}
    df = {w: sum(w in (t or "").split() for _, t in rows) for _, text in rows for w in (text or "").split()}
    want = {(i, w, t.split().count(w), df[w], round(t.split().count(w) * math.log(13 / (df[w] + 1)), 6))
            for i, t in rows if t for w in t.split()}
    assert got == want
    ranks = [r["rank"] for r in found.where("id = 0").orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 2


def test_node_statistics_leave_room_for_the_other_tasks(texts, monkeypatch):
    asked, forest = [], learn.RandomForestClassifier
    monkeypatch.setattr(learn, "RandomForestClassifier", lambda **options: asked.append(options) or forest(**options))
    learn.bootstrap_train(texts, SMALL)
    assert asked[0]["maxMemoryInMB"] <= 256  # four tasks of an executor hold a gigabyte at most


def test_topic_weights_stay_off_the_driver(spark, monkeypatch):
    import pyspark.ml.clustering
    from pyspark.sql.classic.dataframe import DataFrame

    def fail(*_):
        raise AssertionError("the weights of all words meet on the driver")

    monkeypatch.setattr(pyspark.ml.clustering.LDA, "_fit", fail)
    collected, collect = [], DataFrame.collect

    def counted(frame):
        rows = collect(frame)
        collected.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    names = ["planet" + "".join(chr(97 + int(d)) for d in f"{i:03d}") for i in range(400)]
    rows = [(" ".join((names + names)[i * 10 : i * 10 + 20]),) for i in range(40)] + [("",)]
    posts = spark.createDataFrame(rows, "text string")
    assert len(explore.lda_topics(posts, topics=2, terms=3, iterations=2).collect()) == 6
    assert 3 <= len(collected) and max(collected) <= 6


@pytest.mark.parametrize("block", [5, 1 << 18])
def test_topic_fit_against_plain_python(spark, monkeypatch, block):
    monkeypatch.setattr(topic_model, "BLOCK", block)
    posts = [([0, 1], [2.0, 1.0]), ([1, 2, 3], [1.0, 1.0, 4.0]), ([], []), ([4], [3.0]), ([0, 1], [2.0, 1.0])] * 3 + [([3], [900.0])]
    names, topics, words, steps = ["t0", "t1", "t2"], 3, 6, 4  # no post holds the last word

    def digamma(x, h=1e-4):
        return (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)

    def trigamma(x, h=1e-3):
        return (math.lgamma(x + h) - 2 * math.lgamma(x) + math.lgamma(x - h)) / h**2

    first = topic_model._first_weights(spark.range(words), names, 7).collect()
    weights = {row.word: [row[c] for c in names] for row in first}
    alpha, span = [1 / topics] * topics, range(topics)
    for step in range(1, steps + 1):
        rate = (1024 + step) ** -0.51
        spread = [digamma(sum(w[t] for w in weights.values())) for t in span]
        beta = {i: [math.exp(digamma(w[t]) - spread[t]) for t in span] for i, w in weights.items()}
        added, logs = {i: [0.0] * topics for i in weights}, [0.0] * topics
        for ids, n in posts:
            gamma, moved = [*topic_model._draws(7, -step, topics)], 1.0
            while ids:
                own = [digamma(g) - digamma(sum(gamma)) for g in gamma]
                theta = [math.exp(x) for x in own]
                share = [m / sum(theta[t] * beta[i][t] for t in span) for i, m in zip(ids, n)]
                if moved <= 1e-3:
                    break
                new = [alpha[t] + theta[t] * sum(s * beta[i][t] for i, s in zip(ids, share)) for t in span]
                gamma, moved = new, sum(abs(a - b) for a, b in zip(new, gamma)) / topics
            for t in span if ids else ():
                logs[t] += own[t]
                for i, s in zip(ids, share):
                    added[i][t] += theta[t] * s * beta[i][t]
        weights = {i: [(1 - rate) * w[t] + rate * (added[i][t] + 1 / topics) for t in span] for i, w in weights.items()}
        held = sum(1 for ids, _ in posts if ids)
        slope = [held * (digamma(sum(alpha)) - digamma(a) + x / held) for a, x in zip(alpha, logs)]
        own = [-held * trigamma(a) for a in alpha]
        shared = sum(x / q for x, q in zip(slope, own)) / (1 / (held * trigamma(sum(alpha))) + sum(1 / q for q in own))
        moved = [a - rate * (x - shared) / q for a, x, q in zip(alpha, slope, own)]
        alpha = moved if min(moved) > 0 else alpha
    total = [sum(w[t] for w in weights.values()) for t in span]
    counts = spark.createDataFrame(posts, "words array<int>, n array<double>")
    got = topic_model.fit_topics(counts, words, topics, steps, 7).collect()
    assert len(got) == words * topics
    for row in got:
        assert row.weight == pytest.approx(weights[row.word][row.topic] / total[row.topic], rel=1e-4)


def _plain_pass(beta, at, n, lengths, alpha, gamma):
    found = []
    for own, m, mixture in zip(np.split(at, cuts := np.cumsum(lengths)[:-1]), np.split(n, cuts), gamma, strict=True):
        theta = np.exp(topic_model._expected_logs(mixture[:, None])[:, 0])
        found.append(alpha + theta * (beta[:, own] @ (m / (theta @ beta[:, own]))))
    return np.array(found)


def test_mixtures_of_alike_topics_need_few_passes(monkeypatch):
    draw = np.random.default_rng(3)
    lengths = np.array([40, 3, 400, 150, 1, 90])
    at, n = draw.integers(0, 500, lengths.sum()), draw.integers(1, 3, lengths.sum()).astype(float)
    beta, alpha, first = draw.gamma(100, 1 / 100, (4, 500)), np.full(4, 0.1), draw.gamma(100, 1 / 100, 4)
    calls, logs = [], topic_model._expected_logs
    monkeypatch.setattr(topic_model, "_expected_logs", lambda gamma: calls.append(1) or logs(gamma))
    found = topic_model._mixtures(beta, at, n, lengths, alpha, first)
    passes = len(calls)
    plain, most = np.repeat(first[None], len(lengths), axis=0), 0
    still = np.zeros(len(lengths), bool)
    while not still.all():
        moved = _plain_pass(beta, at, n, lengths, alpha, plain)
        still |= np.abs(moved - plain).mean(axis=1) <= topic_model.STILL
        plain, most = moved, most + 1
    assert most > 500 > 2 * passes  # passes alone creep
    again = _plain_pass(beta, at, n, lengths, alpha, found)
    assert (np.abs(again - found).mean(axis=1) <= 2 * topic_model.STILL).all()
    assert (found > 0).all() and found.sum(axis=1) == pytest.approx(0.4 + np.add.reduceat(n, np.cumsum(lengths) - lengths))


def test_topic_fit_is_the_same_in_parts(spark, monkeypatch):
    posts = [([0, 1], [2.0, 1.0]), ([1, 2, 3], [1.0, 1.0, 4.0]), ([6, 8], [3.0, 1.0]), ([5], [2.0])] * 4 + [([], [])]
    counts = spark.createDataFrame(posts, "words array<int>, n array<double>")

    def fitted(block, part):
        monkeypatch.setattr(topic_model, "BLOCK", block)
        monkeypatch.setattr(topic_model, "PART", part, raising=False)
        return {(r.word, r.topic): r.weight for r in topic_model.fit_topics(counts, 9, 2, 3, 5).collect()}

    whole = fitted(1 << 18, 1 << 14)
    assert len(whole) == 18 and fitted(6, 2) == pytest.approx(whole)


def test_words_of_posts_are_cut_once_for_the_topics(texts, monkeypatch):
    labels, write = [], explore.written
    monkeypatch.setattr(explore, "written", lambda frame, label: labels.append(label) or write(frame, label))
    read = []

    class Counter(explore.CountVectorizer):
        def fit(self, words):
            read.append(words._jdf.queryExecution().optimizedPlan().toString())
            return super().fit(words)

    monkeypatch.setattr(explore, "CountVectorizer", Counter)
    assert explore.lda_topics(texts, topics=2, terms=3, iterations=1).count() == 6
    assert labels[0] == "words" and "split(" not in read[0]


def test_texts_are_cut_once_for_the_forest(texts, monkeypatch):
    read = []

    class Weights(learn.IDF):
        def fit(self, counted):
            read.append((counted.columns, counted.count()))
            return super().fit(counted)

    monkeypatch.setattr(learn, "IDF", Weights)
    model = learn.bootstrap_train(texts, SMALL)
    assert read == [(["_counts", "label"], 36)]
    kinds = [type(stage).__name__.removesuffix("Model") for stage in model.stages]
    assert kinds[4:] == ["CountVectorizer", "IDF", "Normalizer", "StringIndexer", "RandomForestClassification"]


def test_forest_queries_use_all_cores(spark, tmp_path, monkeypatch):
    from moodstream.plans.table_queries import QUERIES

    rows = [(i if i % 10 else 7, f"{['good great', 'awful bad', 'plain'][i % 3]} day number {i % 5}") for i in range(30)] + [(None, "lost")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    marks = [(i, int(i % 3 == 0), int(i % 3 == 1)) for i in range(20)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    sizes, train, predict = [], learn.train, learn.predict

    def spread(rows, *_):
        sizes.append([part for part in rows.rdd.glom().map(len).collect() if part])

    monkeypatch.setattr(learn, "train", lambda rows, **options: spread(rows) or train(rows, SMALL, **options))
    monkeypatch.setattr(learn, "predict", lambda model, texts, *a, **k: spread(texts) or predict(model, texts, *a, **k))
    got = QUERIES["rf_reload"](spark, str(tmp_path)).collect()
    ids = [i for i, _ in rows if i is not None]
    assert sorted(r.doc_id for r in got) == sorted(i for i in ids for _ in range(ids.count(i)))
    assert all(r.same for r in got if r.doc_id != 7) and {r.same for r in got} == {True, False}
    assert len(sizes) == 3 and all(len(parts) >= 4 for parts in sizes)
