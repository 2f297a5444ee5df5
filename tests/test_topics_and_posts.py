from collections import Counter

from moodstream.operators import explore, lexicon, posts, topics

TEXTS = [
    ("1", "Planets planets MOON about! don't-stop", "positive"),
    ("2", "planets rising 2024 within galaxies", "negative"),
    ("3", "galaxies galaxies rising", "negative"),
    ("4", None, "neutral"),
]


def scored(spark):
    rows = [(i, t, (label, 0.0)) for i, t, label in TEXTS]
    return spark.createDataFrame(rows, "id string, text string, sentiment struct<label:string,score:double>")


def test_topic_counts(spark):
    got = {(r.word, r.label): r["count"] for r in topics.topic_counts(scored(spark)).collect()}
    assert got == {
        ("planets", "positive"): 2, ("dontstop", "positive"): 1, ("planets", "negative"): 1,
        ("rising", "negative"): 2, ("galaxies", "negative"): 3,
    }


def test_ties_are_ordered_and_one_label_stays(spark):
    counts = spark.createDataFrame(
        [("bbbbb", "positive", 2), ("aaaaa", "positive", 2), ("aaaaa", "negative", 2), ("ccccc", "neutral", 1)],
        "word string, label string, count long",
    )
    top = topics.top_topics(counts, 3)
    assert [(r.word, r.label) for r in top.collect()] == [
        ("aaaaa", "negative"), ("aaaaa", "positive"), ("bbbbb", "positive")]
    stored = topics.one_label_per_word(top)
    assert {(r.word, r.sentiment_association) for r in stored.collect()} == {
        ("aaaaa", "negative"), ("bbbbb", "positive")}
    assert [r.width for r in topics.topic_bars(topics.served_topics(stored)).collect()] == [100, 100]


def test_shuffled_word_list_gives_the_same_words_as_a_broadcast_one(spark):
    stops = spark.createDataFrame([("planets",), ("rising",)], "word string")

    def found():
        return Counter(r.word for r in topics.word_rows(scored(spark), stops=stops).collect())

    broadcast = found()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert found() == broadcast and "planets" not in broadcast
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_stop_list_passed_in_is_applied_to_the_counts(spark):
    stops = spark.createDataFrame([("planets",), ("rising",)], "word string")
    counts = topics.topic_counts(scored(spark), stops=stops)
    assert {r.word for r in counts.collect()} == {"about", "dontstop", "within", "galaxies"}


def test_lexicon_average(spark):
    words = spark.createDataFrame(
        [("planets", 0.5, 1.0), ("galaxies", -1.0, 0.5)], "word string, polarity double, subjectivity double"
    )
    got = {r.id: (r.polarity, r.subjectivity) for r in lexicon.with_lexicon_scores(scored(spark), words).collect()}
    assert got == {"1": (0.5, 1.0), "2": (-0.25, 0.75), "3": (-1.0, 0.5), "4": (0.0, 0.0)}


def test_ngrams_do_not_cross_posts(spark):
    got = {r.ngram: r["count"] for r in explore.ngram_counts(scored(spark)).where("n = 2").collect()}
    assert got == {"planets planets": 1, "planets dontstop": 1, "planets rising": 1, "rising galaxies": 1,
                   "galaxies galaxies": 1, "galaxies rising": 1}


def test_latest_with_details_equals_the_plain_top(spark):
    rows = [(str(i), float(i % 17), f"text {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "id string, timestamp double, text string")
    plain = [r.id for r in posts.latest(frame, 10).collect()]
    late = posts.latest_with_details(frame.select("id", "timestamp"), frame.select("id", "text"), 10)
    assert sorted(plain) == sorted(r.id for r in late.collect())
    assert "text" in late.columns


def test_feed_defaults(spark):
    served = spark.createDataFrame(
        [("1", None, "", (None, 0.0)), ("2", "hi", "src", ("positive", 0.3))],
        "id string, title string, subreddit string, sentiment struct<label:string,score:double>",
    )
    got = [r.asDict() for r in posts.post_feed(served).orderBy("id").collect()]
    assert got == [
        {"id": "1", "source": "bluesky", "label": "neutral", "content": "No content"},
        {"id": "2", "source": "src", "label": "positive", "content": "hi"},
    ]


def test_copies_of_one_time_with_different_texts_are_ordered(spark):
    rows = [("u", "1", "s", 5.0, text, "c") for text in ("b", "a", "c")] * 20
    frame = spark.createDataFrame(rows, "did string, id string, source string, timestamp double, text string, created_at string")
    assert [r.text for r in posts.latest_distinct(frame.repartition(4), 3).collect()] == ["a"]


def test_a_word_of_a_post_meets_the_lexicon_once(spark, monkeypatch):
    seen, join = [], lexicon.join_word_list
    monkeypatch.setattr(lexicon, "join_word_list", lambda words, *rest: seen.append(words.count()) or join(words, *rest))
    words = spark.createDataFrame([("the", 0.5, None), ("end", -1.0, 0.25)], "word string, polarity double, subjectivity double")
    rows = [(1, "the " * 500 + "end"), (2, None), (None, "no entry"), (None, "end end"), (3, "")]
    got = {r.id: (r.polarity, r.subjectivity) for r in lexicon.lexicon_scores(spark.createDataFrame(rows, "id int, text string"), words).collect()}
    assert got == {1: (249 / 501, 0.25), 2: (0.0, 0.0), 3: (0.0, 0.0), None: (-1.0, 0.25)}
    assert seen[0] <= 7  # one row a word of a post, not one an occurrence
