import pytest
from pyspark.sql import functions as F

from moodstream.functions import scoring
from moodstream.operators import labels, lexicon, models, trends, vote
from moodstream.plans import serve
from moodstream.schemas import POST
from moodstream.sources import events, lake
from moodstream.streaming import jobs, state

WORDS = ["good morning planets", "terrible weather", "plain words"]


def posts(spark, numbers, minute=0):
    rows = [(str(i), f"u{i % 3}", "src", 60.0 * minute + i % 50, WORDS[i % 3], "t") for i in numbers]
    return spark.createDataFrame(rows, POST)


def counts(frame):
    return frame.first().asDict()


def test_empty_state_answers_with_zeros(spark, tmp_path):
    root = str(tmp_path)
    assert counts(serve.stats(spark, root)) == {"total": 0, "positive": 0, "negative": 0, "neutral": 0}
    assert serve.latest_posts(spark, root).count() == 0
    assert serve.topics(spark, root).count() == 0
    assert serve.trend_summary(spark, root, as_of=0).first().trend_direction == "stable"


def test_repeated_batch_replaces_itself_and_totals_are_exact(spark, tmp_path):
    root = str(tmp_path)
    for batch, numbers in ((0, range(10)), (1, range(10, 17)), (1, range(10, 17)), (2, [])):
        state.update_state(posts(spark, numbers), root, batch)
    assert counts(serve.stats(spark, root)) == {"total": 17, "positive": 6, "negative": 6, "neutral": 5}
    assert lake.read_cold(spark, f"{root}/cold").count() == 17
    assert [r.id for r in serve.latest_posts(spark, root, 3, scope="batch").collect()] == ["16", "15", "14"]
    assert serve.latest_posts(spark, root, 50, scope="batch").count() == 7  # the last non-empty batch
    shown = {r.word for r in serve.topics(spark, root, scope="batch").collect()}
    assert shown == {"morning", "planets", "terrible", "weather", "plain", "words"}
    overview = serve.trend_overview(spark, root, as_of=100.0).first()
    assert (overview.buckets, overview.posts, overview.trend_direction) == (1, 17, "stable")
    assert serve.latest_posts(spark, root, 50, scope="all").count() == 17
    assert serve.topics(spark, root, scope="all").where("word = 'planets'").first()["count"] == 6
    totals = labels.running_totals(state.read_parts(spark, root, "label_parts"))
    assert [r.total for r in totals.orderBy("batch_id").collect()] == [10, 17]


def test_compaction_changes_no_answer(spark, tmp_path):
    root, into = str(tmp_path / "a"), str(tmp_path / "b")
    for batch in range(4):
        state.update_state(posts(spark, range(batch * 5, batch * 5 + 5), minute=batch % 2), root, batch)
    state.compact(spark, root, into, up_to=2)
    assert counts(state.totals(spark, into)) == counts(state.totals(spark, root))
    before = {r.time: (round(r.avg_score, 9), r["count"]) for r in state.trends(spark, root).collect()}
    after = {r.time: (round(r.avg_score, 9), r["count"]) for r in state.trends(spark, into).collect()}
    assert before == after
    folded = state.read_parts(spark, into, "label_parts").select("batch_id").distinct()
    assert sorted(r.batch_id for r in folded.collect()) == [2, 3]
    for answer in (serve.latest_posts, serve.topics):
        for scope in ("all", "batch"):
            old, new = answer(spark, root, scope=scope), answer(spark, into, scope=scope)
            assert old.exceptAll(new).isEmpty() and new.exceptAll(old).isEmpty() and not new.isEmpty()
    assert serve.trends(spark, into, "1w", 500.0).count() == serve.trends(spark, root, "1w", 500.0).count() == 2
    assert lake.read_cold(spark, f"{into}/cold").count() == 20
    state.register_views(spark, into)
    assert spark.sql("SELECT total_count FROM sentiment_stats").first()[0] == 20
    state.update_state(posts(spark, range(20, 23)), into, 4)  # the hand-over: later batches go to the new root
    assert counts(state.totals(spark, into))["total"] == 23


def test_open_reader_keeps_its_list_while_batches_follow(spark, tmp_path):
    root = str(tmp_path)
    state.update_state(posts(spark, range(5)), root, 0)
    opened = serve.latest_posts(spark, root, 50, scope="batch")
    for batch, numbers in ((1, []), (2, range(5, 9)), (3, []), (4, range(9, 11))):
        state.update_state(posts(spark, numbers), root, batch)
    assert sorted(r.id for r in opened.collect()) == list("01234")
    assert serve.latest_posts(spark, root, 50).count() == 11


def test_update_stamp_is_the_time_of_the_update(spark, tmp_path):
    state.update_state(posts(spark, range(5)), str(tmp_path), 0)
    state.register_views(spark, str(tmp_path))
    first = spark.sql("SELECT updated_at FROM sentiment_stats").first()[0]
    assert spark.sql("SELECT updated_at FROM sentiment_stats").first()[0] == first
    state.update_state(posts(spark, range(5, 7)), str(tmp_path), 1)
    state.register_views(spark, str(tmp_path))
    assert spark.sql("SELECT updated_at FROM sentiment_stats").first()[0] > first


def test_stream_scored_by_a_vote_a_lexicon_and_a_model(spark, tmp_path):
    def load():
        return lambda texts: [("5 stars" if "good" in t else "1 star", 0.9) for t in texts]

    words = spark.createDataFrame([("good", 0.9, 1.0), ("terrible", -0.9, 1.0)],
                                  "word string, polarity double, subjectivity double")
    scorers = {
        "vote": (vote.vote_sentiment({"lstm": scoring.keyword_prediction, "rf": scoring.keyword_prediction}), (4, 3, 3)),
        "lexicon": (lexicon.lexicon_sentiment(words), (4, 3, 3)),
        "model": (models.model_sentiment(load), (4, 6, 0)),
    }
    for name, (scorer, expected) in scorers.items():
        inbox, root, checkpoint = (str(tmp_path / name / n) for n in ("in", "state", "check"))
        deliver(posts(spark, range(10)), inbox)
        jobs.keep_state(events.parsed_post_stream(spark, inbox), root, checkpoint, frame_scorer=scorer, once=True).awaitTermination()
        got = counts(serve.stats(spark, root))
        assert (got["positive"], got["negative"], got["neutral"]) == expected


def test_bad_lines_of_a_stream_are_kept_apart(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("in", "state", "check"))
    deliver(posts(spark, range(3)), inbox)
    (tmp_path / "in" / "hand.json").write_text('{"id": "9"}\n{broken\n\n{"id": "1", "timestamp"\n{"timestamp": 1.0}\n')
    jobs.keep_state(events.parsed_post_stream(spark, inbox), root, checkpoint, once=True).awaitTermination()
    assert counts(serve.stats(spark, root))["total"] == 3
    bad = spark.read.parquet(f"{root}/quarantine").groupBy("reason").count().collect()
    assert {r.reason: r["count"] for r in bad}["corrupt"] == 2
    assert sum(r["count"] for r in bad) in (4, 5)  # an empty line may be passed over by the reader
    assert [r.time for r in serve.trends(spark, root, "1w", 100.0).collect()] == ["1970-01-01 05:30"]


def test_hot_tables_answer_sql(spark, tmp_path):
    state.update_state(posts(spark, range(9)), str(tmp_path), 0)
    state.register_views(spark, str(tmp_path))
    assert spark.sql("SELECT total_count FROM sentiment_stats").first()[0] == 9
    assert spark.sql("SELECT * FROM posts_recent ORDER BY timestamp DESC LIMIT :n", args={"n": 2}).count() == 2
    assert spark.sql("SELECT * FROM trending_topics ORDER BY count DESC LIMIT 1").count() == 1
    assert spark.sql("SELECT sum(count) FROM hourly_trends").first()[0] == 9


def test_posts_without_id_count_in_the_totals_only(spark, tmp_path):
    frame = posts(spark, range(3)).withColumn("id", F.when(F.col("id") != "1", F.col("id")))
    state.update_state(frame, str(tmp_path), 0)
    assert counts(state.totals(spark, str(tmp_path)))["total"] == 3
    got = state.trends(spark, str(tmp_path)).first()
    assert got["count"] == 2 and got.avg_score == pytest.approx(0.15)


def test_copies_appear_once_among_the_latest(spark, tmp_path):
    hot = posts(spark, [40] * 60)
    no_author = posts(spark, [41]).withColumn("did", F.lit(None).cast("string"))
    state.update_state(posts(spark, range(40)).union(hot).union(no_author), str(tmp_path), 0)
    got = [r.id for r in serve.latest_posts(spark, str(tmp_path), 5).collect()]
    assert got == ["41", "40", "39", "38", "37"]
    assert counts(serve.stats(spark, str(tmp_path)))["total"] == 101


def deliver(frame, path):
    frame.write.mode("append").json(path)


def test_stream_reads_each_file_once_and_late_posts_reach_their_minute(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("in", "state", "check"))

    def run():
        jobs.keep_state(events.post_stream(spark, inbox), root, checkpoint, once=True).awaitTermination()

    deliver(posts(spark, range(10), minute=100), inbox)
    run()
    run()
    deliver(posts(spark, range(10, 14), minute=1), inbox)  # hours late
    deliver(posts(spark, range(14, 20), minute=100), inbox)
    run()
    whole = posts(spark, range(10), 100).union(posts(spark, range(10, 14), 1)).union(posts(spark, range(14, 20), 100))
    expected = labels.label_distribution(whole.withColumn("sentiment", jobs.keyword_sentiment(F.col("text"))))
    assert counts(state.totals(spark, root)) == counts(expected)
    assert {r.time: r["count"] for r in state.trends(spark, root).collect()} == {
        "1970-01-01 05:31": 4, "1970-01-01 07:10": 16}


def test_windowed_trend_drops_posts_beyond_the_delay(spark, tmp_path):
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    seen = {}

    def keep(batch, _):
        for row in batch.collect():
            seen[row.time] = row["count"]

    def run():
        series = jobs.windowed_trend(events.post_stream(spark, inbox), delay="5 minutes")
        writer = series.writeStream.outputMode("update").foreachBatch(keep)
        jobs.start(writer, checkpoint, once=True).awaitTermination()

    deliver(posts(spark, range(10), minute=100), inbox)
    run()
    deliver(posts(spark, range(10, 14), minute=98), inbox)  # late, within the delay
    deliver(posts(spark, range(14, 18), minute=80), inbox)  # beyond it
    run()
    assert seen == {"1970-01-01 07:10": 10, "1970-01-01 07:08": 4}


@pytest.mark.parametrize("salts", [1, 3])
def test_copies_are_removed_within_the_delay(spark, tmp_path, salts):
    inbox, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run():
        distinct = jobs.without_copies(events.post_stream(spark, inbox), salts=salts)
        writer = distinct.writeStream.format("parquet").option("path", out)
        jobs.start(writer, checkpoint, once=True).awaitTermination()

    hot = posts(spark, [7] * 40, minute=100)
    deliver(posts(spark, range(10), minute=100).union(hot), inbox)
    run()
    deliver(posts(spark, range(5, 15), minute=100), inbox)
    run()
    assert sorted(int(r.id) for r in spark.read.parquet(out).collect()) == list(range(15))


def test_lake_round_trip_and_quarantine(spark, tmp_path):
    path = str(tmp_path)
    lake.append_json(posts(spark, range(6)), path)
    lake.append_json(posts(spark, range(6, 8)), path)
    spark.createDataFrame([("{broken",)], "value string").write.mode("append").text(path + "/bad")
    good, _ = events.read_posts(spark, path)
    assert good.exceptAll(posts(spark, range(8))).isEmpty() and good.count() == 8
    (tmp_path / "hand.jsonl").write_text('{"id": "9"}\n{broken\n')
    good, bad = events.read_posts(spark, path)
    assert good.count() == 8  # a post without a time is set aside too
    assert sorted(r.reason for r in bad.collect()) == ["corrupt", "no time"]


def test_cold_store_reads_only_the_days_asked_for(spark, tmp_path):
    path = str(tmp_path)
    days = [posts(spark, range(4), minute=1440 * d) for d in range(3)]
    for day in days:
        scored = day.withColumn("sentiment", jobs.keyword_sentiment(F.col("text")))
        lake.append_cold(scored, path, rebalance=True)
    chosen = lake.read_cold(spark, path, "1970-01-02", "1970-01-02")
    assert chosen.count() == 4 and {r.date for r in chosen.collect()} == {"1970-01-02"}
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan


def test_trend_of_state_equals_batch(spark, tmp_path):
    root = str(tmp_path)
    for batch in range(3):
        state.update_state(posts(spark, range(batch * 20, batch * 20 + 20)), root, batch)
    whole = posts(spark, range(60)).withColumn("sentiment", jobs.keyword_sentiment(F.col("text")))
    expected = {r.time: r["count"] for r in trends.trend(whole).collect()}
    assert {r.time: r["count"] for r in state.trends(spark, root).collect()} == expected


def test_files_come_in_small_batches_and_each_once(spark, tmp_path):
    inbox, out, checkpoint, archive = (str(tmp_path / n) for n in ("in", "out", "check", "done"))
    event = (
        '{"kind":"commit","did":"d","time_us":1,"commit":{"operation":"create","rkey":"%d",'
        '"record":{"langs":["en"],"text":"hi","createdAt":"t"}}}'
    )
    lines = spark.createDataFrame([(event % i,) for i in range(12)] + [("{broken",)], "value string")
    lines.repartition(4).write.text(inbox)

    def run():
        raw = events.event_line_stream(spark, inbox, files_per_trigger=1, archive=archive)
        query = jobs.write_lake(jobs.post_stream_of(raw, sample=1.0, seed=1), out, checkpoint, once=True)
        query.awaitTermination()

    run()
    run()
    good, bad = events.read_posts(spark, out)
    assert sorted(int(r.id) for r in good.collect()) == list(range(12)) and bad.isEmpty()


def test_running_query_picks_up_new_files(spark, tmp_path):
    inbox, root, checkpoint = (str(tmp_path / n) for n in ("in", "state", "check"))
    deliver(posts(spark, range(5)), inbox)
    writer = events.post_stream(spark, inbox, files_per_trigger=100).writeStream.foreachBatch(
        lambda batch, n: state.update_state(batch, root, n)
    )
    query = jobs.start(writer, checkpoint, period="1 second")
    try:
        query.processAllAvailable()
        deliver(posts(spark, range(5, 9)), inbox)
        query.processAllAvailable()
    finally:
        query.stop()
    assert counts(state.totals(spark, root))["total"] == 9


def test_message_source_gives_lines(spark):
    stream = events.message_stream(spark, "rate", rowsPerSecond="1")
    assert stream.isStreaming and stream.schema.simpleString() == "struct<value:string>"
