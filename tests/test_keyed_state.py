"""Keyed state with expiry against totals computed from all posts."""

from pyspark.sql import functions as F
from test_state_and_streams import deliver, posts

from moodstream.sources import events
from moodstream.streaming import jobs, keyed


def sourced(spark, numbers, minute=0, sources=("a", "b", None)):
    frame = posts(spark, numbers, minute)
    names = F.array(*[F.lit(s).cast("string") for s in sources])
    return frame.withColumn("source", names[F.col("id").cast("int") % len(sources)])


def runner(spark, tmp_path, **options):
    inbox, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def run(frame):
        deliver(frame, inbox)
        series = keyed.source_state(events.post_stream(spark, inbox), **options)

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{out}/batch_id={number}")

        jobs.start(series.writeStream.outputMode("update").foreachBatch(keep), check, once=True).awaitTermination()

    def state():
        rows = spark.read.parquet(out).groupBy("source").agg(F.max_by(F.struct("*"), "batch_id").alias("r")).select("r.*")
        return {r.source: r for r in rows.collect()}

    return run, state


def test_state_after_a_restart_is_that_of_all_posts(spark, tmp_path):
    run, state = runner(spark, tmp_path, keep=4)
    run(sourced(spark, range(20)))
    run(sourced(spark, range(20, 31), minute=-1))  # late ones too: no watermark without expiry
    whole = sourced(spark, range(20)).union(sourced(spark, range(20, 31), -1))
    scored = whole.withColumn("s", jobs.keyword_sentiment(F.col("text"))).fillna("", ["source"])
    rows = scored.select("source", "id", "timestamp", "s.*").collect()
    found = state()
    assert set(found) == {"a", "b", ""}
    for source, row in found.items():
        own = [r for r in rows if r.source == source]
        assert row.total == len(own) and not row.expired
        for label in ("positive", "negative", "neutral"):
            assert row[label] == sum(r.label == label for r in own)
        assert abs(row.sum_score - sum(r.score for r in own)) < 1e-9
        newest = sorted(own, key=lambda r: (r.timestamp, r.id))[::-1][:4]
        assert [n.id for n in row.newest] == [r.id for r in newest]


def test_a_silent_source_expires(spark, tmp_path):
    run, state = runner(spark, tmp_path, keep=2, idle=600.0, delay="1 minute")
    run(sourced(spark, range(6), minute=100, sources=("a", "b")))
    run(sourced(spark, [6, 8], minute=200, sources=("a", "b")))  # a alone goes on
    run(sourced(spark, [10], minute=201, sources=("a", "b")))
    found = state()
    assert found["b"].expired and found["b"].total == 3 and found["b"].newest == []
    assert not found["a"].expired and found["a"].total in (3, 6)
    run(sourced(spark, [21], minute=202, sources=("a", "b")))
    assert state()["b"].total == 1  # anew
