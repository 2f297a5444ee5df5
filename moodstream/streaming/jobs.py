"""Streaming queries: ingest, per-batch state, windowed trends, removal of copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from moodstream.functions.scoring import Scorer, keyword_sentiment
from moodstream.functions.timebuckets import SHIFT_SECONDS, bucket_label
from moodstream.operators.ingest import decode_events, good_events, new_posts, random_sample
from moodstream.streaming.state import FrameScorer, update_state

# Fixed value: time between two micro-batches.
PERIOD = "60 seconds"


def start(writer: DataStreamWriter, checkpoint: str, *, once: bool = False, period: str = PERIOD) -> StreamingQuery:
    """Start a query; ``once`` works off what is there and stops."""
    writer = writer.option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=period)).start()


def post_stream_of(
    lines: DataFrame, *, language: str | None = "en", sample: float | None = None, seed: int | None = None
) -> DataFrame:
    """Event lines → flat posts, with an optional random sample."""
    posts = new_posts(good_events(decode_events(lines)), language=language)
    return posts if sample is None else random_sample(posts, sample, seed)


def write_lake(posts: DataFrame, path: str, checkpoint: str, *, once: bool = False) -> StreamingQuery:
    """Append posts as JSON lines below the UTC day of writing; the sink commits whole files."""
    writer = posts.withColumn("ingest_date", F.current_date()).writeStream.format("json")
    return start(writer.partitionBy("ingest_date").option("path", path), checkpoint, once=once)


def keep_state(
    posts: DataFrame,
    root: str,
    checkpoint: str,
    *,
    scorer: Scorer = keyword_sentiment,
    frame_scorer: FrameScorer | None = None,
    unit: str = "minute",
    sketch: int | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Score each micro-batch and merge it into the cold store and the hot tables below ``root``.

    ``posts`` are flat posts, or parsed lines whose bad ones go to the quarantine of the run.  Late
    posts always reach their old bucket: its partials are summed when they are read.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        update_state(batch, root, batch_id, scorer=scorer, frame_scorer=frame_scorer, unit=unit, sketch=sketch)

    return start(posts.writeStream.foreachBatch(merge), checkpoint, once=once)


def event_times(posts: DataFrame) -> DataFrame:
    return posts.withColumn("event_time", F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("long")))


def windowed_trend(
    posts: DataFrame,
    *,
    window: str = "1 minute",
    delay: str = "5 minutes",
    scorer: Scorer = keyword_sentiment,
    shift: int = SHIFT_SECONDS,
) -> DataFrame:
    """The series kept in Spark's own state: a post later than ``delay`` is dropped."""
    scored = event_times(posts).select(
        "event_time", "id", scorer(F.col("text")).getField("score").alias("score")
    )
    windows = (
        scored.withWatermark("event_time", delay)
        .groupBy(F.window("event_time", window).alias("window"))
        .agg(F.sum("score").alias("sum_score"), F.count("id").alias("count"))
    )
    return windows.select(
        bucket_label(F.unix_timestamp("window.start") + shift).alias("time"),
        F.when(F.col("count") > 0, F.col("sum_score") / F.col("count")).alias("avg_score"),
        "count",
    )


def without_copies(
    posts: DataFrame, *, key: tuple[str, ...] = ("did", "id"), delay: str = "10 minutes", salts: int = 1
) -> DataFrame:
    """First copy of each post; copies further apart than ``delay`` count as new.

    Like every watermarked query it drops posts older than the watermark, and with them those whose
    time is missing (0).

    With ``salts`` above 1 the copies of one very hot post are first thinned out in that many
    groups, so no single task receives all of them; every post then goes through two shuffles and
    is held in two states, so leave it at 1 without such posts.
    """
    timed = event_times(posts).withWatermark("event_time", delay)
    if salts > 1:
        spread = timed.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        timed = spread.dropDuplicatesWithinWatermark([*key, "_salt"]).drop("_salt")
    return timed.dropDuplicatesWithinWatermark(list(key)).drop("event_time")
