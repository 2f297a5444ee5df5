"""The lake: day-rotated JSON lines, and date-partitioned Parquet of scored posts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from moodstream.functions.timebuckets import utc_day
from moodstream.schemas import COLD


#: The day of posts without a time.
NO_DAY = "unknown"


def append_json(posts: DataFrame, path: str, compression: str | None = None) -> None:
    """Append posts as JSON lines below the UTC day of writing."""
    posts.withColumn("ingest_date", F.current_date()).write.mode("append").partitionBy(
        "ingest_date"
    ).json(path, compression=compression)


def with_date(scored: DataFrame) -> DataFrame:
    """Add the UTC day of the post, the partition column of the cold store."""
    return scored.withColumn("date", F.coalesce(utc_day("timestamp"), F.lit(NO_DAY)))


def append_cold(scored: DataFrame, path: str, *, rebalance: bool = False) -> None:
    """Append scored posts to the cold store, one folder per day.

    A running stream touches one or two days per batch and needs no shuffle.  A backfill over many
    days should ``rebalance``: rows of a day meet in few files, and a day too big for one task is
    split over several.
    """
    dated = with_date(scored)
    if rebalance:
        dated = dated.hint("rebalance", "date")
    dated.write.mode("append").partitionBy("date").parquet(path)


def write_cold_batch(scored: DataFrame, path: str, batch_id: int) -> list[str]:
    """Write one batch below its days, ``date=D/batch_id=N``; gives the folders written.

    Only those folders are replaced, so a repeated batch replaces itself.  The days are noted while
    the batch is written.
    """
    days = Observation()
    dated = with_date(scored).withColumn("batch_id", F.lit(batch_id).cast("long"))
    dated = dated.observe(days, F.collect_set("date").alias("days"))
    writer = dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch_id").parquet(path)
    return [f"{path}/date={day}/batch_id={batch_id}" for day in sorted(days.get["days"])]


def read_cold_folders(spark: SparkSession, path: str, folders: list[str]) -> DataFrame:
    """The folders of one batch, without listing any other."""
    if not folders:
        return spark.createDataFrame([], COLD)
    return spark.read.option("basePath", path).schema(COLD).parquet(*folders)


def read_cold(
    spark: SparkSession, path: str, first_day: str | None = None, last_day: str | None = None
) -> DataFrame:
    """Cold posts of a range of days (both ends included); only those folders are read."""
    frame = spark.read.option("basePath", path).schema(COLD).parquet(path)
    if first_day:
        frame = frame.where(F.col("date") >= first_day)
    if last_day:
        frame = frame.where(F.col("date") <= last_day)
    return frame
