"""Posts behind the watermark, kept beside the stream instead of vanishing from it.

Layout below the root::

    on_time/batch_id=N/     posts at or after the watermark
    late/batch_id=N/        posts before it, with the seconds they are behind
    newest/batch_id=N/      (newest): the largest time of the batch

The watermark of a batch is the largest time of the batches before it, less the delay, as in Spark's
own watermark; it is read from what earlier batches noted, so a repeated batch is split alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from moodstream.streaming.jobs import start
from moodstream.streaming.state import read_table

NEWEST = StructType([StructField("newest", DoubleType()), StructField("batch_id", LongType())])


def watermark(spark: SparkSession, root: str, batch_id: int, delay: float) -> float | None:
    """Seconds; none before the first post."""
    noted = read_table(spark, f"{root}/newest", NEWEST).where(F.col("batch_id") < batch_id)
    newest = noted.agg(F.max("newest")).first()[0]
    return None if newest is None else newest - delay


def split_late(batch: DataFrame, root: str, batch_id: int, *, delay: float, time: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """The batch's posts on time and behind the watermark (with ``seconds_late``), both written; no post is lost.

    A post without a time is on time: nothing says that it is late.
    """
    spark = batch.sparkSession
    mark = watermark(spark, root, batch_id, delay)
    behind = F.lit(mark).cast("double") - F.col(time)
    marked = batch.withColumn("seconds_late", behind).withColumn("_late", F.coalesce(behind > 0, F.lit(False)))
    paths = {name: f"{root}/{name}/batch_id={batch_id}" for name in ("on_time", "late", "newest")}
    marked.where("not _late").drop("seconds_late", "_late").write.mode("overwrite").parquet(paths["on_time"])
    marked.where("_late").drop("_late").write.mode("overwrite").parquet(paths["late"])
    batch.agg(F.max(time).cast("double").alias("newest")).write.mode("overwrite").parquet(paths["newest"])
    return spark.read.parquet(paths["on_time"]), spark.read.parquet(paths["late"])


def keep_late(posts: DataFrame, root: str, checkpoint: str, *, delay: float, once: bool = False) -> StreamingQuery:
    """Split each micro-batch of the stream at its watermark."""

    def split(batch: DataFrame, batch_id: int) -> None:
        split_late(batch, root, batch_id, delay=delay)

    return start(posts.writeStream.foreachBatch(split), checkpoint, once=once)


def late_share(spark: SparkSession, root: str) -> DataFrame:
    """``(batch_id, on_time, late, most_late)`` of every batch."""
    on_time = spark.read.option("basePath", f"{root}/on_time").parquet(f"{root}/on_time")
    late = spark.read.option("basePath", f"{root}/late").parquet(f"{root}/late")
    rows = on_time.select("batch_id", F.lit(None).cast("double").alias("s")).unionByName(
        late.select("batch_id", F.col("seconds_late").alias("s")))
    return rows.groupBy("batch_id").agg(
        F.count_if(F.col("s").isNull()).alias("on_time"), F.count("s").alias("late"), F.max("s").alias("most_late")
    )
