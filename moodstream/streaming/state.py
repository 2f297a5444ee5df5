"""Hot tables: mergeable partials per batch.

Layout below the root of one run (use a new root when a checkpoint is lost, since batch ids then
start again at 0)::

    cold/date=D/batch_id=N/           scored posts
    trend_parts/date=D/batch_id=N/    (bucket, sum_score, n); D is the bucket's day
    topic_parts/batch_id=N/           (word, label, count)
    post_parts/batch_id=N/            the batch's newest distinct posts
    label_parts/batch_id=N/           (label, n, updated_at)
    topic_sketch/batch_id=N/          heavy words with error bounds, where asked for
    quarantine/batch_id=N/            (reason, line) of lines that are no posts
    manifest/batch_id=N/              (posts, committed_at); written last, it commits the batch

A folder belongs to one batch.  A batch counts from the moment its manifest row is there; a batch
stopped on the way is written again, a committed one never.  Batches come in order, so the newest
committed batch names a *version* of all tables: everything up to it.  Every reader resolves one
version first and reads no table beyond it; ``Snapshot`` gives several answers of the same version,
the newest or any earlier one.  Run-wide answers add up or rank the partials.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodstream.functions.scoring import Scorer, keyword_sentiment
from moodstream.functions.timebuckets import utc_day
from moodstream.operators import posts as post_ops
from moodstream.operators import sketch as sketch_ops
from moodstream.operators import topics as topic_ops
from moodstream.operators.ingest import split_parsed_posts
from moodstream.operators.labels import (
    distribution_of_counts,
    label_counts,
    with_percentages,
)
from moodstream.operators.trends import merge_trends, period_start, trend_partials
from moodstream.schemas import (
    COLD, CORRUPT, LABEL_PARTS, MANIFEST, POST_PARTS, QUARANTINE, TOPIC_PARTS, TOPIC_SKETCH, TREND_PARTS,
)
from moodstream.sources.lake import read_cold, read_cold_folders, write_cold_batch

PARTS: dict[str, StructType] = {
    "label_parts": LABEL_PARTS, "trend_parts": TREND_PARTS, "topic_parts": TOPIC_PARTS, "post_parts": POST_PARTS,
    "topic_sketch": TOPIC_SKETCH,
}

#: Adds the ``sentiment`` struct to posts: a lexicon, a model, a forest or a vote.
FrameScorer = Callable[[DataFrame], DataFrame]


def write_parts(parts: DataFrame, root: str, name: str, batch_id: int, *, few: bool = False) -> None:
    """Partials of one batch; ``few`` rows go to one file."""
    (parts.coalesce(1) if few else parts).write.mode("overwrite").parquet(f"{root}/{name}/batch_id={batch_id}")


def write_trend_parts(parts: DataFrame, root: str, batch_id: int) -> None:
    """Partials of the touched buckets below their days; only those folders are replaced."""
    dated = with_bucket_day(parts).withColumn("batch_id", F.lit(batch_id).cast("long"))
    writer = dated.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("date", "batch_id").parquet(f"{root}/trend_parts")


def with_bucket_day(parts: DataFrame) -> DataFrame:
    return parts.withColumn("date", F.coalesce(utc_day("bucket"), F.lit("unknown")))


def read_table(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The rows below ``path``, or none before anything is written there."""
    try:
        return spark.read.schema(schema).option("basePath", path).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def committed(spark: SparkSession, root: str) -> DataFrame:
    """``(posts, committed_at, batch_id)`` of every whole batch."""
    return read_table(spark, f"{root}/manifest", MANIFEST)


def newest_batch(spark: SparkSession, root: str) -> int | None:
    """The last whole batch: the newest version of the tables."""
    return committed(spark, root).agg(F.max("batch_id")).first()[0]


def read_parts(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The partials of one version (the newest unless given), or an empty frame before the first batch."""
    version = newest_batch(spark, root) if version is None else version
    parts = read_table(spark, f"{root}/{name}", PARTS[name])
    return parts.where(F.lit(False) if version is None else F.col("batch_id") <= version)


def commit(spark: SparkSession, root: str, batch_id: int) -> None:
    """Declare a batch whole: one small file, put in place at once by the writer's own commit."""
    counts = spark.read.schema(LABEL_PARTS).parquet(f"{root}/label_parts/batch_id={batch_id}")
    row = counts.agg(F.sum("n").alias("posts"), F.max("updated_at").alias("committed_at"))
    write_parts(row, root, "manifest", batch_id, few=True)


def update_state(
    posts: DataFrame,
    root: str,
    batch_id: int,
    *,
    scorer: Scorer = keyword_sentiment,
    frame_scorer: FrameScorer | None = None,
    unit: str = "minute",
    sketch: int | None = None,
) -> None:
    """Score one batch, write it to the cold store, add its partials and commit it.

    ``scorer`` works on the text column; a ``frame_scorer`` takes the posts and adds ``sentiment``
    itself, by joins or in Arrow batches.  Parsed lines (``events.parsed_post_stream``) are split
    first and the bad ones kept in the quarantine.  The partials are computed from the batch as
    written: it is scored once.  A batch without posts adds nothing; one already committed is left
    alone.  ``sketch`` also keeps the batch's heavy words in that many counters.
    """
    spark = posts.sparkSession
    if committed(spark, root).where(F.col("batch_id") == batch_id).count():
        return
    if CORRUPT in posts.columns:
        posts, bad = split_parsed_posts(posts)
        if not bad.isEmpty():
            bad.write.mode("overwrite").parquet(f"{root}/quarantine/batch_id={batch_id}")
    scored = posts.withColumn("sentiment", scorer(F.col("text"))) if frame_scorer is None else frame_scorer(posts)
    folders = write_cold_batch(scored, f"{root}/cold", batch_id)
    if not folders:
        return
    batch = read_cold_folders(spark, f"{root}/cold", folders)
    write_trend_parts(trend_partials(batch, unit), root, batch_id)
    write_parts(topic_ops.topic_counts(batch), root, "topic_parts", batch_id)
    if sketch is not None:
        counted = spark.read.parquet(f"{root}/topic_parts/batch_id={batch_id}")
        write_parts(sketch_ops.summary(counted, sketch, "word", "label"), root, "topic_sketch", batch_id, few=True)
    newest = post_ops.latest_distinct(batch, post_ops.STORED)
    write_parts(newest.select(*POST_PARTS.names[:-1]), root, "post_parts", batch_id, few=True)
    counts = label_counts(batch).withColumn("updated_at", F.current_timestamp())
    write_parts(counts, root, "label_parts", batch_id, few=True)
    commit(spark, root, batch_id)


def compact(spark: SparkSession, root: str, into: str, up_to: int) -> None:
    """Copy a run to a new root, with all batches up to ``up_to`` folded into that one.

    Every table is carried over, so the new root answers all that the old one does.  To hand over:
    stop the query, compact up to its last batch, and start it again with the same checkpoint and
    the new root; later batches then land there.  The old root stays as it is.
    """
    version = newest_batch(spark, root)
    batch = F.greatest("batch_id", F.lit(up_to).cast("long")).alias("batch_id")

    def parts(name: str) -> DataFrame:
        return read_parts(spark, root, name, version)

    def folded(frame: DataFrame, keys: list[str], *sums) -> DataFrame:
        return frame.groupBy(batch, *keys).agg(*sums)

    def save(frame: DataFrame, name: str, *by: str) -> None:
        frame.write.mode("overwrite").partitionBy(*by, "batch_id").parquet(f"{into}/{name}")

    n = F.sum("n").alias("n")
    save(folded(parts("trend_parts"), ["date", "bucket"], F.sum("sum_score").alias("sum_score"), n), "trend_parts", "date")
    save(folded(parts("topic_parts"), ["word", "label"], F.sum("count").alias("count")), "topic_parts")
    save(parts("topic_sketch").withColumn("batch_id", batch), "topic_sketch")
    posts = parts("post_parts")
    old = post_ops.latest_distinct(posts.where(F.col("batch_id") <= up_to), post_ops.STORED)
    later = posts.where(F.col("batch_id") > up_to)
    save(old.withColumn("batch_id", F.lit(up_to).cast("long")).unionByName(later), "post_parts")
    cold = read_cold(spark, f"{root}/cold").where(F.col("batch_id") <= version).withColumn("batch_id", batch)
    save(cold.hint("rebalance", "date"), "cold", "date")
    save(quarantine(spark, root).withColumn("batch_id", batch), "quarantine")
    save(folded(parts("label_parts"), ["label"], n, F.max("updated_at").alias("updated_at")), "label_parts")
    whole = folded(committed(spark, root), [], F.sum("posts").alias("posts"), F.max("committed_at").alias("committed_at"))
    save(whole, "manifest")


def quarantine(spark: SparkSession, root: str) -> DataFrame:
    """``(reason, line, batch_id)`` of all lines set aside, also those of batches without posts."""
    return read_table(spark, f"{root}/quarantine", QUARANTINE)


def totals(spark: SparkSession, root: str, *, version: int | None = None) -> DataFrame:
    """One row of all-time counts per label."""
    return distribution_of_counts(read_parts(spark, root, "label_parts", version))


def trends(
    spark: SparkSession, root: str, period: str | None = None, as_of: float | None = None, *, version: int | None = None
) -> DataFrame:
    """The series of the run, or of a period: days before it are not opened."""
    parts = read_parts(spark, root, "trend_parts", version)
    if period is not None:
        start = period_start(period, as_of)
        day = F.date_format(F.timestamp_seconds(F.lit(start)), "yyyy-MM-dd")
        parts = parts.where((F.col("date") >= day) & (F.col("bucket") >= start))
    return merge_trends(parts)


def topics(spark: SparkSession, root: str, batch_id: int | None = None, *, version: int | None = None) -> DataFrame:
    """The stored topic list of the run, or of one batch."""
    parts = read_parts(spark, root, "topic_parts", version)
    if batch_id is not None:
        parts = parts.where(F.col("batch_id") == batch_id)
    summed = parts.groupBy("word", "label").agg(F.sum("count").alias("count"))
    return topic_ops.one_label_per_word(topic_ops.top_topics(summed))


def topic_bounds(spark: SparkSession, root: str, k: int, *, version: int | None = None) -> DataFrame:
    """``(word, label, low, high, total)`` from the batches' sketches: no exact counts are read."""
    parts = read_parts(spark, root, "topic_sketch", version)
    return sketch_ops.bounds(sketch_ops.merged(parts, k, "word", "label", part="batch_id"))


def latest_posts(spark: SparkSession, root: str, batch_id: int | None = None, *, version: int | None = None) -> DataFrame:
    """Stored form of the newest distinct posts of the run, or of one batch."""
    parts = read_parts(spark, root, "post_parts", version)
    if batch_id is not None:
        parts = parts.where(F.col("batch_id") == batch_id)
    return post_ops.recent_posts(parts)


@dataclass(frozen=True)
class Snapshot:
    """All hot tables and the cold store at one version; later batches change none of its answers."""

    spark: SparkSession
    root: str
    version: int | None

    def totals(self) -> DataFrame:
        return totals(self.spark, self.root, version=self._at())

    def trends(self, period: str | None = None, as_of: float | None = None) -> DataFrame:
        return trends(self.spark, self.root, period, as_of, version=self._at())

    def topics(self, batch_id: int | None = None) -> DataFrame:
        return topics(self.spark, self.root, batch_id, version=self._at())

    def latest_posts(self, batch_id: int | None = None) -> DataFrame:
        return latest_posts(self.spark, self.root, batch_id, version=self._at())

    def parts(self, name: str) -> DataFrame:
        return read_parts(self.spark, self.root, name, self._at())

    def cold(self) -> DataFrame:
        if self.version is None:
            return self.spark.createDataFrame([], COLD)
        return read_cold(self.spark, f"{self.root}/cold").where(F.col("batch_id") <= self.version)

    def _at(self) -> int:
        return NO_VERSION if self.version is None else self.version


#: Before the first whole batch.
NO_VERSION = -1


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """The newest version, or the one given if that batch is whole (in a compacted run: if it is still apart)."""
    if version is not None and not committed(spark, root).where(F.col("batch_id") == version).count():
        raise ValueError(f"batch {version} is not committed")
    return Snapshot(spark, root, newest_batch(spark, root) if version is None else version)


def register_views(spark: SparkSession, root: str, version: int | None = None) -> None:
    """The four hot tables at one version as temporary views, for ``spark.sql(query, args=…)``."""
    at = snapshot(spark, root, version)
    at.latest_posts().createOrReplaceTempView("posts_recent")
    at.topics().createOrReplaceTempView("trending_topics")
    at.trends().createOrReplaceTempView("hourly_trends")
    stats = with_percentages(distribution_of_counts(at.parts("label_parts"), F.max("updated_at").alias("updated_at")))
    stats.where(F.col("total") > 0).select(
        F.col("total").alias("total_count"), "positive_pct", "negative_pct", "neutral_pct", "updated_at",
    ).createOrReplaceTempView("sentiment_stats")
