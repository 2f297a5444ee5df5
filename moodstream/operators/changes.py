"""Change points of a trend by cumulative sums (Page's test).

The upper sum adds what each bucket lies above target plus slack and never falls below zero:
``S = max(0, S + x)``.  Such steps compose: over a stretch, the sum is what the running total of ``x``
has risen above its lowest point.  So the series is cut into chunks, each chunk is summed up by
its total and its lowest running total, the few chunk rows are scanned, and the chunks are then
finished in parallel.  The lower sum is the upper one of the mirrored series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.timebuckets import BUCKET_SECONDS, bucket_label
from moodstream.session import written


def change_points(
    parts: DataFrame, unit: str = "hour", *, target: float | None = None, slack: float | None = None,
    limit: float | None = None, chunk: int = 24 * 64,
) -> DataFrame:
    """``(time, avg_score, upper, lower, alarm, since)`` of every bucket with posts.

    ``alarm`` is ``up`` or ``down`` in the bucket where a sum first passes ``limit``, and ``since`` the
    bucket before which the change began: the last one where that sum was zero (null: none was).
    Where not given, the target is the mean of the bucket averages, the slack half their standard
    deviation and the limit four times it.  Sums are not reset by an alarm.  Buckets without posts
    are absent.
    """
    merged = parts.groupBy("bucket").agg(F.sum("sum_score").alias("sum_score"), F.sum("n").alias("n"))
    series = merged.where((F.col("n") > 0) & F.col("bucket").isNotNull())
    series = series.select("bucket", (F.col("sum_score") / F.col("n")).alias("avg_score"))
    series = written(series.withColumn("chunk", F.floor(F.col("bucket") / (BUCKET_SECONDS[unit] * chunk))), "series")
    spread = F.coalesce(F.stddev_samp("avg_score"), F.lit(0.0))

    def or_(value: float | None, default: Column) -> Column:
        return default if value is None else F.lit(float(value))

    facts = series.agg(
        or_(target, F.avg("avg_score")).alias("target"), or_(slack, spread / 2).alias("slack"),
        or_(limit, spread * 4).alias("limit"),
    )
    over = F.col("avg_score") - F.col("target")
    steps = series.crossJoin(F.broadcast(facts)).select(  # one row
        "*", (over - F.col("slack")).alias("x_upper"), (-over - F.col("slack")).alias("x_lower")
    )
    for name in ("upper", "lower"):
        steps = _summed(steps, f"x_{name}", name)
    steps = written(steps, "sums")
    ordered = Window.partitionBy("chunk").orderBy("bucket")
    marked = steps
    for name in ("upper", "lower"):
        marked = _carried_max(marked, F.when(F.col(name) == 0, F.col("bucket")), f"zero_{name}")
        marked = _carried_last(marked, name, ordered)
    passed = {n: (F.col(n) > F.col("limit")) & (F.col(f"before_{n}") <= F.col("limit")) for n in ("upper", "lower")}
    return marked.select(
        bucket_label("bucket").alias("time"), "avg_score", "upper", "lower",
        F.when(passed["upper"], "up").when(passed["lower"], "down").alias("alarm"),
        bucket_label(F.when(passed["upper"], F.col("zero_upper")).when(passed["lower"], F.col("zero_lower"))).alias("since"),
    )


def _by_chunk(frame: DataFrame, *sums: Column) -> DataFrame:
    return frame.groupBy("chunk").agg(*sums)


def _before(name: str, least: Column) -> Column:
    """Over the chunks before each one; there are ``chunk`` times fewer rows than buckets."""
    return least.over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)).alias(name)


def _summed(frame: DataFrame, step: str, into: str) -> DataFrame:
    running = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    totals = frame.withColumn("_total", F.sum(step).over(running))
    chunks = _by_chunk(totals, F.sum(step).alias("_all"), F.min("_total").alias("_least"))
    offset = chunks.select("chunk", "_all", "_least", F.coalesce(_before("o", F.sum("_all")), F.lit(0.0)).alias("_offset"))
    low = F.coalesce(_before("l", F.min(F.col("_offset") + F.col("_least"))), F.lit(0.0))
    known = offset.select("chunk", "_offset", F.least(low, F.lit(0.0)).alias("_low"))
    joined = totals.join(known, "chunk")
    here = F.col("_offset") + F.col("_total")
    lowest = F.least("_low", F.col("_offset") + F.min("_total").over(running))
    return joined.withColumn(into, here - lowest).drop("_total", "_offset", "_low")


def _carried_max(frame: DataFrame, value: Column, into: str) -> DataFrame:
    """Largest value at or before each bucket."""
    running = Window.partitionBy("chunk").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    own = frame.withColumn("_value", value)
    chunks = _by_chunk(own, F.max("_value").alias("_most")).select("chunk", _before("_earlier", F.max("_most")))
    joined = own.join(chunks, "chunk")
    return joined.withColumn(into, F.greatest("_earlier", F.max("_value").over(running))).drop("_value", "_earlier")


def _carried_last(frame: DataFrame, name: str, ordered: Window) -> DataFrame:
    """The sum in the bucket before, zero before the first."""
    chunks = _by_chunk(frame, F.max_by(name, "bucket").alias("_end"))
    chunks = chunks.select("chunk", F.lag("_end").over(Window.orderBy("chunk")).alias("_earlier"))
    joined = frame.join(chunks, "chunk")
    before = F.coalesce(F.lag(name).over(ordered), F.col("_earlier"), F.lit(0.0))
    return joined.withColumn(f"before_{name}", before).drop("_earlier")
