"""Average-score series per time bucket, their merge, and their direction."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.display import gauge_band, gauge_score
from moodstream.functions.timebuckets import (
    BUCKET_FORMAT,
    BUCKET_SECONDS,
    CHART_PERIOD_HOURS,
    PERIOD_HOURS,
    SHIFT_SECONDS,
    bucket_label,
    bucket_start,
    clock_label,
    period_cutoff,
)
from moodstream.session import written

# Smallest change of the average, and of the 0-100 score, that counts as a movement.
DIRECTION_STEP = 0.05
CHART_STEP = 3


def trend_partials(
    scored: DataFrame,
    unit: str = "minute",
    *,
    score: str = "sentiment.score",
    timestamp: str = "timestamp",
    key: str = "id",
    shift: int = SHIFT_SECONDS,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """``(bucket, sum_score, n)``, per ``by`` if given: sums merge exactly, averages would not.

    Rows without a ``key`` count in neither, so the average fits its count.
    """
    return scored.groupBy(*by, bucket_start(timestamp, unit, shift).alias("bucket")).agg(
        F.sum(F.when(F.col(key).isNotNull(), F.col(score))).alias("sum_score"), F.count(key).alias("n")
    )


def merge_trends(parts: DataFrame) -> DataFrame:
    """Fold partials of any number of batches into the series ``time, avg_score, count``."""
    merged = parts.groupBy("bucket").agg(F.sum("sum_score").alias("sum_score"), F.sum("n").alias("n"))
    return finish_trend(merged)


def finish_trend(partials: DataFrame) -> DataFrame:
    """Series from partials that hold each bucket once."""
    average = F.when(F.col("n") > 0, F.col("sum_score") / F.col("n"))
    return partials.select(
        bucket_label("bucket").alias("time"), average.alias("avg_score"), F.col("n").alias("count")
    )


def trend(scored: DataFrame, unit: str = "minute", **columns) -> DataFrame:
    """The series of one frame in one pass."""
    return finish_trend(trend_partials(scored, unit, **columns))


def in_period(
    series: DataFrame, period: str = "1h", as_of: float | None = None, shift: int = SHIFT_SECONDS
) -> DataFrame:
    """Buckets of the last ``period`` before ``as_of`` (now if not given), oldest first.

    An unknown period counts as one hour; labels compare as strings.
    """
    hours = PERIOD_HOURS.get(period, 1)
    return series.where(F.col("time") >= period_cutoff(hours, as_of, shift)).orderBy("time")


def period_start(period: str = "1h", as_of: float | None = None, shift: int = SHIFT_SECONDS) -> int:
    """First bucket number inside the period, a plain number that scans and folders are pruned by.

    The same buckets as ``in_period`` gives: labels stop at the minute.
    """
    now = time.time() if as_of is None else as_of
    seconds = math.floor(now + shift - PERIOD_HOURS.get(period, 1) * 3600)
    return seconds - seconds % 60


def trend_in_period(
    scored: DataFrame, period: str = "1h", as_of: float | None = None, unit: str = "minute",
    *, timestamp: str = "timestamp", shift: int = SHIFT_SECONDS, **columns,
) -> DataFrame:
    """The series of the period, from raw scored rows; older rows are left out before grouping."""
    width = BUCKET_SECONDS[unit]
    first = -(-period_start(period, as_of, shift) // width) * width
    recent = scored.where(F.col(timestamp) >= float(first - shift))
    return trend(recent, unit, timestamp=timestamp, shift=shift, **columns).orderBy("time")


def in_period_or_all(
    series: DataFrame, period: str = "All", as_of: float | None = None, shift: int = SHIFT_SECONDS
) -> DataFrame:
    """Buckets of the chart period; the whole series when the period holds none.

    The series is written once to the shared folder and decided on from there.
    """
    hours = CHART_PERIOD_HOURS.get(period)
    if hours is None:
        return series.orderBy("time")
    series = written(series, "series")
    now = F.unix_timestamp().cast("double") if as_of is None else F.lit(float(as_of))
    start = F.unix_timestamp(F.to_timestamp("time", BUCKET_FORMAT)) - shift
    recent = now - start <= hours * 3600
    found = series.where(recent).agg(F.count(F.lit(1))).scalar()
    return series.where(recent | (found == 0)).orderBy("time")


def _newest_two(series: DataFrame) -> DataFrame:
    # A limit of two rows is a top-k, so the window that follows never sees more than two rows.
    newest = series.select("time", "avg_score").orderBy(F.desc("time")).limit(2)
    earlier = F.lag("avg_score").over(Window.partitionBy(F.lit(0)).orderBy("time"))
    return newest.withColumn("previous", earlier)


def trend_direction(series: DataFrame) -> DataFrame:
    """One row ``trend_direction, avg_score``: last bucket against the last one before it."""
    change = F.max_by(F.col("avg_score") - F.col("previous"), "time")
    return _newest_two(series).agg(
        F.when(change > DIRECTION_STEP, "rising")
        .when(change < -DIRECTION_STEP, "falling")
        .otherwise("stable")
        .alias("trend_direction"),
        F.coalesce(F.max_by("avg_score", "time"), F.lit(0.0)).alias("avg_score"),
    )


def chart_series(series: DataFrame) -> DataFrame:
    """Points of the chart: clock label, 0-100 score with its band, count."""
    score = gauge_score("avg_score")
    return series.select(
        F.col("time"),
        clock_label("time").alias("clock"),
        score.alias("score"),
        gauge_band(score).alias("band"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def chart_trend(chart: DataFrame) -> DataFrame:
    """One row: last score minus first, and its label."""
    change = F.coalesce(F.max_by("score", "time") - F.min_by("score", "time"), F.lit(0))
    moved = chart.agg(change.alias("change"))
    return moved.withColumn(
        "trend",
        F.when(F.col("change") > CHART_STEP, "Rising")
        .when(F.col("change") < -CHART_STEP, "Falling")
        .otherwise("Stable"),
    )


def rolling(parts: DataFrame, unit: str = "hour", span: int = 24, chunk: int = 24 * 64) -> DataFrame:
    """Mean and spread of the ``span`` buckets before each bucket, and the bucket's z-score.

    The series is cut into chunks of ``chunk`` buckets; the last ``span`` buckets of a chunk are
    also given to the next one, so every window is whole and the chunks run in parallel.  The span
    is clock time: an empty bucket inside it is simply absent.
    """
    if span > chunk:
        raise ValueError("chunk must be at least as long as span")
    width = BUCKET_SECONDS[unit]
    merged = parts.groupBy("bucket").agg(F.sum("sum_score").alias("sum_score"), F.sum("n").alias("n"))
    series = merged.where(F.col("n") > 0).select(
        (F.col("bucket") / width).cast("long").alias("step"),
        F.col("bucket"),
        (F.col("sum_score") / F.col("n")).alias("avg_score"),
        F.col("n").alias("count"),
    )
    own = F.floor(F.col("step") / chunk)
    reaches = F.floor((F.col("step") + span) / chunk)
    placed = series.withColumn("_own", own).withColumn("_chunk", F.explode(F.sequence(own, reaches)))

    before = Window.partitionBy("_chunk").orderBy("step").rangeBetween(-span, -1)
    mean, spread = F.avg("avg_score").over(before), F.stddev_samp("avg_score").over(before)
    measured = placed.withColumn("rolling_avg", mean).withColumn("spread", spread)
    z_score = F.when(
        F.col("spread") > 0, (F.col("avg_score") - F.col("rolling_avg")) / F.col("spread")
    )
    return measured.where(F.col("_chunk") == F.col("_own")).select(
        bucket_label("bucket").alias("time"), "avg_score", "count", "rolling_avg",
        z_score.alias("z_score"),
    )


def summary(series: DataFrame) -> DataFrame:
    """One row: direction, latest, lowest and highest average, number of buckets and posts."""
    whole: list[Column] = [
        F.min("avg_score").alias("min_avg"),
        F.max("avg_score").alias("max_avg"),
        F.count(F.lit(1)).alias("buckets"),
        F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("posts"),
    ]
    newest = trend_direction(series).select(F.struct("trend_direction", "avg_score")).scalar()
    return series.agg(*whole).select(
        newest.getField("trend_direction").alias("trend_direction"),
        newest.getField("avg_score").alias("latest_avg"),
        "min_avg", "max_avg", "buckets", "posts",
    )
