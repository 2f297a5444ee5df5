"""Label counts, running totals and percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.display import dominant_mood, share, whole_share
from moodstream.session import written

SENTIMENT_LABEL = "sentiment.label"
SHOWN = ("positive", "negative", "neutral")


def label_counts(
    scored: DataFrame, label: str = SENTIMENT_LABEL, by: tuple[str, ...] = ()
) -> DataFrame:
    """One row per label (and ``by``): the mergeable partial of a batch."""
    return scored.groupBy(*by, F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def label_distribution(scored: DataFrame, label: str = SENTIMENT_LABEL) -> DataFrame:
    """One row ``total, positive, negative, neutral``; all zeros for no input."""
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(label) == name).alias(name) for name in SHOWN],
    )


def distribution_of_counts(counts: DataFrame, *extra: Column) -> DataFrame:
    """The same row from ``(label, n)`` partials of any number of batches."""
    return counts.agg(*_sums(F.col("label"), F.col("n")), *extra)


def _sums(label: Column, n: Column) -> list[Column]:
    def total(value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0)).cast("long")

    return [total(n).alias("total")] + [
        total(F.when(label == name, n)).alias(name) for name in SHOWN
    ]


def with_percentages(distribution: DataFrame) -> DataFrame:
    """Add ``positive_pct``, ``negative_pct`` and ``neutral_pct``."""
    return distribution.withColumns(
        {f"{name}_pct": share(name, "total") for name in SHOWN}
    )


def stat_cards(distribution: DataFrame) -> DataFrame:
    """Post count and whole-number percentages."""
    return distribution.select(
        "total", *[whole_share(name, "total").alias(f"{name}_percent") for name in SHOWN]
    )


def mood(distribution: DataFrame) -> DataFrame:
    """The dominant label, judged on whole-number percentages."""
    cards = stat_cards(distribution)
    leading = dominant_mood("positive_percent", "negative_percent", "neutral_percent")
    return cards.withColumn("mood", leading)


def running_totals(parts: DataFrame, block: int = 1024) -> DataFrame:
    """All-time totals after each batch, from ``(batch_id, label, n)`` partials.

    A prefix sum in two levels: within blocks of batches, plus what all earlier blocks held, so no
    single task sorts the whole batch history.  The sums per batch are written first, so that the
    posts behind them are scored once.
    """
    names = ["total", *SHOWN]
    per_batch = parts.groupBy("batch_id").agg(*_sums(F.col("label"), F.col("n")))
    per_batch = written(per_batch.withColumn("_block", F.floor(F.col("batch_id") / block)), "per-batch")

    held = per_batch.groupBy("_block").agg(*[F.sum(name).alias(name) for name in names])
    in_order = Window.partitionBy(F.lit(0)).orderBy("_block")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    before = held.select(
        "_block", *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"_{name}") for name in names]
    )

    so_far = (
        Window.partitionBy("_block").orderBy("batch_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    within = per_batch.select(
        "batch_id", "_block", *[F.sum(name).over(so_far).alias(name) for name in names]
    )
    return within.join(before, "_block").select(
        "batch_id", *[(F.col(name) + F.col(f"_{name}")).alias(name) for name in names]
    )


def latest_totals(totals: DataFrame) -> DataFrame:
    """The row of the highest batch id."""
    newest = totals.agg(F.max_by(F.struct(*totals.columns), "batch_id").alias("row"))
    return newest.where(F.col("row").isNotNull()).select("row.*")
