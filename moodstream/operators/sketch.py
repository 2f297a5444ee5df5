"""Heavy hitters in a fixed number of counters, mergeable, with bounds on every count.

A summary of ``k`` counters keeps the ``k`` largest counts, each less the ``k + 1``-st largest.  Sums of
summaries, cut down the same way, are a summary of all their rows (Misra and Gries; Agarwal et al.,
"Mergeable Summaries").  The cuts add up to an error of at most ``n / (k + 1)`` for ``n`` counted
occurrences, so every key above that share has a counter, and its true count lies between the
counter and the counter plus the error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summary(counts: DataFrame, k: int, *keys: str, count: str = "count") -> DataFrame:
    """``(keys, low, error, total)`` of exact counts, each key once.

    One more row, without keys and with a count of 0, holds error and total where all counters are cut
    away or nothing was counted.
    """
    facts = counts.agg(F.coalesce(F.sum(count), F.lit(0)).alias("total"), F.lit(0).cast("long").alias("before"))
    return _cut(counts.select(*keys, F.col(count).alias("low")), facts, k, keys)


def merged(summaries: DataFrame, k: int, *keys: str, part: str) -> DataFrame:
    """One summary of many; ``part`` tells whose row is whose."""
    each = summaries.groupBy(part).agg(F.first("error").alias("error"), F.first("total").alias("total"))
    facts = each.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("error"), F.lit(0)).alias("before")
    )
    held = summaries.where(F.col("low") > 0).groupBy(*keys).agg(F.sum("low").alias("low"))
    return _cut(held, facts, k, keys)


def _cut(held: DataFrame, facts: DataFrame, k: int, keys: tuple[str, ...]) -> DataFrame:
    """Keep ``k`` counters, less the next largest one; ``facts`` is one row."""
    largest = held.orderBy(F.desc("low"), *keys).limit(k + 1)  # each task sends k + 1 rows at most
    cut = largest.agg(F.when(F.count(F.lit(1)) > k, F.min("low")).otherwise(F.lit(0)).alias("cut")).scalar()
    facts = facts.select("total", cut.alias("cut"), (F.col("before") + cut).cast("long").alias("error"))
    known = facts.select(F.struct("total", "cut", "error")).scalar()
    kept = largest.where(F.col("low") > known["cut"]).select(
        *keys, (F.col("low") - known["cut"]).cast("long").alias("low"), known["error"].alias("error"), known["total"].alias("total")
    )
    none = [F.lit(None).cast(held.schema[key].dataType).alias(key) for key in keys]
    return kept.unionByName(facts.select(*none, F.lit(0).cast("long").alias("low"), "error", "total"))


def bounds(summary_rows: DataFrame) -> DataFrame:
    """``(keys, low, high, total)``: between which counts each kept key lies."""
    rest = [c for c in summary_rows.columns if c not in ("low", "error", "total")]
    rows = summary_rows.where(F.col("low") > 0)
    return rows.select(*rest, "low", (F.col("low") + F.col("error")).alias("high"), "total")
