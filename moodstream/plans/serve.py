"""Answers read from the hot tables of a run.

The two lists describe every post of the run (``scope="all"``) or the last whole batch
(``scope="batch"``); totals and trends always cover the run.  None of them reads the cold store.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moodstream.operators import posts as post_ops
from moodstream.operators import topics as topic_ops
from moodstream.operators import trends as trend_ops
from moodstream.streaming import state

NO_BATCH = -1


def _batch(spark: SparkSession, root: str, scope: str) -> int | None:
    if scope not in ("batch", "all"):
        raise ValueError("scope is 'batch' or 'all'")
    if scope == "all":
        return None
    newest = state.newest_batch(spark, root)
    return NO_BATCH if newest is None else newest


def latest_posts(spark: SparkSession, root: str, n: int = post_ops.SERVED, scope: str = "all") -> DataFrame:
    return post_ops.served_posts(state.latest_posts(spark, root, _batch(spark, root, scope)), n)


def topics(spark: SparkSession, root: str, n: int = topic_ops.SERVED, scope: str = "all") -> DataFrame:
    return topic_ops.served_topics(state.topics(spark, root, _batch(spark, root, scope)), n)


def stats(spark: SparkSession, root: str) -> DataFrame:
    """``total, positive, negative, neutral`` from exact counts; zeros before the first batch."""
    return state.totals(spark, root)


def trends(spark: SparkSession, root: str, period: str = "1h", as_of: float | None = None) -> DataFrame:
    return state.trends(spark, root, period, as_of).orderBy("time")


def trend_overview(spark: SparkSession, root: str, period: str = "1h", as_of: float | None = None) -> DataFrame:
    """Direction, latest, lowest and highest average, and sizes, of the period."""
    return trend_ops.summary(trends(spark, root, period, as_of))


def trend_summary(spark: SparkSession, root: str, period: str = "1h", as_of: float | None = None) -> DataFrame:
    """Direction and latest average of the period."""
    return trend_ops.trend_direction(trends(spark, root, period, as_of))
