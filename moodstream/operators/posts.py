"""Latest posts and their display form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Posts kept for display, posts served by default.
STORED, SERVED = 50, 20


def latest(posts: DataFrame, n: int) -> DataFrame:
    """Newest ``n`` rows; equal times are ordered by id."""
    return posts.orderBy(F.desc("timestamp"), "id").limit(n)


def latest_with_details(keys: DataFrame, details: DataFrame, n: int, on: str = "id") -> DataFrame:
    """Newest ``n`` rows when the wide columns live in another table.

    The choice is made on the narrow ``keys``; only the ``n`` chosen rows are broadcast to pick up
    their details, so the wide table is scanned but never shuffled.
    """
    return F.broadcast(latest(keys, n)).join(details, on)


def stored_form(scored: DataFrame) -> DataFrame:
    return scored.select(
        "id", "source", "timestamp", "text",
        F.col("sentiment.label").alias("label"), F.col("sentiment.score").alias("score"),
        "created_at",
    )


def latest_distinct(posts: DataFrame, n: int, key: tuple[str, ...] = ("did", "id")) -> DataFrame:
    """Newest ``n`` posts, each once.

    Copies are folded and the choice is made on key and time alone; then the ``n`` chosen keys are
    broadcast to pick their rows out of the scan, so no text is shuffled but that of the result.  Of
    copies with one time and different contents the one first in the order of ``source`` and
    ``text`` is shown.
    """
    newest = latest(posts.groupBy(*key).agg(F.max("timestamp").alias("timestamp")), n)
    columns = [*key, "timestamp"]
    chosen = newest.select(*[F.col(name).alias(f"_{name}") for name in columns])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in columns]
    found = posts.join(F.broadcast(chosen), same, "left_semi")
    first = F.min_by(F.struct(*posts.columns), F.struct("source", "text")).alias("_row")
    return found.groupBy(*[F.col(name).alias(f"_{name}") for name in key]).agg(first).select("_row.*")


def recent_posts(scored: DataFrame, n: int = STORED) -> DataFrame:
    """Stored form of the newest distinct posts."""
    return stored_form(latest_distinct(scored, n))


def served_posts(stored: DataFrame, n: int = SERVED) -> DataFrame:
    """Response form: ``id, title, subreddit, sentiment``."""
    return latest(stored, n).select(
        "id",
        F.col("text").alias("title"),
        F.col("source").alias("subreddit"),
        F.struct("label", "score").alias("sentiment"),
    )


def post_feed(served: DataFrame, default_source: str = "bluesky") -> DataFrame:
    """Feed cards: missing or empty values replaced by their defaults."""

    def filled(column: str, default: str):
        return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))

    return served.select(
        "id",
        filled("subreddit", default_source).alias("source"),
        filled("sentiment.label", "neutral").alias("label"),
        filled("title", "No content").alias("content"),
    )
