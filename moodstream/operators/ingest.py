"""From raw event lines to flat post rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.text import _column
from moodstream.schemas import CORRUPT, EVENT_OR_CORRUPT, LINE

# Name of the source written into each post, share of posts kept, longest text taken.
SOURCE = "bluesky"
LANGUAGE = "en"
SAMPLE_FRACTION = 0.10
MAX_TEXT = 5000


def decode_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """One JSON document per row → event columns plus ``_corrupt_record`` for bad lines."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    event = F.from_json(F.col(value), EVENT_OR_CORRUPT, options)
    return lines.select(event.alias("event")).select("event.*")


def good_events(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def corrupt_lines(decoded: DataFrame) -> DataFrame:
    """The quarantine: lines that are not an event."""
    return decoded.where(F.col(CORRUPT).isNotNull()).select(CORRUPT)


def speaks(language: str = LANGUAGE, langs: Column | str = "commit.record.langs") -> Column:
    """The post names the language; a missing or null list does not."""
    return F.coalesce(F.array_contains(_column(langs), language), F.lit(False))


def new_posts(
    events: DataFrame, *, language: str | None = LANGUAGE, source: str = SOURCE
) -> DataFrame:
    """Newly created, non-empty posts in one language (``None``: any), flattened."""
    kept = events.where(
        (F.col("kind") == "commit")
        & (F.col("commit.operation") == "create")
        & (F.coalesce(F.col("commit.record.text"), F.lit("")) != "")
    )
    if language is not None:
        kept = kept.where(speaks(language))
    return kept.select(
        F.col("commit.rkey").alias("id"),
        "did",
        F.lit(source).alias("source"),
        (F.coalesce("time_us", F.lit(0)) / 1e6).alias("timestamp"),
        F.col("commit.record.text").alias("text"),
        F.col("commit.record.createdAt").alias("created_at"),
    )


def split_parsed_posts(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good posts of parsed lines, and the quarantine ``(reason, line)``.

    A line is set aside when it is no JSON of a post, or lacks the id or the time of one.
    """
    reason = (
        F.when(F.col(CORRUPT).isNotNull(), "corrupt")
        .when(F.col("id").isNull(), "no id")
        .when(F.col("timestamp").isNull(), "no time")
    )
    good = parsed.where(reason.isNull()).drop(CORRUPT, LINE)
    return good, parsed.where(reason.isNotNull()).select(reason.alias("reason"), F.col(LINE).alias("line"))


def with_id(posts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Posts that have an id, and the quarantine of those that have none."""
    return posts.where(F.col("id").isNotNull()), posts.where(F.col("id").isNull())


def random_sample(
    posts: DataFrame, fraction: float = SAMPLE_FRACTION, seed: int | None = None
) -> DataFrame:
    """Independent draw per row; works on batch and streaming frames alike."""
    draw = F.rand() if seed is None else F.rand(seed)
    return posts.where(draw <= fraction)


def hash_sample(
    posts: DataFrame, fraction: float = SAMPLE_FRACTION, key: Column | str = "id"
) -> DataFrame:
    """Reproducible draw: a key is always in or always out, whatever the batch or partitioning."""
    limit = format(min(int(fraction * 2**32), 2**32), "09x")
    prefix = F.concat(F.lit("0"), F.substring(F.md5(_column(key).cast("binary")), 1, 8))
    return posts.where(prefix < limit)


def text_in_bounds(text: Column | str = "text", longest: int | None = MAX_TEXT) -> Column:
    """Length from 1 to ``longest`` characters (``None``: any); null is out of bounds."""
    size = F.length(_column(text))
    return F.coalesce(size >= 1 if longest is None else size.between(1, longest), F.lit(False))


def split_by_bounds(
    posts: DataFrame, text: str = "text", longest: int = MAX_TEXT
) -> tuple[DataFrame, DataFrame]:
    """Rows to analyse, and the quarantine."""
    fits = text_in_bounds(text, longest)
    return posts.where(fits), posts.where(~fits)


def distinct_posts(posts: DataFrame, key: tuple[str, ...] = ("did", "id")) -> DataFrame:
    """One row per post; copies of a hot post already collapse before the shuffle."""
    return posts.dropDuplicates(list(key))
