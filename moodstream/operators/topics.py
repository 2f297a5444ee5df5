"""Word frequencies by label and the topic lists built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from moodstream.functions.display import round_half_up
from moodstream.functions.text import tokens
from moodstream.functions.wordlists import ENGLISH_STOP_WORDS, SOCIAL_STOP_WORDS
from moodstream.operators.lookup import join_word_list

# A topic word is longer than this; sizes of the stored, served and drawn lists.
MIN_LENGTH = 4
STORED, SERVED, DRAWN = 100, 20, 12


def stop_word_frame(spark, *lists: list[str]) -> DataFrame:
    """One-column ``word`` frame with the union of the lists (the two built-in ones by default)."""
    merged = set().union(*(lists or (ENGLISH_STOP_WORDS, SOCIAL_STOP_WORDS)))
    literals = F.array(*[F.lit(word) for word in sorted(merged)])
    return spark.range(1).select(F.explode(literals).alias("word"))


def word_rows(
    posts: DataFrame,
    *keep: str,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    stops: DataFrame | None = None,
    clean_first: bool = False,
) -> DataFrame:
    """One row per kept word occurrence, with the ``keep`` columns.

    The built-in stop list has a fixed size and is broadcast; a list passed in is joined as its size asks.
    """
    words = _long_words(posts, *keep, text=text, min_length=min_length, clean_first=clean_first)
    if stops is None:
        listed = stop_word_frame(posts.sparkSession)
        return words.join(F.broadcast(listed), "word", "left_anti").select(*_names(keep), "word")
    return join_word_list(words, stops, "left_anti").select(*_names(keep), "word")


def _long_words(posts: DataFrame, *keep: str, text: str, min_length: int, clean_first: bool) -> DataFrame:
    word = F.explode(tokens(text, clean_first=clean_first)).alias("word")
    return posts.select(*keep, word).where(F.length("word") > min_length)


def _names(columns: tuple[str, ...]) -> list[str]:
    return [name.rsplit(".", 1)[-1] for name in columns]


def topic_counts(
    scored: DataFrame,
    label: str = "sentiment.label",
    *,
    text: str = "text",
    min_length: int = MIN_LENGTH,
    stops: DataFrame | None = None,
    clean_first: bool = False,
) -> DataFrame:
    """Occurrences per ``(word, label)``; counts are summed before and after the shuffle.

    A stop list passed in takes the place of the built-in one and is applied to the counts, where
    every word is rare.
    """
    labelled = scored.withColumn("label", F.col(label))

    def counted(words: DataFrame) -> DataFrame:
        return words.groupBy("word", "label").agg(F.count(F.lit(1)).alias("count"))

    options = {"text": text, "min_length": min_length, "clean_first": clean_first}
    if stops is None:
        return counted(word_rows(labelled, "label", **options))
    return join_word_list(counted(_long_words(labelled, "label", **options)), stops, "left_anti")


def top_topics(counts: DataFrame, n: int = STORED) -> DataFrame:
    """The ``n`` most frequent ``(word, label)`` pairs, ties by word and label."""
    return counts.orderBy(F.desc("count"), "word", "label").limit(n)


def one_label_per_word(top: DataFrame) -> DataFrame:
    """Keep each word's most frequent label of a short top list."""
    first = Window.partitionBy("word").orderBy(F.desc("count"), "label")
    return (
        top.withColumn("_rank", F.row_number().over(first))
        .where(F.col("_rank") == 1)
        .select("word", "count", F.col("label").alias("sentiment_association"))
    )


def trending_topics(scored: DataFrame, n: int = STORED, **options) -> DataFrame:
    """The stored list: top pairs first, then one label per word."""
    return one_label_per_word(top_topics(topic_counts(scored, **options), n))


def served_topics(stored: DataFrame, n: int = SERVED) -> DataFrame:
    """The served list: most frequent first."""
    return stored.orderBy(F.desc("count"), "word").limit(n)


def topic_bars(served: DataFrame, n: int = DRAWN) -> DataFrame:
    """Bar width of each shown topic relative to the largest one shown."""
    shown = served.orderBy(F.desc("count"), "word").limit(n)
    largest = F.greatest(F.max("count").over(Window.partitionBy(F.lit(0))), F.lit(1))
    return shown.withColumn("width", round_half_up(F.col("count") / largest * 100))
