"""Joins against reference lists."""

from __future__ import annotations

from pyspark.sql import DataFrame


def join_word_list(words: DataFrame, listed: DataFrame, how: str) -> DataFrame:
    """Join word occurrences to a word list on ``word``.

    Spark decides by the list's size in bytes whether to broadcast it.  If not, both sides are
    shuffled by a plain join, whose hot words adaptive execution splits over several tasks.
    """
    return words.join(listed, "word", how)
