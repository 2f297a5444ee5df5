"""Polarity of a text as the average over its words found in a lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.functions.scoring import polarity_sentiment
from moodstream.functions.text import histogram, tokens
from moodstream.operators.lookup import join_word_list


def lexicon_scores(
    posts: DataFrame, lexicon: DataFrame, *, key: str = "id", text: str = "text"
) -> DataFrame:
    """``(key, polarity, subjectivity)`` of every key; 0 where no word is in the lexicon.

    ``lexicon`` is ``(word, polarity, subjectivity)``, one row per word.  The result is narrow: the
    words of a post are counted in its own row, so a word costs a post one row however often it
    stands there, and neither a text nor a word without an entry goes further than the join.
    """
    counted = F.explode(histogram(tokens(text))).alias("_c")
    words = posts.select(key, counted).select(key, "_c.word", F.col("_c.n").alias("n"))
    found = join_word_list(words, lexicon, "inner")
    names = ("polarity", "subjectivity")

    def parts(name: str) -> list:
        n = F.when(F.col(name).isNotNull(), F.col("n"))
        return [(F.col(name) * n).cast("double").alias(name), n.alias(f"n_{name}")]

    nothing = [F.lit(None).cast(kind).alias(c) for name in names for c, kind in ((name, "double"), (f"n_{name}", "long"))]
    rows = found.select(key, *[c for name in names for c in parts(name)]).unionByName(posts.select(key, *nothing))

    def average(name: str):
        return F.coalesce(F.sum(name) / F.sum(f"n_{name}"), F.lit(0.0)).alias(name)

    return rows.groupBy(key).agg(*[average(name) for name in names])


def with_lexicon_scores(
    posts: DataFrame, lexicon: DataFrame, *, key: str = "id", text: str = "text"
) -> DataFrame:
    """Posts with ``polarity`` and ``subjectivity``; 0 where no word is in the lexicon.

    To keep other columns the posts are joined with their scores, which shuffles them; take
    ``lexicon_scores`` where the key is enough.
    """
    scores = lexicon_scores(posts, lexicon, key=key, text=text)
    return posts.join(scores, key, "left").fillna(0.0, ["polarity", "subjectivity"])


def lexicon_sentiment(lexicon: DataFrame, *, key: str = "id", text: str = "text"):
    """A frame scorer for streams: adds ``sentiment`` by text polarity."""

    def score(posts: DataFrame) -> DataFrame:
        scored = with_lexicon_scores(posts, lexicon, key=key, text=text)
        polarity = polarity_sentiment(text, F.round("polarity", 6))
        return scored.withColumn("sentiment", polarity).drop("polarity", "subjectivity")

    return score
