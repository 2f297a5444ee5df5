"""Scorers and label rules.

A *scorer* is any function from a text column to ``struct<label, score>``; jobs take one as an
argument and use :func:`keyword_sentiment` when none is given.  A *prediction* is the richer struct
a model returns, always with ``label`` and ``confidence``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodstream.functions.text import _column, is_blank
from moodstream.functions.wordlists import NEGATIVE_WORDS, POSITIVE_WORDS

Scorer = Callable[[Column], Column]

LABELS = ("negative", "neutral", "positive")

# Strict thresholds on polarity and on the vote score, and the probabilities that
# stand in for a class a model did not report.
POLARITY_THRESHOLD = 0.1
VOTE_THRESHOLD = 0.33
DEFAULT_PROBABILITIES = {"negative": 0.33, "neutral": 0.34, "positive": 0.33}


def label_by_threshold(value: Column | str, threshold: float) -> Column:
    """``positive`` above, ``negative`` below, ``neutral`` on or between the thresholds."""
    value = _column(value)
    return (
        F.when(value > threshold, "positive").when(value < -threshold, "negative").otherwise("neutral")
    )


def label_value(label: Column | str) -> Column:
    """-1, 0 or +1; an unknown or missing label counts 0."""
    label = _column(label)
    return F.when(label == "positive", 1.0).when(label == "negative", -1.0).otherwise(0.0)


def polarity_sentiment(
    text: Column | str, polarity: Column | str, threshold: float = POLARITY_THRESHOLD
) -> Column:
    """``struct<label, score>`` from a polarity computed elsewhere; empty text is neutral, 0."""
    text, polarity = _column(text), _column(polarity)
    usable = F.coalesce(F.when(F.coalesce(text, F.lit("")) != "", polarity), F.lit(0.0))
    return F.struct(
        label_by_threshold(usable, threshold).alias("label"), usable.cast("double").alias("score")
    )


def polarity_prediction(
    polarity: Column | str,
    subjectivity: Column | str,
    text: Column | str | None = None,
    threshold: float = POLARITY_THRESHOLD,
) -> Column:
    """Label plus a confidence that grows with distance from neutral and with subjectivity.

    Without a polarity or a subjectivity, or for a blank ``text`` if one is given, the prediction is
    neutral with confidence 0 and an error.
    """
    polarity, subjectivity = _column(polarity), _column(subjectivity)
    confidence = F.least(F.abs(polarity) * subjectivity + 0.3, F.lit(1.0))
    nothing = polarity.isNull() | subjectivity.isNull()
    blank = F.lit(False) if text is None else is_blank(text)
    usable = ~(blank | nothing)

    def rounded(value: Column) -> Column:
        return F.when(usable, F.round(value, 4)).otherwise(0.0)

    return F.struct(
        F.when(usable, label_by_threshold(polarity, threshold)).otherwise("neutral").alias("label"),
        rounded(confidence).alias("confidence"),
        rounded(polarity).alias("polarity"),
        rounded(subjectivity).alias("subjectivity"),
        F.when(blank, "Empty text").when(nothing, "No polarity").alias("error"),
    )


def polarity_value(prediction: Column | str) -> Column:
    """Numeric score of a polarity prediction, 0 when there is none."""
    return F.coalesce(_column(prediction).getField("polarity"), F.lit(0.0))


def _hits(text: Column, words: list[str]) -> Column:
    counted = [F.contains(text, F.lit(word)).cast("int") for word in words]
    return sum(counted[1:], counted[0])


def keyword_lean(
    text: Column | str, positive: list[str] | None = None, negative: list[str] | None = None
) -> Column:
    """-1, 0 or +1: which list has more of its words somewhere in the text (each at most once).

    Null text leans nowhere.  The result must not be null: ``element_at`` on a constant array takes
    the last element for a null index (seen on Spark 4.1.2).
    """
    lowered = F.lower(_column(text))
    balance = _hits(lowered, positive or POSITIVE_WORDS) - _hits(lowered, negative or NEGATIVE_WORDS)
    return F.coalesce(F.sign(balance).cast("int"), F.lit(0))


def keyword_prediction(
    text: Column | str, positive: list[str] | None = None, negative: list[str] | None = None
) -> Column:
    """Keyword scorer with its fixed confidence, polarity and subjectivity.

    The outcome is looked up in a constant array.  CASE branches per field would make each branch
    lower and scan the text again.
    """

    def outcome(label: str, confidence: float, polarity: float, subjectivity: float) -> Column:
        return F.struct(
            F.lit(label).alias("label"),
            F.lit(confidence).alias("confidence"),
            F.lit(polarity).alias("polarity"),
            F.lit(subjectivity).alias("subjectivity"),
        )

    blank = outcome("neutral", 0.0, 0.0, 0.0)
    outcomes = F.array(
        outcome("negative", 0.5, -0.3, 0.5),
        outcome("neutral", 0.5, 0.0, 0.5),
        outcome("positive", 0.5, 0.3, 0.5),
    )
    blanks = F.array(blank, blank, blank)
    lean = keyword_lean(text, positive, negative)
    return F.element_at(F.when(is_blank(text), blanks).otherwise(outcomes), lean + 2)


def keyword_sentiment(text: Column | str) -> Column:
    """The default scorer: ``struct<label, score>`` from the keyword lists."""

    def outcome(label: str, score: float) -> Column:
        return F.struct(F.lit(label).alias("label"), F.lit(score).alias("score"))

    neutral = outcome("neutral", 0.0)
    outcomes = F.array(outcome("negative", -0.3), neutral, outcome("positive", 0.3))
    return F.element_at(outcomes, keyword_lean(text) + 2)


def star_prediction(stars_label: Column | str, score: Column | str, text: Column | None = None) -> Column:
    """Label and confidence from a rating such as ``"4 stars"`` and the model's own score.

    A malformed or missing rating, or blank ``text``, gives neutral with confidence 0.
    """
    stars_label, score = _column(stars_label), _column(score)
    stars = F.regexp_extract(stars_label, r"^\s*([+-]?\d+)(?:\s|$)", 1).try_cast("int")
    usable = stars.isNotNull() & score.isNotNull()
    if text is not None:
        usable = usable & ~is_blank(text)
    distance = F.abs(stars - 3) / 2
    return F.when(
        usable,
        F.struct(
            F.when(stars <= 2, "negative").when(stars == 3, "neutral").otherwise("positive").alias("label"),
            F.round(score * (F.lit(0.7) + F.lit(0.3) * distance), 4).alias("confidence"),
            stars.alias("raw_stars"),
            F.round(score, 4).alias("raw_score"),
        ),
    ).otherwise(
        F.struct(
            F.lit("neutral").alias("label"),
            F.lit(0.0).alias("confidence"),
            F.lit(3).alias("raw_stars"),
            F.lit(0.0).alias("raw_score"),
        )
    )


def star_value(stars: Column | str) -> Column:
    """1 to 5 stars mapped to -1 … +1; a missing rating counts as three stars."""
    return (F.coalesce(_column(stars), F.lit(3)) - 3) / 2


def probability_value(probabilities: Column | str) -> Column:
    """p(positive) - p(negative) of a ``map<label, probability>``."""
    probabilities = _column(probabilities)

    def of(label: str) -> Column:
        found = F.try_element_at(probabilities, F.lit(label))
        return F.coalesce(found, F.lit(DEFAULT_PROBABILITIES[label]))

    return F.round(of("positive") - of("negative"), 4)


def score_texts(df, scorer: Scorer = keyword_sentiment, text: str = "text", into: str = "sentiment"):
    """Add the scorer's struct to ``df``."""
    return df.withColumn(into, scorer(F.col(text)))
