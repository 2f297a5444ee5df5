"""Numbers a dashboard shows, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodstream.functions.text import _column


def round_half_up(value: Column) -> Column:
    """Nearest whole number, halves upwards (also for negative values)."""
    return F.floor(value + 0.5).cast("long")


def gauge_score(avg_score: Column | str) -> Column:
    """-1 … +1 rescaled to 0 … 100; a missing average is the middle."""
    return round_half_up((F.coalesce(_column(avg_score), F.lit(0.0)) + 1) * 50)


def gauge_band(score: Column | str) -> Column:
    """Band of a 0 … 100 score."""
    score = _column(score)
    return F.when(score >= 65, "positive").when(score <= 40, "negative").otherwise("neutral")


def share(part: Column | str, whole: Column | str) -> Column:
    """Percentage, 0 when there is nothing; divides first, so halves fall as on the dashboard."""
    part, whole = _column(part), _column(whole)
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def whole_share(part: Column | str, whole: Column | str) -> Column:
    """Percentage rounded to a whole number, halves upwards."""
    return round_half_up(share(part, whole))


def dominant_mood(positive: Column | str, negative: Column | str, neutral: Column | str) -> Column:
    """The label whose whole-number percentage is strictly ahead of both others, else Neutral."""
    positive, negative, neutral = _column(positive), _column(negative), _column(neutral)
    return (
        F.when((positive > negative) & (positive > neutral), "Mostly Positive")
        .when((negative > positive) & (negative > neutral), "Mostly Negative")
        .otherwise("Neutral")
    )
