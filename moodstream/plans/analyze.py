"""Full analysis of a table of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.scoring import keyword_prediction
from moodstream.functions.text import clean_text, is_blank, preview
from moodstream.operators.ingest import MAX_TEXT, text_in_bounds
from moodstream.operators.vote import WEIGHTS, vote

Predictor = Callable[[Column], Column]
OUT_OF_BOUNDS = "Text out of bounds"


def with_cleaned(frame: DataFrame, text: str = "text", **flags: bool) -> DataFrame:
    return frame.withColumn("cleaned", clean_text(text, **flags))


def analyze(
    frame: DataFrame,
    predictors: dict[str, Predictor] | None = None,
    weights: dict[str, float] | None = None,
    *,
    text: str = "text",
    longest: int | None = MAX_TEXT,
) -> DataFrame:
    """Clean each text, let the models vote on it, and keep previews of both forms.

    ``predictors`` are column functions from text to ``struct<label, confidence, …>``; a model whose
    struct column is already in ``frame`` (a joined or batch-scored model) needs none.  Unless
    ``weights`` says otherwise, the models that are there share the vote; one that has nothing to
    say about a row keeps its weight there.  Every row comes back: a text without characters, or
    with more than ``longest`` (``None``: no bound), is neutral with an error.
    """
    predictors = {"lstm": keyword_prediction} if predictors is None else predictors
    if weights is None:
        weights = {name: w for name, w in WEIGHTS.items() if name in predictors or name in frame.columns}
        if not weights:
            raise ValueError("no model to vote: give predictors, model columns or weights")
    cleaned = frame if "cleaned" in frame.columns else with_cleaned(frame, text)
    models = {name: predict(F.col("cleaned")) for name, predict in predictors.items()}
    fits = text_in_bounds(text, longest)
    voted = vote(cleaned.withColumns(models), weights, text="cleaned", blank=~fits | is_blank("cleaned"))
    refused = F.col("vote").withField("error", F.when(fits, F.col("vote.error")).otherwise(OUT_OF_BOUNDS))
    voted = voted.withColumn("vote", refused)
    kept = [name for name in frame.columns if name not in (text, "cleaned") and name not in (weights or {})]
    return voted.select(
        *kept,
        preview(text).alias("original_text"),
        preview("cleaned").alias("cleaned_text"),
        "vote.*",
    )
