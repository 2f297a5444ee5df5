"""Weighted vote over the predictions of several models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from moodstream.functions.scoring import VOTE_THRESHOLD, label_by_threshold, label_value
from moodstream.functions.text import is_blank

# Models and their weights.
WEIGHTS = {"bert": 0.5, "lstm": 0.3, "rf": 0.2}


def join_predictions(posts: DataFrame, predictions: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Put each model's ``(key, label, confidence, …)`` frame beside the posts as a struct column.

    Of several predictions for one key the surest counts, then the first label by name, so that a
    repeated prediction never repeats a post; one a model skipped gets a null struct.
    """
    joined = posts
    for model, frame in predictions.items():
        fields = [name for name in frame.columns if name != key]
        order = F.struct(F.coalesce(-F.col("confidence"), F.lit(1.0)), F.coalesce("label", F.lit("")))
        single = frame.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias(model))
        joined = joined.join(single, key, "left")
    return joined


def vote(
    frame: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    text: str = "text",
    blank: Column | None = None,
    into: str = "vote",
    breakdown: bool = True,
) -> DataFrame:
    """Add the vote over the model struct columns named in ``weights``.

    A model without a prediction adds nothing, but its weight stays in the divisor; it is named in
    ``warnings`` and shown as ``error`` in ``breakdown``.  Blank text is neutral with an error; ``blank`` can
    carry that test instead of ``text``, so the text need not go through the joins.
    """
    weights = weights or WEIGHTS
    divisor = sum(weights.values())
    present = [model for model in weights if model in frame.columns]

    def weighted(value) -> Column:
        terms = [value(F.col(model)) * weights[model] for model in present]
        return sum(terms[1:], terms[0]) / divisor if terms else F.lit(0.0)

    score = weighted(lambda model: label_value(model.getField("label")))
    confidence = weighted(lambda model: F.coalesce(model.getField("confidence"), F.lit(0.0)))
    blank = is_blank(text) if blank is None else blank

    def missing(model: str) -> Column:
        return F.col(model).isNull() if model in present else F.lit(True)

    warnings = F.array_compact(
        F.array(*[F.when(missing(model), F.lit(f"{model}: no prediction")) for model in weights])
    )
    fields = {
        "label": F.when(blank, "neutral").otherwise(label_by_threshold(score, VOTE_THRESHOLD)),
        "confidence": F.when(blank, 0.0).otherwise(F.round(confidence, 4)),
        "score": F.when(blank, 0.0).otherwise(F.round(score, 4)),
        "error": F.when(blank, "Empty text"),
        "warnings": F.when(~blank, warnings),
    }
    if breakdown:
        parts: list[Column] = []
        for model, weight in weights.items():
            known = F.col(model) if model in present else None
            label = F.lit("error") if known is None else F.coalesce(known.getField("label"), F.lit("error"))
            sure = F.lit(0.0) if known is None else F.coalesce(known.getField("confidence"), F.lit(0.0))
            parts += [
                F.lit(model),
                F.struct(
                    label.alias("label"),
                    F.round(sure, 4).alias("confidence"),
                    F.lit(float(weight)).alias("weight"),
                ),
            ]
        fields["breakdown"] = F.when(~blank, F.create_map(*parts))
    return frame.withColumn(into, F.struct(*[value.alias(name) for name, value in fields.items()]))


def vote_sentiment(predictors: dict, weights: dict[str, float] | None = None, *, text: str = "text"):
    """A frame scorer for streams: adds ``sentiment`` by the vote of column predictors.

    ``predictors`` maps model names to functions from a text column to ``struct<label, confidence>``;
    without ``weights`` those models share the vote.
    """
    weights = weights or {model: WEIGHTS.get(model, 1.0) for model in predictors}

    def score(posts: DataFrame) -> DataFrame:
        models = {model: predict(F.col(text)) for model, predict in predictors.items()}
        voted = vote(posts.withColumns(models), weights, text=text, into="_vote", breakdown=False)
        sentiment = F.struct(F.col("_vote.label").alias("label"), F.col("_vote.score").alias("score"))
        return voted.withColumn("sentiment", sentiment).drop("_vote", *models)

    return score
