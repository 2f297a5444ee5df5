"""Hook for a user's own star-rating model, run in Arrow batches inside the tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from moodstream.functions.scoring import star_prediction, star_value
from moodstream.functions.text import SPACES

RATING = "label string, score double, error string"

# Takes texts, returns one (rating label such as "4 stars", score) per text.
Model = Callable[[list[str]], list[tuple[str, float]]]


def rating_udf(make_model: Callable[[], Model], batch_size: int = 64):
    """Pandas UDF ``text -> struct<label, score, error>``.

    ``make_model`` runs once per Python worker task and should load the model there.  Texts reach
    the model whole; a text it fails on gets an error and does not spoil its batch.
    """

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        model = make_model()

        def rate_some(texts):
            try:
                rated = [(label, float(score), None) for label, score in model(texts)]
                if len(rated) != len(texts):
                    raise ValueError(f"{len(rated)} ratings for {len(texts)} texts")
                return rated
            except Exception as failure:
                if len(texts) == 1:
                    return [(None, None, str(failure))]
                return [row for text in texts for row in rate_some([text])]

        for texts in batches:
            blank = texts.fillna("").str.strip() == ""
            rated = pd.DataFrame(
                {"label": None, "score": None, "error": None}, index=texts.index, dtype=object
            )
            rated.loc[blank, "error"] = "Empty text"
            todo = texts[~blank]
            for start in range(0, len(todo), batch_size):
                part = todo.iloc[start : start + batch_size]
                rows = pd.DataFrame(
                    rate_some(list(part)), columns=["label", "score", "error"], index=part.index, dtype=object
                )
                rated.loc[part.index] = rows
            yield rated.astype({"score": "float64"})

    rate.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(rate, RATING)


def score_with_model(
    frame: DataFrame,
    make_model: Callable[[], Model],
    *,
    text: str = "text",
    into: str = "bert",
    batch_size: int = 64,
) -> DataFrame:
    """Add ``struct<label, confidence, raw_stars, raw_score, error>`` from the model's ratings."""
    rated = frame.withColumn("_rating", rating_udf(make_model, batch_size)(F.col(text)))
    prediction = star_prediction(F.col("_rating.label"), F.col("_rating.score"))
    return rated.withColumn(
        into, prediction.withField("error", F.col("_rating.error"))
    ).drop("_rating")


def model_sentiment(make_model: Callable[[], Model], *, text: str = "text", batch_size: int = 64):
    """A frame scorer for streams: adds ``sentiment`` from a user's own star model."""

    def score(posts: DataFrame) -> DataFrame:
        rated = score_with_model(posts, make_model, text=text, into="_stars", batch_size=batch_size)
        sentiment = F.struct(
            F.col("_stars.label").alias("label"), star_value("_stars.raw_stars").cast("double").alias("score")
        )
        return rated.withColumn("sentiment", sentiment).drop("_stars")

    return score


def windows(words: str, size: int, step: int) -> Column:
    """Overlapping runs of up to ``size`` words that begin every ``step`` words and reach the last one."""
    n = F.size(words)
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)
    return F.transform(starts, lambda i: F.slice(words, i + 1, size))


def score_long_texts(
    frame: DataFrame, make_scores: Callable[[], Callable[[list[str]], list[float]]], *, key: str = "id",
    text: str = "text", size: int = 256, step: int = 192, batch_size: int = 64,
) -> DataFrame:
    """``(key, score, lowest, highest, windows)``: a model with a bounded input over texts of any length.

    Each text is cut into overlapping windows of ``size`` words, so no part of it is unseen, and the
    model rates window by window in batches over all texts; a long text is many rows for many tasks.
    The windows' scores are averaged by their words.  A text without words has no score and no
    windows; of rows that share a key all windows count.  ``make_scores`` is called in each worker
    and gives a function from texts to scores.
    """
    if not 0 < step <= size:
        raise ValueError("step must lie between 1 and size")

    def load():
        rate = make_scores()

        def predict(texts):
            scores = np.asarray(rate([str(t) for t in np.asarray(texts).ravel()]), dtype=np.float64)
            if len(scores) != len(texts):
                raise ValueError(f"{len(scores)} scores for {len(texts)} texts")
            return scores

        return predict

    rated = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch_size)
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES), lambda w: w != "")
    cut = frame.select(key, words.alias("_words"))
    parts = cut.where(F.size("_words") > 0).select(key, F.explode(windows("_words", size, step)).alias("_part"))
    parts = parts.select(key, F.size("_part").alias("_n"), F.array_join("_part", " ").alias("_part"))
    scored = parts.withColumn("_score", rated("_part"))
    merged = scored.groupBy(key).agg(
        (F.sum(F.col("_score") * F.col("_n")) / F.sum("_n")).alias("score"), F.min("_score").alias("lowest"),
        F.max("_score").alias("highest"), F.count(F.lit(1)).alias("windows"),
    )
    return frame.select(key).distinct().join(merged, key, "left").fillna(0, ["windows"])
