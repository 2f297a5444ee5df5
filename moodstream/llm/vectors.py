"""Vectors as both vector operators take them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: str) -> Column:
    """True where every component is there and finite; false for null and empty vectors."""
    ends = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (x < ends) & (x > -ends))
    return F.coalesce((F.size(vector) > 0) & fine, F.lit(False))


def usable(frame: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, vector)`` in doubles, one row for each different whole vector of an id.

    Rows without an id, and vectors that are null, empty or hold null or non-finite components, are
    left out; a row that stands there again counts once.
    """
    rows = frame.where(F.col(id_column).isNotNull() & whole(vector)).select(
        F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")
    )
    return rows.distinct()


def matrix(vectors, width: int) -> np.ndarray:
    """Rows of doubles; a vector shorter than ``width`` is filled up with zeros."""
    if not len(vectors):
        return np.zeros((0, width))
    if all(len(v) == width for v in vectors):
        return np.stack([np.asarray(v, np.float64) for v in vectors])
    out = np.zeros((len(vectors), width))
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    return out
