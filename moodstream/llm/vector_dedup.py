"""Embedding near-duplicates: spherical k-means cells, blocked cosine products inside each cell.

A vector is compared in its own cell and, since neighbours may lie across a border, in the earlier
cells whose border is near: within a proven distance, or within a margin (``PROBED``) that most
neighbours do not exceed and that leaves far fewer cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from moodstream.llm.components import connected_components
from moodstream.llm.shared import hash_share
from moodstream.llm.vectors import matrix, usable
from moodstream.session import written

#: Vectors that the cells are fitted on (a bound on what the driver holds).
FIT_ROWS = 32_768
CELL_ROWS = 1024
MAX_CELLS = 1024
#: Added to the reach of a vector, against rounding.
SLACK = 1e-9
BLOCK = 16_384
#: Margin of the query, in standard deviations of how far a neighbour in a random direction moves.
PROBED = 2.5
AT_ONCE = 512
#: Centroids nearer to each other than this are one cell, so that a hot group is not cut apart.
APART = 0.7


def fit_cells(unit: np.ndarray, cells: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Centroids of spherical k-means over unit vectors, no two of them close together."""
    order = np.random.default_rng(seed).permutation(len(unit))
    centres = _apart(unit[order], cells)
    for _ in range(rounds):
        home = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return _apart(centres, cells)


def _apart(vectors: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` vectors that are not close to one already chosen."""
    nearest, chosen = np.full(len(vectors), -1.0), []
    for _ in range(most):
        free = np.flatnonzero(nearest < APART)
        if not len(free):
            break
        chosen.append(vectors[free[0]])
        nearest = np.maximum(nearest, vectors @ chosen[-1])
        nearest[free[0]] = 1.0
    return np.array(chosen)


def near_groups(
    frame: DataFrame, id_column: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
    margin: float | None = None,
) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every id: links are pairs of cosine >= threshold.

    Cells are fitted on a bounded sample; every vector is placed.  A vector is compared in full
    double precision with all vectors of its own cell and of the earlier cells near it
    (``_reached``).  Without ``margin`` these are all that can hold a neighbour, so no pair is
    missed; with one, pairs across a border further away are.  No pair below the threshold is ever
    linked, and each counts once.  A cell above the block size is compared block against block in
    tasks of their own.  ``component_id`` is the smallest id reachable, ``kept`` marks it.  Vectors
    that are null, zero, or hold null or non-finite components link with nothing; shorter vectors
    are filled up with zeros; rows without an id are left out, repeated rows count once, and
    different vectors of one id are all compared: their links add up.
    """
    vectors = written(usable(frame, id_column, vector), "vectors")
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    single = isinstance(frame.schema[vector].dataType.elementType, FloatType)
    kind = np.float32 if single else np.float64  # as given: half the bytes to move
    found = written(_compare(_placed(vectors, n, width, kind, threshold, margin), kind, threshold), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("n_links")).withColumnRenamed("id", "_id")
    groups = connected_components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    ids = frame.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id")).distinct()
    joined = ids.join(counts, F.col("id") == F.col("_id"), "left").join(groups, F.col("id") == F.col("node"), "left")
    component = F.coalesce("component", "id")
    return joined.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def _unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as unit vectors in doubles, and their lengths, zero for rows of zeros, before."""
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True, initial=0)
    x /= np.where(scale > 0, scale, 1)  # no overflow in the length
    length = np.linalg.norm(x, axis=1)
    return x / np.where(length > 0, length, 1)[:, None], length


def _placed(
    vectors: DataFrame, n: int, width: int, kind: type, threshold: float, margin: float | None,
) -> DataFrame:
    """``(id, raw, cells)``: vectors as bytes and the cells they are compared in, own cell first."""
    sample = vectors.where(hash_share(FIT_ROWS / max(n, 1), "id", "vector")).orderBy("id").toPandas()
    rows, length = _unit(matrix(sample["vector"], width))
    rows = rows[length > 0]
    cells = max(1, min(MAX_CELLS, n // CELL_ROWS))
    centres = fit_cells(rows, cells) if len(rows) else np.eye(1, width)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            given = matrix(rows["vector"], width)
            x, length = _unit(given)
            fine = length > 0
            if fine.any():
                cells = _reached(x[fine], centres, threshold, margin)
                raw = [v.tobytes() for v in given[fine].astype(kind)]
                yield pd.DataFrame({"id": rows["id"].to_numpy()[fine], "raw": raw, "cells": cells})

    return written(vectors.mapInPandas(place, "id long, raw binary, cells array<int>"), "placed")


def _reached(
    unit: np.ndarray, centres: np.ndarray, threshold: float, margin: float | None = None,
) -> list[np.ndarray]:
    """Each vector's own cell and the earlier cells that a vector of cosine >= ``threshold`` may have for its own.

    A vector of cell h is no nearer to centre c than to h, so it lies on h's side of the plane between
    them.  From x in cell c that plane is (x.c - x.h) / |c - h| away, and a unit vector within the
    angle of the threshold gets at most the sine of that angle closer to it.  A neighbour in a random
    direction moves by about the tangent over the root of the dimensions; ``margin`` is how many
    times that distance is searched, should it be the smaller one.
    """
    likeness = unit @ centres.T
    home = likeness.argmax(axis=1)
    reach = np.sqrt(1 - threshold * threshold) + SLACK if threshold > 0 else np.inf
    if margin is not None and threshold > 0:
        spread = np.sqrt(1 - threshold * threshold) / threshold / np.sqrt(max(1, unit.shape[1] - 1))
        reach = min(reach, margin * spread)
    numbers = np.arange(len(centres), dtype=np.int32)
    found: list[np.ndarray] = [numbers[:1]] * len(unit)
    for c in np.unique(home):
        rows = np.flatnonzero(home == c)
        between = np.linalg.norm(centres[:c] - centres[c], axis=1)
        near = likeness[rows, c, None] - likeness[rows, :c] <= (reach * between if reach < np.inf else reach)
        for row, hit in zip(rows, near):
            found[row] = np.concatenate([numbers[c : c + 1], numbers[:c][hit]])
    return found


def _compare(placed: DataFrame, kind: type, threshold: float) -> DataFrame:
    """``(id, links, root)`` from each block pair of each cell: links found, smallest id connected."""
    members = placed.select("id", "raw", F.col("cells")[0].alias("home"), F.explode("cells").alias("cell"))
    # a row for each cell, of which there are at most MAX_CELLS
    sizes = members.groupBy("cell").agg(F.count(F.lit(1)).alias("size"))
    blocks = sizes.select("cell", F.ceil(F.col("size") / BLOCK).alias("blocks"))
    dealt = members.join(F.broadcast(blocks), "cell").withColumn("block", F.pmod(F.xxhash64("id", "raw"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        cell, low, high = (int(rows[c].iloc[0]) for c in ("cell", "low", "high"))
        unit = _unit(np.frombuffer(b"".join(rows["raw"]), kind).reshape(len(rows), -1))[0]
        own, block = rows["home"].to_numpy() == cell, rows["block"].to_numpy()
        links, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if low == high:
            sides = [(np.flatnonzero(own), np.arange(len(rows)))]
        else:
            first, second = block == low, block == high
            sides = [(np.flatnonzero(own & first), np.flatnonzero(second)),
                     (np.flatnonzero(~own & first), np.flatnonzero(own & second))]
        for left, right in sides:
            for at in range(0, len(left), AT_ONCE):
                i, j = np.nonzero(unit[left[at : at + AT_ONCE]] @ unit[right].T >= threshold)
                i, j = left[at + i], right[j]
                if low == high:
                    keep = (i < j) | ((i > j) & ~own[j])  # pairs inside the cell come twice
                    i, j = i[keep], j[keep]
                links += np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
                _hook(root, i, j)
        some = links > 0
        ids = rows["id"].to_numpy()
        return pd.DataFrame({"id": ids[some], "links": links[some], "root": ids[root[some]]})

    columns = dealt.select("cell", "low", "high", "block", "id", "raw", "home")
    return columns.groupBy("cell", "low", "high").applyInPandas(compare, "id long, links long, root long")


def _hook(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the groups of linked rows; ``root`` holds the smallest row of each group."""
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root[:] = root[root]
