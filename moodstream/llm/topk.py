"""Exact top-k inner products over an impact-ordered index, a score at a time.

Vectors are cut into shards.  In a shard every component that is not zero is a posting (row, value);
the postings of one dimension and one quantised impact, the bit length of the value, form a segment.
Segments are processed from the highest impact down, for a batch of queries at once, and partial
scores add up by row.  What the segments left out can still add to a row is at most |query| times the
length of the row's unprocessed part.  After each impact the best rows so far are scored exactly; a
row whose bound stays below the k-th of those scores is proven out.  A query stops once few rows are
left, which are rescored exactly, so the segments below are never read for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodstream.llm.vectors import matrix, usable
from moodstream.session import written

#: Rows of an index, and queries that one task puts to it, a batch after the other.
SHARD_ROWS = 16_384
QUERY_ROWS = 262_144
AT_ONCE = 64
#: Rows per query that may be rescored instead of processing the next segments.
RESCORED = 256

FOUND = "query_id long, vec_id long, score long"


def quantised(frame: DataFrame, id_column: str, vector: str, steps: int = 256) -> DataFrame:
    """``(id, vector)`` with every component as floor(steps * x)."""
    whole = usable(frame, id_column, vector)
    return whole.withColumn("vector", F.transform("vector", lambda x: F.floor(x * steps)))


class ImpactIndex:
    """Posting segments of a shard by descending impact.

    ``postings`` counts those the shard has, ``touched`` those read so far, once for each query.
    """

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.first = np.unique(self.ids, return_index=True)[1]  # a row of every id
        level = np.frexp(np.abs(self.values))[1]  # bit length of an integer
        rows, dims = np.nonzero(self.values)
        impact = level[rows, dims]
        order = np.lexsort((rows, dims, -impact))
        rows, dims, impact = rows[order], dims[order], impact[order]
        self.rows, self.entries = rows, self.values[rows, dims]
        starts = np.flatnonzero(np.diff(impact, prepend=-1) | np.diff(dims, prepend=-1))
        ends = np.append(starts[1:], len(rows))
        self.impacts = []
        for step in sorted(set(impact.tolist()), reverse=True):
            rest = np.where(level < step, self.values, 0.0)
            left = np.sqrt(np.einsum("ij,ij->i", rest, rest)) * (1 + 1e-9)
            chosen = impact[starts] == step
            segments = list(zip(dims[starts[chosen]], starts[chosen], ends[chosen]))
            self.impacts.append((segments, left))
        self.postings, self.touched = len(rows), 0

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, int, int]]:
        """``(query id, row id, score)`` of the k best ids for each query but its own."""
        for low in range(0, len(ids), AT_ONCE):
            yield from self._search(ids[low : low + AT_ONCE], queries[low : low + AT_ONCE], k)

    def _search(self, ids, queries, k):
        scores = np.zeros((len(self.ids), len(ids)))
        scores[self.ids[:, None] == ids[None, :]] = -np.inf
        possible = np.isfinite(scores)
        length = np.sqrt(np.einsum("ij,ij->i", queries, queries)) * (1 + 1e-9)
        live = np.arange(len(ids))
        for segments, left in self.impacts:
            for dim, low, high in segments:
                scores[self.rows[low:high]] += self.entries[low:high, None] * queries[live, dim]
                self.touched += (high - low) * len(live)
            least = self._kth(scores, queries[live], k)
            possible &= scores + left[:, None] * length[live] >= least
            done = possible.sum(axis=0) <= RESCORED
            for at in np.flatnonzero(done):
                yield from self._exact(ids[live[at]], queries[live[at]], np.flatnonzero(possible[:, at]), k)
            live, scores, possible = live[~done], scores[:, ~done], possible[:, ~done]
            if not len(live):
                return
        for at, query in enumerate(live):
            yield from self._exact(ids[query], queries[query], np.flatnonzero(possible[:, at]), k)

    def _kth(self, scores: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
        """For each query a score that k different ids reach: the least of the k best so far, exactly."""
        if len(self.first) < k:
            return np.full(len(queries), -np.inf)
        partial = scores[self.first]
        best = np.argpartition(partial, len(partial) - k, axis=0)[len(partial) - k :]
        exact = np.einsum("kqd,qd->kq", self.values[self.first[best]], queries)
        return np.where(np.isfinite(np.take_along_axis(partial, best, axis=0)), exact, -np.inf).min(axis=0)

    def _exact(self, query_id: int, query: np.ndarray, rows: np.ndarray, k: int):
        exact, own = self.values[rows] @ query, self.ids[rows]
        order = np.lexsort((own, -exact))
        ids, first = np.unique(own[order], return_index=True)  # the best row of every id
        for at in np.sort(first)[:k]:
            yield int(query_id), int(own[order[at]]), int(exact[order[at]])


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best ids of ``vectors`` for each id of ``queries``.

    Both hold ``(id, vector)`` with integers in doubles' exact range.  An id may have several
    vectors: all are searched and its best score counts.  A query never finds its own id.  Ties go
    to the smaller id; with fewer than k ids all come.  Each task indexes one shard once and reads
    the queries of one block in batches, as they come; it gives at most k rows a query, and a window
    ranks those.  No rows or no queries give no rows.
    """
    n, width = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    asked = queries.count()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-asked // QUERY_ROWS))

    def dealt(frame: DataFrame, own: str, parts: int, other: str, copies: int, asks: bool) -> DataFrame:
        placed = frame.withColumn(own, F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int"))
        placed = placed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        part = F.col("shard") * blocks + F.col("block")
        return placed.select(part.alias("part"), F.lit(asks).alias("asks"), "id", "vector")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, rows, index = None, [], None
        for frame in frames:
            for (now, asks), some in frame.groupby(["part", "asks"]):
                if now != part:
                    part, rows, index = now, [], None
                if not asks:
                    rows.append((some["id"].to_numpy(), matrix(some["vector"], width)))
                    continue
                if index is None and rows:
                    index = ImpactIndex(*map(np.concatenate, zip(*rows)))
                    rows = []
                if index is not None:
                    found = index.search(some["id"].to_numpy(), matrix(some["vector"], width), k)
                    yield pd.DataFrame(list(found), columns=["query_id", "vec_id", "score"], dtype="int64")

    both = dealt(vectors, "shard", shards, "block", blocks, False).unionByName(
        dealt(queries, "block", blocks, "shard", shards, True)
    )
    # rows of a shard come before the queries put to it
    placed = both.repartitionById(shards * blocks, "part").sortWithinPartitions("part", "asks")
    found = placed.mapInPandas(search, FOUND).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def search_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """Top-k of every id divisible by ``every``, among all other ids."""
    vectors = written(quantised(embeddings, "vec_id", "embedding"), "quantised")
    return top_k(vectors, vectors.where(F.col("id") % every == 0), k)
