"""Ranked lexical search by one scan of the documents for all items' terms at once.

An Aho-Corasick automaton holds every term of the items between two guards, and runs over each
document with its separators turned into guards: what it reports are whole terms and how often they
stand there.  No index of the documents is built.  The automaton's outputs are numbers of terms; a
table from terms to items turns weighted term counts into the items' scores.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from moodstream.llm.shared import dealt_out, portions
from moodstream.session import written

#: What each byte of a text turns into: A-Z to lower case, digits, letters and bytes from 128 kept, the rest to guards.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
#: Bytes of item texts searched for in one scan.  More items than that take several scans.
BLOCK_BYTES = 8 << 20
#: Cells of the table of documents by items that a task fills at once.
CELLS = 1 << 22


def terms_of(text: str | None) -> list[str]:
    """Terms of a text in order."""
    return _guarded(text).decode("utf-8", "replace").split(" ")[1:-1] if text else []


def _guarded(text: str | None) -> bytes:
    """The terms of a text, each between two guards; neighbours share one."""
    found = (text or "").encode("utf-8", "replace").translate(_PLAIN).split()
    return b" ".join([b"", *found, b""]) if found else b" "


class Terms:
    """The automaton of a block of items, and which items hold which of its terms."""

    def __init__(self, ids: list, texts: list[str | None]):
        counts = [Counter(terms_of(text)) for text in texts]
        self.ids = ids
        self.terms = sorted(set().union(*counts))
        number = {term: k for k, term in enumerate(self.terms)}
        held = [[] for _ in self.terms]
        for item, counted in enumerate(counts):
            for term, times in counted.items():
                held[number[term]].append((item, times))
        self.starts = np.append(0, np.cumsum([len(x) for x in held])).astype(np.int64)
        self.item = np.array([i for x in held for i, _ in x], np.int64)
        self.times = np.array([t for x in held for _, t in x], np.int64)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, term in enumerate(self.terms or [""]):
            machine.add_word(f" {term} ", k)
        machine.make_automaton()
        return machine


def scan(documents: DataFrame, terms: Terms) -> DataFrame:
    """``(id, n, terms, tf)`` from ``(id, text)``: all terms of a document, and the items' terms in it."""
    given = dealt_out(documents.sparkSession, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = given().automaton()
        for batch in batches:
            for part in portions(batch, 1):
                n, sizes, found, times = [], [], [], []
                for text in part.column(1).to_pylist():
                    guarded = _guarded(text)
                    n.append(guarded.count(b" ") - 1)
                    hits = Counter(map(itemgetter(1), machine.iter(guarded.decode("utf-8", "replace"))))
                    sizes.append(len(hits))
                    found += hits.keys()
                    times += hits.values()
                offsets = np.append(0, np.cumsum(sizes)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(found, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))],
                    names=["id", "n", "terms", "tf"],
                )

    kind = documents.schema["id"].dataType.simpleString()
    return documents.mapInArrow(run, f"id {kind}, n long, terms array<int>, tf array<int>")


def weights(hits: DataFrame, terms: Terms) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and the weight of each of the items' terms."""
    some, total = hits.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    counted = hits.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = np.zeros(len(terms.terms), np.int64)
    for term, df in counted.collect():  # a row for each term of a block of items
        weight[term] = math.floor(1000 * math.log((2 * some + 2) / (2 * df + 1)))
    return some, total, weight


class Best:
    """The highest-scoring documents of each item so far; equal scores by id, a missing id last."""

    def __init__(self, items: int, k: int):
        self.k, self.least = k, np.ones(items, np.int64)
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.none, self.id = np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: a row for each document, a column for each item."""
        least = self.least
        if len(scores) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=0)[-self.k])
        row, item = np.nonzero(scores >= least)
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[row, item[len(self.item) :]]])
        none, ids = np.concatenate([self.none, none[row]]), np.concatenate([self.id, ids[row]])
        order = np.lexsort((ids, none, -score, item))
        item = item[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        order = order[rank < self.k]
        self.item, self.score, self.none, self.id = item[rank < self.k], score[order], none[order], ids[order]
        last = np.flatnonzero(rank[rank < self.k] == self.k - 1)
        self.least[self.item[last]] = self.score[last]


def scored(hits: DataFrame, terms: Terms, some: int, total: int, weight: np.ndarray, k: int, item_type: T.DataType) -> DataFrame:
    """``(number, item, id, score)``: the best ``k`` documents of each item in each task."""
    given = dealt_out(hits.sparkSession, (terms, weight))
    fields = [T.StructField("number", T.LongType()), T.StructField("item", item_type),
              T.StructField("id", T.LongType()), T.StructField("score", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weigh = given()
        items = len(table.ids)
        best, step = Best(items, k), max(1, CELLS // max(1, items))
        held = np.diff(table.starts)
        for batch in batches:
            for low in range(0, batch.num_rows, step):
                part = batch.slice(low, step)
                n = part.column(1).to_numpy(zero_copy_only=False)
                m = 25 + (75 * n * some) // max(1, total)
                rows = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                term = part.column(2).flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), rows)
                part_score = weigh[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                spread = held[term]
                at = np.arange(spread.sum()) - np.repeat(np.cumsum(spread) - spread, spread) + np.repeat(table.starts[term], spread)
                scores = np.zeros(part.num_rows * items, np.int64)
                np.add.at(scores, np.repeat(row, spread) * items + table.item[at], np.repeat(part_score, spread) * table.times[at])
                ids = part.column(0)
                best.add(scores.reshape(-1, items), np.asarray(ids.is_null()), ids.fill_null(0).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array([table.ids[i] for i in best.item], schema.field("item").type),
             pa.array(best.id, pa.int64(), mask=best.none), pa.array(best.score)], names=[f.name for f in fields])

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType(fields))
    return hits.mapInArrow(run, T.StructType(fields))


def best_of(rows: DataFrame, k: int, *keys: str) -> DataFrame:
    order = W.partitionBy(*keys).orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """The items ``(item, text)`` in lists of at most about twice ``block_bytes`` of text, or of one item."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 16
    n, total = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    blocks = -(-total // block_bytes)
    while True:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(max(1, blocks))))
        most = dealt.groupBy("block").agg(F.sum(size).alias("bytes")).agg(F.max("bytes")).first()[0] or 0
        if most <= 2 * block_bytes or blocks > 8 * n:
            break
        blocks *= 2
    for block in range(blocks):
        yield dealt.where(F.col("block") == block).select("item", "text").orderBy("item", "text").collect()


def search(
    documents: DataFrame, items: DataFrame, k: int = 10, *, id_column: str = "doc_id", item_column: str = "item_id",
    text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(item, rank, id, score)``: the ``k`` documents of each item with the highest scores above 0.

    A term's weight falls with the documents that hold it; a document's score sums, over the item's
    terms with repeats, weight times a saturating term frequency, in 64-bit integers.  Equal scores
    rank by ascending id, a null id last.  Null and empty texts have no terms: such documents count
    nowhere, such items give no rows.  Each row of ``items`` is an item of its own, also where ids
    repeat, and each row of ``documents`` a document; ids are integers.  Other columns are not read.

    Items are searched for in blocks with a bound on their text; each block scans all documents once.
    """
    texts = documents.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    asked = items.select(F.col(item_column).alias("item"), F.col(text).alias("text"))
    found = None
    for rows in item_blocks(asked, block_bytes):
        terms = Terms([row[0] for row in rows], [row[1] for row in rows])
        hits = written(scan(texts, terms), "hits")
        near = scored(hits, terms, *weights(hits, terms), k, asked.schema["item"].dataType)
        # first among some of the tasks, then among all
        some = best_of(near.withColumn("task", F.spark_partition_id() % 64), k, "number", "task").drop("rank")
        best = best_of(some, k, "number").select("item", "rank", "id", "score")
        found = best if found is None else found.unionByName(best)
    if found is None:
        found = asked.where(F.lit(False)).select(
            "item", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score")
        )
    return found.select(F.col("item").alias(item_column), "rank", F.col("id").alias(id_column), "score")
