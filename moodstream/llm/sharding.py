"""Reproducible global shuffle into shards: a Feistel permutation of global row numbers.

Rows are numbered 0 … n-1 in the order of stated keys.  A row's place in the shuffled order is a
keyed permutation of its number alone, so shard and slot of any row (and the row at any shard and
slot) can be computed without looking at other rows.  Only column functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodstream.llm.shared import in_order
from moodstream.session import written

MASK = (1 << 31) - 1
STIR, SPREAD = 1_103_515_245, 1_597_334_677


@dataclass(frozen=True)
class Permutation:
    """A permutation of 0 … n-1: alternating additions on a grid of ``a`` by ``b`` cells.

    The grid is the smallest near-square one that holds n numbers; a result outside 0 … n-1 is
    permuted again until it falls inside (cycle walking).  Fewer than ``a`` cells lie outside.
    """

    n: int
    keys: tuple[int, ...]
    a: int
    b: int

    @classmethod
    def of(cls, n: int, seed: str, rounds: int = 6) -> Permutation:
        keys = tuple(
            int.from_bytes(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:4], "big") & MASK
            for i in range(rounds)
        )
        a = max(1, isqrt(max(n, 1) - 1) + 1)
        return cls(n, keys, a, max(1, -(-n // a)))

    def once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i, key in enumerate(self.keys):
            if i % 2 == 0:
                left = (left + _mixed(right, key)) % self.a
            else:
                right = (right + _mixed(left, key)) % self.b
        return left * self.b + right

    def place(self, x: int) -> int:
        y = self.once(x)
        while y >= self.n:
            y = self.once(y)
        return y

    def row(self, place: int) -> int:
        """The row number at a place: the inverse of ``place``."""
        y = self._back(place)
        while y >= self.n:
            y = self._back(y)
        return y

    def _back(self, y: int) -> int:
        left, right = divmod(y, self.b)
        for i, key in reversed(list(enumerate(self.keys))):
            if i % 2 == 0:
                left = (left - _mixed(right, key)) % self.a
            else:
                right = (right - _mixed(left, key)) % self.b
        return left * self.b + right

    def walk(self) -> int:
        """How often any number must be permuted again at most: the longest way outside 0 … n-1.

        Only cells entered from inside count; fewer than ``a``, about the square root of n.
        """
        outside, steps = {y for y in range(self.n, self.a * self.b) if self._back(y) < self.n}, 0
        while outside:
            outside = {y for y in map(self.once, outside) if y >= self.n}
            steps += 1
        return steps

    def place_column(self, frame: DataFrame, number: str, name: str) -> DataFrame:
        """``frame`` with ``name``: the place of the row number in column ``number``."""
        frame = self._once_columns(frame, number, name)
        for _ in range(self.walk()):
            again = self._once_columns(frame, name, "_again")
            inside = F.col(name) < self.n
            frame = again.withColumn(name, F.when(inside, F.col(name)).otherwise(F.col("_again"))).drop("_again")
        return frame

    def _once_columns(self, frame: DataFrame, number: str, name: str) -> DataFrame:
        frame = frame.withColumn("_left", F.expr(f"{number} div {self.b}"))
        frame = frame.withColumn("_right", F.expr(f"{number} % {self.b}"))
        for i, key in enumerate(self.keys):
            side, other, size = ("_left", "_right", self.a) if i % 2 == 0 else ("_right", "_left", self.b)
            frame = frame.withColumn("_stir", (F.col(other) * STIR + key).bitwiseAND(MASK))
            frame = frame.withColumn("_stir", F.col("_stir").bitwiseXOR(F.shiftright("_stir", 15)) * SPREAD)
            frame = frame.withColumn("_stir", F.shiftright(F.col("_stir").bitwiseAND((1 << 46) - 1), 15))
            frame = frame.withColumn(side, (F.col(side) + F.col("_stir")) % size)
        return frame.withColumn(name, F.col("_left") * self.b + F.col("_right")).drop("_left", "_right", "_stir")


def _mixed(value: int, key: int) -> int:
    t = (value * STIR + key) & MASK
    t = (t ^ (t >> 15)) * SPREAD
    return (t & ((1 << 46) - 1)) >> 15


def number_rows(frame: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """``frame`` with ``row_no`` 0 … n-1 in the order of ``keys``, and n.

    Nulls come first; rows equal in all keys are numbered in any order.  One range shuffle; the
    sizes of the partitions (a row each) give the offsets.
    """
    placed = written(in_order(frame, *keys), "numbered")
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    n = placed.count()
    # a row for each partition of a shuffle: at most as many as spark.sql.shuffle.partitions
    joined = placed.join(F.broadcast(offsets), "part")
    return joined.withColumn("row_no", F.col("_before") + F.col("at")).drop("part", "at", "_before"), n


def shard_rows(frame: DataFrame, keys: list[str], shards: int, seed: str = "0") -> DataFrame:
    """``frame`` with ``row_no``, ``place``, ``shard`` (0 … shards-1) and ``slot`` (gapless from 0).

    Shard sizes differ by at most one row.  The same rows, keys and seed give the same shards and
    slots, whatever files or partitions the rows come in; rows equal in all keys may swap places.
    Nulls in keys come first.  An empty frame stays empty.  Columns of these names are replaced.
    """
    frame = frame.drop("row_no", "place", "shard", "slot")
    numbered, n = number_rows(frame, *keys)
    placed = Permutation.of(n, seed).place_column(numbered, "row_no", "place")
    return placed.withColumns({
        "shard": (F.col("place") % shards).cast("int"), "slot": F.expr(f"place div {shards}"),
    })


def shard_documents(documents: DataFrame, shards: int = 24, seed: str = "0") -> DataFrame:
    """Where each document goes: ids, sizes and places; a null text counts as empty.

    Size is the UTF-8 length and 8 bytes for the record.  Documents with equal ids are told apart
    by their texts' hashes and sizes; full copies are interchangeable.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("text_hash"),
    )
    # written first: a range shuffle samples its input, and the texts are to be read once
    return shard_rows(written(narrow, "sizes"), ["doc_id", "text_hash", "size"], shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_no", "place",
    )
