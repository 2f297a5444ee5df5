"""Pack token ids into fixed-length sequences along a Hilbert curve.

Documents become hashed, length-normalised token vectors, projected to three dimensions.  Their
places on a Hilbert curve through that cube put similar documents side by side.  In curve order the
ids form one long run that is cut every ``length`` ids, so only the last sequence is padded.
"""

from __future__ import annotations

import string
import struct
from collections.abc import Iterator
from unicodedata import normalize

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from moodstream.llm.shared import in_order, portions, remembered
from moodstream.session import written

BUCKETS, DIMENSIONS, BITS = 256, 3, 16
#: Words whose ids a worker remembers, and as many again that it has met less lately.
REMEMBERED = 200_000
SPREAD = 12.0

#: Letters that lower-case and normalise one by one, whatever stands beside them.
_PLAIN = frozenset(
    c for c in map(chr, range(0x61, 0x180))
    if c.isalpha() and (c < "{" or c >= "\xc0") and len(c.lower()) == 1 and normalize("NFC", c) == c
)
_MARKS = string.punctuation
#: Encoded both ways when a tokenizer is loaded.
_PROBE = "Hello World again,  it's 3.14 N\xe9e\tDON'T\nEND-of x2 (ABC) na\xefve--so "
# The characters that stand for bytes in byte-level vocabularies.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
_TO_SHOWN = {b: c for b, c in _BYTES.items() if ord(c) != b}


class WordIds:
    """Ids of whole texts, word by word where the tokenizer never joins across ASCII white space.

    If it lower-cases and looks at each word alone, a word's ids are the same wherever it stands and
    are looked up once.  Plain letters with marks behind them go straight to the vocabulary's
    merges, letters and marks apart, as the tokenizer's own rules cut them; other words are encoded
    in full, and a text that may hold a special token as a whole.  Loading encodes a probe both ways;
    a tokenizer for which they differ encodes every text as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.by_word = True
        self.by_word = self.text(_PROBE) == self._encoded(_PROBE)

    def text(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if not text:
            return b""
        if "<|" in text or not self.by_word:
            return self._encoded(text)
        parts, out = text.encode("utf-8", "replace").lower().split(), []
        for low in range(0, len(parts), REMEMBERED):
            if len(self.known) > REMEMBERED:
                self.known, self.older = {}, self.known
            some = parts[low : low + REMEMBERED]
            ids = list(map(self.known.get, some))
            if None in ids:
                ids = [self._word(part) if found is None else found for part, found in zip(some, ids)]
            out += ids
        return b"".join(out)

    def _word(self, part: bytes) -> bytes:
        found = self.known.get(part) or self.older.get(part) or self._part(part)
        self.known[part] = found
        return found

    def _part(self, part: bytes) -> bytes:
        word = part.decode("utf-8", "replace")
        core = word.rstrip(_MARKS)
        if not core or not _PLAIN.issuperset(core.lower()):
            return self._encoded(word)
        shown = core.lower().encode().decode("latin-1").translate(_TO_SHOWN)
        ids = _packed([t.id for t in self.tokenizer.model.tokenize(shown)])
        return ids + self._word(part[len(core.encode()) :]) if len(core) < len(word) else ids

    def _encoded(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def projection(seed: int = 7) -> np.ndarray:
    """Fixed random directions from hashed token buckets to the cube."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMENSIONS)) / np.sqrt(BUCKETS)


def curve_keys(ids: list[bytes], directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document from its packed ids; documents without ids share one key."""
    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
    bucket = (flat * 2_654_435_761 >> 11) % BUCKETS
    owner = np.repeat(np.arange(len(ids)), sizes)
    counts = np.bincount(owner * BUCKETS + bucket, minlength=len(ids) * BUCKETS).reshape(len(ids), BUCKETS)
    length = np.sqrt((counts.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    places = (counts / np.maximum(length, 1)) @ directions
    grid = (1 << BITS) / (1 + np.exp(-SPREAD * places))
    return hilbert(np.minimum(grid, (1 << BITS) - 1).astype(np.int64), BITS)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), ``bits`` bits per coordinate.

    From the highest bit down: a set bit mirrors the first coordinate below it, a clear one swaps
    the lower part with the first coordinate's; Gray decoding then gives the curve's digits.
    """
    x = [points[:, k].copy() for k in range(points.shape[1])]
    for bit in range(bits - 1, 0, -1):
        high, low = 1 << bit, (1 << bit) - 1
        for k in range(len(x)):
            mirrored = (x[k] & high) > 0
            change = np.where(mirrored, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(mirrored, low, change)
            x[k] ^= change if k else 0
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & (1 << bit)) > 0, (1 << bit) - 1, 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | ((axis ^ turn) >> bit & 1)
    return key


def tokenised(frame: DataFrame, path: str, end: int, text: str = "text") -> DataFrame:
    """``frame`` without the text, with ``ids``, ``n_ids`` and ``curve_key``; written once.

    ``ids`` are little-endian unsigned 32-bit numbers, compressed; they end with ``end``, which an
    empty or null text has alone.
    """
    frame = frame.drop("ids", "n_ids", "curve_key")
    at = frame.columns.index(text)
    fields = [f for f in frame.schema.fields if f.name != text]
    schema = T.StructType([*fields, T.StructField("ids", T.BinaryType()), T.StructField("n_ids", T.LongType()),
                           T.StructField("curve_key", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered(f"ids of {path}", lambda: WordIds(path))
        directions, squeeze = projection(), zstandard.ZstdCompressor(level=1)
        last = _packed([end])
        for batch in batches:
            for part in portions(batch, at):
                ids = [words.text(t) + last for t in part.column(at).to_pylist()]
                keys = curve_keys([x[:-4] for x in ids], directions)
                rest = [c for k, c in enumerate(part.columns) if k != at]
                columns = [*rest, pa.array([squeeze.compress(x) for x in ids], pa.binary()),
                           pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(keys)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return written(frame.mapInArrow(run, schema), "ids")


def along_curve(rows: DataFrame) -> DataFrame:
    """``(row, first)`` from ``(row, curve_key, n_ids)``: where each row's ids begin in the long run.

    One range sort of narrow rows; running sums inside each range, offsets from the ranges' sums.
    """
    placed = written(in_order(rows, "curve_key", "row"), "curve")
    sums = placed.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_offset"))
    within = W.partitionBy("part").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    running = placed.withColumn("_within", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
    # a row for each partition of the range shuffle
    return running.join(F.broadcast(offsets), "part").select(
        "row", (F.col("_offset") + F.col("_within")).alias("first")
    )


def pack(frame: DataFrame, path: str, end: int, length: int = 4096, text: str = "text") -> DataFrame:
    """Pieces of all rows of ``frame``: its other columns, and where which ids go.

    ``start``: ids of the row before the piece; ``ids``: the piece's ids, little-endian unsigned
    32-bit; ``piece_length``; ``doc_tokens``: all ids of the row; ``sequence_id`` and ``offset``: the
    place, gapless from 0.  Every id lies in one piece.  All sequences but the last are full.
    Repeated rows are packed each; an empty frame gives no pieces.  Clashing columns are replaced.
    """
    frame = frame.drop("start", "ids", "piece_length", "doc_tokens", "sequence_id", "offset", "row", "first")
    rows = tokenised(frame.withColumn("row", F.monotonically_increasing_id()), path, end, text)
    first = written(along_curve(rows.select("row", "curve_key", "n_ids")), "places")
    placed = rows.join(first.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"))
    kept = [c for c in frame.columns if c != text]
    placed = placed.select(*kept, "ids", "first")
    extra = T.StructType.fromDDL(
        "start long, piece_length long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    schema = T.StructType([*placed.select(*kept).schema.fields, *extra.fields])
    at = placed.columns.index("ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezed = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in portions(batch, at):
                whole = [squeezed.decompress(x) for x in part.column(at).to_pylist()]
                sizes = np.array([len(x) // 4 for x in whole], np.int64)
                begin = part.column(at + 1).to_numpy(zero_copy_only=False)
                low, high = begin // length, (begin + sizes - 1) // length
                owner = np.repeat(np.arange(len(whole)), high - low + 1)
                fresh = np.arange(len(owner)) - np.repeat(np.cumsum(high - low + 1) - (high - low + 1), high - low + 1)
                sequence = low[owner] + fresh
                start = np.maximum(sequence * length - begin[owner], 0)
                stop = np.minimum((sequence + 1) * length - begin[owner], sizes[owner])
                ids = [whole[k][4 * a : 4 * b] for k, a, b in zip(owner, start, stop)]
                columns = [part.column(k).take(pa.array(owner)) for k in range(len(kept))]
                columns += [pa.array(start), pa.array(stop - start), pa.array(sizes[owner]), pa.array(sequence),
                            pa.array(begin[owner] + start - sequence * length), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return placed.mapInArrow(cut, schema)


def pack_documents(documents: DataFrame, path: str, end: int = 2, length: int = 4096) -> DataFrame:
    """Pieces of all documents, with the checksum of their ids instead of the ids."""
    pieces = pack(documents.select("doc_id", "text"), path, end, length)
    return pieces.select(
        "doc_id", "start", F.col("piece_length").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset",
    )
