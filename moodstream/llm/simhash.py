"""SimHash near-duplicates found through deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits.  Fingerprints that differ in at most two
bits differ in at most one bit in one of the segments, so they share one of that segment's
variants: the segment with one bit left out.  Variants are joined by equality and verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from moodstream.llm.components import connected_components
from moodstream.session import written

SEED = 42
SHINGLE = 3
DISTANCE = 2
BLOCK = 1 << 15
#: Buckets of more fingerprints than this are compared by flipped bits instead of pair by pair.
SMALL_BUCKET = 32


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles of a whole text, repeats counted; 0 without words."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return 0
    joined = b" ".join(parts)
    starts = [0, *accumulate(len(part) + 1 for part in parts)]
    count = max(1, len(parts) - words + 1)
    width = min(words, len(parts))
    bits, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for low in range(0, count, BLOCK):
        high = min(low + BLOCK, count)
        hashes = np.array(
            [digest(joined[i : j - 1], SEED) for i, j in zip(starts[low:high], starts[low + width : high + width])],
            np.uint64,
        )
        bits += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int.from_bytes(np.packbits(2 * bits > count, bitorder="little").tobytes(), "little")


def with_fingerprints(frame: DataFrame, id_column: str = "doc_id", text: str = "text", *more: str) -> DataFrame:
    """``(id, more..., fp)`` of every row; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py()) for t in batch.column(0)], np.uint64)
            columns = [*batch.columns[1:], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    narrow = frame.select(text, id_column, *more)
    schema = T.StructType([*narrow.schema.fields[1:], T.StructField("fp", T.LongType())])
    return narrow.mapInArrow(run, schema)


def close_pairs(prints: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints (column ``fp``, each once) within two bits.

    The signature of a variant holds the segment, the bit left out and the rest of the segment.
    In a bucket of up to 32 fingerprints every pair is verified, each pair in its first variant.
    Fingerprints of a larger bucket are put out as ``(fp, fp)`` and linked exactly by
    ``flip_links``: no bucket is cut short, and none is compared pair by pair without bound.
    """
    segment = [F.col("fp").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("fp", 32)]
    variants = F.array(*[
        F.array(*[
            segment[s].bitwiseAND(0xFFFFFFFF ^ (1 << j)).bitwiseOR(((s << 5) | j) << 32) for j in range(32)
        ])
        for s in (0, 1)
    ])
    signed = prints.select("fp", F.explode(F.flatten(variants)).alias("sig"))
    found = signed.repartition("sig").sortWithinPartitions("sig", "fp").mapInArrow(_verify, "a long, b long")
    found = written(found, "close")
    hot = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    return found.where("a != b").unionByName(flip_links(hot))


def flip_links(prints: DataFrame) -> DataFrame:
    """Links of fingerprints within two bits, through the values at one flipped bit or none.

    Two fingerprints differ in at most two bits just when some value is at most one bit away from
    both; those around one value number at most 65 and are all within two bits of each other.
    """
    flips = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << j))) for j in range(64)])
    near = prints.select("fp", F.explode(flips).alias("middle"))
    first = F.min("fp").over(W.partitionBy("middle"))
    return near.select(F.col("fp").alias("a"), first.alias("b")).where("a != b").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare neighbours in buckets of equal signatures; rows come sorted by signature."""
    kept = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        fp = np.concatenate([kept[0], batch.column(0).to_numpy(zero_copy_only=False)])
        sig = np.concatenate([kept[1], batch.column(1).to_numpy(zero_copy_only=False)])
        if not len(sig):
            continue
        cut = int(np.searchsorted(sig, sig[-1]))  # the last bucket may go on in the next batch
        yield _links(fp[:cut], sig[:cut])
        kept = fp[cut:], sig[cut:]
        if len(kept[0]) > 4 * SMALL_BUCKET:  # a large bucket's rows leave as they come
            extra = kept[0][: -2 * SMALL_BUCKET]
            yield pa.RecordBatch.from_arrays([pa.array(extra), pa.array(extra)], names=["a", "b"])
            kept = kept[0][-2 * SMALL_BUCKET :], kept[1][-2 * SMALL_BUCKET :]
    yield _links(*kept)


def _links(fp: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(fp):
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        large = np.repeat(sizes > SMALL_BUCKET, sizes)
        left.append(fp[large])
        right.append(fp[large])
        rest = np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes)
        fp, sig = fp[rest], sig[rest]
        for step in range(1, SMALL_BUCKET):
            same = sig[step:] == sig[:-step]
            if not same.any():
                break
            a, b, s = fp[:-step][same], fp[step:][same], sig[step:][same]
            differ = (a ^ b).view(np.uint64)
            close = np.bitwise_count(differ) <= DISTANCE
            # of equal segments the variant of bit 0 counts; the second segment only where the first would not do
            second, bit = (s >> 37) & 1, ((s >> 32) & 31).astype(np.uint64)
            low, high = differ & np.uint64(0xFFFFFFFF), differ >> np.uint64(32)
            part = np.where(second == 1, high, low)
            first_variant = np.where(part == 0, bit == 0, (part >> bit) & np.uint64(1) == 1)
            new = (second == 0) | (np.bitwise_count(low) > 1)
            good = close & first_variant & new
            left.append(a[good])
            right.append(b[good])
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"]
    )


def near_duplicates(frame: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, fp, component_id)`` of every row of ``frame``.

    ``component_id`` is the smallest id reachable over links.  Texts that are null or without words
    have fingerprint 0 and link like others.  Copies share a fingerprint and are grouped before any
    search.  A null id is never the smallest; a component of null ids alone has a null id.
    """
    return _grouped(with_fingerprints(frame, id_column, text), id_column).select(id_column, "fp", "component_id")


def _grouped(prints: DataFrame, id_column: str) -> DataFrame:
    """``prints`` (id, ``fp`` and more) with ``root``, a fingerprint that names the component, and
    ``component_id``.
    """
    rows = written(prints, "prints")
    classes = written(rows.groupBy("fp").agg(F.min(id_column).alias("first")), "classes")
    groups = connected_components(close_pairs(classes.select("fp")))
    rooted = classes.join(groups.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = written(rooted.select("fp", "first", F.coalesce("component", "fp").alias("root")), "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "root", "component_id"), "named")
    return rows.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def keep_one(frame: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``frame`` with one row of each near-duplicate group: the smallest id, then the smallest text hash.

    A null id comes after all others.  Groups are found by fingerprint, so an id that stands at
    several texts is judged text by text; of full copies one row stays.
    """
    hashed = frame.withColumn("_hash", F.xxhash64(text))
    prints = with_fingerprints(hashed, id_column, text, "_hash")
    best = F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("_id"), F.col("_hash").alias("_text")))
    chosen = written(_grouped(prints, id_column).groupBy("root").agg(best.alias("b")).select("b._id", "b._text"), "chosen")
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    kept = hashed.join(chosen, same, "left_semi")
    return kept.dropDuplicates([id_column, "_hash"]).drop("_hash")


def hex_of(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))
