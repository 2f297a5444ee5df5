"""Edited copies of documents: SimHash deletion-variant signatures, verified by exact Jaccard.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of 0.8 or
more.  Candidates come from SimHash fingerprints of six segments of 20 bits.  An edit changes two
two-word shingles but five of five words, so the fingerprints are taken over the former, where
linked documents differ in about a tenth of the bits.  A segment is indexed under its variants with
one bit left out; documents that share a variant and whose fingerprints are close are compared in
full.  A pair of similarity 0.8 is found with a probability of about 0.95, a closer one more surely.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodstream.llm.components import connected_components
from moodstream.llm.shared import portions
from moodstream.session import written

SEED = 42
#: Words of a shingle in the comparison, and in the fingerprint that finds what to compare.
SHINGLE = 5
PRINT_SHINGLE = 2
#: Least Jaccard similarity of a link, in percent.
SIMILARITY = 80
SEGMENT_BITS = 20
#: Segments of each of the two longs that hold a fingerprint.
SEGMENTS = 3
#: Most differing bits, of 120, of a pair that is compared in full; those of similarity 0.8 differ in about 11.
DISTANCE = 24
#: Hashes whose bits are counted at once; their counts fit in 16 bits.
BLOCK = 1 << 15
SMALL_BUCKET = 32
#: Rows of a bucket that a task compares all with all.
LARGE_BUCKET = 4096
#: A bucket with more close pairs a row than this is a family, compared through its middle first.
DENSE = 16
SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Rows whose common shingles are the centre of a family.
FEW = 64
#: How often a family is split by the differences its rows share; then the rows of a difference meet pair by pair.
LEVELS = 4
PAIR = "a long, b long"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(parts: list[bytes], width: int) -> np.ndarray:
    """Distinct XXH64 values of the shingles; fewer words than ``width`` are one shingle, none give none."""
    if not parts:
        return np.zeros(0, np.uint64)
    digest, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    starts = [0, *accumulate(len(part) + 1 for part in parts)]
    ends = starts[min(width, len(parts)) :]
    return np.unique(np.array([digest(joined[i : j - 1], SEED) for i, j in zip(starts, ends)], np.uint64))


def fingerprint(parts: list[bytes]) -> tuple[int, int]:
    """SimHash of the distinct two-word shingles: twice ``SEGMENTS`` segments."""
    hashes = shingle_hashes(parts, PRINT_SHINGLE)
    mixed = hashes * SPREAD
    mixed ^= mixed >> np.uint64(32)
    bits = np.zeros(128, np.int64)
    for low in range(0, len(hashes), BLOCK):
        both = np.stack([hashes[low : low + BLOCK], mixed[low : low + BLOCK]], axis=1).astype("<u8")
        bits += np.unpackbits(both.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    packed = np.packbits(2 * bits > len(hashes), bitorder="little").tobytes()
    kept = (1 << SEGMENTS * SEGMENT_BITS) - 1
    return int.from_bytes(packed[:8], "little") & kept, int.from_bytes(packed[8:], "little") & kept


def _with_prints(frame: DataFrame, text: str, *more: str) -> DataFrame:
    """``(more..., key, fp0, fp1)``: ``key`` is a 64-bit hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 0):
                rows = []
                for value in batch.column(0):
                    parts = words_of(value.as_py())
                    rows.append((xxhash.xxh64_intdigest(b" ".join(parts), SEED), *fingerprint(parts)))
                made = np.array(rows, np.uint64).reshape(-1, 3).view(np.int64)
                columns = [*batch.columns[1:], *(pa.array(np.ascontiguousarray(c)) for c in made.T)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    narrow = frame.select(text, *more)
    longs = [T.StructField(name, T.LongType()) for name in ("key", "fp0", "fp1")]
    schema = T.StructType([*narrow.schema.fields[1:], *longs])
    return narrow.mapInArrow(run, schema)


def _shingle_sets(frame: DataFrame, text: str) -> DataFrame:
    """``(key, shingles)`` of the rows of ``frame``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in portions(whole, 0):
                split = [words_of(value.as_py()) for value in batch.column(0)]
                keys = np.array([xxhash.xxh64_intdigest(b" ".join(p), SEED) for p in split], np.uint64).view(np.int64)
                sets = [shingle_hashes(p, SHINGLE).view(np.int64) for p in split]
                arrays = pa.array(sets, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys), arrays], names=["key", "shingles"])

    return frame.select(text).mapInArrow(run, "key long, shingles array<long>")


def _segments() -> list[Column]:
    """The values of the segments of ``fp0`` and ``fp1``."""
    mask = (1 << SEGMENT_BITS) - 1
    every = range(2 * SEGMENTS)
    return [F.shiftrightunsigned(f"fp{s // SEGMENTS}", s % SEGMENTS * SEGMENT_BITS).bitwiseAND(mask) for s in every]


def _signatures(classes: DataFrame) -> DataFrame:
    """A row for each segment and bit: ``sig`` holds both, and the segment without the bit."""
    mask = (1 << SEGMENT_BITS) - 1
    variants = []
    for s, part in enumerate(_segments()):
        for j in range(SEGMENT_BITS):
            variants.append(part.bitwiseAND(mask ^ (1 << j)).bitwiseOR((s * SEGMENT_BITS + j) << SEGMENT_BITS))
    return classes.select("key", "fp0", "fp1", F.explode(F.array(*variants)).alias("sig"))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs (a, b)`` of close fingerprints, each once, and the ``sig`` of crowded buckets.

    ``classes`` holds ``(key, fp0, fp1)``, each key once.  A bucket is crowded if it has more than
    ``LARGE_BUCKET`` rows or ``DENSE`` close pairs a row; ``crowd_middles`` and ``family_pairs``
    compare its rows, which are those of its ``segments_of``.
    """
    rows = _signatures(classes).select("sig", "key", "fp0", "fp1").repartition("sig").sortWithinPartitions("sig", "key")
    found = written(rows.mapInArrow(_buckets, "a long, b long, sig long"), "close")
    return found.where("sig is null").select("a", "b"), found.where("sig is not null").select("sig")


def segments_of(crowd: DataFrame) -> DataFrame:
    """``(bucket, sig)``: the two segments, bit unset and set, that a bucket named by ``sig`` is made of."""
    place = F.shiftright("sig", SEGMENT_BITS)
    segment = F.floor(place / SEGMENT_BITS)
    unset = F.shiftleft(segment, SEGMENT_BITS).bitwiseOR(F.col("sig").bitwiseAND((1 << SEGMENT_BITS) - 1))
    bits = F.array(*[F.lit(1 << j).cast("long") for j in range(SEGMENT_BITS)])
    both = F.array(unset, unset.bitwiseOR(F.get(bits, (place % SEGMENT_BITS).cast("int"))))
    return crowd.select(F.col("sig").alias("bucket"), F.explode(both).alias("sig"))


def segment_rows(classes: DataFrame, segments: DataFrame) -> DataFrame:
    """``(sig, key, fp0, fp1)``: the rows of ``segments (sig)``; a row has six of them, but 120 signatures."""
    parts = [part.bitwiseOR(s << SEGMENT_BITS) for s, part in enumerate(_segments())]
    rows = classes.select(F.explode(F.array(*parts)).alias("sig"), "key", "fp0", "fp1")
    return rows.join(segments.select("sig").distinct(), "sig", "left_semi")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the rows of each bucket; they come sorted by signature."""
    kept, crowded = np.zeros((0, 4), np.int64), None
    for batch in batches:
        new = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
        rows = np.concatenate([kept, new])
        if not len(rows):
            continue
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))  # the last bucket may go on in the next batch
        yield from _compared(rows[:cut], crowded)
        kept = rows[cut:]
        if kept[0, 0] != crowded:
            crowded = None
        if crowded is None and len(kept) > LARGE_BUCKET:
            crowded = int(kept[0, 0])
            yield _crowded(crowded)
        if crowded is not None:  # its name is out; the rest of its rows needn't wait
            kept = kept[:0]
    yield from _compared(kept, crowded)


def _compared(rows: np.ndarray, crowded: int | None) -> Iterator[pa.RecordBatch]:
    if not len(rows):
        return
    starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
    sizes = np.diff(np.r_[starts, len(rows)])
    small = rows[np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET) & (rows[starts, 0] != crowded), sizes)]
    for step in range(1, SMALL_BUCKET):
        if len(small) <= step:
            break
        at = np.flatnonzero(small[step:, 0] == small[:-step, 0])
        if not len(at):
            break
        a, b = small[at], small[at + step]
        fine = _close(a, b)
        a, b = a[fine], b[fine]
        fine = _first_time(a, b)
        yield _output(a[fine, 1], b[fine, 1])
    for start, size in zip(starts, sizes):
        bucket = rows[start : start + size]
        if bucket[0, 0] != crowded and size > SMALL_BUCKET:
            i, j = _close_pairs(bucket, bucket, DENSE * size)
            if size > LARGE_BUCKET or len(i) > DENSE * size:
                yield _crowded(int(bucket[0, 0]))
            else:
                fine = _first_time(bucket[i], bucket[j])
                yield _output(bucket[i[fine], 1], bucket[j[fine], 1])


def _output(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["a", "b", "sig"])


def _crowded(sig: int) -> pa.RecordBatch:
    nothing = pa.nulls(1, pa.int64())
    return pa.RecordBatch.from_arrays([nothing, nothing, pa.array([sig], pa.int64())], names=["a", "b", "sig"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows whose last two columns are fingerprints."""
    differ = (a[..., -2:] ^ b[..., -2:]).view(np.uint64)
    return np.bitwise_count(differ).sum(axis=-1, dtype=np.int32)


def _close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _distance(a, b) <= DISTANCE


def _close_pairs(left: np.ndarray, right: np.ndarray, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of close rows; within one block each pair once.  Stops once there are more than ``enough``."""
    first, second, total = [], [], 0
    for low in range(0, len(left), 256):
        i, j = np.nonzero(_close(left[low : low + 256, None], right[None]))
        i = i + low
        if left is right:
            i, j = i[i < j], j[i < j]
        first.append(i)
        second.append(j)
        total += len(i)
        if enough is not None and total > enough:
            break
    return np.concatenate(first), np.concatenate(second)


def _first_time(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a pair meets in its first variant of the first segment that differs in at most one bit."""
    variant = a[:, 0] >> SEGMENT_BITS
    own, bit = variant // SEGMENT_BITS, variant % SEGMENT_BITS
    mask, fine = (1 << SEGMENT_BITS) - 1, np.ones(len(a), bool)
    for s in range(2 * SEGMENTS):
        column = 2 + s // SEGMENTS
        part = ((a[:, column] ^ b[:, column]) >> (s % SEGMENTS * SEGMENT_BITS)) & mask
        fine &= (own <= s) | (np.bitwise_count(part.view(np.uint64)) > 1)
        fine &= (own != s) | np.where(part == 0, bit == 0, (part >> bit) & 1 == 1)
    return fine


def crowd_middles(crowd: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of rows of a segment and the row nearest to the majority of their bits.

    Copies edited from one text lie around it, so these few comparisons join most of a family.
    Rows are taken as they come in the order of segments and keys, at most ``LARGE_BUCKET`` at once;
    a segment of very many rows may be cut into several tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            for start, end in _runs(rows[:, 0]):
                bucket = rows[start:end]
                bits = np.unpackbits(np.ascontiguousarray(bucket[:, 2:]).view(np.uint8), axis=1).mean(axis=0) > 0.5
                middle = np.packbits(bits).view(np.int64)[None]
                best = bucket[_distance(bucket, middle).argmin()][None]
                near = bucket[_close(bucket, best) & (bucket[:, 1] != best[0, 1])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(near[:, 1].copy()), pa.array(np.full(len(near), best[0, 1]))], names=["a", "b"]
                )

    return crowd.repartitionByRange("sig", "key").sortWithinPartitions("sig", "key").mapInArrow(run, PAIR)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True])
    for start, end in zip(edges[:-1], edges[1:]):
        for low in range(start, end, LARGE_BUCKET):
            yield low, min(low + LARGE_BUCKET, end)


def mixed(rows: DataFrame, groups: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``(fam, key, grp)``: the rows of all buckets of several groups, each row once a family.

    ``rows`` are ``(sig, key)``, a bucket for each ``sig``; with ``parts (bucket, sig)`` a bucket has the
    rows of its parts, which have none in common.  Then only a part's counts are repeated for its
    buckets, its rows are not.  ``groups`` is ``(node, component)``; a row in none is its own.  The
    buckets in which the same group has most rows are one family, named by it.
    """
    known = rows.join(groups, F.col("key") == F.col("node"), "left")
    known = written(known.select("sig", "key", F.coalesce("component", "key").alias("grp")), "known")
    sizes = known.groupBy("sig", "grp").agg(F.count(F.lit(1)).alias("n"))
    if parts is None:
        sizes = sizes.withColumnRenamed("sig", "bucket")
    else:
        sizes = sizes.join(parts, "sig").groupBy("bucket", "grp").agg(F.sum("n").alias("n"))
    most = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("several"), F.max(F.struct("n", "grp")).alias("m"))
    most = most.where("several > 1").select("bucket", F.col("m.grp").alias("fam"))
    if parts is None:
        named = most.withColumnRenamed("bucket", "sig")
    else:
        named = most.join(parts, "bucket").select("sig", "fam").distinct()
    return known.join(named, "sig").select("fam", "key", "grp").distinct()


def differences(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(fam, key, grp, more, less, centre, w)``: how a row's shingles differ from its family's centre.

    The centre holds the shingles of most rows of a few.  It may be any set: it decides how much work
    is saved, not which links are found.  ``more`` are the row's other shingles, ``less`` those of the
    centre that it lacks, and ``w`` is nine times their number less the row's size.
    """
    chosen = Window.partitionBy("fam").orderBy(F.xxhash64("key"), "key")
    few = members.withColumn("at", F.row_number().over(chosen)).where(F.col("at") <= FEW).select("fam", "key")
    rows = few.groupBy("fam").agg(F.count(F.lit(1)).alias("rows"))
    counted = few.join(sets, "key").select("fam", F.explode("shingles").alias("e")).groupBy("fam", "e").agg(F.count(F.lit(1)).alias("n"))
    common = counted.join(rows, "fam").where("2 * n > rows").groupBy("fam").agg(F.collect_list("e").alias("c"))
    met = members.join(sets, "key").join(common, "fam", "left")
    met = met.withColumn("c", F.coalesce("c", F.array().cast("array<long>")))
    more, less = F.sort_array(F.array_except("shingles", "c")), F.sort_array(F.array_except("c", "shingles"))
    met = met.withColumns({"more": more, "less": less, "centre": F.size("c")})
    met = met.withColumn("w", 9 * (F.size("more") + F.size("less")) - F.size("shingles"))
    return met.select("fam", "key", "grp", "more", "less", "centre", "w").dropDuplicates(["fam", "key"])


def family_pairs(rows: DataFrame, last: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``links (a, b)``, ``pairs (a, b)`` that may be links, and smaller ``buckets (sig, key)`` to go on with.

    ``rows`` are ``differences``, written.  Two rows are linked if their sets differ in at most a ninth
    of their summed sizes.  They differ where their differences do, so a link needs 18 times the
    differences they share to be ``w + w'`` or more.  The row of the smallest ``w`` is linked to all
    rows with ``w + w' <= 0``.  Any link of another row, a far one, shares a difference, and the
    first it shares (additions before losses) has enough differences after it in both rows.  So far
    rows meet others over such differences only.  A difference that many rows share makes a smaller
    bucket, as long as ``last`` is false: its centre has that difference too.
    """
    least = rows.groupBy("fam").agg(F.min(F.struct("w", "key", "grp")).alias("z"))
    known = rows.join(least, "fam").withColumn("far", F.col("w") + F.col("z.w") > 0)
    links = known.where("not far and key != z.key").select(F.col("key").alias("a"), F.col("z.key").alias("b"))
    found = known.select(
        "fam", "key", "w", "far", "centre", F.col("z.w").alias("zw"), F.size("more").alias("p"), F.size("less").alias("q"),
        F.when(F.col("far"), F.col("grp")).otherwise(F.col("z.grp")).alias("grp"),
        F.posexplode(F.concat("more", "less")).alias("at", "e"),
    ).withColumn("after", F.expr("18 * (p + q - at)"))
    # A link that shares losses alone has 8p + 8p' + 9|q - q'| + q + q' <= 2 centre; x and y ask it of the best partner.
    x = F.expr("far and after >= w + zw and (at < p or 4 * p + q <= centre)")
    y = F.expr("after > w - zw and (at < p or 8 * p + q + greatest(centre + 1 - zw - 9 * q, q) <= 2 * centre)")
    found = found.withColumns({"x": x, "y": y}).where("x or y")
    found = written(found.select("fam", "e", "key", "grp", "w", "after", "x", "y"), "postings")
    lists = found.groupBy("fam", "e").agg(
        F.count_if("x").alias("nx"), F.count_if("y").alias("ny"), F.min("grp").alias("g"), F.max("grp").alias("h"),
        F.bit_xor(F.xxhash64("key", "x", "y")).alias("rows"),
    ).where("nx > 0 and ny > 0 and g != h")
    busy = F.lit(False) if last else F.col("nx") * F.col("ny") > 2 * DENSE * (F.col("nx") + F.col("ny"))
    lists = lists.select("fam", "e", busy.alias("busy"), F.xxhash64("fam", "nx", "ny", "rows").alias("sig"))
    met = written(found.join(lists, ["fam", "e"]), "met")
    one = met.where("x and not busy").selectExpr("fam", "e", "key a", "grp g", "w v", "after s")
    two = met.where("y and not busy").selectExpr("fam", "e", "key b", "grp h", "w", "after t")
    both = one.join(two, ["fam", "e"]).where("g != h and least(s, t) >= v + w")
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return links, pairs, met.where("busy").select("sig", "key").distinct()


def crowd_groups(buckets: DataFrame, links: DataFrame, sets: DataFrame, parts: DataFrame | None = None) -> DataFrame:
    """``(node, component)`` over ``links`` and all links within the ``buckets`` of ``(sig, key)``, by exact count.

    With ``parts (bucket, sig)`` it is all links within the buckets that are put together of those.
    """
    groups = written(connected_components(links), "groups")
    for level in range(LEVELS):
        members = written(mixed(buckets, groups, None if level else parts), "members")
        rows = written(differences(members, sets), "differences")
        sure, pairs, buckets = family_pairs(rows, last=level == LEVELS - 1)
        late = written(sure.unionByName(_linked(pairs, sets)), "late-links")
        if late.limit(1).count():
            links = links.unionByName(late)
            groups = written(connected_components(links), "groups")
        if not buckets.limit(1).count():
            break
    return groups


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` whose shingle sets reach the similarity, by exact count."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    enough = 100 * both >= SIMILARITY * (F.size("x") + F.size("y") - both)
    return pairs.join(one, "a").join(two, "b").where(enough).select("a", "b")


def grouped(frame: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, _hash, key, root)`` of every row: ``_hash`` is that of its text, ``root`` names its group."""
    hashed = frame.withColumn("_hash", F.xxhash64(text))
    rows = written(_with_prints(hashed, text, id_column, "_hash"), "prints")
    first = _best(id_column)
    classes = written(rows.groupBy("key", "fp0", "fp1").agg(first.alias("r")).select("key", "fp0", "fp1", "r.*"), "classes")
    pairs, crowded = candidates(classes.select("key", "fp0", "fp1"))
    parts = written(segments_of(crowded), "parts")
    crowd = written(segment_rows(classes, parts), "crowd")
    asked = pairs.select("a").union(pairs.select("b")).union(crowd.select("key")).distinct()
    wanted = classes.join(asked, F.col("key") == F.col("a"), "left_semi").select("_id", "_text")
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    texts = hashed.select(id_column, text, "_hash").join(wanted, same, "left_semi")
    sets = written(_shingle_sets(texts, text), "shingles")
    near = _linked(pairs.unionByName(crowd_middles(crowd).distinct()), sets)
    near = written(near, "links")
    groups = crowd_groups(crowd.select("sig", "key"), near, sets, parts)
    return rows.join(groups, F.col("key") == F.col("node"), "left").select(
        id_column, "_hash", "key", F.coalesce("component", "key").alias("root")
    )


def _best(id_column: str) -> Column:
    """The smallest id, then the smallest text hash; a null id comes after all others."""
    return F.min(F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("_id"), F.col("_hash").alias("_text")))


def keep_one(frame: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``frame`` with one row of each group of near copies: the smallest id, then the smallest text hash.

    Groups are connected over links.  Letters A-Z and white space don't count; texts that are null or
    without words are copies of each other.  A null id comes after all others.  An id that stands at
    several texts is judged text by text; of full copies one row stays.  No rows give no rows.
    """
    chosen = written(grouped(frame, id_column, text).groupBy("root").agg(_best(id_column).alias("b")).select("b._id", "b._text"), "chosen")
    hashed = frame.withColumn("_hash", F.xxhash64(text))
    same = F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_hash") == F.col("_text"))
    kept = hashed.join(chosen, same, "left_semi")
    return kept.dropDuplicates([id_column, "_hash"]).drop("_hash")
