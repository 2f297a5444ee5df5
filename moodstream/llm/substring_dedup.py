"""Words inside passages that stand more than once, found by recompression.

Rounds of recompression rename a text: a maximal run of equal symbols becomes one symbol, then the
symbols are dealt to a left and a right side and every left symbol followed by a right one becomes a
pair with a name of its own.  A name is a 64-bit hash of what it stands for, so all tasks give the
same name to the same run or pair without asking each other.  What a round does to a symbol depends
on its neighbours only: inside a passage the symbols are the same wherever the passage stands, but
for the outermost one on either side, which may join something outside.

A window is judged by one long symbol that lies inside it in some round (its *anchor*): equal
windows have equal anchors.  Spark counts the anchors of the whole corpus; those seen once are done
with.  The windows around the others are named too, and compared with all windows of the same anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.llm.shared import portions, settle
from moodstream.session import written

WIDTH = 35
#: Symbols of this many words are long enough for an anchor: the one with the least hash counts, so
#: neighbouring windows mostly share theirs.
LONG = 8
#: Anchors seen more often than this are compared class by class, others row by row.
COMMON = 64
#: Windows of one anchor that share a row; their verdicts are bits of a long.
MOST = 60
#: Words renamed at once; a longer text is cut into pieces that overlap by a window less a word.
PIECE = 1 << 17

_STEP = 0x9E3779B97F4A7C15
_BACK = pow(_STEP, -1, 1 << 64)
_U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """Scatter the bits of 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_names(words: list[bytes]) -> np.ndarray:
    """A 64-bit name for each word; equal words have equal names."""
    coded = pa.array(words, pa.binary()).dictionary_encode()
    names = np.array([xxhash.xxh3_64_intdigest(word) for word in coded.dictionary.to_pylist()], _U)
    return names[coded.indices.to_numpy()]


def window_names(names: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit name for the ``width`` words from each start, by sums of weighted word names."""
    up, down = _powers(_STEP, len(names)), _powers(_BACK, len(names))
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(names * up)])
    return mixed((sums[starts + width] - sums[starts]) * down[starts])


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, _U)
    powers[:1] = 1
    return np.cumprod(powers, dtype=_U)


def anchors(names: np.ndarray, text: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, key, at)`` of every window of ``width`` words inside one text (``text``: its number, sorted).

    ``key`` names the symbol chosen inside the window: of those of ``LONG`` words the one with the
    greatest hash, else the longest.  ``at`` is the word it begins with.  Whether a symbol counts as
    inside is read from the window alone: the first and last run of words are left out, and at each
    round an outermost symbol that could pair with a neighbour outside.  Runs of words are named
    first; what repeats in later rounds stays a row of equal symbols.  A window without a pair inside
    is its own anchor.
    """
    n = len(names)
    ends = np.searchsorted(text, text, side="right")
    start = np.flatnonzero(np.arange(n) + width <= ends)
    rank, key, at = np.zeros(len(start), _U), np.zeros(len(start), _U), start.copy()
    symbol, owner, first = names, text, np.arange(n)
    open_, low, high = np.arange(len(start)), start.copy(), start + width
    if len(open_):
        fresh = np.append(True, (symbol[1:] != symbol[:-1]) | (owner[1:] != owner[:-1]))
        run, begin = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        times = np.diff(np.append(begin, n)).astype(_U)
        named = mixed(symbol[begin] + times * _U(_STEP))
        symbol, owner, first = np.where(times > 1, named, symbol[begin]), owner[begin], first[begin]
        low, high = run[low] + 1, run[high - 1]
    round_ = 0
    while True:
        round_ += 1
        inside = low < high
        open_, low, high = open_[inside], low[inside], high[inside]
        if not len(open_):
            break
        right = (mixed(symbol + _U(round_)) >> _U(63)).astype(np.int64)
        low, high = low + right[low], high - 1 + right[high - 1]
        inside = low < high
        open_, low, high = open_[inside], low[inside], high[inside]
        pair = np.append((right[:-1] < right[1:]) & (owner[:-1] == owner[1:]), False)
        kept = ~np.append(False, pair[:-1])
        named = mixed(symbol * _U(3) + mixed(np.append(symbol[1:], _U(0))) + _U(round_))
        place = np.cumsum(kept) - 1
        symbol, owner, first = np.where(pair, named, symbol)[kept], owner[kept], first[kept]
        low, high = place[low], place[high - 1] + 1
        if len(open_):
            length = np.minimum(np.diff(np.append(first, n)), LONG).astype(_U)
            value = (length << _U(56)) | (mixed(symbol) >> _U(8))
            best = _best(value, low, high)
            better = value[best] > rank[open_]
            rank[open_[better]] = value[best[better]]
            key[open_[better]], at[open_[better]] = symbol[best[better]], first[best[better]]
    alone = rank == 0
    key[alone] = window_names(names, start[alone], width)
    return start, key, at


def _best(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Leftmost place of the largest value in each range ``[low, high)``."""
    power = np.frexp(high - low)[1] - 1
    best, table = np.empty(len(low), np.int64), np.arange(len(value))
    for k in range(int(power.max()) + 1):
        chosen = power == k
        a, b = table[low[chosen]], table[high[chosen] - (1 << k)]
        best[chosen] = np.where(value[a] >= value[b], a, b)
        if len(table) <= 1 << k:
            break
        a, b = table[: -(1 << k)], table[1 << k :]
        table = np.where(value[a] >= value[b], a, b)
    return best


def _pieces(texts: list[list[bytes]], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(names, text, word)`` of up to about ``PIECE`` words: each window of a text is in one piece."""
    words: list[bytes] = []
    owner: list[np.ndarray] = []
    at: list[np.ndarray] = []
    for k, text in enumerate(texts):
        if len(text) < width:
            continue
        for low in range(0, len(text) - width + 1, PIECE):
            piece = text[low : low + PIECE + width - 1]
            words += piece
            owner.append(np.full(len(piece), k))
            at.append(np.arange(low, low + len(piece)))
            if len(words) >= PIECE:
                yield word_names(words), np.concatenate(owner), np.concatenate(at)
                words, owner, at = [], [], []
    if words:
        yield word_names(words), np.concatenate(owner), np.concatenate(at)


def _words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def anchor_rows(frame: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(who, key, first, n)`` from ``(who, text)``: ``n`` neighbouring windows with one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                who = part.column(0).to_numpy()
                for names, text, word in _pieces([_words(t) for t in part.column(1).to_pylist()], width):
                    start, key, at = anchors(names, text, width)
                    gap = (np.diff(at) != 0) | (key[1:] != key[:-1]) | (np.diff(start) != 1)
                    begin = np.append(0, np.flatnonzero(gap) + 1)
                    size = np.diff(np.append(begin, len(start)))
                    rows = -(-size // MOST)
                    step = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
                    begin, left = np.repeat(begin, rows) + step * MOST, np.repeat(size, rows) - step * MOST
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(who[text[start[begin]]]), pa.array(key[begin].view(np.int64)),
                         pa.array(word[start[begin]].astype(np.int32)), pa.array(np.minimum(left, MOST).astype(np.int32))],
                        names=["who", "key", "first", "n"],
                    )

    return frame.select("who", "text").mapInArrow(run, "who long, key long, first int, n int")


def window_rows(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(who, what, key, common, first, names)``: 64-bit names of the windows that ``found`` lists, from its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in portions(batch, 2):
                lists = part.column(3)
                listed = lists.flatten()
                first, n = (listed.field(k).to_numpy() for k in ("first", "n"))
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                every = []
                for packed in part.column(2).to_pylist():
                    words = unpack.decompress(packed).split()
                    every.append(window_names(word_names(words), np.arange(len(words) - width + 1), width))
                room = np.array([len(x) for x in every], np.int64)
                begin = np.cumsum(room) - room
                good = first + n <= room[row]  # two rows may share a hash
                row, first, n = row[good], first[good].astype(np.int64), n[good].astype(np.int64)
                at = np.repeat(begin[row] + first - np.cumsum(n) + n, n) + np.arange(n.sum())
                names = pa.ListArray.from_arrays(
                    np.append(0, np.cumsum(n)).astype(np.int32), np.concatenate(every)[at].view(np.int64)
                )
                chosen, kept = pa.array(row), listed.filter(pa.array(good))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(chosen), part.column(1).take(chosen), kept.field("key"), kept.field("common"),
                     kept.field("first"), names],
                    names=["who", "what", "key", "common", "first", "names"],
                )

    narrow = found.select("who", "what", "packed", "listed")
    return narrow.mapInArrow(run, "who long, what long, key long, common boolean, first int, names array<long>")


def compared(windows: DataFrame) -> DataFrame:
    """``(who, what, first, mask)`` of rows with a window that stands at least twice; a bit of ``mask`` for each.

    For anchors with a bounded number of rows, which a task sees together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if kept is None else [kept, batch]).combine_chunks().to_batches()
            if not rows:
                continue
            key = rows[0].column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))  # the last anchor may go on in the next batch
            yield agreed(rows[0].slice(0, cut))
            kept = rows[0].slice(cut)
        if kept is not None:
            yield agreed(kept)

    def agreed(rows: pa.RecordBatch) -> pa.RecordBatch:
        lists = rows.column(4)
        size = lists.value_lengths().to_numpy().astype(np.int64)
        name = lists.flatten().to_numpy()
        _, place, times = np.unique(name, return_inverse=True, return_counts=True)
        begin = np.cumsum(size) - size
        bit = (times[place] > 1).astype(np.int64) << (np.arange(len(name)) - np.repeat(begin, size))
        mask = np.add.reduceat(bit, begin) if len(size) else bit
        some = pa.array(mask != 0)
        columns = [c.filter(some) for c in (rows.column(1), rows.column(2), rows.column(3), pa.array(mask))]
        return pa.RecordBatch.from_arrays(columns, names=["who", "what", "first", "mask"])

    together = windows.select("key", "who", "what", "first", "names").repartition("key").sortWithinPartitions("key")
    return together.mapInArrow(run, "who long, what long, first int, mask long")


def verdicts(windows: DataFrame) -> DataFrame:
    """``(key, span, mask)``: which windows of a class stand at least twice; classes without any are left out.

    A class is what rows with the same windows share.  A class that stands twice has all its windows
    twice.  A class that stands alone is compared window by window with all classes of its anchor.
    """
    classes = windows.groupBy("key", "names").agg(F.count(F.lit(1)).alias("times"))
    classes = written(classes.withColumn("span", F.xxhash64("names")), "classes")
    alone = written(classes.where("times = 1").select("key").distinct(), "alone")
    near = classes.join(alone, "key", "left_semi")
    near = written(near.select("key", "span", "times", F.posexplode("names").alias("i", "name")), "near")
    twice = near.groupBy("key", "name").agg(F.sum("times").alias("n")).where("n > 1").drop("n")

    def bit(place):
        return F.call_function("shiftleft", F.lit(1).cast("long"), place)

    some = near.where("times = 1").join(twice, ["key", "name"]).groupBy("key", "span").agg(F.bit_or(bit(F.col("i"))).alias("mask"))
    whole = classes.where("times > 1").select("key", "span", (bit(F.size("names")) - 1).alias("mask"))
    return whole.unionByName(some)


def _packed(rows: DataFrame) -> DataFrame:
    """``(who, what, packed)``: the texts squeezed, since they go through a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in portions(batch, 2):
                packed = [squeeze.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(packed, pa.binary())], names=["who", "what", "packed"]
                )

    return rows.select("who", "what", "text").mapInArrow(run, "who long, what long, packed binary")


def _form(words: list[bytes], form: str) -> str:
    joined = b" ".join(words)
    return joined.decode("utf-8", "surrogatepass") if form == "text" else hashlib.sha256(joined).hexdigest()


def _whole(rows: DataFrame, form: str) -> DataFrame:
    """``(id, who, what, n_words, whole)`` of every row, as if nothing were removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 3):
                words = [_words(t) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([len(w) for w in words], pa.int64()),
                     pa.array([_form(w, form) for w in words], pa.string())],
                    names=["id", "who", "what", "n_words", "whole"],
                )

    narrow = rows.select("id", "who", "what", "text")
    kind = narrow.schema["id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"id {kind}, who long, what long, n_words long, whole string")


def _cut(found: DataFrame, form: str, width: int) -> DataFrame:
    """``(who, what, n_removed, kept)`` from the texts and their proven windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for part in portions(batch, 2):
                removed, kept = [], []
                for packed, proven in zip(part.column(2).to_pylist(), part.column(3).to_pylist()):
                    words = unpack.decompress(packed).split()
                    covered = covered_words(len(words), [(x["first"], x["mask"]) for x in proven], width)
                    removed.append(int(covered.sum()))
                    kept.append(_form([w for w, gone in zip(words, covered.tolist()) if not gone], form))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                    names=["who", "what", "n_removed", "kept"],
                )

    narrow = found.select("who", "what", "packed", "proven")
    return narrow.mapInArrow(run, "who long, what long, n_removed long, kept string")


def covered_words(n: int, proven: list[tuple[int, int]], width: int) -> np.ndarray:
    """Whether each of ``n`` words lies in a proven window, from the first window and the bits of each row."""
    first = np.array([f for f, _ in proven], np.int64)
    bits = np.array([m for _, m in proven], np.int64)
    start = first[:, None] + np.arange(MOST)
    good = (bits[:, None] >> np.arange(MOST)) & 1 == 1
    start = np.unique(start[good & (start + width <= n)])
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + width, -1)
    return np.cumsum(change[:n]) > 0


def without_repeats(
    frame: DataFrame, id_column: str = "doc_id", text: str = "text", width: int = WIDTH, form: str = "text"
) -> DataFrame:
    """``(id, n_words, n_removed, kept)`` of every row of ``frame``, without the words of repeated windows.

    A word goes if a window of ``width`` words that covers it stands anywhere else in ``frame``, the
    same text included; windows are judged on the input.  ``kept`` holds the kept words joined by one
    space, or their SHA-256 with ``form="sha256"``.  A null or empty text has no words; a text shorter
    than a window loses none; repeated rows take each other's windows away.  Rows are told apart by
    two hashes of id and text, so an id may be null or stand at several texts, and equal rows get
    equal results.  An empty frame gives no rows; other columns are not read.
    """
    spark = frame.sparkSession
    rows = frame.select(
        F.col(id_column).alias("id"), F.col(text).alias("text"),
        F.xxhash64(id_column, text).alias("who"), F.xxhash64(text, F.lit(7), id_column).alias("what"),
    )
    marked = written(anchor_rows(rows, width), "anchors")
    counts = marked.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    shared = written(counts.select("key", (F.col("times") > COMMON).alias("common")), "shared")
    settle(spark)
    listed = F.collect_set(F.struct("first", "n", "key", "common")).alias("listed")
    listed = written(marked.join(shared, "key").groupBy("who").agg(listed), "listed")
    settle(spark)
    found = written(_packed(rows).join(listed, "who"), "found")
    settle(spark)
    windows = written(window_rows(found, width), "windows")
    common = windows.where("common")
    placed = common.select("who", "what", "key", "first", F.xxhash64("names").alias("span"))
    proven = placed.join(verdicts(common), ["key", "span"]).select("who", "what", "first", "mask")
    proven = proven.unionByName(compared(windows.where("not common")))
    proven = written(proven.groupBy("who", "what").agg(F.collect_set(F.struct("first", "mask")).alias("proven")), "proven")
    settle(spark)
    cut = written(_cut(found.join(proven, ["who", "what"]), form, width).distinct(), "cut")
    return _whole(rows, form).join(cut, ["who", "what"], "left").select(
        F.col("id").alias(id_column), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("kept", "whole").alias("kept"),
    )
