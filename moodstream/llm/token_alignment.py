"""Tokens of two tokenizers over the same bytes, aligned by pointer jumping.

Both tokenizers cut the bytes of a text into tokens.  Tokens of different tokenizers whose byte
ranges overlap are linked, and linked tokens form groups that begin and end together.  Every token
points to the farthest-right token that overlaps it; doubling the pointers of all tokens at once
leads each to the last token of its group, which names the group.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodstream.llm.shared import dealt_out, portions, remembered
from moodstream.session import written

#: Id pairs whose counts a task holds at once (16 bytes each); more are applied in several passes.
BLOCK_PAIRS = 4 << 20
#: Id pairs that a task counts before it hands them on.
FLUSH_PAIRS = 4 << 20

# The characters that stand for bytes in byte-level vocabularies.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_OF = {chr(b): b for b in _SHOWN} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
# Fixed value: the character that stands for a space in piece vocabularies.
_PIECE_SPACE = "▁"


_ENDLESS = re.compile(r"\s{10000}")


class ByteLevel:
    """A byte-level vocabulary of the ``tokenizers`` library; special tokens in texts are plain text.

    Where an entry's id tells its rank among the merges, ``tiktoken`` does the merging by the same
    vocabulary: three times as fast, with the same ids.
    """

    prefix = " "

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.bytes = [b""] * self.tokenizer.get_vocab_size()
        for entry, k in self.tokenizer.get_vocab().items():
            known = all(c in _BYTE_OF for c in entry)
            self.bytes[k] = bytes(_BYTE_OF[c] for c in entry) if known else entry.encode()
        special = self.tokenizer.get_added_tokens_decoder()
        ranks = {entry: k for k, entry in enumerate(self.bytes) if k not in special}
        model = json.loads(self.tokenizer.to_str())["model"]
        merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merged]
        self.fast = None
        if ids == list(range(256, 256 + len(ids))) and len(ranks) == 256 + len(ids):
            self.fast = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._fast(self.prefix + text) or self._slow(self.prefix + text) for text in texts]

    def _fast(self, text: str) -> list[int] | None:
        """None where the pattern gives up on a text, as on white space without end."""
        if self.fast is None or _ENDLESS.search(text):
            return None
        return self.fast.encode_ordinary(text)

    def _slow(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids


class Pieces:
    """A vocabulary of pieces with single bytes as a fallback; it puts the space before a text itself."""

    prefix = ""

    def __init__(self, path: str):
        import sentencepiece

        self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for k in range(self.tokenizer.get_piece_size()):
            piece = self.tokenizer.id_to_piece(k)
            if self.tokenizer.is_byte(k):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace(_PIECE_SPACE, " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.tokenizer.encode(text) for text in texts]


def tokenizer_of(path: str) -> ByteLevel | Pieces:
    return remembered(f"tokens of {path}", lambda: ByteLevel(path) if path.endswith(".json") else Pieces(path))


def tokens_of(text: str | None, a: ByteLevel | Pieces, b: ByteLevel | Pieces) -> tuple[list[int], list[int]]:
    """Ids of a text by both tokenizers, or none if either doesn't give back the bytes of space and text."""
    if not text:
        return [], []
    whole = b" " + text.encode("utf-8", "surrogatepass")
    found = []
    for tokenizer in (a, b):
        try:
            ids = tokenizer.encode([text])[0]
        except UnicodeError:
            return [], []
        if b"".join(map(tokenizer.bytes.__getitem__, ids)) != whole:
            return [], []
        found.append(ids)
    return found[0], found[1]


def group_labels(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A, then of B, the number of its group, from the byte offsets where tokens end.

    Offsets rise strictly within each array and both end at the same byte; several texts may follow
    each other.  A token that begins before ``e`` and ends last overlaps one that ends at ``e`` from
    the right.  Of two tokens that end together the one of A is last.
    """
    na = len(end_a)
    ends = np.concatenate([end_a, end_b])
    over_a = na + np.searchsorted(end_b, end_a, side="left")  # the B token that holds A's last byte
    over_b = np.searchsorted(end_a, end_b, side="left")
    farthest = np.concatenate([np.where(end_b[over_a - na] > end_a, over_a, np.arange(na)), over_b])
    own = np.arange(len(ends))
    pointer = np.where(ends[farthest] >= ends, farthest, own)
    while True:
        jumped = pointer[pointer]
        if np.array_equal(jumped, pointer):
            break
        pointer = jumped
    terminal = np.unique(pointer)  # tokens of A, in order
    label = np.searchsorted(terminal, pointer)
    return label[:na], label[na:]


def links(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and in B of every overlapping pair: one for each stretch that no token ends within."""
    stretch = np.union1d(end_a, end_b)
    return np.searchsorted(end_a, stretch, side="left"), np.searchsorted(end_b, stretch, side="left")


def group_text(a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, shown: list[str]) -> str:
    """``a1,a2|b1;a3|b2,b3``: ids of A and of B, group by group.

    ``shown`` holds each id with a comma, then with a bar, then with a semicolon behind it.
    """
    v = len(shown) // 3
    last_a, last_b = np.append(in_a[1:] != in_a[:-1], True), np.append(in_b[1:] != in_b[:-1], True)
    order = np.argsort(np.concatenate([2 * in_a, 2 * in_b + 1]), kind="stable")
    codes = np.concatenate([a + v * last_a, b + 2 * v * last_b])[order]
    return "".join(map(shown.__getitem__, codes.tolist()))[:-1]


def aligned(documents: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``(id, n_a, n_b, n_groups, n_links, groups_text as bytes, pairs)`` of ``(id, text)``; encoded once.

    ``pairs`` holds the distinct linked id pairs of the text and how often each is linked, packed.
    """
    names = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = tokenizer_of(path_a), tokenizer_of(path_b)
        sizes = [np.array([len(x) for x in t.bytes], np.int64) for t in (a, b)]
        base = len(b.bytes)
        most = max(len(a.bytes), base)
        shown = [f"{k}{mark}" for mark in ",|;" for k in range(most)]
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in portions(batch, 1):
                rows: list[list] = [[] for _ in names[1:]]
                for text in part.column(1).to_pylist():
                    row = _row(tokens_of(text, a, b), sizes, base, shown, squeeze)
                    for column, value in zip(rows, row):
                        column.append(value)
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, rows, kinds)], names=names)

    kind = documents.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary"
    return documents.select("id", "text").mapInArrow(run, schema)


def _row(ids: tuple[list[int], list[int]], sizes: list[np.ndarray], base: int, shown: list[str], squeeze) -> tuple:
    if not ids[0]:
        return 0, 0, 0, 0, "", _pack(np.zeros(0, np.int64), np.zeros(0, np.int64), squeeze)
    a, b = np.array(ids[0]), np.array(ids[1])
    end_a, end_b = np.cumsum(sizes[0][a]), np.cumsum(sizes[1][b])
    in_a, in_b = group_labels(end_a, end_b)
    at_a, at_b = links(end_a, end_b)
    codes, times = np.unique(a[at_a] * base + b[at_b], return_counts=True)
    text = group_text(a, b, in_a, in_b, shown)
    digest = hashlib.sha256(text.encode()).hexdigest()
    return len(a), len(b), int(in_a[-1]) + 1, len(at_a), digest, _pack(codes, times, squeeze)


def _pack(codes: np.ndarray, times: np.ndarray, squeeze) -> bytes:
    """Rising codes as differences, then counts, byte planes side by side, squeezed."""
    gaps = np.diff(codes, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    counts = times.astype("<i4").view(np.uint8).reshape(-1, 4).T
    return squeeze.compress(gaps.tobytes() + counts.tobytes())


def _unpack(packed: bytes, squeezed) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(squeezed.decompress(packed), np.uint8)
    n = len(raw) // 12
    gaps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel()
    times = np.ascontiguousarray(raw[8 * n :].reshape(4, n).T).view("<i4").ravel()
    return np.cumsum(gaps), times


def pair_counts(rows: DataFrame, base: int) -> DataFrame:
    """``(a, b, documents)``: how many rows hold an id pair linked; summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeezed = zstandard.ZstdDecompressor()
        seen, times, loose, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                loose.append(_unpack(packed, squeezed)[0])
                waiting += len(loose[-1])
                if waiting > FLUSH_PAIRS:
                    seen, times = _summed(seen, times, loose)
                    loose, waiting = [], 0
                    if len(seen) > FLUSH_PAIRS:
                        yield _counted(seen, times)
                        seen, times = seen[:0], times[:0]
        yield _counted(*_summed(seen, times, loose))

    def _counted(seen: np.ndarray, times: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array((seen // base).astype(np.int32)), pa.array((seen % base).astype(np.int32)), pa.array(times)]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

    counted = rows.select("pairs").mapInArrow(run, "a int, b int, n long")
    return counted.groupBy("a", "b").agg(F.sum("n").alias("documents"))


def _summed(seen: np.ndarray, times: np.ndarray, loose: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    codes, counts = np.unique(np.concatenate([np.zeros(0, np.int64), *loose]), return_counts=True)
    every, place = np.unique(np.concatenate([seen, codes]), return_inverse=True)
    sums = np.zeros(len(every), np.int64)
    np.add.at(sums, place, np.concatenate([times, counts]))
    return every, sums


def with_counts(rows: DataFrame, counts: DataFrame, base: int, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum`` in place of ``pairs``.

    The counts go to the tasks in blocks of whole A ids, at most ``block_pairs`` and one A id's pairs
    (no more than B has ids) at a time; each block reads the rows once and adds to their sums.
    """
    sized = written(counts.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"), F.max("documents").alias("most")), "sizes")
    cuts, room = [0], block_pairs
    for a, pairs in sized.select("a", "pairs").orderBy("a").toLocalIterator():  # a row for each id of A
        if pairs > room and room < block_pairs:
            cuts.append(a)
            room = block_pairs
        room -= pairs
    flagged = written(counts.join(sized.select("a", "most"), "a"), "counts")
    done = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for low, high in zip(cuts, [*cuts[1:], 1 << 31]):
        block = flagged.where((F.col("a") >= low) & (F.col("a") < high)).toArrow()
        code = block["a"].to_numpy().astype(np.int64) * base + block["b"].to_numpy()
        order = np.argsort(code)
        n, most = block["documents"].to_numpy()[order], block["most"].to_numpy()[order]
        done = _counts_added(done, code[order], n, n == most)
        if high < 1 << 31:
            done = written(done, "counted")
    return done.drop("pairs")


def _counts_added(rows: DataFrame, codes: np.ndarray, counts: np.ndarray, best: np.ndarray) -> DataFrame:
    given = dealt_out(rows.sparkSession, (codes, counts, best))
    pairs, n_best, count_sum = (rows.columns.index(c) for c in ("pairs", "n_best", "count_sum"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, count, top = given()
        squeezed = zstandard.ZstdDecompressor()
        for batch in batches:
            sums = np.zeros((batch.num_rows, 2), np.int64)
            for k, packed in enumerate(batch.column(pairs).to_pylist()):
                own, times = _unpack(packed, squeezed)
                at = np.minimum(np.searchsorted(code, own), max(0, len(code) - 1))
                known = code[at] == own if len(code) else np.zeros(len(own), bool)
                at, times = at[known], times[known]
                sums[k] = times[top[at]].sum(), (times * count[at]).sum()
            columns = list(batch.columns)
            for column, added in zip((n_best, count_sum), sums.T):
                columns[column] = pa.array(columns[column].to_numpy() + added)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def align(documents: DataFrame, path_a: str, path_b: str, *, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``documents``: its tokens by both tokenizers, their groups, and how common its links are.

    ``n_a``, ``n_b``: tokens; ``n_groups``: groups; ``n_links``: overlapping pairs; ``n_best``: links
    whose id pair is linked in as many documents as any pair of its A id; ``count_sum``: those numbers
    of documents summed over the links; ``groups_sha256``: checksum of the groups' ids.  A text that
    is null, empty, or not given back byte for byte by either tokenizer has zeros and an empty
    checksum.  Repeated rows count each; an empty frame gives no rows; other columns are not read.
    """
    texts = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    rows = written(aligned(texts, path_a, path_b), "aligned")
    base = len(tokenizer_of(path_b).bytes)
    counts = written(pair_counts(rows, base), "pairs")
    return with_counts(rows, counts, base).withColumnRenamed("id", id_column)
