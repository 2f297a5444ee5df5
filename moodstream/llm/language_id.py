"""Language identification by prediction by partial matching over bytes.

A context tree per language counts which byte follows which one to three bytes.  A byte unseen in
a context costs that context's escape (method C) and is then looked for in the next shorter one,
down to equal shares of all bytes.  With frozen counts the code length of a text is an exact sum
over its bytes; the language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from moodstream.llm.shared import dealt_out, held_out
from moodstream.session import written

ORDER = 3
#: Labelled texts per language that the trees are grown from, about.
FIT_ROWS = 2000
#: Languages that are learned: the most frequent ones, should the labels hold more.
MAX_LANGS = 1000
#: Nodes of all trees together.  Small trees stay whole; the others get equal shares of the rest.
MAX_NODES = 1_000_000
WINDOW = 1 << 19
#: The largest table of byte pairs by byte pairs; beyond it nodes are found by binary search.
DENSE_PAIRS = 6000
UNKNOWN = "und"
PAD = b" " * ORDER

_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))


def plain(text: str | None) -> bytes:
    """The letters of a text in lower case; whatever else stands in ASCII becomes one space."""
    if not text:
        return b""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_LETTERS).split())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _codes(data: bytes) -> np.ndarray:
    """The four bytes ending at each byte after the padding, as one number."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    return b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]


def count_nodes(labelled: DataFrame) -> DataFrame:
    """``(lang, gram, n)``: how often each byte follows each three bytes, from ``lang, text``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lang, texts in frame.groupby("lang")["text"]:
                codes = np.concatenate([_codes(PAD + plain(t)) for t in texts])
                grams, n = np.unique(codes, return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": grams.astype(np.int64), "n": n})

    counted = labelled.select("lang", "text").mapInPandas(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ContextTrees:
    """Frozen code lengths of all languages, looked up by the last four bytes."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        shape = len(self.langs)
        of = {lang: k for k, lang in enumerate(self.langs)}
        column = counts["lang"].map(of).to_numpy(np.int64) if shape else np.zeros(0, np.int64)
        grams, n = counts["gram"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        cost = np.full((1, shape), 8.0)  # equal shares of 256 bytes
        below = np.zeros(1, np.int64)
        self.escape, self.cost, self.keys = [], [], []
        for depth in range(1, ORDER + 2):  # a context of depth - 1 bytes and the byte that follows
            here = grams & ((1 << 8 * depth) - 1)
            keys, at = np.unique(here, return_inverse=True)
            table = np.zeros((len(keys), shape))
            np.add.at(table, (at, column), n)
            contexts, of_context = np.unique(keys >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), shape)), np.zeros((len(contexts), shape))
            np.add.at(total, of_context, table)
            np.add.at(kinds, of_context, table > 0)
            seen = total > 0
            escape = np.where(seen, -np.log2(np.where(seen, kinds / np.maximum(total + kinds, 1), 1)), 0.0)
            if depth == 1:
                shorter = np.broadcast_to(cost, table.shape)
            else:
                shorter = cost[np.searchsorted(below, keys & ((1 << 8 * (depth - 1)) - 1))]
            share = table / np.maximum(total + kinds, 1)[of_context]
            cost = np.where(table > 0, -np.log2(np.where(table > 0, share, 1)), escape[of_context] + shorter)
            below = keys
            self.escape.append((contexts, escape))
            self.keys.append(keys)
            self.cost.append(cost.astype(np.float32))
        self._index()

    def _index(self) -> None:
        """A table from byte pair and byte pair to the node, where it stays small."""
        keys = self.keys[-1]
        pairs = np.unique(np.concatenate([keys >> 16, keys & 0xFFFF]))
        self.dense = None
        if len(pairs) <= DENSE_PAIRS:
            self.pair = np.zeros(1 << 16, np.int64)
            self.pair[pairs] = np.arange(1, len(pairs) + 1)
            self.width = len(pairs) + 1
            self.dense = np.full(self.width * self.width, -1, np.int32)
            self.dense[self.pair[keys >> 16] * self.width + self.pair[keys & 0xFFFF]] = np.arange(len(keys))

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense[self.pair[codes >> 16] * self.width + self.pair[codes & 0xFFFF]]
        return _find(self.keys[-1], codes.astype(np.int64))

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits for the last byte of each code, one column per language."""
        rows = self._rows(codes)
        cost = self.cost[-1][rows]
        missed = np.flatnonzero(rows < 0)
        if len(missed):
            cost[missed] = self._shorter(codes[missed].astype(np.int64), ORDER + 1)
        return cost

    def _shorter(self, codes: np.ndarray, depth: int) -> np.ndarray:
        """Bits for codes of which no language has the node at ``depth``."""
        contexts, escape = self.escape[depth - 1]
        at = _find(contexts, (codes & ((1 << 8 * depth) - 1)) >> 8)
        bits = np.where((at >= 0)[:, None], escape[at], 0.0)
        if depth == 1:
            return bits + 8.0
        at = _find(self.keys[depth - 2], codes & ((1 << 8 * (depth - 1)) - 1))
        found = at >= 0
        bits[found] += self.cost[depth - 2][at[found]]
        if not found.all():
            bits[~found] += self._shorter(codes[~found], depth - 1)
        return bits

    def text_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths of whole texts in bits: a row per text, a column per language."""
        data = PAD + PAD.join(texts)
        sizes = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
        edges = np.stack([starts, starts + sizes], axis=1)
        sums = np.zeros((*edges.shape, len(self.langs)))
        base, n = np.zeros(len(self.langs)), len(data) - ORDER
        for low in range(0, n, WINDOW):
            high = min(low + WINDOW, n)
            running = np.cumsum(self.lengths(_codes(data[low : high + ORDER])), axis=0, dtype=np.float64)
            inside = (edges > low) & (edges <= high)
            sums[inside] = base + running[edges[inside] - low - 1]
            base = base + running[-1]
        return sums[:, 1] - sums[:, 0]


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``; -1 where it isn't there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def fit(labelled: DataFrame, id_column: str = "doc_id", rows: int = FIT_ROWS, nodes: int = MAX_NODES) -> ContextTrees:
    """Trees of every language among ``labelled`` (id, ``lang``, ``text``), nulls left out.

    Each language gives about ``rows`` texts, chosen by a hash of their ids; the counting is a
    Spark job.  At most ``nodes`` nodes reach the driver, of each language its most frequent ones up
    to a common bound, so that frequent languages take nothing from the tree of a rare one.
    """
    known = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    often = known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGS)
    sizes = {r["lang"]: r["count"] for r in often.collect()}
    if not sizes:
        return ContextTrees(pd.DataFrame({"lang": [], "gram": [], "n": []}))
    steps = 1 << 20
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(steps * min(1, rows / n)) + 1)])
    chosen = known.where(F.pmod(F.xxhash64(id_column), F.lit(steps)) < share[F.col("lang")])
    counts = written(count_nodes(chosen), "nodes")
    bound = _common_bound([r["count"] for r in counts.groupBy("lang").count().collect()], nodes)
    frequent = W.partitionBy("lang").orderBy(F.col("n").desc(), "gram")
    kept = counts.withColumn("_rank", F.row_number().over(frequent)).where(F.col("_rank") <= bound)
    return ContextTrees(kept.select("lang", "gram", "n").toPandas())


def _common_bound(sizes: list[int], total: int) -> int:
    """The largest bound that leaves at most ``total`` of all, should each size be cut at it."""
    left = total
    for k, size in enumerate(sorted(sizes)):
        share = left // (len(sizes) - k)
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def identify(frame: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """``frame`` with ``lang_pred`` and ``score``, the share of the language among all code lengths.

    The whole text counts.  A text that is null or has no letter gets ``und`` and 0, and so does
    every text if no language was learned.  Equal lengths go to the first language by name.
    Columns of these names are replaced.
    """
    frame = frame.drop("lang_pred", "score")
    shared = dealt_out(frame.sparkSession, trees)
    at = frame.columns.index(text)
    schema = T.StructType([*frame.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            langs, scores = _best(trees, texts)
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def _best(trees: ContextTrees, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    if not trees.langs or not texts:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    bits = trees.text_lengths([plain(t) for t in texts])
    share = np.exp2(bits.min(axis=1, keepdims=True) - bits)
    share /= share.sum(axis=1, keepdims=True)
    best = bits.argmin(axis=1)
    known = np.array([has_letter(t) for t in texts])
    langs = [trees.langs[k] if ok else UNKNOWN for k, ok in zip(best, known)]
    return langs, np.where(known, share[np.arange(len(texts)), best], 0.0)


def identify_documents(documents: DataFrame) -> DataFrame:
    """Languages of all documents by trees grown from those that are not held out."""
    trees = fit(documents.where(~held_out()).select("doc_id", "lang", "text"))
    found = identify(documents.select("doc_id", "text"), trees)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
