"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Documents carry labels, words don't.  Word labels for training come from the labelled documents: in
a toxic document a word is toxic if it, or a beginning of it, is found far more often in toxic than
in clean documents, and in many of them.  The field has two states and sees each word with its
beginnings; forward-backward marginals give every word of every text its probability, and a
logistic curve fitted to the same labelled documents turns their sum, their share and the largest
one into the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodstream.llm.shared import dealt_out, held_out, portions

#: Labelled documents that the model is fitted on, of each kind.
FIT_ROWS = 1500
WINDOW = 64
BUCKETS = 1 << 18
BEGINNINGS = (3, 4, 5, 6)
ROUNDS = 40
#: A sign of toxicity is in this share of the toxic texts, and this many times as frequent in them.
SHARE, RATIO = 0.03, 8.0
CUT = 0.7
FLOOR = 0.1
#: Words whose weights a task remembers.
REMEMBERED = 500_000

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def features(word: str) -> list[int]:
    """Checksums of the word and its beginnings; a short word has fewer beginnings."""
    parts = [f"={word}", *[word[:n] for n in BEGINNINGS if len(word) > n]]
    return [zlib.crc32(p.encode("utf-8", "replace")) for p in parts]


class ToxicSpans:
    """Field weights (bucket, state bias, transitions) and the curve from marginals to a score."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS)
        self.bias = -4.0
        self.moves = np.zeros((2, 2))
        self.curve = np.array([-3.0, 0.0, 0.0, 0.0])

    def emission(self, word: str) -> float:
        return float(np.clip(self.bias + self.weights[[f % BUCKETS for f in features(word)]].sum(), -30, 30))

    def marginals(self, emissions: np.ndarray, filled: np.ndarray, moves: bool = False):
        """Probability of the toxic state at each place of each window (rows), by forward-backward.

        ``filled`` marks the places that hold a word.  With ``moves`` also the expected transitions.
        """
        m, (rows, length) = np.exp(self.moves), emissions.shape
        psi = np.exp(emissions)
        clean, toxic = np.empty((length, rows)), np.empty((length, rows))
        o, t = np.full(rows, 0.5), np.full(rows, 0.5)
        for k in range(length):
            if k:
                o, t = o * m[0, 0] + t * m[1, 0], o * m[0, 1] + t * m[1, 1]
            t = t * psi[:, k]
            total = o + t
            o, t = o / total, t / total
            clean[k], toxic[k] = o, t
        out, pairs = np.empty((rows, length)), np.zeros((2, 2))
        bo, bt = np.full(rows, 1.0), np.full(rows, 1.0)
        for k in range(length - 1, -1, -1):
            o, t = clean[k] * bo, toxic[k] * bt
            out[:, k] = t / (o + t)
            if k == 0:
                break
            to, tt = bo, psi[:, k] * bt
            if moves:
                step = np.array([
                    [clean[k - 1] * m[0, 0] * to, clean[k - 1] * m[0, 1] * tt],
                    [toxic[k - 1] * m[1, 0] * to, toxic[k - 1] * m[1, 1] * tt],
                ])
                pairs += (step / step.sum(axis=(0, 1)) * filled[:, k]).sum(axis=2)
            bo, bt = m[0, 0] * to + m[0, 1] * tt, m[1, 0] * to + m[1, 1] * tt
            total = bo + bt
            here = filled[:, k]  # behind the last word nothing is known
            bo, bt = np.where(here, 2 * bo / total, 1.0), np.where(here, 2 * bt / total, 1.0)
        return (out * filled, pairs) if moves else out * filled

    def fit(self, texts: Iterable[str | None], toxic: np.ndarray, prior: float) -> ToxicSpans:
        """Learn from texts and labels of documents; ``prior`` is the toxic share of all."""
        if not toxic.any() or toxic.all():
            return self
        vocabulary: dict[str, int] = {}
        index = [
            np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in words(t)), np.int32) for t in texts
        ]
        rows = [features(w) for w in vocabulary]
        parts = np.fromiter(chain.from_iterable(rows), np.int64)
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        sign, flat = _signs(index, parts, of, toxic), parts % BUCKETS
        windows, filled, starts = _windows(index)
        labels = sign[windows] & np.repeat(toxic, np.diff(starts))[:, None] & filled
        seen = np.bincount(windows[filled], minlength=len(rows))
        observed_words = np.bincount(windows[labels], minlength=len(rows))
        inner = filled[:, 1:]
        observed_moves = np.array([
            [((labels[:, :-1] == a) & (labels[:, 1:] == b) & inner).sum() for b in (0, 1)] for a in (0, 1)
        ], float)
        squares, bias_square, move_squares = np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        for _ in range(ROUNDS):
            score = np.clip(self.bias + np.bincount(of, self.weights[flat], len(rows)), -30, 30)
            p, pairs = self.marginals(score[windows], filled, moves=True)
            slope = np.bincount(windows[filled], p[filled], len(rows)) - observed_words
            step = np.bincount(flat, slope[of], BUCKETS) + 0.1 * self.weights
            squares += step**2
            self.weights -= 0.8 * step / np.sqrt(squares)
            bias_square += slope.sum() ** 2
            self.bias -= 0.8 * slope.sum() / np.sqrt(bias_square)
            step = pairs - observed_moves + 0.1 * self.moves
            move_squares += step**2
            self.moves -= 0.3 * step / np.sqrt(move_squares)
        self.weights[np.bincount(flat, seen[of], BUCKETS) == 0] = 0.0
        score = np.clip(self.bias + np.bincount(of, self.weights[flat], len(rows)), -30, 30)
        p = self.marginals(score[windows], filled)
        self.curve = _logistic(_summary(p, filled, starts), toxic, prior)
        return self

    def scores(self, summary: np.ndarray) -> np.ndarray:
        z = self.curve[0] + summary @ self.curve[1:]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _signs(index: list[np.ndarray], parts: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which words tell toxic documents from clean ones, by themselves or a beginning.

    ``index`` holds each document's word numbers; ``parts`` the checksums of words and beginnings,
    ``of`` the word each belongs to.
    """
    n = of[-1] + 1 if len(of) else 0
    counts = [
        np.bincount(np.concatenate([np.zeros(0, np.int32), *[d for d, bad in zip(index, toxic) if bad == kind]]), minlength=n)
        for kind in (True, False)
    ]
    names, part = np.unique(parts, return_inverse=True)
    begin = np.searchsorted(of, np.arange(n + 1))
    inside, outside = (np.bincount(part, own[of], len(names)) for own in counts)
    spread = np.zeros(len(names))
    for words_, bad in zip(index, toxic):
        if bad and len(words_):
            spread[np.unique(np.concatenate([part[begin[w] : begin[w + 1]] for w in np.unique(words_)]))] += 1
    rate = (inside + 0.5) / max(1, counts[0].sum()), (outside + 0.5) / max(1, counts[1].sum())
    marks = (spread >= max(3, SHARE * toxic.sum())) & (rate[0] >= RATIO * rate[1])
    return np.bincount(of, marks[part], n) > 0


def _windows(index: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers of all texts in rows of ``WINDOW``, which places are filled, first row per text."""
    sizes = np.array([len(t) for t in index], np.int64)
    rows = -(-sizes // WINDOW)
    starts = np.concatenate([[0], np.cumsum(rows)])
    words = np.concatenate([*index, np.zeros(0, np.int64)]).astype(np.int64, copy=False)
    place = np.arange(len(words)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[:-1], sizes) * WINDOW
    out, filled = np.zeros(starts[-1] * WINDOW, np.int64), np.zeros(starts[-1] * WINDOW, bool)
    out[place], filled[place] = words, True
    return out.reshape(-1, WINDOW), filled.reshape(-1, WINDOW), starts


def _summary(p: np.ndarray, filled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: log of the expected toxic words, log of their share, the largest probability.

    Words below ``FLOOR`` count as clean, lest a long text add up to a toxic one.
    """
    rows = np.diff(starts)
    some = rows > 0
    first = starts[:-1][some]
    out = np.zeros((len(rows), 3))
    total, count, most = np.zeros(len(rows)), np.zeros(len(rows)), np.zeros(len(rows))
    if some.any():
        total[some] = np.add.reduceat(np.where(p >= FLOOR, p, 0).sum(axis=1), first)
        count[some] = np.add.reduceat(filled.sum(axis=1), first)
        most[some] = np.maximum.reduceat(p.max(axis=1), first)
    out[:, 0] = np.log(total + 0.1)
    out[:, 1] = np.log((total + 0.1) / (count + 20))
    out[:, 2] = most
    return out


def _logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1.0) -> np.ndarray:
    """Newton steps for a logistic curve; the intercept is moved from the sample's share to ``prior``.

    No sign of toxicity may lower the score, so slopes stay at zero or above.
    """
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        b += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - ridge * b), -2, 2)
        b[1:] = np.maximum(b[1:], 0)
    share = y.mean()
    b[0] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return b


def fit(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", rows: int = FIT_ROWS) -> ToxicSpans:
    """A model from ``documents`` (id, text) and ``labels`` (id, ``toxic`` 0 or 1).

    At most ``rows`` labelled rows of each kind are used, chosen by a hash of their ids, also where an
    id stands at many rows; other label values and nulls are left out.  An id with several labels counts as toxic if one is.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col(id_column).isNotNull())
    known = known.groupBy(id_column).agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return ToxicSpans()
    order = [F.xxhash64(id_column), F.col(id_column)]
    chosen = known.where("toxic = 0").orderBy(*order).limit(rows).unionByName(
        known.where("toxic = 1").orderBy(*order).limit(rows)
    )
    # 2 * rows ids at most
    sample = documents.select(id_column, "text").join(F.broadcast(chosen), id_column)
    parts = [sample.where(F.col("toxic") == kind).orderBy(*order, "text").limit(rows) for kind in (0, 1)]
    got = parts[0].unionByName(parts[1]).orderBy(id_column, "text").toPandas()
    return ToxicSpans().fit(got["text"], got["toxic"].to_numpy() == 1, sizes[1] / (sizes[0] + sizes[1]))


def tag(frame: DataFrame, model: ToxicSpans, text: str = "text") -> DataFrame:
    """``frame`` with ``score`` (0 to 1) and ``spans``: start, length and probability of toxic words.

    Whole texts are read, in windows of 64 words.  Start and length count code points.  A text that
    is null or without words has no spans and the score of no toxic words.  Columns of these names
    are replaced.
    """
    frame = frame.drop("score", "spans")
    shared = dealt_out(frame.sparkSession, model)
    at = frame.columns.index(text)
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
                         T.StructField("p", T.DoubleType())])
    schema = T.StructType([*frame.schema.fields, T.StructField("score", T.DoubleType()),
                           T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("p", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memory = shared(), {}
        for batch in batches:
            for part in portions(batch, at):
                texts = part.column(at).to_pylist()
                scores, spans = _tagged(model, memory, texts)
                columns = [*part.columns, pa.array(scores), pa.array(spans, arrow)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return frame.mapInArrow(run, schema)


def _tagged(model: ToxicSpans, memory: dict[str, float], texts: list[str | None]):
    if len(memory) > REMEMBERED:
        memory.clear()
    index = []
    for text in texts:
        found = words(text)
        for word in set(found).difference(memory):
            memory[word] = model.emission(word)
        index.append(np.fromiter(map(memory.__getitem__, found), np.float64, len(found)))
    places = [np.arange(len(e)) for e in index]
    emissions, filled, starts = _windows([e.view(np.int64) for e in index])
    p = model.marginals(emissions.view(np.float64), filled)
    scores = model.scores(_summary(p, filled, starts))
    spans = []
    for k, text in enumerate(texts):
        own = p[starts[k] : starts[k + 1]].ravel()[: len(places[k])]
        hits = np.flatnonzero(own >= 0.5)
        spans.append(_spans(text, hits, own) if len(hits) else [])
    return scores, spans


def _spans(text: str, hits: np.ndarray, p: np.ndarray) -> list[dict]:
    found, wanted = [], set(hits.tolist())
    matches = list(_WORDS.finditer(text))
    if len(matches) != len(p):  # lower case has other words than the text, as with a dotted capital I
        matches = list(_WORDS.finditer(text.lower()))
    for k in sorted(wanted):
        m = matches[k]
        found.append({"start": m.start(), "length": m.end() - m.start(), "p": float(p[k])})
    return found


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    model = fit(documents.select("doc_id", "text"), labels.where(~held_out()))
    found = tag(documents.select("doc_id", "text"), model)
    return found.select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"), "spans",
    )
