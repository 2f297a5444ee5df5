"""Totals and newest posts of each source in Spark's keyed state, with expiry.

State lives in RocksDB: per source one row of totals and a short map of its newest posts.  Every
batch costs the sources it touches, not the run; a source that stays silent for ``idle`` seconds
of event time is forgotten by a timer, and begins anew if it comes back.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moodstream.functions.scoring import Scorer, keyword_sentiment
from moodstream.session import use_streaming_state
from moodstream.streaming.jobs import event_times

TOTALS = "total long, positive long, negative long, neutral long, sum_score double, last_ms long"
NEWEST = "timestamp double, label string, score double"
OUT = (
    "source string, total long, positive long, negative long, neutral long, sum_score double, expired boolean,"
    " newest array<struct<id: string, timestamp: double, label: string, score: double>>"
)
NAMES = ["source", "total", "positive", "negative", "neutral", "sum_score", "expired", "newest"]


class SourceTotals(StatefulProcessor):
    """Running totals and the ``keep`` newest posts of one source; of equal times the greater id is newer."""

    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", TOTALS)
        self.newest = handle.getMapState("newest", "id string", NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        total, positive, negative, neutral, score, last = self.totals.get() if self.totals.exists() else (0, 0, 0, 0, 0.0, 0)
        best = {k[0]: tuple(v) for k, v in self.newest.iterator()}
        known = set(best)
        for frame in rows:  # one part of the key's rows at a time
            counts = frame["label"].value_counts()
            total += len(frame)
            positive += int(counts.get("positive", 0))
            negative += int(counts.get("negative", 0))
            neutral += int(counts.get("neutral", 0))
            score += float(frame["score"].sum())
            last = max(last, int(frame["event_time"].max().timestamp() * 1000))
            some = frame.dropna(subset=["id"]).sort_values(["timestamp", "id"]).tail(self.keep)
            best |= {r.id: (float(r.timestamp), r.label, float(r.score)) for r in some.itertuples(index=False)}
            best = dict(sorted(best.items(), key=lambda x: (x[1][0], x[0]))[-self.keep :])
        for gone in known - set(best):
            self.newest.removeKey((gone,))
        for id_, value in best.items():
            self.newest.updateValue((id_,), value)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(last + self.idle_ms)
        self.totals.update((total, positive, negative, neutral, score, last))
        yield self._row(key, (total, positive, negative, neutral, score), best, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.totals.exists():
            gone = tuple(self.totals.get())[:5]
            self.totals.clear()
            self.newest.clear()
            yield self._row(key, gone, {}, True)

    def close(self) -> None:
        pass

    def _row(self, key, totals: tuple, best: dict, expired: bool) -> pd.DataFrame:
        newest = [{"id": k, "timestamp": v[0], "label": v[1], "score": v[2]} for k, v in best.items()][::-1]
        return pd.DataFrame([(key[0], *totals, expired, newest)], columns=NAMES)


def source_state(
    posts: DataFrame, *, keep: int = 50, idle: float | None = None, delay: str = "10 minutes",
    scorer: Scorer = keyword_sentiment,
) -> DataFrame:
    """A row for each source that a batch touches, with its state after it, and one for each that expires.

    In update mode the newest row of a source is its present state.  Posts without a source form
    one of their own.  The text is scored where it is read and does not reach the state.  With
    ``idle`` a source expires when the watermark passes its newest post by that many seconds, and
    posts behind the watermark are dropped, as in every watermarked query.
    """
    use_streaming_state(posts.sparkSession)
    timed = event_times(posts).withColumn("sentiment", scorer(F.col("text")))
    narrow = timed.select(
        F.coalesce("source", F.lit("")).alias("source"), "id", F.col("timestamp"), "event_time",
        F.col("sentiment.label").alias("label"), F.col("sentiment.score").cast("double").alias("score"),
    )
    mode = "None"
    if idle is not None:
        narrow, mode = narrow.withWatermark("event_time", delay), "EventTime"
    idle_ms = None if idle is None else int(idle * 1000)
    return narrow.groupBy("source").transformWithStateInPandas(
        SourceTotals(keep, idle_ms), outputStructType=OUT, outputMode="Update", timeMode=mode
    )
