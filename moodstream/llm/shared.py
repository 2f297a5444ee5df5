"""Small helpers that several corpus operators use."""

from __future__ import annotations

import gc
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as every contract on words counts it.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a task handles at once.
PORTION = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows set aside for testing: crc32 of the id as text leaves 1 on division by 3.

    A row without an id counts as held out, so nothing is learned from it.
    """
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(True))


def hash_share(share: float, *columns: str) -> Column:
    """A repeatable choice of about ``share`` of the rows, by a hash of ``columns``."""
    steps = 1 << 20
    return F.pmod(F.xxhash64(*columns), F.lit(steps)) < int(max(1, min(1.0, share) * steps))


def in_order(frame: DataFrame, *keys: str) -> DataFrame:
    """``frame`` sorted over all partitions, with ``part`` and ``at``: partition and place there.

    Ties fall as they will: rows equal in every key are to be interchangeable.  A last key that
    counts the rows as they are scanned lets the range partitioner split a hot key.  The caller
    writes the result before using ``part`` twice, since a second run may cut the ranges elsewhere.
    """
    scanned = frame.withColumn("_scan", F.monotonically_increasing_id())
    order = [F.col(key).asc_nulls_first() for key in keys] + [F.col("_scan").asc()]
    placed = scanned.repartitionByRange(*order).sortWithinPartitions(*order).drop("_scan")
    place = F.monotonically_increasing_id()
    return placed.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("at"))


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps: it does once the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def dealt_out(spark: SparkSession, value: object) -> Callable[[], object]:
    """A function for tasks that gives ``value``; the value, classes included, is broadcast once."""
    box = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(box.value)


def remembered(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gave the first time in this worker process; later tasks find it again."""
    store = sys.modules.setdefault("_moodstream_remembered", ModuleType("_moodstream_remembered"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def portions(batch: pa.RecordBatch, at: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``PORTION`` bytes in column ``at``; a longer text comes alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False))
    low = 0
    while low < batch.num_rows:
        done = sizes[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(sizes, done + PORTION, side="right")))
        yield batch.slice(low, high - low)
        low = high
