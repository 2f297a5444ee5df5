"""Session settings and the shared scratch folder."""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGE_LOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def build_session(app: str = "moodstream", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on; ``conf`` overrides any of them.

    ``conf`` keys use ``__`` for ``.`` (``spark__sql__shuffle__partitions="8"``).
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        CHANGE_LOG: "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Pin the session zone: bucket and date strings are defined on UTC plus a fixed shift."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_streaming_state(spark: SparkSession) -> SparkSession:
    """Keep streaming state on local disk with change logs instead of on the executor heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set(CHANGE_LOG, "true")
    return spark


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables, below the shared folder the cluster names."""
    return f"{_scratch_base(spark)}/{label}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables; frames that read them are of no use afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_scratch_base(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _scratch_base(spark: SparkSession) -> str:
    """Only a local session may fall back to a machine-local folder; it goes when the process ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = _local_folder().name
    return f"{base.rstrip('/')}/moodstream"


@functools.cache
def _local_folder() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="moodstream-", ignore_cleanup_errors=True)


def written(frame: DataFrame, label: str) -> DataFrame:
    """``frame`` as a table in the scratch folder: computed once, and safe from lost executors."""
    path = scratch(frame.sparkSession, label)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def on_all_cores(table: DataFrame) -> DataFrame:
    """A table as read, its rows spread evenly: a file of few row groups is read by few tasks, however many there are.

    This shuffles the rows, so it is meant for work that costs far more.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(cores, table.rdd.getNumPartitions()))
