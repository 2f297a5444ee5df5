"""Removal of copies over the whole run, however far apart they come.

Layout below the root::

    seen/date=D/batch_id=N/     (did, id) of the posts kept, below the day of the post
    seen_bits/batch_id=N/       (date, bucket, bits): bitmaps of the hashed keys of each day

The bitmaps of all batches are merged by OR.  Most new posts hash to a bit that no day has set and are
let through at once; for the others the days whose bit is set are looked up, and only the ids of
those days are read for the exact answer.  A bitmap has false alarms but misses nothing.  All this
takes keys alone; only the rows of new posts are moved with their texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from moodstream.functions.timebuckets import utc_day
from moodstream.schemas import SEEN, SEEN_BITS
from moodstream.session import written
from moodstream.sources.lake import NO_DAY
from moodstream.streaming.jobs import start
from moodstream.streaming.state import read_table

#: Bits of a day's bitmap as a power of two: 27 takes 16 MB a day at most, and only where bits are set.
BITS = 27


_ORDER = ["timestamp", "text", "created_at"]


def _key_bits(frame: DataFrame, bits: int) -> DataFrame:
    """``bucket`` and ``place`` of each post's hashed key among the bitmaps of 32,768 bits."""
    hashed = F.pmod(F.xxhash64("did", "id"), F.lit(1 << bits))
    return frame.withColumns({"bucket": F.bitmap_bucket_number(hashed), "place": F.bitmap_bit_position(hashed)})


def _is_set(bits: str, place: str):
    """Whether a bit of a bitmap is set."""
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.col(place) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (F.col(place) % 8).cast("int")).bitwiseAND(1) == 1


def _same_key(left: DataFrame, right: DataFrame):
    return left["did"].eqNullSafe(right["did"]) & left["id"].eqNullSafe(right["id"])


def first_copies(batch: DataFrame, root: str, batch_id: int, *, bits: int = BITS) -> DataFrame:
    """The posts of a batch whose (author, id) neither the batch before them nor any earlier batch has.

    Of copies within the batch the earliest stays, ties by text.  A post without an id is no copy of
    any other.  What is kept is recorded before it is returned; a repeated batch does not see its own
    record, so it gives the same posts again.
    """
    spark = batch.sparkSession
    rest = [c for c in batch.columns if c not in ("did", "id", *_ORDER)]
    named = batch.where(F.col("id").isNotNull())
    keys = written(_key_bits(named.select("did", "id").distinct(), bits), "keys")  # the texts stay behind
    old = read_table(spark, f"{root}/seen_bits", SEEN_BITS).where(F.col("batch_id") < batch_id)
    days = old.groupBy("date", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    days = written(days, "bits")
    anywhere = days.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    maybe = keys.join(anywhere, "bucket").where(_is_set("bits", "place"))
    hits = maybe.drop("bits").join(days, "bucket").where(_is_set("bits", "place")).select("did", "id", "date")
    hits = written(hits, "hits")
    dates = [row.date for row in hits.select("date").distinct().collect()]  # days, not posts
    seen = read_table(spark, f"{root}/seen", SEEN).where(F.col("date").isin(dates) & (F.col("batch_id") < batch_id))
    same = F.col("h.did").eqNullSafe(F.col("s.did")) & (F.col("h.id") == F.col("s.id")) & (F.col("h.date") == F.col("s.date"))
    copies = written(hits.alias("h").join(seen.alias("s"), same, "left_semi").select("did", "id"), "copies")
    # A bitmap of the new keys, bounded by its bits, drops the rows of old ones before their text is
    # moved; those that share a bit with a new key meet the exact list.
    new = keys.join(copies, _same_key(keys, copies), "left_anti")
    new = written(new.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits")), "new-bits")
    rows = _key_bits(named, bits).join(F.broadcast(new), "bucket").where(_is_set("bits", "place"))
    rows = rows.select("did", "id", F.struct(*_ORDER, *rest).alias("post"), F.lit(False).alias("old"))
    rows = rows.unionByName(copies.select("did", "id", F.lit(True).alias("old")), allowMissingColumns=True)
    # combined before the shuffle: a hot post costs a row a task
    once = rows.groupBy("did", "id").agg(F.min("post").alias("post"), F.max("old").alias("old"))
    once = _key_bits(once.where(~F.col("old")).select("did", "id", "post.*"), bits)
    fresh = written(once.withColumn("date", F.coalesce(utc_day("timestamp"), F.lit(NO_DAY))), "fresh")
    _record(fresh, root, batch_id)
    return fresh.select(*batch.columns).unionByName(batch.where(F.col("id").isNull()))


def _record(fresh: DataFrame, root: str, batch_id: int) -> None:
    number = F.lit(batch_id).cast("long").alias("batch_id")
    ids = fresh.select("did", "id", "date", number).write.mode("overwrite")
    ids.option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch_id").parquet(f"{root}/seen")
    maps = fresh.groupBy("date", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    maps.write.mode("overwrite").parquet(f"{root}/seen_bits/batch_id={batch_id}")


def keep_first_copies(
    posts: DataFrame, root: str, out: str, checkpoint: str, *, bits: int = BITS, once: bool = False
) -> StreamingQuery:
    """Write each post of the stream once to ``out``, over the whole run."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        kept = first_copies(batch, root, batch_id, bits=bits)
        kept.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return start(posts.writeStream.foreachBatch(keep), checkpoint, once=once)


def seen_days(spark: SparkSession, root: str) -> DataFrame:
    """``(date, bits_set)``: how full the bitmap of each day is, a measure of its false alarms."""
    parts = read_table(spark, f"{root}/seen_bits", SEEN_BITS).groupBy("date", "bucket")
    merged = parts.agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    return merged.groupBy("date").agg(F.sum("n").alias("bits_set"))
