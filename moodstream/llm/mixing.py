"""Mix sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key divided by its quality weight; in key order within its
source, documents are taken until the source's word budget is spent.  A budget above the source's
size first takes complete epochs and then selects for the remaining part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from moodstream.llm.shared import WORD, in_order
from moodstream.session import written

MAX_EPOCHS = 3
MARKS = "0123456789#$%&*|!@=<>_~^+\\/"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """Weight from 0.05 to 1: falls with the share of digits and marks among the characters."""
    length = F.length(text)
    marks = length - F.length(F.translate(text, MARKS, ""))
    return F.when(length > 0, F.greatest(F.lit(0.05), 1 - 4 * marks / length)).otherwise(F.lit(0.05))


def sampling_key(doc_id: str = "doc_id", weight: str = "weight", seed: str = "0") -> Column:
    """-ln(u) / weight, u from the id's MD5: an exponential draw that every run repeats."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))))
    u = (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.ln(u) / F.col(weight)


def targets(sizes: DataFrame) -> DataFrame:
    """A source's budget from ``source, source_size``: adds ``target``.

    Sources by code point, null last, weigh 1, 2, 3, repeating, and share the total of all sizes.
    No target is above three times its source; the excess goes to the others by weight.  Ordered
    by cap over weight the capped sources come first, so running sums give the share of the rest
    directly.  The windows see one row per source.
    """
    cap = F.col("source_size") * MAX_EPOCHS
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("_w", (F.row_number().over(order) - 1) % 3 + 1)
    fill = W.orderBy(cap / F.col("_w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    filled = weighed.select(
        "*",
        ((F.sum("source_size").over(everything) - F.coalesce(F.sum(cap).over(before), F.lit(0)))
         / F.sum("_w").over(after)).alias("_share"),
    )
    free = cap / F.col("_w") > F.col("_share")
    share = F.coalesce(F.max(F.when(free, F.col("_share"))).over(everything), F.lit(0.0))
    return filled.withColumn("target", F.least(cap.cast("double"), share * F.col("_w"))).drop("_w", "_share")


def mix(frame: DataFrame, id_column: str = "doc_id", seed: str = "0") -> DataFrame:
    """What the mix takes of each row of ``frame`` (id, ``source``, ``size``, ``weight``).

    Adds ``source_size``, ``target``, ``taken`` and ``key`` (the drawn key); drops nothing.  The document at the border of
    the selection gives as many words as the budget still needs, so a source's ``taken`` words add
    up to its target, rounded down.  A null source is a source; size 0 takes nothing; equal rows
    are interchangeable.  Columns that would clash are replaced.
    """
    frame = frame.drop("source_size", "target", "taken", "part", "at", "key")
    keyed = written(frame.withColumn("key", sampling_key(id_column, "weight", seed)), "keyed")
    placed = written(in_order(keyed, "source", "key", id_column, "size"), "mix-order")
    blocks = written(placed.groupBy("source", "part").agg(F.sum("size").alias("_words")), "mix-blocks")
    wanted = targets(blocks.groupBy("source").agg(F.sum("_words").alias("source_size")))
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("source", "part", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_start"))
    named = starts.join(wanted.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    named = named.select(F.col("source").alias("_source"), F.col("part").alias("_part"), "_start", "source_size", "target")
    within = W.partitionBy("part", "source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    running = placed.withColumn("_within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source"))
    joined = running.join(named, same)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target")) - epochs * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("_start") - F.col("_within"), F.lit(0)), F.col("size"))
    taken = (epochs * F.col("size") + part).cast("long")
    return joined.withColumn("taken", taken).drop("part", "at", "_part", "_source", "_start", "_within")


def sized(documents: DataFrame) -> DataFrame:
    """Ids, sources, word counts and quality weights of documents; a null text has no words."""
    return documents.select("doc_id", "source", word_count().alias("size"), quality().alias("weight"))


def mix_documents(documents: DataFrame, seed: str = "0") -> DataFrame:
    return mix(sized(documents), "doc_id", seed).select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def resample(documents: DataFrame, seed: str = "0") -> DataFrame:
    """``documents`` as the mix has them: each row as often as it is taken, none to three times.

    Within a source the selection is all that comes up to one place in key order, so that place and
    the number of complete epochs, one row per source, decide every row; texts are not shuffled.
    The document at the border is taken if at least half of its words are.  Documents without words
    go by their keys; a source without any words gives nothing.
    """
    found = mix(sized(documents), "doc_id", seed)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    place = F.struct(F.col("key"), F.col("doc_id"), F.col("size"))
    extra = 2 * (F.col("taken") - epochs * F.col("size")) >= F.col("size")
    borders = found.where("size > 0").groupBy("source").agg(
        F.max(epochs).alias("_epochs"), F.max(F.when(extra, place)).alias("_border")
    )
    borders = written(borders.withColumnRenamed("source", "_source"), "borders")
    drawn = documents.withColumns({"_size": word_count(), "_weight": quality()})
    drawn = drawn.withColumn("_key", sampling_key("doc_id", "_weight", seed))
    joined = drawn.join(borders, F.col("source").eqNullSafe(F.col("_source")))
    own = F.struct(F.col("_key").alias("key"), F.col("doc_id"), F.col("_size").alias("size"))
    copies = F.col("_epochs") + F.coalesce((own <= F.col("_border")).cast("long"), F.lit(0))
    repeated = joined.withColumn("_copies", copies).where("_copies > 0")
    return repeated.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*documents.columns)
