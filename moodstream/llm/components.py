"""Connected components of a large graph by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodstream.session import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of every node in ``edges(a, b)``: the smallest node it reaches.

    Each round hooks nodes to the smallest neighbour, first among the larger neighbours of a node,
    then among its smaller ones, until the graph is a set of stars.  Rounds are written to the
    shared folder.  Smallest neighbours are combined before the shuffle, and the joins read two
    written tables, so that Spark can split a node with very many neighbours.  Self links and nulls
    are left out; no edges, no rows.
    """
    edges = written(_tidy(edges.select("a", "b")), "edges")
    while True:
        grown = written(_tidy(_large_star(edges)), "large-star")
        shrunk = written(_tidy(_small_star(grown)), "small-star")
        if _is_star_forest(shrunk):
            break
        edges = shrunk
    roots = shrunk.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return shrunk.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.distinct()
    )


def _tidy(edges: DataFrame) -> DataFrame:
    """Larger node first, each edge once."""
    turned = edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    return turned.distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least.select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    # edges hold the larger node first: b's larger neighbours are the a's
    return edges.join(least, F.col("b") == F.col("u")).select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    least = written(least.withColumnRenamed("a", "u"), "least")
    hooked = edges.join(least, F.col("a") == F.col("u"))
    return hooked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
        least.select(F.col("u").alias("a"), F.col("m").alias("b"))
    )


def _is_star_forest(edges: DataFrame) -> bool:
    """No node hangs below two others, and no centre hangs below another node."""
    leaves = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
    if leaves.where("n > 1").limit(1).count():
        return False
    centres = edges.select(F.col("b").alias("a")).distinct()
    return not centres.join(leaves, "a", "left_semi").limit(1).count()
