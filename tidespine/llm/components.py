"""Connected components of a table of links, by alternating star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidespine.llm.common import Scratch


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long), root being the smallest node reachable; roots stand for themselves.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones, until only stars are left: about
    the logarithm of the longest path in rounds. Neighbours are never gathered: a node needs its smallest neighbour alone, a minimum that is
    combined before the shuffle. The links of a node with a third of all links meet that one row in a join whose large partitions Spark splits.
    Self links and repeated links change nothing, nulls are dropped as links to nothing, and an empty table gives none. The links of a round are
    dropped when the next round's are written.
    """
    held = Scratch(links.sparkSession)
    edges = held.stored(_oriented(links.select(F.col("a").cast("long"), F.col("b").cast("long"))), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))  # each node with each neighbour
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")).select("node", F.least("node", "least").alias("least"))
        large = _oriented(edges.join(least, edges["lo"] == least["node"]).select(F.col("hi").alias("a"), F.col("least").alias("b")))
        lowest = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
        small = large.join(lowest, large["hi"] == lowest["node"]).select(F.col("lo").alias("a"), F.col("least").alias("b"))
        last, held = held, Scratch(links.sparkSession)
        edges = held.stored(_oriented(small.union(lowest.select("node", "least"))), "links")
        last.drop()
        seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _oriented(links: DataFrame) -> DataFrame:
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
