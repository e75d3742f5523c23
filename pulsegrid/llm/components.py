"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """`(node, root)` for each node with an edge; root is the component's smallest node.

    `edges` has long columns src and dst. Rounds of two star steps: each node hands its larger neighbours to the
    smallest one it sees, then its smaller neighbours. Every step is an aggregation (combined on the map side) and
    a join, so that a node with very many neighbours is never held in one place; each round is checkpointed.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.union(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        else:
            both = e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        low = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        out = both.join(low, "src")
        if large:
            return out.filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).filter("src <> dst").distinct()
        return out.select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(low.select("src", F.col("m").alias("dst"))).filter("src <> dst").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())

    now = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    was = None
    while (seen := mark(now)) != was:
        was = seen
        now = cut(star(star(now, True), False))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("root")).union(now.select(F.col("dst").alias("node"), F.col("dst").alias("root"))).distinct()
