"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import settled


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: join each node's neighbours to the least of them and itself.

    The large step moves the neighbours above a node, the small step those
    below it. The least is found by an aggregation that combines on the map
    side, and brought back by a join, so that a node with very many neighbours
    isn't gathered anywhere.
    """
    out = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    if large:
        out = out.union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
    least = out.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    joined = out.join(least, F.col("u") == F.col("c"))
    if large:
        joined = joined.filter(F.col("v") > F.col("u"))
        return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a < b").distinct()
    moved = joined.filter("v <> m").select(F.col("m").alias("a"), F.col("v").alias("b"))
    return moved.union(least.filter("m <> c").select(F.col("m").alias("a"), F.col("c").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of `edges` (a long, b long).

    The component is the least node reachable. Loops are ignored, as are
    edges with a null end; a node that has no other edge isn't returned. Large
    and small star steps alternate until the edges stay as they are; their
    number grows with the logarithm of the longest path. Each round is written
    to the shared folder, so a lost executor costs at most one round.
    """
    ends = edges.filter("a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b")).distinct()
    now = settled(ends, "edges")
    mark = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if seen == mark or not seen[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        mark = seen
        now = settled(_stars(_stars(now, True), False), "edges")
