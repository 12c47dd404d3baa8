"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import Spread, cut, discard


def _least(edges: DataFrame, spread: Spread, least: Column) -> tuple[DataFrame, DataFrame]:
    """``edges`` with ``m`` of their ``u``, and ``m`` by ``u``. The edges of a hub are dealt to several tasks."""
    by_node = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", least.alias("m"))
    return spread.join(edges, by_node, "v"), by_node


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a and b; returns (node, root), root the least node.

    Alternating large-star and small-star steps: each needs a minimum by node,
    summed before the shuffle, and one join. Every round is written to the
    shared folder, and takes the place of the one before. It ends when all edges
    are those of stars around their least nodes. Nodes without an edge are not
    returned.
    """
    e = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "edges",
    )
    while True:
        both = e.select("u", "v", F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("up")))
        degrees = both.groupBy("u").agg(F.count("*").alias("degree"), F.sum("up").alias("up"))
        # a star's node has one edge, to its root; a root has none to a lesser node
        loose = F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("degree") > 1)))
        top, open_ = degrees.agg(F.max("degree"), loose).first()
        if not open_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        # a node's degree doesn't grow in the large step, so the hubs of the small one are among these
        spread = Spread(degrees, ["u"], "degree", top)
        large, _ = _least(both.select("u", "v"), spread, F.least("u", "m"))
        large = large.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small, least = _least(large, spread, F.col("m"))
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        discard(last)
