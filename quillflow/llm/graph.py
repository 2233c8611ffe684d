"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillflow.llm.common import discard, written


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """One contraction: neighbours of u are hung on the least of them and u.

    The least neighbour is a partial aggregate, so a hub with a third of all edges sends one row per
    task; the join that follows is split by the adaptive skew join.
    """
    if small:
        both = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    else:
        both = edges.select("x", "y").unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("m"))
    hung = both.join(least, "x")
    if small:
        out = hung.select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(least.select("x", F.col("m").alias("y")))
    else:
        out = hung.where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return out.where("x <> y").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (x, y); root is the least node of its component.

    Each round is a table of its own, from which a lost executor's work is taken up again; the one before
    is deleted then.
    """
    edges = written(edges.where("x <> y").select("x", "y"), "edges")
    seen = None
    while True:
        before, edges = edges, written(_star(_star(edges, False), True), "edges")
        discard(before)
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    roots = edges.select(F.col("x").alias("node"), F.col("y").alias("root"))
    return roots.unionByName(edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())
