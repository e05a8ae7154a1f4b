"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.runtime import materialize

MOST_ROUNDS = 40


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Hang each node's neighbours (small: the smaller ones and the node) on the least of them.

    The least neighbour is an aggregate and comes back by a join, so a hub's neighbours are
    never one task's group.
    """
    if small:
        around = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written first: a join of two plain exchanges lets Spark split a hub's rows
    least = materialize(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    hung = around.join(least, "u")
    if small:
        moved = hung.filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
    return hung.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _is_flat(edges: DataFrame) -> bool:
    """Whether every node hangs on one root and no root hangs on anything."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("root")))).alias("e"))
    seen = ends.select("e.node", "e.root").groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("root").isNull()).alias("is_root"))
    return seen.filter((F.col("low") != F.col("high")) | (F.col("is_root") & F.col("low").isNotNull())).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node on an edge (a, b); alternating stars.

    Each round's edges are written to the shared folder; rounds grow with the logarithm of
    the number of nodes, and stars need one. Loops and repeated edges are fine.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(MOST_ROUNDS):
        large = materialize(_star(now, small=False), "edges")
        now = materialize(_star(large, small=True), "edges")
        if _is_flat(now):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
