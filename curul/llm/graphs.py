"""Connected components as rounds of joins over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curul.llm.common import Scratch


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _stars(rows: DataFrame, salts: int = 8) -> DataFrame:
    """(u, v) with ``m``, the smallest of u and its neighbours; a hub's rows are dealt over several tasks."""
    least = rows.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    spread = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "salt"]).drop("salt")


def alternating_stars(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node on an edge: the smallest node reachable.

    Large-star joins each node's larger neighbours to the smallest one; small-star joins its smaller
    neighbours and itself. Edges never grow in number, and a few rounds leave one star per
    component. Each round is written, so no lineage grows; the driver sees a count and a hash.
    """
    both = edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).where("u <> v").distinct()
    now = scratch.table(both)
    state = _state(now)
    while True:
        sides = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(sides).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _stars(large)
        now = scratch.table(small.select("v", "m").union(small.select("u", "m")).toDF("u", "v").where("u <> v").distinct())
        new = _state(now)
        if new == state:
            break
        state = new
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.union(now.select("v", "v").distinct())


def union_find(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node on an edge, as a distributed union-find.

    A round hooks every root to its smallest neighbouring root, halves the paths to the roots by
    pointer jumping until none changes, and rewrites the edges between roots. Roots that have no
    edge left are done. Each round is written; the driver sees counts only.
    """
    left = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    nodes = left.select("a").union(left.select("b")).distinct().toDF("node")
    parents = None
    while left.limit(1).count():
        # The smaller root is never hooked to a larger one, so there are no cycles.
        hooks = scratch.table(left.groupBy("b").agg(F.min("a").alias("up")).toDF("node", "up"))
        while True:
            above = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = scratch.table(hooks.join(above, "up", "left").select("node", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
            hooks = jumped.select("node", "up")
            if not jumped.where("moved").limit(1).count():
                break
        if parents is None:
            parents = hooks
        else:
            onward = hooks.select(F.col("node").alias("up"), F.col("up").alias("top"))
            parents = scratch.table(parents.join(onward, "up", "left").select("node", F.coalesce("top", "up").alias("up")).unionByName(hooks))
        for end in ("a", "b"):
            root = hooks.select(F.col("node").alias(end), F.col("up").alias("root"))
            left = left.join(root, end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
        left = scratch.table(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    if parents is None:
        return nodes.select("node", F.col("node").alias("component"))
    return nodes.join(parents, "node", "left").select("node", F.coalesce("up", "node").alias("component"))
