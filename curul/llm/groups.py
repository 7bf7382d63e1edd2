"""From band groups to components, without comparing all pairs of a group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curul.llm.common import Scratch

Check = Callable[[DataFrame], DataFrame]


def possible(least: int, shared: str, own: str, other: str) -> str:
    """SQL: whether sets of sizes ``own`` and ``other`` with at most ``shared`` in common can reach the limit."""
    return f"100 * {shared} >= {least} * ({own} + {other} - {shared})"


def resolved(
    member: DataFrame,
    prepare: Callable[[DataFrame], tuple[Check, DataFrame]],
    join_up: Callable[[DataFrame, Scratch], DataFrame],
    least: int,
    scratch: Scratch,
) -> DataFrame:
    """(node, component) of the nodes with a verified link.

    ``member`` has a node's id and one row per band ``key``. ``prepare`` gets the ids that share a
    key with another and returns a check of pairs (a, b) on full sets, and the sets as (id, hashes).

    1. Each group's members are checked against one of them, the one that meets most others.
    2. Components are built. A group within one component is done, whatever its size.
    3. In the others, a set's hashes that no other open set has bound what it can share. Sets whose
       bound rules out every partner are set aside; the rest are checked across components.
    So no link between different sets is lost, and a group of many near copies costs one pair a member.
    """
    groups = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = scratch.table(member.join(groups, "key"))
    check, sets = prepare(met.select("id").distinct())
    central = met.groupBy("id").agg(F.sum("size").alias("met"))
    heads = met.join(central, "id").groupBy("key").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("head"))
    star = met.join(heads, "key").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct()
    links = scratch.table(check(star))
    found = join_up(links, scratch)

    labelled = met.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    mixed = labelled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    apart = scratch.table(labelled.select("key", "id", "component").join(mixed.select("key"), "key", "left_semi"))
    able = apart
    for _ in range(3):
        # Sets that were set aside no longer count: what only they share with a set is its own the next time.
        opened = sets.join(able.select("id").distinct(), "id", "left_semi")
        alone = opened.select("id", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("id").alias("id"))
        own = alone.where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
        bound = opened.select("id", F.size("hashes").alias("n")).join(own, "id", "left").select("id", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("shared"))
        bounded = scratch.table(able.select("key", "id", "component").join(bound, "id"))
        among = bounded.groupBy("key").agg(F.min("n").alias("least_n"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").drop("lo", "hi")
        able = scratch.table(bounded.join(among, "key").where(possible(least, "shared", "n", "greatest(least_n, shared)")).select("key", "id", "n", "shared", "component"))
    x, y = (able.select("key", *(F.col(c).alias(f"{c}_{k}") for c in ("id", "n", "shared", "component"))) for k in "xy")
    rest = x.join(y, "key").where("id_x < id_y and component_x <> component_y").where(possible(least, "least(shared_x, shared_y)", "n_x", "n_y"))
    more = scratch.table(check(rest.select(F.col("id_x").alias("a"), F.col("id_y").alias("b")).distinct()))
    if not more.limit(1).count():
        return found
    return join_up(links.union(more), scratch)


def verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= least * union."""
    left, right = (sets.select(F.col("id").alias(k), F.col("hashes").alias(f"set_{k}")) for k in "ab")
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("set_a", "set_b")))
    return met.where(F.lit(100) * F.col("both") >= F.lit(least) * (F.size("set_a") + F.size("set_b") - F.col("both"))).select("a", "b").distinct()
