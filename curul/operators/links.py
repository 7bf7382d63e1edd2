"""Source links: denormalised, ranked, and the choice of the primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.operators.keyed import best_per_key
from curul.schema import DEFAULT_PRIORITY


def ranked_links(links: DataFrame, records: DataFrame, sources: DataFrame, inner: bool = False) -> DataFrame:
    """Links with the system and priority of their source.

    Outer form: a broken link keeps its row with the default priority and confidence 0. Inner
    form, for audits: a broken link is dropped. The planner broadcasts sources and records only
    where their size allows it.
    """
    how = "inner" if inner else "left"
    described = records.select(
        "source_record_id", "source_id", *[c for c in ("source_url", "record_type") if c in records.columns]
    ).join(sources.select("source_id", "system", "priority"), "source_id", how)
    joined = links.join(described.drop("source_id"), "source_record_id", how)
    if inner:
        return joined.withColumnRenamed("priority", "source_priority")
    return joined.withColumn(
        "source_priority", F.coalesce(F.col("priority"), F.lit(DEFAULT_PRIORITY))
    ).withColumn("confidence", F.coalesce(F.col("confidence"), F.lit(0))).drop("priority")


def link_order() -> list[Column]:
    """Best link first."""
    return [
        F.col("source_priority").asc(),
        F.col("confidence").desc(),
        F.coalesce(F.col("system"), F.lit("")).asc(),
        F.col("link_id").asc(),
    ]


def primary_links(ranked: DataFrame) -> DataFrame:
    """One link per initiative: lowest priority, highest confidence, system, link id."""
    return best_per_key(ranked, ["initiative_id"], link_order())


def rebalanced_links(ranked: DataFrame) -> DataFrame:
    """Links with ``is_primary`` set on the chosen one only; ``was_primary`` keeps the old flag.

    The choice is joined back by link id, which is unique, so a much-linked initiative does not
    become one join partition.
    """
    chosen = primary_links(ranked).select("link_id", F.lit(True).alias("_chosen"))
    return (
        ranked.withColumnRenamed("is_primary", "was_primary")
        .join(chosen, "link_id", "left")
        .withColumn("is_primary", F.coalesce(F.col("_chosen"), F.lit(False)))
        .drop("_chosen")
    )


def rebalance_report(rebalanced: DataFrame) -> DataFrame:
    """Per initiative: whether a flag changed, the chosen link and system, the number of links."""
    return rebalanced.groupBy("initiative_id").agg(
        F.bool_or(F.col("is_primary") != F.col("was_primary")).alias("changed"),
        F.max(F.when(F.col("is_primary"), F.col("link_id"))).alias("selected_link_id"),
        F.max(F.when(F.col("is_primary"), F.col("system"))).alias("selected_system"),
        F.count(F.lit(1)).alias("link_count"),
    )


def source_summary(ranked: DataFrame) -> DataFrame:
    """Per initiative: lowest priority and the sorted set of systems, which has five values at most."""
    return ranked.groupBy("initiative_id").agg(
        F.min("source_priority").alias("source_priority"),
        F.sort_array(F.collect_set("system")).alias("source_systems"),
    )
