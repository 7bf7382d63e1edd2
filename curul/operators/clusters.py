"""Duplicate initiatives and author variants: clusters, canonical picks and merge plans.

Clusters are kept as one row per cluster plus one row per member. A cluster of copies may hold a
large share of all rows, so members are never collected into an array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curul.functions.names import display_quality, loose_key, merge_key
from curul.functions.status import status_rank
from curul.functions.text import as_col, normalize_text
from curul.operators.keyed import best_per_key, with_count
from curul.schema import DEFAULT_PRIORITY

# --- fixed values: weights of the two confidences ---------------------------------------------
VARIANT_BASE, VARIANT_SHARE, VARIANT_QUALITY, VARIANT_QUALITY_STEPS = 0.45, 0.4, 0.03, 4
QUALITY_GAP = 3
DUPLICATE_BASE, DUPLICATE_PRIORITY, DUPLICATE_STATUS, DUPLICATE_COUNT = 60, 15, 10, 5
CONFIDENCE_CAP = 0.99
# --- end of fixed values ----------------------------------------------------------------------


def first_wins(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """One record per key, the earliest by input position."""
    return best_per_key(records, keys, [F.col(position).asc()])


# ---- author variants -------------------------------------------------------------------------


def keyed_authors(authors: DataFrame) -> DataFrame:
    """Authors with the key of their variant cluster; a missing chamber is a group of its own."""
    return authors.withColumn("loose_key", loose_key("full_name")).withColumn(
        "cluster_key",
        F.concat_ws("|", F.col("loose_key"), F.coalesce(F.col("chamber"), F.lit("no-chamber"))),
    )


def variant_clusters(authors: DataFrame) -> DataFrame:
    """Clusters of more than one author with more than one spelling."""
    keyed = authors if "cluster_key" in authors.columns else keyed_authors(authors)
    return (
        keyed.groupBy("cluster_key", "loose_key", "chamber")
        .agg(
            F.count(F.lit(1)).alias("n_authors"),
            F.min("full_name").alias("first_name"),
            F.max("full_name").alias("last_name"),
            F.min("name_normalized").alias("_low"),
            F.max("name_normalized").alias("_high"),
        )
        .filter(
            (F.col("n_authors") > 1)
            & ((F.col("first_name") != F.col("last_name")) | (F.col("_low") != F.col("_high")))
        )
        .drop("_low", "_high")
    )


def variant_names(authors: DataFrame) -> DataFrame:
    """The distinct spellings of each cluster, one row each."""
    keyed = keyed_authors(authors)
    return keyed.join(variant_clusters(keyed).select("cluster_key"), "cluster_key").groupBy(
        "cluster_key", "full_name"
    ).agg(F.count(F.lit(1)).alias("n_authors"))


def variant_members(authors: DataFrame, relations: DataFrame) -> DataFrame:
    """Members of variant clusters with their initiative count and display quality."""
    keyed = keyed_authors(authors)
    clusters = variant_clusters(keyed).select("cluster_key")
    members = keyed.join(clusters, "cluster_key")
    counted = with_count(members, "id", relations, "author_id", "initiative_count")
    return counted.withColumn("quality", display_quality("full_name"))


def _defeats(members: DataFrame) -> DataFrame:
    """(cluster, quality, count) -> how many members of the cluster are preferred to such a one.

    A is preferred to B if its quality is at least three higher; within that gap the larger
    initiative count decides, then the higher quality. The relation is not transitive, so members
    are ordered by the number of members preferred to them: the same order wherever the relation
    is consistent, and a definite one where it runs in a circle. It is counted on the histogram of
    (quality, count), whose size is bounded by the spread of the counts, not by the members.
    """
    histogram = members.groupBy("cluster_key", "quality", "initiative_count").agg(
        F.count(F.lit(1)).alias("n")
    )
    far_better = Window.partitionBy("cluster_key").orderBy(F.col("quality").desc()).rangeBetween(
        Window.unboundedPreceding, -QUALITY_GAP
    )
    near = range(-(QUALITY_GAP - 1), QUALITY_GAP)
    entry = lambda target, turn, n: F.struct(target.alias("target"), F.lit(turn).alias("turn"), n.alias("n"))
    quality = F.col("quality")
    # Each bar of the histogram stands before (turn 0) or after (turn 2) the equal count it meets.
    entries = [entry(quality, 1, F.lit(0).cast("long"))]
    entries += [entry(quality - d, 0 if d > 0 else 2, F.col("n")) for d in near]
    running = (
        Window.partitionBy("cluster_key", "target")
        .orderBy(F.col("initiative_count").desc(), F.col("turn"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        histogram.withColumn("_far", F.coalesce(F.sum("n").over(far_better), F.lit(0)))
        .select("cluster_key", "initiative_count", "_far", F.explode(F.array(*entries)).alias("e"))
        .select("cluster_key", "initiative_count", "_far", "e.*")
        .withColumn("_near", F.sum("n").over(running))
        .filter(F.col("turn") == 1)
        .select(
            "cluster_key",
            F.col("target").alias("quality"),
            "initiative_count",
            (F.col("_far") + F.col("_near")).alias("defeats"),
        )
    )


def ranked_variants(authors: DataFrame, relations: DataFrame) -> DataFrame:
    """Members with ``defeats``; order a cluster by (defeats, name, id) to list its aliases."""
    members = variant_members(authors, relations)
    return members.join(_defeats(members), ["cluster_key", "quality", "initiative_count"])


def variant_order() -> list[Column]:
    """Canonical author first, then the aliases."""
    return [
        F.col("defeats").asc(),
        normalize_text("full_name").asc(),
        F.col("full_name").asc(),
        F.col("id").asc(),
    ]


def variant_confidence(share: Column, quality_gain: Column) -> Column:
    steps = F.least(F.greatest(quality_gain, F.lit(0)), F.lit(VARIANT_QUALITY_STEPS))
    score = F.lit(VARIANT_BASE) + share * VARIANT_SHARE + steps * VARIANT_QUALITY
    return F.round(F.least(F.lit(CONFIDENCE_CAP), score), 2)


def variant_suggestions(ranked: DataFrame) -> DataFrame:
    """One row per cluster: canonical author, confidence, size and total relations."""
    weight = F.greatest(F.col("initiative_count"), F.lit(1))
    totals = ranked.groupBy("cluster_key").agg(
        F.sum(weight).alias("total_relations"), F.count(F.lit(1)).alias("n_authors")
    )
    pick = lambda position, column: F.max(F.when(F.col("_rank") == position, F.col(column)))
    leaders = (
        best_per_key(ranked, ["cluster_key"], variant_order(), k=2, rank="_rank")
        .groupBy("cluster_key", "loose_key", "chamber")
        .agg(
            pick(1, "id").alias("canonical_author_id"),
            pick(1, "full_name").alias("canonical_full_name"),
            pick(1, "initiative_count").alias("_count"),
            (pick(1, "quality") - pick(2, "quality")).alias("_gain"),
        )
    )
    share = F.greatest(F.col("_count"), F.lit(1)) / F.col("total_relations")
    return (
        leaders.join(totals, "cluster_key")
        .withColumn("confidence", variant_confidence(share, F.col("_gain")))
        .drop("_count", "_gain")
    )


def safe_author_merges(ranked: DataFrame, suggestions: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Alias -> canonical author, only where every spelling of the cluster has the same merge key."""
    keys = (
        ranked.withColumn("_key", merge_key("full_name"))
        .groupBy("cluster_key")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count("_key").alias("_keyed"),
            F.min("_key").alias("canonical_key"),
            F.max("_key").alias("_high"),
        )
        .filter((F.col("_n") == F.col("_keyed")) & (F.col("canonical_key") == F.col("_high")))
        .select("cluster_key", "canonical_key")
    )
    plans = suggestions.filter(F.col("confidence") >= min_confidence).join(keys, "cluster_key").select(
        "cluster_key", "canonical_author_id", "canonical_full_name", "confidence", "canonical_key"
    )
    return (
        ranked.select("cluster_key", F.col("id").alias("alias_author_id"), F.col("full_name").alias("alias_name"))
        .join(plans, "cluster_key")
        .filter(F.col("alias_author_id") != F.col("canonical_author_id"))
    )


# ---- duplicate initiatives -------------------------------------------------------------------


def match_key(title: Column | str = "title_normalized", date: Column | str = "presented_at", chamber: Column | str = "originating_chamber") -> Column:
    return F.concat_ws(
        "|",
        as_col(title),
        F.coalesce(as_col(date).cast("string"), F.lit("no-date")),
        F.coalesce(as_col(chamber), F.lit("no-chamber")),
    )


def duplicate_clusters(initiatives: DataFrame) -> DataFrame:
    """Clusters of initiatives with the same title, date and chamber."""
    return (
        initiatives.groupBy("title_normalized", "presented_at", "originating_chamber")
        .agg(F.count(F.lit(1)).alias("cluster_size"), F.min("id").alias("first_id"))
        .filter(F.col("cluster_size") > 1)
        .select(match_key().alias("match_key"), "cluster_size", "first_id")
    )


def duplicate_members(initiatives: DataFrame) -> DataFrame:
    """The initiatives of the duplicate clusters, one row each."""
    clusters = duplicate_clusters(initiatives).drop("first_id")
    return initiatives.withColumn("match_key", match_key()).join(clusters, "match_key")


def duplicate_candidates(
    members: DataFrame,
    sources_per_initiative: DataFrame,
    links: DataFrame,
    events: DataFrame,
    relations: DataFrame,
    commissions: DataFrame | None = None,
) -> DataFrame:
    """Members with what the canonical pick looks at."""
    priority = sources_per_initiative.select(
        F.col("initiative_id").alias("id"), "source_priority", "source_systems"
    )
    out = members.join(priority, "id", "left").withColumn(
        "source_priority", F.coalesce(F.col("source_priority"), F.lit(DEFAULT_PRIORITY))
    )
    out = with_count(out, "id", links, "initiative_id", "link_count")
    out = with_count(out, "id", events, "initiative_id", "event_count")
    out = with_count(out, "id", relations, "initiative_id", "author_count")
    if commissions is None:
        return out.withColumn("commission_count", F.lit(0).cast("long"))
    return with_count(out, "id", commissions, "initiative_id", "commission_count")


def duplicate_order() -> list[Column]:
    """Canonical initiative first."""
    return [
        F.col("source_priority").asc(),
        status_rank("normalized_status").desc(),
        F.col("link_count").desc(),
        F.col("event_count").desc(),
        F.col("author_count").desc(),
        F.col("commission_count").desc(),
        F.coalesce(F.col("parser"), F.lit("")).asc(),
        F.col("id").asc(),
    ]


def duplicate_plans(candidates: DataFrame) -> DataFrame:
    """One row per cluster: canonical initiative, confidence, reasons."""
    compared = (
        "source_priority", "link_count", "event_count", "author_count", "commission_count", "_status",
        "id", "canonical_title", "normalized_status", "parser",
    )
    two = best_per_key(
        candidates.withColumn("_status", status_rank("normalized_status")),
        ["match_key"],
        duplicate_order(),
        k=2,
        rank="_rank",
    )
    row = F.struct(*compared)
    pair = two.groupBy("match_key", "cluster_size").agg(
        F.max(F.when(F.col("_rank") == 1, row)).alias("best"),
        F.max(F.when(F.col("_rank") == 2, row)).alias("next"),
    )
    more = lambda c: F.col(f"best.{c}") > F.col(f"next.{c}")
    points = lambda condition, value: F.when(condition, value).otherwise(0)
    score = (
        DUPLICATE_BASE
        + points(F.col("best.source_priority") < F.col("next.source_priority"), DUPLICATE_PRIORITY)
        + points(more("_status"), DUPLICATE_STATUS)
        + points(more("link_count"), DUPLICATE_COUNT)
        + points(more("event_count"), DUPLICATE_COUNT)
        + points(more("author_count") | more("commission_count"), DUPLICATE_COUNT)
    )
    reasons = F.concat_ws(
        "; ",
        F.concat(F.lit("parser="), F.coalesce(F.col("best.parser"), F.lit("unknown"))),
        F.concat(F.lit("sourcePriority="), F.col("best.source_priority")),
        F.concat(F.lit("status="), F.col("best.normalized_status")),
        F.concat(F.lit("links="), F.col("best.link_count")),
        F.concat(F.lit("events="), F.col("best.event_count")),
    )
    return pair.select(
        "match_key",
        "cluster_size",
        F.col("best.id").alias("canonical_initiative_id"),
        F.col("best.canonical_title").alias("canonical_title"),
        (F.least(score, F.lit(99)) / 100).alias("confidence"),
        reasons.alias("reason"),
    )


def duplicate_pairs(members: DataFrame, plans: DataFrame) -> DataFrame:
    """(duplicate, canonical, confidence) for every member but the canonical one."""
    return (
        members.select("match_key", F.col("id").alias("duplicate_initiative_id"))
        .join(plans.select("match_key", "canonical_initiative_id", "confidence"), "match_key")
        .filter(F.col("duplicate_initiative_id") != F.col("canonical_initiative_id"))
    )
