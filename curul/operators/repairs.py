"""Repairs: artifact authors, re-derived author lists, commission backfill."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curul.functions.commissions import BACKFILL_KEYS, raw_commission_text, senate_commissions
from curul.functions.names import is_artifact, proponent_signers, repaired_artifact
from curul.functions.text import normalize_text
from curul.operators.keyed import best_per_key, without
from curul.operators.snapshots import find_or_create, replace_children


def artifact_plan(relations: DataFrame, authors: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Relations to artifact authors with the name behind them; action delete or rewrite.

    ``touched`` limits the plan to some initiatives, for instance those of one parser.
    """
    bad = authors.filter(is_artifact("full_name")).select(
        F.col("id").alias("author_id"),
        "full_name",
        "chamber",
        repaired_artifact("full_name").alias("canonical_full_name"),
    )
    scoped = relations if touched is None else relations.join(touched, "initiative_id", "left_semi")
    lost = (F.col("canonical_full_name") == "") | is_artifact("canonical_full_name")
    return scoped.join(bad, "author_id").withColumn("action", F.when(lost, "delete").otherwise("rewrite"))


def apply_artifact_plan(plan: DataFrame, relations: DataFrame, authors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations and authors after the clean-up.

    A rewritten relation goes to an author of the same normalised name and chamber, created if
    there is none; artifact authors left without relations are removed.
    """
    rewrites = plan.filter(F.col("action") == "rewrite").withColumn(
        "name_normalized", normalize_text("canonical_full_name")
    )
    wanted = rewrites.select(F.col("canonical_full_name").alias("full_name"), "name_normalized", "chamber")
    people = authors.filter(~is_artifact("full_name") & (normalize_text("full_name") == F.col("name_normalized")))
    known = find_or_create(people, wanted, ["name_normalized", "chamber"])
    grown = authors.unionByName(known.join(people.select("id"), "id", "left_anti").select(*authors.columns))
    targets = best_per_key(known, ["name_normalized", "chamber"], [F.col("id").asc()]).select(
        F.col("id").alias("new_author_id"),
        F.col("name_normalized").alias("_name"),
        F.col("chamber").alias("_chamber"),
    )
    moved = rewrites.join(
        targets,
        (F.col("name_normalized") == F.col("_name")) & F.col("chamber").eqNullSafe(F.col("_chamber")),
    ).select("initiative_id", F.col("new_author_id").alias("author_id"), "role", "sort_order")
    key = ["initiative_id", "author_id", "role"]
    kept = without(relations, plan, key)
    fresh = best_per_key(moved, key, [F.col("sort_order").asc()])
    out = kept.unionByName(without(fresh, kept, key).select(*relations.columns))
    used = out.select(F.col("author_id").alias("id")).distinct()
    orphans = grown.filter(is_artifact("full_name")).join(used, "id", "left_anti").select("id")
    return out, grown.join(orphans, "id", "left_anti").select(*authors.columns)


def author_repairs(initiatives: DataFrame, relations: DataFrame, authors: DataFrame) -> DataFrame:
    """Initiatives whose stored author list differs from the one its proponent text gives.

    Returns the wanted (initiative, place, name) rows of the changed initiatives. Where the
    lengths differ the initiative is changed anyway; only lists of equal length, no longer than
    one proponent text, are numbered and compared place by place.
    """
    wanted = initiatives.filter(F.col("cargo_proponente").isNotNull()).select(
        F.col("id").alias("initiative_id"), proponent_signers("cargo_proponente").alias("_names")
    )
    sized = (
        wanted.filter(F.size("_names") > 0)
        .join(
            relations.groupBy("initiative_id").agg(F.count(F.lit(1)).alias("_stored")), "initiative_id", "left"
        )
        .withColumn("_same_size", F.coalesce(F.col("_stored") == F.size("_names"), F.lit(False)))
    )
    places = sized.select("initiative_id", "_same_size", F.posexplode("_names").alias("_place", "full_name")).select(
        "initiative_id",
        "_same_size",
        (F.col("_place") + 1).alias("sort_order"),
        "full_name",
        normalize_text("full_name").alias("name"),
    )
    by_place = Window.partitionBy("initiative_id").orderBy("sort_order", "author_id")
    stored = (
        relations.join(sized.filter("_same_size").select("initiative_id"), "initiative_id", "left_semi")
        .join(authors.select(F.col("id").alias("author_id"), F.col("full_name").alias("_name")), "author_id")
        .select("initiative_id", F.row_number().over(by_place).alias("sort_order"), normalize_text("_name").alias("_stored_name"))
    )
    same = (
        places.filter("_same_size")
        .join(stored, ["initiative_id", "sort_order"], "left")
        .groupBy("initiative_id")
        .agg(F.bool_and(F.coalesce(F.col("name") == F.col("_stored_name"), F.lit(False))).alias("_same"))
        .filter("_same")
    )
    return places.join(same.select("initiative_id"), "initiative_id", "left_anti").drop("_same_size")


def apply_author_repairs(
    repairs: DataFrame, initiatives: DataFrame, relations: DataFrame, authors: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Relations of the changed initiatives replaced by the wanted list, authors created as needed."""
    chambers = initiatives.select(F.col("id").alias("initiative_id"), F.col("current_chamber").alias("chamber"))
    wanted = repairs.join(chambers, "initiative_id").withColumnRenamed("name", "name_normalized")
    grown = find_or_create(
        authors, wanted.select("full_name", "name_normalized", "chamber"), ["name_normalized", "chamber"]
    )
    ids = best_per_key(grown, ["name_normalized", "chamber"], [F.col("id").asc()]).select(
        F.col("id").alias("author_id"), F.col("name_normalized").alias("_name"), F.col("chamber").alias("_chamber")
    )
    fresh = wanted.join(
        ids, (F.col("name_normalized") == F.col("_name")) & F.col("chamber").eqNullSafe(F.col("_chamber"))
    ).select("initiative_id", "author_id", F.lit("primary").alias("role"), "sort_order")
    return replace_children(relations, repairs.select("initiative_id"), fresh), grown


def commission_assignments(initiatives: DataFrame, split_bars: bool = True) -> DataFrame:
    """Senate commission assignments read from the raw fields, dated by presentation."""
    raw = (
        raw_commission_text("metadata", BACKFILL_KEYS)
        if "metadata" in initiatives.columns
        else F.col("raw_commissions")
    )
    return (
        initiatives.select(
            F.col("id").alias("initiative_id"),
            F.col("presented_at").alias("assigned_at"),
            F.explode(senate_commissions(raw, split_bars)).alias("name"),
        )
        .withColumn("name_normalized", normalize_text("name"))
        .withColumn("chamber", F.lit("senado"))
    )


def commission_backfill(
    assignments: DataFrame, commissions: DataFrame, relations: DataFrame, run_date: str
) -> tuple[DataFrame, DataFrame]:
    """Commissions with the missing ones added, and relations with the new assignments added."""
    grown = find_or_create(commissions, assignments.select("name", "name_normalized", "chamber"), ["name_normalized", "chamber"])
    ids = grown.select(
        F.col("id").alias("commission_id"), F.col("name_normalized").alias("_name"), F.col("chamber").alias("_chamber")
    )
    fresh = assignments.join(
        ids, (F.col("name_normalized") == F.col("_name")) & F.col("chamber").eqNullSafe(F.col("_chamber"))
    ).select(
        "initiative_id",
        "commission_id",
        F.lit("referred").alias("relation_type"),
        F.coalesce(F.col("assigned_at"), F.lit(run_date).cast("date")).alias("assigned_at"),
    )
    key = ["initiative_id", "commission_id", "relation_type", "assigned_at"]
    added = without(fresh.distinct(), relations, key)
    return grown, relations.unionByName(added.select(*relations.columns), allowMissingColumns=True)
