"""Quality audit and scorecard.

Everything known about an initiative is gathered once in ``profile``: each child table is
aggregated per initiative and joined on the initiative id, so every check is a filter on one row
per initiative and all counts come out of a single aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.commissions import actionable_commission_text
from curul.functions.status import compare_status, status_rank
from curul.functions.text import normalize_text
from curul.operators.clusters import duplicate_clusters, keyed_authors, variant_clusters
from curul.operators.keyed import best_per_key
from curul.session import durable

# --- fixed values: the scorecard's checks -----------------------------------------------------
SCORECARD = (
    ("duplicateInitiativeClusters", "fail", 0, "Iniciativas duplicadas"),
    ("sourceConflicts", "fail", 0, "Conflictos entre fuentes"),
    ("primarySourceAnomalies", "fail", 0, "Fuente primaria inconsistente"),
    ("statusEventMismatches", "fail", 0, "Estatus inconsistente con timeline"),
    ("presentationEventGaps", "fail", 0, "Faltan eventos de presentación"),
    ("commissionNormalizationGaps", "fail", 0, "Comisiones sin normalizar"),
    ("authorVariantClusters", "warn", 0, "Variantes de autores para revisión"),
)
SAMPLE_ROWS = 20
# --- end of fixed values ----------------------------------------------------------------------


def latest_events(events: DataFrame) -> DataFrame:
    """Per initiative: the latest event by date, status rank and type, and what else occurred."""
    key = F.struct(
        F.col("event_date").alias("event_date"),
        status_rank(F.coalesce(F.col("normalized_status_after"), F.lit("unknown"))).alias("rank"),
        F.col("event_type").alias("event_type"),
        F.col("normalized_status_after").alias("status"),
    )
    return (
        events.groupBy("initiative_id")
        .agg(
            F.max(key).alias("latest"),
            F.bool_or(F.col("event_type") == "presentation").alias("has_presentation"),
            F.count(F.lit(1)).alias("event_count"),
        )
        .select(
            "initiative_id",
            F.col("latest.event_type").alias("latest_event_type"),
            F.col("latest.event_date").alias("latest_event_date"),
            F.col("latest.status").alias("latest_event_status"),
            "has_presentation",
            "event_count",
        )
    )


def link_facts(ranked: DataFrame) -> DataFrame:
    """Per initiative: number of links and primaries, the recommended system, and whether sources differ."""
    status, title = _comparable(ranked, "source_status"), _comparable(ranked, "source_title")
    best = F.struct("source_priority", (-F.col("confidence")).alias("c"), "system", "link_id")
    facts = ranked.withColumn("_status", status).withColumn("_title", title)
    return facts.groupBy("initiative_id").agg(
        F.count(F.lit(1)).alias("link_count"),
        F.count_if("is_primary").alias("primary_count"),
        F.min(best).getField("system").alias("recommended_system"),
        F.min(F.when(F.col("is_primary"), F.col("system"))).alias("primary_system"),
        F.sort_array(F.collect_set("system")).alias("systems"),
        _differ("_status").alias("statuses_differ"),
        _differ("_title").alias("titles_differ"),
    )


def _comparable(df: DataFrame, column: str):
    if column not in df.columns:
        return F.lit(None).cast("string")
    return F.nullif(normalize_text(column), F.lit(""))


def _differ(column: str):
    """More than one distinct value, told by the two extremes."""
    return F.coalesce(F.min(column) != F.max(column), F.lit(False))


def profile(
    initiatives: DataFrame, ranked_links: DataFrame, events: DataFrame, commissions: DataFrame | None = None
) -> DataFrame:
    """One row per initiative with everything the checks need.

    Initiatives bring ``raw_commissions`` (joined raw commission text) and ``has_raw_authors``.
    """
    out = initiatives.join(
        link_facts(ranked_links).withColumnRenamed("initiative_id", "id"), "id", "left"
    ).join(latest_events(events).withColumnRenamed("initiative_id", "id"), "id", "left")
    if commissions is None:
        out = out.withColumn("commission_count", F.lit(0).cast("long"))
    else:
        per_initiative = commissions.groupBy(F.col("initiative_id").alias("id")).agg(
            F.count(F.lit(1)).alias("commission_count")
        )
        out = out.join(per_initiative, "id", "left")
    return out.withColumn("actionable_commissions", actionable_commission_text("raw_commissions"))


def _several_systems():
    return F.size("systems") > 1


def _direction() -> Column:
    return compare_status("normalized_status", "latest_event_status")


def conditions() -> dict[str, Column]:
    """The checks on one initiative, as conditions on its profile."""
    mismatch = F.col("latest_event_status").isNotNull() & (
        F.col("latest_event_status") != F.col("normalized_status")
    )
    return {
        "statusEventMismatches": mismatch,
        "statusAheadOfEvents": mismatch & (_direction() == "ahead"),
        "statusBehindEvents": mismatch & (_direction() == "behind"),
        "presentationEventGaps": F.col("presented_at").isNotNull()
        & ~F.coalesce(F.col("has_presentation"), F.lit(False)),
        "commissionNormalizationGaps": (F.coalesce(F.col("commission_count"), F.lit(0)) == 0)
        & (F.col("actionable_commissions") != ""),
        "sourceConflicts": (F.size("systems") > 1) & (F.col("statuses_differ") | F.col("titles_differ")),
        "primarySourceAnomalies": F.col("link_count").isNotNull()
        & ((F.col("primary_count") != 1) | (F.col("primary_system") != F.col("recommended_system"))),
    }


def status_event_mismatches(profiled: DataFrame) -> DataFrame:
    return profiled.filter(conditions()["statusEventMismatches"]).select(
        F.col("id").alias("initiative_id"),
        "canonical_title",
        F.col("normalized_status").alias("initiative_status"),
        "latest_event_type",
        "latest_event_date",
        "latest_event_status",
        _direction().alias("direction"),
    )


def presentation_gaps(profiled: DataFrame) -> DataFrame:
    return profiled.filter(conditions()["presentationEventGaps"]).select(
        F.col("id").alias("initiative_id"), "canonical_title", "presented_at", "parser"
    )


def commission_gaps(profiled: DataFrame) -> DataFrame:
    return profiled.filter(conditions()["commissionNormalizationGaps"]).select(
        F.col("id").alias("initiative_id"),
        "canonical_title",
        "parser",
        F.col("actionable_commissions").alias("commission_raw"),
    )


def source_conflicts(profiled: DataFrame) -> DataFrame:
    return profiled.filter(conditions()["sourceConflicts"]).select(
        F.col("id").alias("initiative_id"),
        "canonical_title",
        F.array_join("systems", ",").alias("systems"),
        "statuses_differ",
        "titles_differ",
    )


def conflict_values(ranked: DataFrame, conflicts: DataFrame) -> DataFrame:
    """The differing values of the conflicts: one row per comparison form, with one spelling."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value"))
                for kind, column in (("status", "source_status"), ("title", "source_title"))
                if column in ranked.columns
            ]
        )
    )
    return (
        ranked.join(conflicts.select("initiative_id"), "initiative_id", "left_semi")
        .select("initiative_id", "link_id", pairs.alias("p"))
        .select("initiative_id", "p.kind", "p.value", normalize_text("p.value").alias("value_key"))
        .filter(F.col("value_key") != "")
        .groupBy("initiative_id", "kind", "value_key")
        .agg(F.min("value").alias("sample_value"), F.count(F.lit(1)).alias("n_links"))
    )


def primary_anomalies(profiled: DataFrame) -> DataFrame:
    return profiled.filter(conditions()["primarySourceAnomalies"]).select(
        F.col("id").alias("initiative_id"),
        "canonical_title",
        "primary_count",
        "recommended_system",
        "primary_system",
    )


def coverage(profiled: DataFrame) -> DataFrame:
    """One row: totals and how many initiatives have a date, raw authors, links, events, commissions."""
    return profiled.agg(
        F.count(F.lit(1)).alias("initiatives"),
        F.coalesce(F.sum("link_count"), F.lit(0)).alias("linked_rows"),
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_rows"),
        F.count("presented_at").alias("with_presented_at"),
        F.count_if("has_raw_authors").alias("with_authors_raw"),
        F.count("link_count").alias("with_source_links"),
        F.count("event_count").alias("with_events"),
        F.count_if(F.col("commission_count") > 0).alias("with_commissions"),
    )


def check_counts(profiled: DataFrame, initiatives: DataFrame, authors: DataFrame) -> DataFrame:
    """One row per check: (check, count)."""
    rules = conditions()
    one_row = profiled.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    pairs = F.explode(
        F.array(*[F.struct(F.lit(n).alias("check_key"), F.col(n).alias("count")) for n in rules])
    )
    per_initiative = one_row.select(pairs.alias("p")).select("p.*")
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("count")).select(
        F.lit(name).alias("check_key"), "count"
    )
    return per_initiative.unionByName(
        total(duplicate_clusters(initiatives), "duplicateInitiativeClusters")
    ).unionByName(total(variant_clusters(keyed_authors(authors)), "authorVariantClusters"))


def findings(profiled: DataFrame, initiatives: DataFrame, authors: DataFrame) -> DataFrame:
    """Every violation of every check: (check_key, subject, title, detail, presented_at).

    The profile is read once: a row goes to as many checks as it violates. The two checks on clusters have a row per cluster.
    """
    text = lambda *parts: F.concat_ws(" / ", *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts])
    mismatch = text("normalized_status", "latest_event_status")
    details = {
        "statusEventMismatches": mismatch,
        "statusAheadOfEvents": mismatch,
        "statusBehindEvents": mismatch,
        "presentationEventGaps": text("parser", "presented_at"),
        "commissionNormalizationGaps": text("parser", "actionable_commissions"),
        "sourceConflicts": F.array_join("systems", ","),
        "primarySourceAnomalies": text("primary_count", "recommended_system", "primary_system"),
    }
    held = [
        F.when(condition, F.struct(F.lit(key).alias("check_key"), details[key].alias("detail")))
        for key, condition in conditions().items()
    ]
    per_initiative = profiled.select(
        F.col("id").cast("string").alias("subject"), F.col("canonical_title").alias("title"), "presented_at",
        F.explode(F.filter(F.array(*held), lambda h: h.isNotNull())).alias("h"),
    ).select("h.check_key", "subject", "title", "h.detail", "presented_at")
    none = F.lit(None).cast("date").alias("presented_at")
    doubles = duplicate_clusters(initiatives).select(
        F.lit("duplicateInitiativeClusters").alias("check_key"), F.col("match_key").alias("subject"), F.lit("").alias("title"),
        F.col("cluster_size").cast("string").alias("detail"), none,
    )
    variants = variant_clusters(keyed_authors(authors)).select(
        F.lit("authorVariantClusters").alias("check_key"), F.col("cluster_key").alias("subject"), F.lit("").alias("title"),
        F.col("n_authors").cast("string").alias("detail"), none,
    )
    return per_initiative.unionByName(doubles).unionByName(variants)


def report(profiled: DataFrame, initiatives: DataFrame, authors: DataFrame) -> DataFrame:
    """The whole audit: (check_key, count, rank, subject, title, detail), the first twenty rows of each check, latest first, then by subject.

    The violations are written once; their number combines before the exchange, and no more than twenty rows of a check leave
    a task for its sample. A check without violations has one row without a rank.
    """
    found = durable(findings(profiled, initiatives, authors))
    keys = [*conditions(), "duplicateInitiativeClusters", "authorVariantClusters"]
    every = found.sparkSession.createDataFrame([(k,) for k in keys], "check_key string")
    counted = found.groupBy("check_key").agg(F.count(F.lit(1)).alias("n"))
    order = [F.col("presented_at").desc_nulls_last(), F.col("subject").asc()]
    first = best_per_key(found, ["check_key"], order, SAMPLE_ROWS, rank="rank").drop("presented_at")
    rows = every.join(counted, "check_key", "left").join(first, "check_key", "left")
    return rows.select("check_key", F.coalesce("n", F.lit(0)).alias("count"), "rank", "subject", "title", "detail")


def sample(rows: DataFrame, *order) -> DataFrame:
    """First rows of a check in a stated order."""
    return rows.orderBy(*order).limit(SAMPLE_ROWS)


def scorecard(checks: DataFrame) -> DataFrame:
    """The seven scorecard checks with their status, in report order."""
    rules = checks.sparkSession.createDataFrame(
        [(i, *rule) for i, rule in enumerate(SCORECARD)],
        "position int, check_key string, severity string, threshold long, label string",
    )
    status = F.when(F.col("count") > F.col("threshold"), F.col("severity")).otherwise("pass")
    return checks.join(F.broadcast(rules), "check_key").select(
        "position", F.col("check_key").alias("key"), "label", status.alias("status"), "count", "threshold"
    )


def scorecard_status(card: DataFrame) -> DataFrame:
    """One row: overall status, number of blockers and of warnings."""
    blockers, warnings = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "warn")
    return card.agg(
        F.when(blockers > 0, "fail").when(warnings > 0, "warn").otherwise("pass").alias("status"),
        blockers.alias("blockers"),
        warnings.alias("warnings"),
    )
