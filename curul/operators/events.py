"""Legislative events derived from records, and statuses derived from events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.commissions import chamber_commissions
from curul.functions.dates import status_date, weekday_date
from curul.functions.status import (
    EVENT_TITLES,
    STATUS_RULES,
    chamber_wide,
    event_from_status,
    event_status,
    mapped,
    status_rank,
)
from curul.functions.text import as_col, clean_optional, event_hash, let, normalize_text, split, strip, unique_by

# --- fixed values: openings of summary sentences and what they report -------------------------
# (phrase, must the sentence start with it, event type, title key, status if not the type's own)
SENTENCE_RULES = (
    ("turnada a", True, "turn_to_commission", "turn_to_commission", None),
    ("prorroga hasta", True, "other", "extension", "in_commissions"),
    ("retirada", True, "withdrawal", "withdrawal", None),
    ("dictaminada y aprobada en la camara de diputados", False, "approved_origin", "approved_origin", None),
    ("dictaminada y aprobada en la camara de senadores", False, "approved_reviser", "approved_reviser", None),
    ("publicado en el diario oficial de la federacion", True, "dof_publication", "dof_publication", None),
)
# --- end of fixed values ----------------------------------------------------------------------


def _event(event_type: Column, date: Column, title: Column, description: Column, status: Column) -> Column:
    return F.struct(
        event_type.alias("event_type"),
        date.alias("event_date"),
        title.alias("title"),
        description.alias("description"),
        status.alias("normalized_status_after"),
    )


def _typed(kind: str, date: Column, description: Column, title: str | None = None, status: str | None = None) -> Column:
    after = F.lit(status) if status else event_status(F.lit(kind))
    return _event(F.lit(kind), date, F.lit(title or EVENT_TITLES[kind]), description, after)


def _presented() -> Column:
    return F.col("presented_at").cast("timestamp")


def event_array(source: str, run_ts: str) -> Column:
    """Events of one record as an array in order of derivation.

    Reads the columns canonical_title, presented_at, raw_status and, by source, referred_to,
    summary or gaceta_issue_number. A status without any date takes the time of the run.
    """
    presented = _presented()
    fallback = F.coalesce(presented, F.lit(run_ts).cast("timestamp"))
    raw = F.nullif(F.col("raw_status"), F.lit(""))
    events = [F.when(presented.isNotNull(), _typed("presentation", presented, F.col("canonical_title")))]

    if source == "gaceta_diputados":
        return _chamber_events(events, presented, fallback, raw)
    if source == "sil":
        referred = clean_optional("referred_to")
        events.append(F.when(referred.isNotNull(), _typed("turn_to_commission", fallback, referred)))
        status_day = F.coalesce(status_date(raw).cast("timestamp"), fallback)
        titled = {}
    else:
        status_day = fallback
        titled = {"turn_to_commission": EVENT_TITLES["turn_to_commission"]}
    title = lambda kind: mapped(titled, kind, EVENT_TITLES["status"]) if titled else F.lit(EVENT_TITLES["status"])
    from_raw = let(
        event_from_status(raw, source),
        lambda kind: _event(kind, status_day, title(kind), raw, event_status(kind)),
    )
    events.append(F.when(raw.isNotNull(), from_raw))
    return F.filter(F.array(*events), lambda e: e.isNotNull())


def _chamber_events(events: list[Column], presented: Column, fallback: Column, raw: Column) -> Column:
    issue = clean_optional("gaceta_issue_number")
    events.append(
        F.when(
            presented.isNotNull() & issue.isNotNull(),
            _typed(
                "gaceta_publication", presented, F.concat(F.lit("Gaceta Parlamentaria, número "), issue)
            ),
        )
    )

    def from_sentence(sentence: Column) -> Column:
        day = F.coalesce(weekday_date(sentence).cast("timestamp"), fallback)

        def by_rule(text: Column) -> Column:
            found = F.lit(None)
            for phrase, at_start, kind, title, status in reversed(SENTENCE_RULES):
                holds = text.startswith(phrase) if at_start else F.contains(text, F.lit(phrase))
                found = F.when(holds, _typed(kind, day, sentence, EVENT_TITLES[title], status)).otherwise(found)
            return found

        return let(normalize_text(sentence), by_rule)

    sentences = F.filter(
        F.transform(split(F.coalesce(F.col("summary"), F.lit("")), r"\.\s+"), strip), lambda s: s != ""
    )
    titled = {kind: EVENT_TITLES[kind] for kind, _ in STATUS_RULES["gaceta_diputados"]}
    from_raw = let(
        event_from_status(raw, "gaceta_diputados"),
        lambda kind: _event(kind, fallback, mapped(titled, kind, EVENT_TITLES["status"]), raw, event_status(kind)),
    )
    last = F.array(F.when(raw.isNotNull(), from_raw))
    every = F.filter(
        F.concat(F.array(*events), F.transform(sentences, from_sentence), last), lambda e: e.isNotNull()
    )
    return unique_by(
        every,
        key=lambda e: F.concat_ws("|", e["event_type"], e["event_date"].cast("string"), e["title"]),
        keep_blank_keys=True,
    )


def record_events(records: DataFrame, source: str, run_ts: str, key: str = "initiative_id", carry: Sequence[str] = ()) -> DataFrame:
    """One row per event of each record; ``seq`` is the place in the order of derivation, ``carry`` names columns of the record to keep."""
    chamber = chamber_wide("chamber") if "chamber" in records.columns else F.lit(None).cast("string")
    return (
        records.select(key, *carry, chamber.alias("chamber"), F.posexplode(event_array(source, run_ts)).alias("seq", "e"))
        .select(key, *carry, "chamber", "seq", "e.*", F.lit(source).alias("source"))
        .withColumn("event_hash", event_hash(key, "event_type", "event_date", "title"))
    )


def derived_status(events: DataFrame, key: str = "initiative_id") -> DataFrame:
    """Last known status and last event date per initiative; a later derivation wins a tie."""
    order = F.struct("event_date", "seq", "normalized_status_after")
    known = F.when(F.col("normalized_status_after") != "unknown", order)
    return events.groupBy(key).agg(
        F.max(known).getField("normalized_status_after").alias("last_status"),
        F.max("event_date").alias("last_major_event_at"),
    )


def status_or_default(derived: Column | str, presented_at: Column | str) -> Column:
    return F.coalesce(
        as_col(derived), F.when(as_col(presented_at).isNotNull(), "presented").otherwise("unknown")
    )


def commission_turns(events: DataFrame, key: str = "initiative_id") -> DataFrame:
    """Commission assignments told by "Turnada a ..." events, dated by the event."""
    return (
        events.filter(F.col("event_type") == "turn_to_commission")
        .select(key, "chamber", F.col("event_date").alias("assigned_at"), F.explode(chamber_commissions("description")).alias("name"))
        .withColumn("name_normalized", normalize_text("name"))
        .dropDuplicates([key, "name_normalized", "assigned_at"])
    )


def rebuild_source(
    initiatives: DataFrame, events: DataFrame, run_ts: str, source: str = "gaceta_diputados"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replace a source's events by freshly derived ones.

    Returns the events, the initiatives with status and last event date, and the assignments.
    ``initiatives`` holds the source's records; events of other sources stay.
    """
    fresh = record_events(initiatives.withColumn("initiative_id", F.col("id")), source, run_ts)
    touched = initiatives.select(F.col("id").alias("initiative_id"))
    others = events.filter(~F.col("source").eqNullSafe(F.lit(source)))
    untouched = events.filter(F.col("source") == source).join(touched, "initiative_id", "left_anti")
    rebuilt = others.unionByName(untouched).unionByName(fresh, allowMissingColumns=True)
    state = derived_status(fresh).withColumnRenamed("initiative_id", "id")
    updated = (
        initiatives.drop("normalized_status", "last_major_event_at")
        .join(state, "id", "left")
        .withColumn("normalized_status", status_or_default("last_status", "presented_at"))
        .drop("last_status")
    )
    return rebuilt, updated, commission_turns(fresh)


def status_backfill(initiatives: DataFrame, events: DataFrame) -> DataFrame:
    """Initiatives of unknown status with the status of their latest event and an outcome.

    The latest event is taken by date and status rank. Outcomes: changed, skipped_no_known_event.
    """
    unknown = initiatives.filter(F.col("normalized_status") == "unknown")
    key = F.struct(
        "event_date",
        status_rank(F.coalesce(F.col("normalized_status_after"), F.lit("unknown"))).alias("rank"),
        F.col("normalized_status_after").alias("status"),
        "event_type",
    )
    latest = (
        events.join(unknown.select(F.col("id").alias("initiative_id")), "initiative_id", "left_semi")
        .groupBy("initiative_id")
        .agg(F.max(key).alias("latest"))
    )
    status = F.nullif(F.col("latest.status"), F.lit("unknown"))
    return unknown.join(latest.withColumnRenamed("initiative_id", "id"), "id", "left").select(
        "id",
        "canonical_title",
        F.col("normalized_status").alias("from_status"),
        F.coalesce(status, F.col("normalized_status")).alias("to_status"),
        F.col("latest.event_date").alias("event_date"),
        F.when(status.isNull(), "skipped_no_known_event").otherwise("changed").alias("outcome"),
    )


def outcome_counts(rows: DataFrame, column: str = "outcome") -> DataFrame:
    """Counters of a run or of a dry run."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("count"))


