"""Events derived from records, statuses derived from events, snapshots and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions.text import event_hash
from curul.operators import events as event_ops
from curul.operators import matching, merges, snapshots
from curul.operators.clusters import duplicate_pairs, first_wins
from curul.plans import staged
from curul.plans.audit_queries import LATEST_SQL, PLAN_SQL, plan_inputs, rank_sql
from curul.plans.registry import query, sql_norm
from curul.plans.text_queries import RAW_STATUS_SQL, raw_status
from curul.sources.staging import stage


def records(spark: SparkSession, folder: str) -> DataFrame:
    """Records with raw status, referral and summary texts spelled from orders."""
    rows, c, lit = stage(spark, folder, "st_record_texts"), F.concat, F.lit
    kind = F.col("id") % 5
    summary = c(
        lit("Turnada a la Comisión de "), "first_name", lit(", el lunes "), "long_day", lit(". Prórroga hasta el "),
        "long_day", lit(". Nota sin fecha. "),
        F.when(kind == 0, c(lit("Publicado en el Diario Oficial de la Federación el "), "long_day"))
        .when(kind == 1, lit("Dictaminada y aprobada en la Cámara de Diputados"))
        .otherwise(lit("Fin")),
    )
    return rows.select(
        F.col("id").alias("initiative_id"),
        F.col("title").alias("canonical_title"),
        F.when(F.col("id") % 7 > 0, F.col("day").cast("string")).alias("presented_at"),
        raw_status().alias("raw_status"),
        F.when(F.col("id") % 3 == 0, F.col("first_name")).alias("referred_to"),
        summary.alias("summary"),
        F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("gaceta_issue_number"),
        F.lit("Cámara de Diputados").alias("chamber"),
    )


RECORDS_SQL = f"""
rec AS (SELECT *, CASE WHEN id % 7 > 0 THEN CAST(day AS TIMESTAMP) END AS presented, coalesce(CASE WHEN id % 7 > 0 THEN CAST(day AS TIMESTAMP) END, TIMESTAMP '{staged.RUN_TS}') AS fallback,
  {RAW_STATUS_SQL} AS raw_status FROM st_record_texts)"""


def _utc(rows: DataFrame) -> DataFrame:
    """Event dates as zone-less timestamps, for results that other engines compare."""
    return rows.withColumn("event_date", F.date_format("event_date", "yyyy-MM-dd HH:mm:ss"))


def _events_sql(kind_sql: str, status_sql: str, date_sql: str, title_sql: str, extra: str = "") -> str:
    return f"""WITH {RECORDS_SQL}, made AS (
 SELECT id AS initiative_id, 'presentation' AS event_type, presented AS event_date, 'Presentación de iniciativa' AS title, title AS description, 'presented' AS normalized_status_after FROM rec WHERE presented IS NOT NULL
 {extra}
 UNION ALL SELECT id, {kind_sql}, {date_sql}, {title_sql}, raw_status, {status_sql} FROM rec)
 SELECT initiative_id, event_type, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date, title, description, normalized_status_after FROM made"""


EVENT_COLUMNS = "initiative_id event_type event_date title description normalized_status_after".split()


@query(
    _events_sql(
        "CASE id % 5 WHEN 0 THEN 'dof_publication' WHEN 1 THEN 'approved_origin' WHEN 3 THEN 'withdrawal' ELSE 'other' END",
        "CASE id % 5 WHEN 0 THEN 'published_dof' WHEN 1 THEN 'approved_origin' WHEN 3 THEN 'withdrawn' ELSE 'unknown' END",
        "CASE WHEN id % 5 = 0 THEN CAST(day AS TIMESTAMP) ELSE fallback END",
        "'Estatus legislativo'",
        "UNION ALL SELECT id, 'turn_to_commission', fallback, 'Turnado a comisión', first_name, 'in_commissions' FROM rec WHERE id % 3 = 0",
    )
)
def record_events_sil(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_ops.record_events(records(spark, folder), "sil", staged.RUN_TS)
    return _utc(rows).select(*EVENT_COLUMNS)


@query(
    _events_sql(
        "CASE id % 5 WHEN 0 THEN 'dof_publication' WHEN 1 THEN 'approved_origin' WHEN 2 THEN 'turn_to_commission' WHEN 3 THEN 'withdrawal' ELSE 'other' END",
        "CASE id % 5 WHEN 0 THEN 'published_dof' WHEN 1 THEN 'approved_origin' WHEN 2 THEN 'in_commissions' WHEN 3 THEN 'withdrawn' ELSE 'unknown' END",
        "fallback",
        "CASE id % 5 WHEN 2 THEN 'Turnado a comisión' ELSE 'Estatus legislativo' END",
    )
)
def record_events_senate(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_ops.record_events(records(spark, folder), "gaceta_senado", staged.RUN_TS)
    return _utc(rows).select(*EVENT_COLUMNS)


CHAMBER_EVENTS_SQL = f"""WITH {RECORDS_SQL}, made AS (
 SELECT id AS initiative_id, 0 AS seq, 'presentation' AS event_type, presented AS event_date, 'Presentación de iniciativa' AS title, 'presented' AS status FROM rec WHERE presented IS NOT NULL
 UNION ALL SELECT id, 1, 'gaceta_publication', presented, 'Publicación en Gaceta Parlamentaria', 'presented' FROM rec WHERE presented IS NOT NULL AND id % 2 = 0
 UNION ALL SELECT id, 2, 'turn_to_commission', CAST(day AS TIMESTAMP), 'Turnado a comisión', 'in_commissions' FROM rec
 UNION ALL SELECT id, 3, 'other', CAST(day AS TIMESTAMP), 'Prórroga legislativa', 'in_commissions' FROM rec
 UNION ALL SELECT id, 4, 'dof_publication', CAST(day AS TIMESTAMP), 'Publicación en DOF', 'published_dof' FROM rec WHERE id % 5 = 0
 UNION ALL SELECT id, 4, 'approved_origin', fallback, 'Aprobación en cámara de origen', 'approved_origin' FROM rec WHERE id % 5 = 1
 UNION ALL SELECT id, 5, CASE id % 5 WHEN 3 THEN 'withdrawal' ELSE 'other' END, fallback, CASE id % 5 WHEN 3 THEN 'Retiro de iniciativa' ELSE 'Estatus legislativo' END,
   CASE id % 5 WHEN 3 THEN 'withdrawn' ELSE 'unknown' END FROM rec)"""


@query(
    CHAMBER_EVENTS_SQL
    + " SELECT initiative_id, event_type, strftime(event_date, '%Y-%m-%d %H:%M:%S') AS event_date, title, status AS normalized_status_after FROM made"
)
def record_events_chamber(spark: SparkSession, folder: str) -> DataFrame:
    """Events from summary sentences."""
    rows = event_ops.record_events(records(spark, folder), "gaceta_diputados", staged.RUN_TS)
    return _utc(rows).select(*[c for c in EVENT_COLUMNS if c != "description"])


@query(
    CHAMBER_EVENTS_SQL
    + """, known AS (SELECT *, row_number() OVER (PARTITION BY initiative_id ORDER BY event_date DESC, seq DESC) AS rn FROM made WHERE status <> 'unknown')
 SELECT initiative_id, status AS last_status, (SELECT strftime(max(event_date), '%Y-%m-%d %H:%M:%S') FROM made m WHERE m.initiative_id = k.initiative_id) AS last_major_event_at
 FROM known k WHERE rn = 1"""
)
def derived_status(spark: SparkSession, folder: str) -> DataFrame:
    """Status and last event date that the derived events lead to."""
    made = event_ops.record_events(records(spark, folder), "gaceta_diputados", staged.RUN_TS)
    state = event_ops.derived_status(made)
    return state.withColumn("last_major_event_at", F.date_format("last_major_event_at", "yyyy-MM-dd HH:mm:ss"))


@query(
    f"""WITH {RECORDS_SQL} SELECT id AS initiative_id, concat(first_name, ', el lunes ', long_day) AS commission,
 strftime(CAST(day AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') AS assigned_at FROM rec"""
)
def commission_turns(spark: SparkSession, folder: str) -> DataFrame:
    made = event_ops.record_events(records(spark, folder), "gaceta_diputados", staged.RUN_TS)
    turns = event_ops.commission_turns(made.filter(F.col("seq") < 3))
    return turns.select(
        "initiative_id", F.col("name").alias("commission"), F.date_format("assigned_at", "yyyy-MM-dd HH:mm:ss").alias("assigned_at")
    )


@query(
    """SELECT 'other' AS source, count(*) FILTER (initiative_id % 2 = 1) AS n_events FROM st_events
 UNION ALL SELECT 'gaceta_diputados', (SELECT count(*) FROM st_record_texts r) * 3
   + (SELECT count(*) FILTER (id % 7 > 0) + count(*) FILTER (id % 7 > 0 AND id % 2 = 0) + count(*) FILTER (id % 5 < 2) FROM st_record_texts)"""
)
def rebuilt_source_events(spark: SparkSession, folder: str) -> DataFrame:
    """One source's events dropped and derived anew, others kept: rows per source."""
    existing = staged.events(spark, folder).withColumn(
        "source", F.when(F.col("initiative_id") % 2 == 1, "other").otherwise("gaceta_diputados")
    )
    rows = records(spark, folder).withColumnRenamed("initiative_id", "id").withColumn("normalized_status", F.lit("unknown"))
    rebuilt, _, _ = event_ops.rebuild_source(rows, existing.withColumn("event_date", F.col("event_date").cast("timestamp")), staged.RUN_TS)
    return rebuilt.groupBy("source").agg(F.count(F.lit(1)).alias("n_events"))


@query(
    f"""WITH latest AS (SELECT * FROM (SELECT e.*, row_number() OVER (PARTITION BY initiative_id ORDER BY event_date DESC, {rank_sql('normalized_status_after')} DESC) AS rn FROM st_events e) WHERE rn = 1)
 SELECT i.id, 'unknown' AS from_status, coalesce(nullif(l.normalized_status_after, 'unknown'), 'unknown') AS to_status,
 CASE WHEN coalesce(l.normalized_status_after, 'unknown') = 'unknown' THEN 'skipped_no_known_event' ELSE 'changed' END AS outcome
 FROM st_initiatives i LEFT JOIN latest l ON l.initiative_id = i.id WHERE i.normalized_status = 'unknown'"""
)
def status_backfill(spark: SparkSession, folder: str) -> DataFrame:
    rows = event_ops.status_backfill(stage(spark, folder, "st_initiatives"), staged.events(spark, folder))
    return rows.select("id", "from_status", "to_status", "outcome")


@query(
    f"""WITH {LATEST_SQL} SELECT CASE WHEN coalesce(l.normalized_status_after, 'unknown') = 'unknown' THEN 'skipped_no_known_event' ELSE 'changed' END AS outcome,
 count(*) AS count FROM st_initiatives i LEFT JOIN latest l ON l.initiative_id = i.id WHERE i.normalized_status = 'unknown' GROUP BY 1"""
)
def status_backfill_counters(spark: SparkSession, folder: str) -> DataFrame:
    return event_ops.outcome_counts(
        event_ops.status_backfill(stage(spark, folder, "st_initiatives"), staged.events(spark, folder))
    )


# ---- snapshots -------------------------------------------------------------------------------

LINKS = ["link_id", "initiative_id", "source_record_id", "source_status", "confidence"]


def _link_rows(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "st_source_links").select(*LINKS).withColumn("confidence", F.col("confidence").cast("double"))


@query(
    """WITH old AS (SELECT id, canonical_title, normalized_status, created_at FROM st_initiatives WHERE id % 3 > 0),
 new AS (SELECT id, concat(canonical_title, ' (nueva)') AS canonical_title, 'presented' AS normalized_status FROM st_initiatives WHERE id % 4 > 0)
 SELECT coalesce(n.id, o.id) AS id, coalesce(n.canonical_title, o.canonical_title) AS canonical_title,
 coalesce(n.normalized_status, o.normalized_status) AS normalized_status, o.id IS NOT NULL AS was_there FROM old o FULL JOIN new n ON n.id = o.id"""
)
def upsert_update(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming rows replace existing ones; what only one side has stays."""
    rows = stage(spark, folder, "st_initiatives").select("id", "canonical_title", "normalized_status")
    old = rows.filter(F.col("id") % 3 > 0).withColumn("was_there", F.lit(True))
    new = (
        rows.filter(F.col("id") % 4 > 0)
        .withColumn("canonical_title", F.concat("canonical_title", F.lit(" (nueva)")))
        .withColumn("normalized_status", F.lit("presented"))
        .withColumn("was_there", F.lit(False))
    )
    return snapshots.upsert(old, new, ["id"], mode="update", preserve=["was_there"])


@query(
    """WITH k AS (SELECT title_normalized, originating_chamber AS chamber, min(id) FILTER (id % 2 = 0) AS old_id, min(id) FILTER (id % 2 = 1) AS new_id FROM st_initiatives GROUP BY 1, 2)
 SELECT title_normalized, chamber, coalesce(old_id, new_id) AS id FROM k"""
)
def upsert_keep(spark: SparkSession, folder: str) -> DataFrame:
    """Existing rows stay, the first incoming row of a new key is added; null keys are equal."""
    rows = stage(spark, folder, "st_initiatives").select("id", "title_normalized", F.col("originating_chamber").alias("chamber"))
    key = ["title_normalized", "chamber"]
    old = first_wins(rows.filter(F.col("id") % 2 == 0), key, "id")
    return snapshots.upsert(old, rows.filter(F.col("id") % 2 == 1), key, mode="keep", position="id")


@query(
    "SELECT source_status, source_record_id, min(link_id) AS link_id FROM st_source_links GROUP BY 1, 2"
)
def first_wins_links(spark: SparkSession, folder: str) -> DataFrame:
    rows = first_wins(_link_rows(spark, folder), ["source_status", "source_record_id"], "link_id")
    return rows.select("source_status", "source_record_id", "link_id")


@query(
    """SELECT 'initiatives' AS table_name, count(*) FILTER (normalized_status <> 'unknown') AS rows FROM st_initiatives
 UNION ALL SELECT 'legislative_events', count(*) FROM st_events e WHERE initiative_id NOT IN (SELECT id FROM st_initiatives WHERE normalized_status = 'unknown')
 UNION ALL SELECT 'initiative_authors', count(*) FROM st_initiative_authors e WHERE initiative_id NOT IN (SELECT id FROM st_initiatives WHERE normalized_status = 'unknown')
 UNION ALL SELECT 'documents', (SELECT count(*) FROM documents)
 UNION ALL SELECT 'documents kept references', (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT id FROM st_initiatives WHERE normalized_status = 'unknown'))"""
)
def cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    """Initiatives of unknown status deleted: their events and relations go, documents lose the reference."""
    from curul.sources.scans import table

    initiatives = stage(spark, folder, "st_initiatives")
    documents = table(spark, folder, "documents", "doc_id").withColumn("initiative_id", F.col("doc_id"))
    out = snapshots.cascade_delete(
        {
            "initiatives": initiatives,
            "legislative_events": staged.events(spark, folder),
            "initiative_authors": staged.relations(spark, folder),
            "documents": documents,
        },
        "initiatives",
        initiatives.filter(F.col("normalized_status") == "unknown"),
    )
    total = lambda df, name: df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
    result = total(out["documents"].filter(F.col("initiative_id").isNotNull()), "documents kept references")
    for name, df in out.items():
        result = result.unionByName(total(df, name))
    return result


@query(
    """SELECT initiative_id, author_id, role, sort_order FROM st_initiative_authors WHERE initiative_id % 4 > 0
 UNION ALL SELECT initiative_id, author_id + 1, 'primary', 2 FROM st_initiative_authors WHERE initiative_id % 4 = 0"""
)
def replaced_children(spark: SparkSession, folder: str) -> DataFrame:
    """Authors of a part of the initiatives replaced as a whole."""
    rows = staged.relations(spark, folder)
    touched = rows.filter(F.col("initiative_id") % 4 == 0)
    fresh = touched.withColumn("author_id", F.col("author_id") + 1).withColumn("sort_order", F.lit(2))
    return snapshots.replace_children(rows, touched, fresh)


@query(
    """SELECT i.id, coalesce(CASE WHEN id % 10 = 0 THEN 'published_dof' END, normalized_status) AS normalized_status,
 CASE WHEN id % 10 = 0 THEN 'Diario Oficial' END AS correction FROM st_initiatives i"""
)
def corrected_initiatives(spark: SparkSession, folder: str) -> DataFrame:
    """Manual corrections laid over the initiatives."""
    rows = stage(spark, folder, "st_initiatives").select("id", "normalized_status")
    corrections = rows.filter(F.col("id") % 10 == 0).select(
        "id", F.lit("published_dof").alias("normalized_status"), F.lit("Diario Oficial").alias("reason")
    )
    return merges.apply_corrections(rows, corrections, "id", ["normalized_status"])


# ---- duplicate merge -------------------------------------------------------------------------

STAGED_CONFIDENCE = 0.7
MAPPING_SQL = PLAN_SQL + f""",
mapping AS (SELECT c.id AS old_id, p.canonical_initiative_id AS new_id FROM cand c JOIN plan p USING (match_key)
  WHERE c.id <> p.canonical_initiative_id AND p.confidence >= {STAGED_CONFIDENCE})"""


def _merge_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    events = staged.events(spark, folder).withColumn("title", F.col("event_type")).withColumn("event_hash", F.col("event_id"))
    return {
        "initiatives": stage(spark, folder, "st_initiatives"),
        "initiative_source_links": stage(spark, folder, "st_source_links"),
        "initiative_authors": staged.relations(spark, folder),
        "legislative_events": events,
        "source_records": stage(spark, folder, "st_source_records"),
    }


def _merged(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    pairs = duplicate_pairs(*plan_inputs(spark, folder))
    return merges.apply_duplicate_merge(
        pairs, _merge_tables(spark, folder), stage(spark, folder, "st_sources"), STAGED_CONFIDENCE
    )


@query(
    MAPPING_SQL
    + """, moved AS (SELECT l.link_id, coalesce(m.new_id, l.initiative_id) AS initiative_id, l.source_record_id, m.old_id FROM st_source_links l LEFT JOIN mapping m ON m.old_id = l.initiative_id)
 SELECT initiative_id, count(DISTINCT source_record_id) AS link_count, CAST(1 AS BIGINT) AS primary_count FROM moved
 WHERE initiative_id IN (SELECT new_id FROM mapping) GROUP BY 1"""
)
def duplicate_merge_links(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical initiatives after the merge: one link per source record, exactly one primary."""
    links = _merged(spark, folder)["initiative_source_links"]
    pairs = duplicate_pairs(*plan_inputs(spark, folder)).filter(F.col("confidence") >= STAGED_CONFIDENCE)
    targets = pairs.select(F.col("canonical_initiative_id").alias("initiative_id")).distinct()
    return (
        links.join(targets, "initiative_id", "left_semi")
        .groupBy("initiative_id")
        .agg(F.count(F.lit(1)).alias("link_count"), F.count_if("is_primary").alias("primary_count"))
    )


@query(MAPPING_SQL + " SELECT id, canonical_title FROM st_initiatives WHERE id NOT IN (SELECT old_id FROM mapping)")
def duplicate_merge_initiatives(spark: SparkSession, folder: str) -> DataFrame:
    return _merged(spark, folder)["initiatives"].select("id", "canonical_title")


@query(
    MAPPING_SQL
    + """ SELECT 'initiatives' AS "table", (SELECT count(*) FROM mapping) AS rows
 UNION ALL SELECT 'initiative_source_links', (SELECT count(*) FROM st_source_links WHERE initiative_id IN (SELECT old_id FROM mapping))
 UNION ALL SELECT 'initiative_authors', (SELECT count(*) FROM st_initiative_authors WHERE initiative_id IN (SELECT old_id FROM mapping))
 UNION ALL SELECT 'legislative_events', (SELECT count(*) FROM st_events WHERE initiative_id IN (SELECT old_id FROM mapping))"""
)
def duplicate_merge_counters(spark: SparkSession, folder: str) -> DataFrame:
    """Rows a merge would move: the dry run."""
    pairs = duplicate_pairs(*plan_inputs(spark, folder))
    return merges.duplicate_merge_counters(pairs, _merge_tables(spark, folder), STAGED_CONFIDENCE)


def _merged_events(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The merge over events that meet: those of one type have the same date and title in every initiative."""
    rows = staged.events(spark, folder).select(
        F.col("event_id").alias("id"), "initiative_id", "event_type", F.lit("2020-01-01").alias("event_date"), F.lit("t").alias("title")
    )
    links = stage(spark, folder, "st_source_links").select(F.col("link_id").alias("legislative_event_id"), "source_record_id")
    tables = {
        "initiatives": stage(spark, folder, "st_initiatives"),
        "legislative_events": rows,  # hashed by the merge, after its first exchange
        "event_source_links": links,
    }
    return merges.apply_duplicate_merge(duplicate_pairs(*plan_inputs(spark, folder)), tables, min_confidence=STAGED_CONFIDENCE)


MET_SQL = MAPPING_SQL + """, moved AS (SELECT coalesce(m.new_id, e.initiative_id) AS initiative_id, e.event_type, e.event_id FROM st_events e LEFT JOIN mapping m ON m.old_id = e.initiative_id)"""


@query(MET_SQL + " SELECT DISTINCT initiative_id, event_type FROM moved")
def duplicate_merge_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events after the merge: those that meet at one initiative are one."""
    return _merged_events(spark, folder)["legislative_events"].select("initiative_id", "event_type")


@query(MET_SQL + " SELECT DISTINCT moved.initiative_id, event_type, source_record_id FROM moved JOIN st_source_links l ON l.link_id = moved.event_id")
def duplicate_merge_event_links(spark: SparkSession, folder: str) -> DataFrame:
    """Source links of events after the merge, each at the event that stayed; a dangling one would be missing."""
    out = _merged_events(spark, folder)
    events = out["legislative_events"].select(F.col("id").alias("legislative_event_id"), "initiative_id", "event_type")
    return out["event_source_links"].join(events, "legislative_event_id").select("initiative_id", "event_type", "source_record_id")


@query(
    """SELECT event_id, sha256(concat_ws('|', CAST(initiative_id AS VARCHAR), event_type, CASE WHEN initiative_id % 4 = 0 THEN '' ELSE strftime(event_date, '%Y-%m-%d') END, normalized_status_after)) AS event_hash FROM st_events"""
)
def event_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """The key of every event within its initiative; a missing date counts as empty."""
    rows = staged.events(spark, folder)
    day = F.when(F.col("initiative_id") % 4 > 0, F.date_format("event_date", "yyyy-MM-dd"))
    return rows.select("event_id", event_hash("initiative_id", "event_type", day, "normalized_status_after").alias("event_hash"))


# ---- matching --------------------------------------------------------------------------------


def _incoming(spark: SparkSession, folder: str) -> DataFrame:
    """Every staged initiative as an incoming record; some know a page address, some only title and date."""
    rows = stage(spark, folder, "st_initiatives")
    url = F.concat(F.lit("https://sil/"), F.col("id").cast("string"))
    return rows.select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("source_record_key"),
        "title_normalized",
        "presented_at",
        F.concat(F.lit("h"), F.col("id").cast("string")).alias("dedupe_hash"),
        F.map_filter(F.create_map(F.lit("detail_url"), F.when(F.col("id") % 2 == 0, url)), lambda _, v: v.isNotNull()).alias("metadata"),
    )


def _known(spark: SparkSession, folder: str) -> DataFrame:
    """The initiatives already there: two thirds, each with its page address and hash."""
    rows = stage(spark, folder, "st_initiatives").filter(F.col("id") % 3 > 0)
    text = F.col("id").cast("string")
    return rows.select(
        "id", "canonical_title", "title_normalized", "presented_at",
        F.create_map(
            F.lit("detail_url"), F.concat(F.lit("https://sil/"), text),
            F.lit("sil_dedupe_hash"), F.concat(F.lit("h"), text),
            F.lit("parser"), F.when(F.col("id") % 5 == 0, "sil-detail-html-v1").otherwise("x"),
        ).alias("metadata"),
    )


@query(
    """WITH known AS (SELECT * FROM st_initiatives WHERE id % 3 > 0),
 best AS (SELECT title_normalized, presented_at, arg_min(id, (CASE WHEN id % 5 = 0 THEN 0 ELSE 1 END) * 1000000000 + id) AS best_id FROM known GROUP BY 1, 2),
 found AS (SELECT i.id, CASE WHEN i.id % 3 > 0 AND i.id % 2 = 0 AND i.presented_at IS NOT NULL THEN i.id WHEN i.id % 3 > 0 THEN i.id ELSE b.best_id END AS matched_id,
   CAST(CASE WHEN i.id % 3 > 0 AND i.id % 2 = 0 AND i.presented_at IS NOT NULL THEN 0 WHEN i.id % 3 > 0 THEN 1 ELSE 2 END AS INTEGER) AS rule
  FROM st_initiatives i LEFT JOIN best b ON b.title_normalized = i.title_normalized AND b.presented_at IS NOT DISTINCT FROM i.presented_at)
 SELECT concat('r', id) AS source_record_key, matched_id, rule FROM found WHERE matched_id IS NOT NULL"""
)
def matched_records(spark: SparkSession, folder: str) -> DataFrame:
    """Incoming records matched by address, then hash, then title and date."""
    return matching.match_existing(_incoming(spark, folder), _known(spark, folder), "sil")


@query(
    """SELECT link_id, round(CAST(0.35 AS DOUBLE) + CAST(0.15 AS DOUBLE) * CASE WHEN is_primary THEN 1 ELSE 0 END + CAST(0.15 AS DOUBLE) * CAST(confidence AS DOUBLE) + CAST(0.15 AS DOUBLE) + CAST(0.1 AS DOUBLE), 6) AS confidence,
 CASE WHEN is_primary THEN 'attach' WHEN 0.6 + 0.15 * CAST(confidence AS DOUBLE) >= 0.85 THEN 'attach' ELSE 'review' END AS decision FROM st_source_links"""
)
def candidate_decisions(spark: SparkSession, folder: str) -> DataFrame:
    rows = stage(spark, folder, "st_source_links")
    signals = (
        rows.withColumn("title_similarity", F.lit(1.0))
        .withColumn("alias_similarity", F.when(F.col("is_primary"), 1.0).otherwise(0.0))
        .withColumn("author_overlap", F.col("confidence").cast("double"))
        .withColumn("date_proximity", F.lit(1.0))
        .withColumn("chamber_consistency", F.lit(1.0))
        .withColumn("affected_norm_overlap", F.lit(0.0))
    )
    return matching.decide(signals).select("link_id", F.round("confidence", 6).alias("confidence"), "decision")


@query("SELECT id, CAST(0.55 AS DOUBLE) AS sil, 'create' AS sil_decision, CAST(0.6 AS DOUBLE) AS gazette, 'review' AS gazette_decision FROM st_initiatives")
def constant_decisions(spark: SparkSession, folder: str) -> DataFrame:
    """What the fixed signals of a source lead to."""
    rows = stage(spark, folder, "st_initiatives").select("id")
    one = matching.decide(matching.constant_signals(rows, "sil")).select(
        "id", F.round("confidence", 6).alias("sil"), F.col("decision").alias("sil_decision")
    )
    two = matching.decide(matching.constant_signals(rows, "gaceta_senado")).select(
        "id", F.round("confidence", 6).alias("gazette"), F.col("decision").alias("gazette_decision")
    )
    return one.join(two, "id")


# A record per two hundredth initiative: its title with one word changed or left out, its date some days off, its authors in part.
NEAR_SQL = """recs AS (SELECT concat('r', id) AS record_id, CASE id % 3 WHEN 0 THEN concat(canonical_title, ' y otras') WHEN 1 THEN replace(canonical_title, 'reforma la', 'reforma a la') ELSE canonical_title END AS title,
  canonical_title AS alias, presented_at + CAST(id % 5 AS INTEGER) AS presented_at, originating_chamber AS chamber, id FROM st_initiatives WHERE id % 200 = 3)"""


def near_records(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Incoming records with titles near those of existing initiatives, and these initiatives, with authors and norms."""
    signed = staged.relations(spark, folder).select(F.col("initiative_id").alias("id"), F.array(F.col("author_id").cast("string")).alias("authors"))
    rows = stage(spark, folder, "st_initiatives").join(signed, "id")
    norm = F.array(F.col("normalized_status"))
    existing = rows.select("id", F.col("canonical_title").alias("title"), "presented_at", F.col("originating_chamber").alias("chamber"), "authors", norm.alias("norms"))
    title = F.col("canonical_title")
    near = F.when(F.col("id") % 3 == 0, F.concat(title, F.lit(" y otras"))).when(F.col("id") % 3 == 1, F.replace(title, F.lit("reforma la"), F.lit("reforma a la"))).otherwise(title)
    records = rows.where("id % 200 = 3").select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("record_id"), near.alias("title"), title.alias("alias"),
        F.date_add("presented_at", (F.col("id") % 5).cast("int")).alias("presented_at"), F.col("originating_chamber").alias("chamber"), "authors", norm.alias("norms"),
    )
    return records, existing


def _grams(text: str) -> str:
    words = f"regexp_extract_all({sql_norm(text)}, '[\\p{{L}}\\p{{N}}]+')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"


@query(
    f"""WITH {NEAR_SQL},
 r AS (SELECT recs.*, {_grams('title')} AS g, {_grams('alias')} AS ag, a.author_id, i.normalized_status AS norm FROM recs JOIN st_initiatives i USING (id) JOIN st_initiative_authors a ON a.initiative_id = recs.id),
 e AS (SELECT i.id, i.presented_at, originating_chamber AS chamber, {_grams('canonical_title')} AS g, a.author_id, normalized_status AS norm FROM st_initiatives i JOIN st_initiative_authors a ON a.initiative_id = i.id),
 p AS (SELECT r.record_id, e.id, len(list_intersect(r.g, e.g)) / (len(r.g) + len(e.g) - len(list_intersect(r.g, e.g))) AS t, len(list_intersect(r.ag, e.g)) / (len(r.ag) + len(e.g) - len(list_intersect(r.ag, e.g))) AS al,
   abs(date_diff('day', e.presented_at, r.presented_at)) AS days, r.author_id = e.author_id AS same_author, r.chamber IS NOT DISTINCT FROM e.chamber AS same_chamber, r.norm = e.norm AS same_norm
   FROM r, e WHERE abs(date_diff('day', e.presented_at, r.presented_at)) <= 30),
 s AS (SELECT record_id, id, t, CAST(0.35 AS DOUBLE) * t + CAST(0.15 AS DOUBLE) * al + CAST(0.15 AS DOUBLE) * same_author::INT + CAST(0.15 AS DOUBLE) / (1 + days) + CAST(0.1 AS DOUBLE) * same_chamber::INT + CAST(0.1 AS DOUBLE) * same_norm::INT AS c FROM p WHERE t >= 0.7)
 SELECT record_id, id AS matched_id, round(t, 6) AS title_similarity, round(c, 6) AS confidence, CASE WHEN round(c, 9) >= 0.85 THEN 'attach' WHEN round(c, 9) >= 0.6 THEN 'review' ELSE 'create' END AS decision FROM s"""
)
def measured_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair of a record and an initiative with near titles and dates, with six measured signals and the decision."""
    pairs = matching.near_candidates(*near_records(spark, folder), least=0.7, days=30)
    rows = matching.decide(matching.measured_signals(pairs))
    sure = F.round("confidence", 9)
    decision = F.when(sure >= matching.ATTACH, "attach").when(sure >= matching.REVIEW, "review").otherwise("create")
    return rows.select("record_id", F.col("id").alias("matched_id"), F.round("title_similarity", 6).alias("title_similarity"), F.round("confidence", 6).alias("confidence"), decision.alias("decision"))
