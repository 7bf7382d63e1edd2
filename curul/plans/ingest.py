"""Loading a source: pages or dump rows to records, matched and merged into the tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions import names, status, urls
from curul.functions.commissions import raw_commission_text
from curul.functions.text import event_hash, metadata_text, normalize_text, row_id, sha256, unique_by
from curul.operators import events as event_ops
from curul.operators import extraction, quarantine
from curul.operators.keyed import best_per_key
from curul.operators.links import ranked_links, rebalanced_links
from curul.operators.matching import match_existing
from curul.operators.snapshots import find_or_create, merge_columns, replace_children, upsert
from curul.schema import NATURAL_KEYS
from curul.session import durable
from curul.sources import scans

# --- fixed values: how each source is loaded --------------------------------------------------
RECORD_TYPES = {
    "sil": "initiative_html",
    "gaceta_diputados": "initiative_html",
    "gaceta_senado": "initiative_html",
    "senado_transparencia": "initiative_json",
}
LINK_CONFIDENCE = {"sil": 1.0, "gaceta_diputados": 1.0, "gaceta_senado": 1.0, "senado_transparencia": 0.95}
HASH_NAMES = {
    "sil": "sil_dedupe_hash",
    "gaceta_diputados": "diputados_dedupe_hash",
    "gaceta_senado": "senado_dedupe_hash",
    "senado_transparencia": "senado_dedupe_hash",
}
REPLACES_AUTHORS = ("gaceta_senado", "senado_transparencia")
STATUS_FROM_EVENTS = ("gaceta_diputados",)
# Columns of an initiative that a source does not set; all others it replaces.
COLUMN_RULES = {
    "sil": {"last_major_event_at": "keep"},
    "gaceta_diputados": {"matter_topic": "keep"},
    "gaceta_senado": {"matter_topic": "keep", "last_major_event_at": "keep"},
    "senado_transparencia": {"matter_topic": "keep", "last_major_event_at": "keep"},
}
# The open-data dumps are loaded as records of the senate's transparency source.
DUMPS = {"senado_transparencia": "senado_transparencia", "senado_datos_abiertos": "senado_transparencia"}
# --- end of fixed values ----------------------------------------------------------------------

# What is kept of an event in its record, beside its place.
EVENT = ("event_type", "event_date", "title", "description", "normalized_status_after")

TABLES = {
    "sources": "id string, system string, name string, base_url string, priority int",
    "initiatives": "id string, canonical_title string, title_normalized string, summary string, matter_topic string, "
    "originating_chamber string, current_chamber string, normalized_status string, raw_status string, "
    "presented_at date, last_major_event_at timestamp, metadata map<string,string>, created_at timestamp",
    "source_records": "id string, source_id string, record_type string, source_record_key string, source_url string, "
    "content_hash string, status string",
    "initiative_source_links": "id string, initiative_id string, source_record_id string, source_title string, "
    "source_status string, confidence double, is_primary boolean",
    "authors": "id string, full_name string, name_normalized string, chamber string",
    "initiative_authors": "initiative_id string, author_id string, role string, sort_order int",
    "legislative_events": "id string, initiative_id string, event_type string, event_date timestamp, chamber string, "
    "title string, description string, normalized_status_after string, event_hash string, source string",
    "event_source_links": "legislative_event_id string, source_record_id string",
    "documents": "id string, initiative_id string, source_id string, document_kind string, source_url string, sha256 string",
    "commissions": "id string, name string, name_normalized string, chamber string",
    "initiative_commissions": "initiative_id string, commission_id string, relation_type string, assigned_at timestamp",
    "rejected_inputs": "id string, source_id string, source_url string, source_record_key string, outcome string, reason string, "
    "raw string, content_hash string, seen_at timestamp",
}


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The model with no rows; the limit shows the planner that there are none, so joins with them cost nothing."""
    return {name: spark.createDataFrame([], schema).limit(0) for name, schema in TABLES.items()}


def parse(pages: DataFrame, source: str) -> DataFrame:
    """Records of a source's stored pages (``url``, ``html``) or dumps (``url``, ``text``)."""
    if source in DUMPS:
        return _dump_records(dump_rows(pages, source), source)
    if source == "gaceta_senado":
        return extraction.senate_records(pages)
    if source == "gaceta_diputados":
        listed = pages.filter(F.lower("url").rlike(r"_inis\.html|/base/inis/|indice|gp_iniciativas"))
        single = pages.filter(~F.lower("url").rlike(r"_inis\.html|/base/inis/|indice|gp_iniciativas"))
        return extraction.chamber_list_records(listed).unionByName(extraction.chamber_page_records(single))
    if source != "sil":
        raise ValueError(f"unknown source {source}")
    detail_page = F.contains("url", F.lit("pp_ContenidoAsuntos"))
    results = extraction.results_records(pages.filter(urls.is_results_page("url")))
    details = extraction.detail_records(pages.filter(detail_page))
    generic = extraction.generic_records(pages.filter(~urls.is_results_page("url") & ~detail_page))
    return extraction.merge_details(results, details).unionByName(generic)


def dump_rows(dumps: DataFrame, source: str) -> DataFrame:
    """Rows of the dumps that are valid JSON."""
    sound = dumps.filter(dump_error(source).isNull())
    if source == "senado_transparencia":
        return scans.envelope_rows(sound, "text", "url", keep=extraction.is_senate_initiative)
    return scans.embedded_rows(sound, "text", "url").filter(F.col("error").isNull())


def _dump_records(rows: DataFrame, source: str) -> DataFrame:
    return extraction.transparency_records(rows) if source == "senado_transparencia" else extraction.open_data_records(rows)


def dump_error(source: str) -> Column:
    """Why the ``text`` of a dump cannot be read; null where it can."""
    return scans.envelope_error("text") if source == "senado_transparencia" else scans.embedded_error("text")


def read(inputs: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Records that can be loaded, and what was rejected (failed or skipped) with the reason and the raw text.

    The records are kept on durable storage, as the rejects are what is left without them.
    """
    if source in DUMPS:
        rows = durable(dump_rows(inputs, source))
        name = "source_json_url" if source == "senado_transparencia" else "source_label"
        # Kept as well, or every later step works each value out of the row again, once for every use.
        good, broken = quarantine.split_records(durable(_dump_records(rows, source)))
        return good, broken.unionByName(quarantine.rejected_texts(inputs, dump_error(source), rows.select(F.col(name).alias("url"))))
    records = durable(parse(inputs, source))
    good, broken = quarantine.split_records(records)
    return good, broken.unionByName(quarantine.rejected_pages(inputs, records))


def content_hash(records: DataFrame) -> Column:
    """SHA-256 of all that was read from a record: another status, summary or author is another content."""
    kinds = {f.name: f.dataType.typeName() for f in records.schema}
    parts = [F.array_sort(F.map_entries(c)).alias(c) if kinds[c] == "map" else F.col(c) for c in sorted(kinds) if c != "fetched_at"]
    return sha256(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}))


def _chamber(source: str):
    return (status.chamber_narrow if source in REPLACES_AUTHORS else status.chamber_wide)("chamber")


def identified(records: DataFrame, initiatives: DataFrame, source: str) -> DataFrame:
    """Mapped records with the initiative each belongs to, and whether it is a new one."""
    unique = best_per_key(records, ["source_record_key"], [F.col("dedupe_hash").asc(), F.col("source_url").asc()])
    rows = extraction.mapped(unique.withColumn("content_hash", content_hash(unique)))
    extra = F.create_map(
        F.lit(HASH_NAMES[source]), F.col("dedupe_hash"),
        F.lit("source_url"), F.col("source_url"),
        F.lit("source_record_key"), F.col("source_record_key"),
        F.lit("source_document_url"), F.col("source_url"),
        F.lit("initiative_type"), F.coalesce("initiative_type", F.lit("")),
    )
    found = match_existing(rows, initiatives, source)
    return (
        rows.join(found, "source_record_key", "left")
        .withColumn("initiative_id", F.coalesce("matched_id", row_id(F.lit(source), "source_record_key")))
        .withColumn("outcome", F.when(F.col("matched_id").isNull(), "inserted").otherwise("updated"))
        .withColumn("metadata", F.map_zip_with("metadata", extra, lambda _, a, b: F.coalesce(b, a)))
        .withColumn("chamber_name", F.col("chamber"))
        .withColumn("chamber_id", _chamber(source))
        .withColumn("record_type", F.lit(RECORD_TYPES[source]))
    )


class Snapshot(Mapping):
    """Tables by name. Those that a load changes are planned when they are first asked for, so what nobody reads is not written."""

    def __init__(self, tables: Mapping[str, DataFrame]):
        self._tables, self._plans = dict(tables), {}

    def plan(self, name: str, table: Callable[[], DataFrame]) -> None:
        self._tables.pop(name, None)
        self._plans[name] = table

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._plans:
            self._tables[name] = self._plans.pop(name)()
        return self._tables[name]

    def __iter__(self) -> Iterator[str]:
        return iter([*self._tables, *self._plans])

    def __len__(self) -> int:
        return len(self._tables) + len(self._plans)


def load(
    records: DataFrame, tables: Mapping[str, DataFrame], source: str, run_ts: str, rejected: DataFrame | None = None
) -> tuple[Mapping[str, DataFrame], DataFrame]:
    """The next snapshot of every table, and the run's counters: inserted and updated, and of ``rejected`` inputs skipped and failed.

    The matched records feed every table and the derived events three of them, so both are kept
    on durable storage once, when the first of these tables is asked for. The counters need the outcome of each record only.
    What is read from the one record of an initiative that the tables lack meets no other row and needs no exchange (``alone``).
    """
    source = DUMPS.get(source, source)
    out = Snapshot(tables)
    source_id = tables["sources"].filter(F.col("system") == source).select("id").scalar()
    matched = identified(records, tables["initiatives"], source)

    @cache
    def rows() -> DataFrame:
        there = tables["initiatives"].select("id").union(tables["initiative_source_links"].select("initiative_id")).distinct()
        known = matched.join(there, F.col("initiative_id") == F.col("id"), "left").withColumn("alone", F.col("id").isNull()).drop("id")
        known = known.withColumn("source_id", source_id)
        known = known.withColumn("source_record_id", row_id("source_id", "record_type", "source_record_key", "content_hash"))
        # Where a status follows from the events, they go along with their record.
        return durable(_told(known, source, run_ts) if source in STATUS_FROM_EVENTS else known)

    @cache
    def met() -> bool:
        return not rows().where("not alone").isEmpty()

    def parts(df: DataFrame, apart: Callable[[DataFrame], DataFrame], together: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of ``df`` of an initiative's one record by ``apart``, the others by ``together``."""
        one = apart(df.where("alone"))
        return one.unionByName(together(df.where("not alone"))) if met() else one

    @cache
    def derived() -> DataFrame:
        return durable(_derived(rows(), source, run_ts))

    @cache
    def made() -> DataFrame:
        return parts(derived(), _apart, _events)

    @cache
    def signed() -> tuple[DataFrame, DataFrame]:
        return _authors(rows(), tables, source, parts)

    @cache
    def referred() -> tuple[DataFrame, DataFrame]:
        return _commissions(made(), tables)

    def source_records() -> DataFrame:
        fresh = rows().select(
            F.col("source_record_id").alias("id"), "source_id", "record_type", "source_record_key", "source_url",
            "content_hash", F.lit("parsed").alias("status"),
        )
        return upsert(tables["source_records"], fresh, NATURAL_KEYS["source_records"], preserve=["id"], unique=True)

    def event_source_links() -> DataFrame:
        # An event is linked to the records that tell of it, not to all records of its initiative.
        event_links = derived().select(row_id("initiative_id", "event_hash").alias("legislative_event_id"), "source_record_id")
        return upsert(tables["event_source_links"], event_links, NATURAL_KEYS["event_source_links"], mode="keep", unique=True)

    def initiatives() -> DataFrame:
        def apart(one: DataFrame) -> DataFrame:
            return _initiatives(_own_state(one) if source in STATUS_FROM_EVENTS else one, source, run_ts)

        def together(several: DataFrame) -> DataFrame:
            if source in STATUS_FROM_EVENTS:
                several = several.join(event_ops.derived_status(_events(derived().where("not alone"))), "initiative_id", "left")
            return best_per_key(_initiatives(several, source, run_ts), ["id"], [F.col("_order").desc()])

        policy = {"created_at": "keep", **COLUMN_RULES[source]}
        return merge_columns(tables["initiatives"], parts(rows(), apart, together), ["id"], policy, unique=True)

    def links() -> DataFrame:
        existing = tables["initiative_source_links"]
        one = _links(rows().where("alone"), source, primary=True).select(*existing.columns)
        if not met():
            return existing.unionByName(one)
        return one.unionByName(_merged_links(rows().where("not alone"), {**tables, "source_records": out["source_records"]}, source))

    def documents() -> DataFrame:
        pages = rows().select(
            row_id("source_id", "content_hash").alias("id"), "initiative_id", "source_id",
            F.lit("html_snapshot").alias("document_kind"), "source_url", F.col("content_hash").alias("sha256"),
        )
        return upsert(tables["documents"], pages, NATURAL_KEYS["documents"], preserve=["id"])

    out.plan("initiatives", initiatives)
    out.plan("source_records", source_records)
    out.plan("initiative_source_links", links)
    out.plan("authors", lambda: signed()[0])
    out.plan("initiative_authors", lambda: signed()[1])
    out.plan("legislative_events", lambda: upsert(tables["legislative_events"], made(), NATURAL_KEYS["legislative_events"], preserve=["id"], unique=True))
    out.plan("event_source_links", event_source_links)
    if source == "sil":
        out.plan("documents", documents)
    if source == "gaceta_diputados":
        out.plan("commissions", lambda: referred()[0])
        out.plan("initiative_commissions", lambda: referred()[1])
    outcomes = matched.select("outcome")
    if rejected is not None:
        rejected = durable(rejected)
        out.plan("rejected_inputs", lambda: _rejected(rejected, tables["rejected_inputs"], source_id, run_ts))
        outcomes = outcomes.unionByName(rejected.select("outcome"))
    return out, event_ops.outcome_counts(outcomes)


def _rejected(rejected: DataFrame, existing: DataFrame, source_id: Column, run_ts: str) -> DataFrame:
    """Each rejected input once, as it was first seen."""
    fresh = rejected.withColumn("source_id", source_id).withColumn("seen_at", F.lit(run_ts).cast("timestamp"))
    key = NATURAL_KEYS["rejected_inputs"]
    return upsert(existing, fresh.withColumn("id", row_id(*key)), key, mode="keep")


def audited(tables: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Loaded tables under the names that audit, clusters, details and search read."""
    authors = F.coalesce(*[metadata_text("metadata", k) for k in ("senadores_raw", "cargo_proponente", "authors_raw")])
    initiatives = tables["initiatives"].withColumns({
        "parser": metadata_text("metadata", "parser"),
        "raw_commissions": raw_commission_text("metadata"),
        "has_raw_authors": authors.isNotNull(),
    })
    records = tables["source_records"].withColumnRenamed("id", "source_record_id")
    links = tables["initiative_source_links"].withColumnRenamed("id", "link_id")
    return {
        **tables,
        "initiatives": initiatives,
        "legislative_events": tables["legislative_events"].withColumnRenamed("id", "event_id"),
        "ranked_links": ranked_links(links, records, tables["sources"].withColumnRenamed("id", "source_id")),
    }


def _told(rows: DataFrame, source: str, run_ts: str) -> DataFrame:
    """Rows with ``told``, the events of each record with their place in the order of derivation (``seq``); of equal ones the last."""
    read = {name: metadata_text("metadata", name) for name in ("referred_to", "gaceta_issue_number")}
    placed = F.transform(event_ops.event_array(source, run_ts), lambda e, i: F.struct(i.alias("seq"), *(e[c].alias(c) for c in EVENT)))
    # Of one initiative's events, those with this key in common have the same hash.
    key = lambda e: F.concat_ws("|", *(F.coalesce(e[c].cast("string"), F.lit("")) for c in ("event_type", "event_date", "title")))
    last = F.reverse(unique_by(F.reverse(placed), key, keep_blank_keys=True))
    return rows.withColumns(read).withColumn("told", last).drop(*read)


def _derived(rows: DataFrame, source: str, run_ts: str) -> DataFrame:
    """The events that each record tells of, without their id, which follows from initiative and hash."""
    told = rows if source in STATUS_FROM_EVENTS else _told(rows, source, run_ts)
    made = told.select("initiative_id", "source_record_id", "alone", status.chamber_wide("chamber_name").alias("chamber"), F.explode("told").alias("e"))
    made = made.select("initiative_id", "source_record_id", "alone", "chamber", "e.*", F.lit(source).alias("source"))
    return made.withColumn("event_hash", event_hash("initiative_id", "event_type", "event_date", "title"))


def _apart(derived: DataFrame) -> DataFrame:
    """The events of initiatives with one record: what the record tells."""
    # The id follows from the key.
    return derived.drop("source_record_id", "alone").withColumn("id", row_id("initiative_id", "event_hash"))


def _events(derived: DataFrame) -> DataFrame:
    """Each event of an initiative once: the last derived, then by text."""
    order = [F.col("seq").desc(), F.col("description").asc(), F.col("source_record_id").asc()]
    return _apart(best_per_key(derived, ["initiative_id", "event_hash"], order))


def _own_state(rows: DataFrame) -> DataFrame:
    """Rows of initiatives with one record, with what ``derived_status`` finds in the events that it tells."""
    known = F.filter("told", lambda e: e["normalized_status_after"] != "unknown")
    order = F.transform(known, lambda e: F.struct(*(e[c].alias(c) for c in ("event_date", "seq", "normalized_status_after"))))
    return rows.withColumns({
        "last_status": F.array_max(order)["normalized_status_after"],
        "last_major_event_at": F.array_max(F.transform("told", lambda e: e["event_date"])),
    })


def _initiatives(rows: DataFrame, source: str, run_ts: str) -> DataFrame:
    """What is loaded of an initiative, one row a record; where events tell the status, rows come with it."""
    if source in STATUS_FROM_EVENTS:
        state, last = event_ops.status_or_default("last_status", "presented_at"), F.col("last_major_event_at")
    else:
        state, last = status.record_status("raw_status", "presented_at", source), F.lit(None).cast("timestamp")
    return rows.select(
        F.col("initiative_id").alias("id"), "canonical_title", "title_normalized", "summary",
        (metadata_text("metadata", "topic") if source == "sil" else F.lit(None).cast("string")).alias("matter_topic"),
        F.col("chamber_id").alias("originating_chamber"), F.col("chamber_id").alias("current_chamber"),
        state.alias("normalized_status"), "raw_status", "presented_at", last.alias("last_major_event_at"), "metadata",
        F.lit(run_ts).cast("timestamp").alias("created_at"), F.col("source_record_key").alias("_order"),
    )


def _links(rows: DataFrame, source: str, primary: bool) -> DataFrame:
    return rows.select(
        row_id("initiative_id", "source_record_id").alias("id"), "initiative_id", "source_record_id",
        F.col("canonical_title").alias("source_title"), F.col("raw_status").alias("source_status"),
        F.lit(LINK_CONFIDENCE[source]).alias("confidence"), F.lit(primary).alias("is_primary"),
    )


def _merged_links(rows: DataFrame, out: Mapping[str, DataFrame], source: str) -> DataFrame:
    """The links there were and those of ``rows``, with the primary ones chosen anew where ``rows`` add some."""
    existing = out["initiative_source_links"]
    # Only the links of the loaded initiatives are merged and rebalanced; the rest passes through.
    touched = rows.select("initiative_id").distinct()
    known = existing.join(touched, "initiative_id", "left_semi").select(*existing.columns)
    fresh = _links(rows, source, primary=False)
    mine = upsert(known, fresh, NATURAL_KEYS["initiative_source_links"], preserve=["id"], unique=True).withColumnRenamed("id", "link_id")
    records = out["source_records"].withColumnRenamed("id", "source_record_id")
    sources = out["sources"].withColumnRenamed("id", "source_id")
    chosen = rebalanced_links(ranked_links(mine, records, sources)).withColumnRenamed("link_id", "id")
    rest = existing.join(touched, "initiative_id", "left_anti")
    return rest.select(*existing.columns).unionByName(chosen.select(*existing.columns))


def _authors(rows: DataFrame, tables: Mapping[str, DataFrame], source: str, parts: Callable[..., DataFrame]) -> tuple[DataFrame, DataFrame]:
    listed = F.col("authors")
    if source in REPLACES_AUTHORS:
        listed = names.expand_senate_names(listed, deputies_too=source == "senado_transparencia")
    spelled = rows.select(F.col("chamber_id").alias("chamber"), F.explode(listed).alias("full_name"))
    spelled = spelled.withColumn("name_normalized", normalize_text("full_name")).filter(F.col("name_normalized") != "")
    people = find_or_create(tables["authors"], spelled.select("full_name", "name_normalized", "chamber"), ["name_normalized"])

    # A record's first mention of a person counts, so its names are told apart where they stand.
    placed = F.transform(listed, lambda name, i: F.struct(i.alias("place"), normalize_text(name).alias("name_normalized")))
    signed = rows.select("initiative_id", "alone", F.explode(unique_by(placed, lambda p: p["name_normalized"])).alias("p")).select("initiative_id", "alone", "p.*")
    # A new person's id follows from the name, so only the persons there were have to be met.
    there = best_per_key(tables["authors"], ["name_normalized"], [F.col("id").asc()]).select(F.col("id").alias("_id"), "name_normalized")
    named = row_id("name_normalized").cast(tables["authors"].schema["id"].dataType)
    found = signed.join(there, "name_normalized", "left").select(
        "initiative_id", F.coalesce("_id", named).alias("author_id"), F.lit("primary").alias("role"), (F.col("place") + 1).alias("sort_order"), "alone"
    )
    key = NATURAL_KEYS["initiative_authors"]
    fresh = parts(found, lambda one: one, lambda several: best_per_key(several, key, [F.col("sort_order").asc()])).drop("alone")
    existing = tables["initiative_authors"]
    if source in REPLACES_AUTHORS:
        return people, replace_children(existing, rows.select("initiative_id"), fresh)
    return people, upsert(existing, fresh, key, unique=True)


def _commissions(made: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    turns = event_ops.commission_turns(made)
    key = ["name_normalized", "chamber"]
    grown = find_or_create(tables["commissions"], turns.select("name", *key), key)
    ids = grown.select(F.col("id").alias("commission_id"), F.col("name_normalized").alias("_n"), F.col("chamber").alias("_c"))
    fresh = turns.join(
        ids, (F.col("name_normalized") == F.col("_n")) & F.col("chamber").eqNullSafe(F.col("_c"))
    ).select("initiative_id", "commission_id", F.lit("referred").alias("relation_type"), "assigned_at")
    return grown, upsert(
        tables["initiative_commissions"], fresh.distinct(), NATURAL_KEYS["initiative_commissions"], mode="keep"
    )
