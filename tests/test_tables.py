"""Loading, merging and streaming: invariants over whole tables."""

from pyspark.sql import functions as F

from curul.operators import events, integrity, merges, repairs, snapshots
from curul.plans import ingest
from curul.schema import NATURAL_KEYS
from curul.session import durable
from curul.sources.scans import seed_sources
from curul.streaming.landing import Snapshots, landed_pages, stream_source

RUN = "2026-01-01 00:00:00"


def start_tables(spark):
    tables = ingest.empty_tables(spark)
    tables["sources"] = seed_sources(spark).select("id", "system", "name", "base_url", "priority")
    return tables


def gazette(spark, numbers, status="Turnada a la Comisión de Salud"):
    item = "<li>Que reforma el artículo {0} de la Ley General de Salud y otras. Presentada por la diputada Ana Ruiz y Juan Pérez. {1}. Gaceta Parlamentaria, número {0}-I, del martes 4 de marzo de 2025. ({0})</li>"
    rows = [
        (f"https://gaceta.diputados.gob.mx/Gaceta/Iniciativas/66/gp66_b_inis.html?p={n}", "<ul>" + item.format(n, status) + "</ul>")
        for n in numbers
    ]
    return spark.createDataFrame(rows, "url string, html string").withColumn("fetched_at", F.lit(RUN).cast("timestamp"))


def sound(tables):
    for name, key in NATURAL_KEYS.items():
        if name in tables:
            assert integrity.unique_violations(tables[name], key).count() == 0, name
    broken = integrity.audit_tables(tables).filter("violations > 0").collect()
    assert broken == []
    primaries = tables["initiative_source_links"].groupBy("initiative_id").agg(F.count_if("is_primary").alias("n"))
    assert primaries.filter("n <> 1").count() == 0


def loaded(records, tables, source):
    """Load and settle: the tables as a written snapshot would be read back, and the counters."""
    out, counters = ingest.load(records, tables, source, RUN)
    return {name: durable(df) for name, df in out.items()}, {r.outcome: r["count"] for r in counters.collect()}


def contents(tables):
    return {name: sorted(map(str, df.drop("metadata").collect())) for name, df in tables.items()}


def test_load_is_idempotent_and_sound(spark):
    source = "gaceta_diputados"
    records = ingest.parse(gazette(spark, [1, 2, 3]), source)
    first, counters = loaded(records, start_tables(spark), source)
    assert counters == {"inserted": 3}
    sound(first)
    again, counters = loaded(records, first, source)
    assert counters == {"updated": 3}
    assert contents(again) == contents(first)
    assert first["authors"].count() == 2 and first["initiative_authors"].count() == 6
    assert first["commissions"].count() == 1 and first["initiative_commissions"].count() == 3
    assert {r.normalized_status for r in first["initiatives"].collect()} == {"in_commissions"}


def test_senate_load_replaces_authors(spark):
    page = lambda names: spark.createDataFrame(
        [("https://www.senado.gob.mx/66/gaceta_del_senado/documento/5", f"<body>INICIATIVAS: De las senadoras y los senadores {names}, del Grupo Parlamentario del PAN, con proyecto de decreto por el que se reforma la Ley. PROPOSICIONES:</body>")],
        "url string, html string",
    )
    tables = start_tables(spark)
    for names, expected in (("Ana Ruiz y Juan Pérez", 2), ("Ana Ruiz", 1)):
        tables, _ = loaded(ingest.parse(page(names), "gaceta_senado"), tables, "gaceta_senado")
        assert tables["initiatives"].count() == 1
        assert tables["initiative_authors"].count() == expected
    sound(tables)


def test_stream_equals_batch_and_survives_a_replay(spark, tmp_path):
    source = "gaceta_diputados"
    landing = str(tmp_path / "landing")
    for part in ([1, 2], [2, 3]):
        gazette(spark, part).select("url", "html", "fetched_at").withColumn("content_type", F.lit("text/html")).write.mode("append").parquet(landing)
    snapshots_ = Snapshots(spark, str(tmp_path / "tables"))

    def run():
        query = stream_source(landed_pages(spark, landing, files_per_batch=100), source, snapshots_, str(tmp_path / "state"), RUN)
        query.awaitTermination()
        return [p["batchId"] for p in query.recentProgress]

    run()
    gazette(spark, [4, 1]).select("url", "html", "fetched_at").withColumn("content_type", F.lit("text/html")).write.mode("append").parquet(landing)
    last = max(run())
    batch, _ = loaded(ingest.parse(gazette(spark, [1, 2, 3, 4]), source), start_tables(spark), source)
    streamed = snapshots_.read(last + 1)
    sound(streamed)
    assert contents(streamed) == contents(batch)


def test_events_are_linked_to_the_records_that_tell_of_them(spark):
    source = "gaceta_diputados"
    first, _ = loaded(ingest.parse(gazette(spark, [1, 2]), source), start_tables(spark), source)
    second, _ = loaded(ingest.parse(gazette(spark, [1, 2], "Dictaminada y aprobada en la Cámara de Diputados"), source), first, source)
    sound(second)
    assert second["initiatives"].count() == 2
    # The same key and title with another status is another content, so a record of its own.
    assert first["source_records"].count() == 2 and second["source_records"].count() == 4
    links = second["event_source_links"].groupBy("legislative_event_id").count().collect()
    events_of = {r.id: r.event_type for r in second["legislative_events"].collect()}
    by_type = {}
    for r in links:
        by_type.setdefault(events_of[r.legislative_event_id], set()).add(r["count"])
    assert by_type["presentation"] == {2} and by_type["turn_to_commission"] == {1}


def test_late_and_repeated_pages(spark, tmp_path):
    source = "gaceta_diputados"
    landing = str(tmp_path / "landing")
    shaped = lambda n, day: gazette(spark, n).select("url", "html").withColumns({"fetched_at": F.lit(day).cast("timestamp"), "content_type": F.lit("text/html")})
    shaped([1, 2], "2026-03-01").coalesce(1).write.parquet(landing)
    tables = Snapshots(spark, str(tmp_path / "tables"))

    def run():
        query = stream_source(landed_pages(spark, landing, files_per_batch=1), source, tables, str(tmp_path / "state"), RUN)
        query.awaitTermination()
        return max(p["batchId"] for p in query.recentProgress)

    run()
    shaped([3, 2], "2026-01-20").coalesce(1).write.mode("append").parquet(landing)
    shaped([4], "2026-03-02").coalesce(1).write.mode("append").parquet(landing)
    last = run()
    batch, _ = loaded(ingest.parse(gazette(spark, [1, 2, 3, 4]), source), start_tables(spark), source)
    assert contents(tables.read(last + 1)) == contents(batch)


def test_references_follow_merged_events(spark):
    event = "id string, initiative_id string, event_type string, event_date string, title string, event_hash string"
    from curul.functions.text import event_hash

    rows = [("e1", "a", "presentation", "2020-01-01", "t"), ("e2", "b", "presentation", "2020-01-01", "t"), ("e3", "b", "other", "2020-01-02", "t"), ("e4", "c", "other", "2020-01-02", "t")]
    made = spark.createDataFrame([(*r, "") for r in rows], event).withColumn("event_hash", event_hash("initiative_id", "event_type", "event_date", "title"))
    tables = {
        "initiatives": spark.createDataFrame([("a",), ("b",), ("c",)], "id string"),
        "legislative_events": made,
        "event_source_links": spark.createDataFrame([("e1", "r1"), ("e1", "r2"), ("e2", "r1"), ("e3", "r1"), ("e4", "r9")], "legislative_event_id string, source_record_id string"),
        "documents": spark.createDataFrame([("d1", "a", "e1", "s", "h1"), ("d2", "b", "e2", "s", "h2"), ("d3", "c", None, "s", "h3")], "id string, initiative_id string, legislative_event_id string, source_id string, sha256 string"),
    }
    pairs = spark.createDataFrame([("b", "a", 0.95), ("c", "a", 0.92)], "duplicate_initiative_id string, canonical_initiative_id string, confidence double")
    out = merges.apply_duplicate_merge(pairs, tables)
    events_ = {r.id: r for r in out["legislative_events"].collect()}
    assert len(events_) == 2 and {r.initiative_id for r in events_.values()} == {"a"}
    kept = {r.event_type: r.id for r in events_.values()}
    links = {(r.legislative_event_id, r.source_record_id) for r in out["event_source_links"].collect()}
    assert links == {(kept["presentation"], "r1"), (kept["presentation"], "r2"), (kept["other"], "r1"), (kept["other"], "r9")}
    assert {(r.id, r.initiative_id, r.legislative_event_id) for r in out["documents"].collect()} == {("d1", "a", kept["presentation"]), ("d2", "a", kept["presentation"]), ("d3", "a", None)}
    assert integrity.orphan_rows(out["event_source_links"], "legislative_event_id", out["legislative_events"]).count() == 0


def test_duplicate_merge_moves_all_children(spark):
    tables = start_tables(spark)
    tables["initiatives"] = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    tables["source_records"] = spark.createDataFrame([("r1", "s"), ("r2", "s")], "source_record_id string, source_id string")
    tables["initiative_source_links"] = spark.createDataFrame(
        [("l1", "a", "r1", 1.0, True), ("l2", "b", "r1", 0.5, True), ("l3", "b", "r2", 1.0, False)],
        "link_id string, initiative_id string, source_record_id string, confidence double, is_primary boolean",
    )
    tables["initiative_authors"] = spark.createDataFrame(
        [("a", "x", "primary", 1), ("b", "x", "primary", 2), ("b", "y", "primary", 1)], "initiative_id string, author_id string, role string, sort_order int"
    )
    tables["legislative_events"] = spark.createDataFrame(
        [("e1", "a", "presentation", "2020-01-01", "t", "h1"), ("e2", "b", "other", "2020-01-02", "t", "h2")],
        "id string, initiative_id string, event_type string, event_date string, title string, event_hash string",
    )
    tables["documents"] = spark.createDataFrame([("d", "b")], "id string, initiative_id string")
    tables["affected_norms"] = spark.createDataFrame([("b", "Ley")], "initiative_id string, norm_name string")
    sources = spark.createDataFrame([("s", "sil", 10)], "source_id string, system string, priority int")
    pairs = spark.createDataFrame([("b", "a", 0.95), ("c", "a", 0.5)], "duplicate_initiative_id string, canonical_initiative_id string, confidence double")
    out = merges.apply_duplicate_merge(pairs, tables, sources)
    assert [r.id for r in out["initiatives"].orderBy("id").collect()] == ["a", "c"]
    links = {(r.source_record_id): (r.initiative_id, r.confidence, r.is_primary) for r in out["initiative_source_links"].collect()}
    assert links == {"r1": ("a", 0.5, False), "r2": ("a", 1.0, True)}
    assert {(r.author_id, r.sort_order) for r in out["initiative_authors"].collect()} == {("x", 2), ("y", 1)}
    moved = {r.id: r for r in out["legislative_events"].collect()}
    assert moved["e1"].event_hash == "h1" and moved["e2"].event_hash != "h2" and moved["e2"].initiative_id == "a"
    assert out["documents"].first().initiative_id == "a" and out["affected_norms"].first().initiative_id == "a"
    again = merges.apply_duplicate_merge(pairs, out, sources)
    assert sorted(map(str, again["initiative_source_links"].collect())) == sorted(map(str, out["initiative_source_links"].collect()))
    planned = {r.table: r.rows for r in merges.duplicate_merge_counters(pairs, tables).collect()}
    assert planned["initiatives"] == 1 and planned["initiative_source_links"] == 2 and planned["legislative_events"] == 1


def test_author_merge_leaves_no_alias(spark):
    plan = spark.createDataFrame([("b", "a")], "alias_author_id string, canonical_author_id string")
    relations = spark.createDataFrame([("i", "a", "primary", 1), ("i", "b", "primary", 2), ("j", "b", "primary", 1)], "initiative_id string, author_id string, role string, sort_order int")
    authors = spark.createDataFrame([("a",), ("b",)], "id string")
    merged, kept = merges.apply_author_merge(plan, relations, authors)
    assert {tuple(r) for r in merged.collect()} == {("i", "a", "primary", 2), ("j", "a", "primary", 1)}
    assert [r.id for r in kept.collect()] == ["a"]
    assert integrity.orphan_rows(merged, "author_id", kept).count() == 0


def test_cascade_delete_follows_children(spark):
    tables = {
        "initiatives": spark.createDataFrame([("a",), ("b",)], "id string"),
        "legislative_events": spark.createDataFrame([("e1", "a"), ("e2", "b")], "id string, initiative_id string"),
        "event_source_links": spark.createDataFrame([("e1", "r"), ("e2", "r")], "legislative_event_id string, source_record_id string"),
        "documents": spark.createDataFrame([("d", "a", "e1")], "id string, initiative_id string, legislative_event_id string"),
    }
    out = snapshots.cascade_delete(tables, "initiatives", spark.createDataFrame([("a",)], "id string"))
    assert [r.id for r in out["legislative_events"].collect()] == ["e2"]
    assert [r.legislative_event_id for r in out["event_source_links"].collect()] == ["e2"]
    assert tuple(out["documents"].first()) == ("d", None, None)


def test_upsert_modes(spark):
    old = spark.createDataFrame([(1, None, "old", "t0")], "a int, b string, v string, created string")
    new = spark.createDataFrame([(1, None, "x", "t1", 1), (1, None, "y", "t2", 2), (2, "z", "n", "t3", 3)], "a int, b string, v string, created string, at int")
    updated = snapshots.upsert(old, new, ["a", "b"], position="at", preserve=["created"])
    assert {tuple(r) for r in updated.collect()} == {(1, None, "y", "t0"), (2, "z", "n", "t3")}
    kept = snapshots.upsert(old, new, ["a", "b"], mode="keep", position="at")
    assert {tuple(r) for r in kept.collect()} == {(1, None, "old", "t0"), (2, "z", "n", "t3")}
    outcomes = {(r.a, r.outcome) for r in snapshots.upsert_outcomes(old, new, ["a", "b"]).collect()}
    assert outcomes == {(1, "updated"), (2, "inserted")}


def test_author_repairs_compare_in_order(spark):
    initiatives = spark.createDataFrame(
        [("same", "Sen. Ana Ruiz y Sen. Juan Paz. PAN"), ("swapped", "Sen. Ana Ruiz y Sen. Juan Paz. PAN"), ("none", "Sen. Ana Ruiz. PAN"), ("blank", None)],
        "id string, cargo_proponente string",
    ).withColumn("current_chamber", F.lit("senado"))
    authors = spark.createDataFrame([("1", "ana ruiz", "ana ruiz", "senado"), ("2", "Juan Paz", "juan paz", "senado")], "id string, full_name string, name_normalized string, chamber string")
    relations = spark.createDataFrame(
        [("same", "1", "primary", 1), ("same", "2", "primary", 5), ("swapped", "2", "primary", 1), ("swapped", "1", "primary", 2), ("blank", "2", "primary", 1)],
        "initiative_id string, author_id string, role string, sort_order int",
    )
    plan = repairs.author_repairs(initiatives, relations, authors)
    assert {r.initiative_id for r in plan.collect()} == {"swapped", "none"}
    fixed, _ = repairs.apply_author_repairs(plan, initiatives, relations, authors)
    rows = {(r.initiative_id, r.author_id, r.sort_order) for r in fixed.collect()}
    assert rows == {("same", "1", 1), ("same", "2", 5), ("swapped", "1", 1), ("swapped", "2", 2), ("none", "1", 1), ("blank", "2", 1)}


def test_commission_backfill(spark):
    initiatives = spark.createDataFrame([("i", "Salud <br>Justicia", "2020-01-01"), ("j", "Salud", None)], "id string, raw_commissions string, day string").withColumn("presented_at", F.col("day").cast("date"))
    commissions = spark.createDataFrame([("c1", "SALUD", "salud", "senado")], "id string, name string, name_normalized string, chamber string")
    relations = spark.createDataFrame([], "initiative_id string, commission_id string, relation_type string, assigned_at date")
    grown, rows = repairs.commission_backfill(repairs.commission_assignments(initiatives), commissions, relations, "2026-01-01")
    assert grown.count() == 2 and rows.count() == 3
    assert {str(r.assigned_at) for r in rows.filter("initiative_id = 'j'").collect()} == {"2026-01-01"}


def test_status_backfill(spark):
    initiatives = spark.createDataFrame([("i", "unknown"), ("j", "unknown"), ("k", "draft")], "id string, normalized_status string").withColumn("canonical_title", F.lit("t"))
    rows = spark.createDataFrame(
        [("i", "other", "2020-01-02", "unknown"), ("i", "x", "2020-01-02", "in_commissions"), ("j", "other", "2020-01-01", None)],
        "initiative_id string, event_type string, event_date string, normalized_status_after string",
    )
    got = {r.id: (r.to_status, r.outcome) for r in events.status_backfill(initiatives, rows).collect()}
    assert got == {"i": ("in_commissions", "changed"), "j": ("unknown", "skipped_no_known_event")}
