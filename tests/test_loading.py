"""Failure isolation and the column rules of a load."""

import pytest
from pyspark.sql import functions as F

from curul.functions.html import read_errors, with_elements
from curul.operators import quarantine, snapshots
from curul.plans import ingest, load_queries

RUN = "2026-01-01 00:00:00"
ITEM = "<li>Que reforma el artículo 1 de la Ley de Aguas. Presentada por la diputada Eva Luna. Turnada a la Comisión de Salud. Gaceta Parlamentaria, número 5-I, del martes 4 de marzo de 2025. (5)</li>"
URL = "https://gaceta.diputados.gob.mx/Gaceta/Iniciativas/66/gp66_b_inis.html?p={}"


def pages(spark, *bodies):
    return spark.createDataFrame([(URL.format(i), b) for i, b in enumerate(bodies)], "url string, html string")


def test_a_page_that_cannot_be_read_stops_nothing(spark):
    rows = pages(spark, "<![odd[ " + ITEM, ITEM, None, "")
    read = {r.url[-1]: len(r.elements) for r in with_elements(rows).collect()}
    assert read == {"0": 0, "1": 1, "2": 0, "3": 0}
    errors = {r.url[-1]: r.error for r in read_errors(rows).collect()}
    assert errors["0"].startswith("AssertionError") and errors["1"] is None and errors["2"] is None


def test_long_pages_leave_in_parts(spark):
    body = ITEM + "<p>" + "x" * (3 << 20) + "</p>"
    rows = with_elements(pages(spark, *[body] * 5).coalesce(1)).select("url", F.size("elements").alias("n"), F.length("body").alias("b"))
    assert sorted((r.url[-1], r.n) for r in rows.collect()) == [(str(i), 2) for i in range(5)]
    assert len({r.b for r in rows.collect()}) == 1


def test_rejects_tell_why_and_keep_the_text(spark):
    broken = "<![odd[ " + ITEM
    rows = pages(spark, broken, ITEM, None, "<p>nada</p>", " ")
    records, rejected = ingest.read(rows, "gaceta_diputados")
    assert records.count() == 1
    told = {r.source_url[-1]: (r.outcome, r.reason.split(":")[0], r.raw) for r in rejected.collect()}
    assert told == {
        "0": ("failed", "AssertionError", broken), "2": ("failed", "no body", ""),
        "3": ("skipped", "no record", "<p>nada</p>"), "4": ("failed", "no body", " "),
    }
    tables, counters = ingest.load(records, load_queries.start(spark), "gaceta_diputados", RUN, rejected)
    assert {r.outcome: r["count"] for r in counters.collect()} == {"inserted": 1, "failed": 3, "skipped": 1}
    again, _ = ingest.load(records, tables, "gaceta_diputados", "2026-02-01 00:00:00", rejected)
    seen = again["rejected_inputs"].collect()
    assert len(seen) == 4 and {str(r.seen_at) for r in seen} == {RUN}


def test_only_tables_that_are_read_are_written(spark, monkeypatch):
    records, rejected = ingest.read(pages(spark, ITEM, None), "gaceta_diputados")
    written = []
    durable = ingest.durable
    monkeypatch.setattr(ingest, "durable", lambda df: written.append(df) or durable(df))
    tables, counters = ingest.load(records, load_queries.start(spark), "gaceta_diputados", RUN, rejected)
    assert tables["rejected_inputs"].count() == 1 and counters.count() == 2
    assert len(written) == 1
    # The matched records and the derived events are written once each, however many tables they feed.
    assert set(tables) == set(ingest.TABLES) and all(df.count() >= 0 for df in tables.values())
    assert len(written) == 3


def test_records_without_title_or_key_are_kept_apart(spark):
    rows = spark.createDataFrame(
        [("u", "k", "t"), ("u", "", "t"), ("u", "k2", None), (None, "k3", "t")], "source_url string, source_record_key string, title_normalized string"
    )
    good, broken = quarantine.split_records(rows)
    assert [r.source_record_key for r in good.collect()] == ["k"]
    assert {(r.source_record_key, r.reason) for r in broken.collect()} == {("", "no key"), ("k2", "no title"), ("k3", "no address")}


def test_broken_dumps(spark):
    row = '{"tipo_documento":"Iniciativa","titulo_docuemnto":"Que reforma la ley","organo":"Cámara de Senadores","fecha_documento":"04/03/2025"}'
    texts = {"good": '{"data":[' + row + "]}", "cut": '{"data":[' + row, "none": '{"data":[]}', "other": '{"x":1}', "null": None, "odd": "texto"}
    dumps = spark.createDataFrame(list(texts.items()), "url string, text string")
    records, rejected = ingest.read(dumps, "senado_transparencia")
    assert [r.source_url for r in records.collect()] == ["good"]
    told = {r.source_url: (r.outcome, r.reason) for r in rejected.collect()}
    assert told == {
        "cut": ("failed", "no valid JSON"), "none": ("skipped", "no record"), "other": ("failed", "no data"),
        "null": ("failed", "no body"), "odd": ("failed", "no valid JSON"),
    }
    open_data = spark.createDataFrame([("a", 'x [{"id":"1","titulo":"Que reforma","tipo":"Iniciativa"}] y'), ("b", "x [{oops}] y"), ("c", "nada")], "url string, text string")
    records, rejected = ingest.read(open_data, "senado_datos_abiertos")
    assert records.count() == 1
    assert {r.source_url: r.reason for r in rejected.collect()} == {"b": "no valid JSON", "c": "no JSON array"}


def test_unknown_sources_are_an_error(spark):
    with pytest.raises(ValueError):
        ingest.parse(pages(spark, ITEM), "boletin")


def test_each_column_has_its_rule(spark):
    schema = "id string, a string, b string, c string, d string"
    old = spark.createDataFrame([("1", "a", "b", None, "d"), ("2", "x", "x", "x", "x"), (None, "n", "n", "n", "n")], schema)
    new = spark.createDataFrame(
        [("1", None, "B", "C", None, 1), ("1", "late", "B", "C", None, 2), ("3", "A", "B", "C", "D", 1), (None, "N", "N", "N", "N", 1)], schema + ", at int"
    )
    rules = {"b": "keep", "c": "fill", "d": "known"}
    out = {r.id: tuple(r)[1:] for r in snapshots.merge_columns(old, new, ["id"], rules, position="at").collect()}
    assert out == {"1": ("late", "b", "C", "d"), "2": ("x",) * 4, "3": ("A", "B", "C", "D"), None: ("N", "n", "n", "N")}
    assert snapshots.merge_columns(old.limit(0), new.limit(0), ["id"], rules, position="at").count() == 0
    with pytest.raises(ValueError):
        snapshots.merge_columns(old, new, ["id"], {"z": "keep"})
