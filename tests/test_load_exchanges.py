"""What a load exchanges: initiatives with one record meet no other row, addresses of inputs are never broadcast."""

import pytest
from pyspark.sql import functions as F

from curul.operators import quarantine
from curul.plans import ingest, load_queries

RUN = "2026-01-01 00:00:00"
SOURCE = "gaceta_diputados"
PAGE = "https://gaceta.diputados.gob.mx/Gaceta/Iniciativas/66/gp66_b_inis.html?p={}"
ITEM = "<li>Que reforma el artículo {0} de la Ley General de Salud y otras. Presentada por la diputada Ana Ruiz. Turnada a la Comisión de Salud. Gaceta Parlamentaria, número {0}-I, del martes 4 de marzo de 2025. ({0})</li>"


def records(spark, *numbers):
    return ingest.parse(spark.createDataFrame([(PAGE.format(n), ITEM.format(n)) for n in numbers], "url string, html string"), SOURCE)


@pytest.fixture(scope="module")
def first(spark):
    return ingest.load(records(spark, 1, 2), load_queries.start(spark), SOURCE, RUN)[0]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["initiatives", "initiative_source_links", "legislative_events", "event_source_links", "initiative_authors", "source_records"])
def test_a_first_load_exchanges_nothing_for_a_table(first, name):
    assert "Exchange" not in plan(first[name]) and first[name].count() > 0


def test_known_and_new_initiatives_load_together(spark, first):
    settled = {name: ingest.durable(df) for name, df in first.items()}
    out, counters = ingest.load(records(spark, 2, 3), settled, SOURCE, RUN)
    assert {r.outcome: r["count"] for r in counters.collect()} == {"inserted": 1, "updated": 1}
    whole, _ = ingest.load(records(spark, 1, 2, 3), load_queries.start(spark), SOURCE, RUN)
    for name in ("initiatives", "initiative_source_links", "legislative_events", "event_source_links", "initiative_authors"):
        columns = [c for c in whole[name].columns if c not in ("metadata", "seq")]
        assert sorted(map(str, out[name].select(columns).collect())) == sorted(map(str, whole[name].select(columns).collect())), name


def test_addresses_of_inputs_are_not_broadcast(spark):
    # From files, whose size the planner knows.
    texts = ingest.durable(spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "url string, text string"))
    rows = quarantine.rejected_texts(texts, F.lit(None).cast("string"), texts.where("url = 'a'"))
    assert "BroadcastExchange" not in plan(rows)
    assert {(r.source_url, r.outcome) for r in rows.collect()} == {("b", "skipped"), ("c", "failed")}
