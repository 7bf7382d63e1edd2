"""Queries whose check lists all children of a parent in one row: none is left out beyond a page."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from curul.operators import details
from curul.plans import QUERIES

LINKS = 2300


@pytest.fixture(scope="module")
def crowded(spark, small, tmp_path_factory):
    """The small tables with one event, and so one initiative, that has very many source links: its line comes as often."""
    folder = tmp_path_factory.mktemp("crowded")
    for name in ("region", "nation", "supplier", "orders", "part", "customer"):
        pq.write_table(pq.read_table(f"{small}/{name}.parquet"), folder / f"{name}.parquet")
    lines = pq.read_table(f"{small}/lineitem.parquet").slice(0, 50)
    pq.write_table(lines.take([0] * (LINKS - 1) + list(range(50))), folder / "lineitem.parquet")
    return str(folder)


def test_an_event_has_all_its_links_in_the_timeline(spark, crowded):
    rows = QUERIES["timeline"](spark, crowded).select("event_id", F.size(F.split("source_links", "; ")).alias("n"))
    most = rows.groupBy("event_id").agg(F.min("n").alias("n")).orderBy(F.desc("n")).first()
    assert most.n == LINKS


def test_an_initiative_has_all_its_sources_in_one_row(spark, crowded):
    rows = QUERIES["detail_sources"](spark, crowded).select("initiative_id", "n").collect()
    assert len({r.initiative_id for r in rows}) == len(rows) and max(r.n for r in rows) >= LINKS


def test_whole_lists_follow_their_order(spark):
    events = spark.createDataFrame([("e", "i"), ("f", "i")], "event_id string, initiative_id string")
    links = spark.range(LINKS).selectExpr("'e' event_id", "id source_record_id").repartition(7)
    records = spark.range(LINKS).selectExpr("id source_record_id", "1 source_id", "concat('u', id) source_url", "'t' record_type")
    sources = spark.createDataFrame([(1, "sil")], "source_id int, system string")
    got = {r.event_id: r for r in details.timeline(events, links, records, sources, page=None).collect()}
    assert [s.source_url for s in got["e"].source_links] == [f"u{i}" for i in range(LINKS)] and got["e"].source_link_count == LINKS
    assert got["f"].source_links is None and got["f"].source_link_count == 0
