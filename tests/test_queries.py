"""The named queries as the driver sees them: plans, columns, and a few compared with SQL."""

import duckdb
import pytest

import __spark_entry__ as contract
from tests.check import compare
from curul.plans import CHECKS, QUERIES
from curul.sources.staging import BASE_TABLES

COMPARED = (
    "duplicate_clusters", "scorecard", "audit_coverage", "author_variants", "duplicate_merge_plan", "source_conflicts",
    "primary_source_pick", "status_backfill", "listing_constrained", "topic_search", "vector_topk", "gazette_records", "upsert_keep",
)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    rows = contract.entry(spark)
    assert rows.columns == ["position", "key", "status", "count", "threshold"] and rows.count() == 7
    assert not any(name.startswith("op") and name[2:3].isdigit() for name in QUERIES)


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_check(spark, small, name):
    connection = duckdb.connect()
    for table in BASE_TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{table}.parquet'")
    assert name in CHECKS
    ok, note = compare(spark, connection, small, name)
    assert ok, note


def test_no_query_pairs_rows_up(spark, small):
    """No cross or nested-loop join, and no hand-made broadcast of a table, in any plan."""
    offending = []
    for name, query in QUERIES.items():
        plan = query(spark, small)._jdf.queryExecution().executedPlan().toString()
        if "CartesianProduct" in plan or "NestedLoopJoin" in plan:
            offending.append(name)
    assert offending == []
