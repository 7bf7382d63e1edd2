"""Pages of nested children: keys in one task and keys in several."""

import pytest
from pyspark.sql import functions as F

from curul.operators.keyed import numbered, numbered_apart


@pytest.fixture
def rows(spark):
    """A key with most rows, many with few, and null."""
    return spark.range(4000).selectExpr("case when id % 4 > 0 then 'hot' when id % 100 = 0 then null else concat('k', id % 600) end as key", "id", "id % 7 as mark").repartition(5)


def test_places_equal_a_window(spark, rows):
    from pyspark.sql import Window

    own = Window.partitionBy("key")
    want = rows.select("id", (F.row_number().over(own.orderBy("mark", "id")) - 1).alias("place"), F.count("*").over(own).alias("total"))
    got = numbered(rows, "key", [F.col("mark"), F.col("id")], "place", parts=6).select("id", "place", "total")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_keys_of_one_task_are_exchanged_once(rows):
    alone, torn = numbered_apart(rows, "key", [F.col("mark"), F.col("id")], "place", "total", 6)
    assert {r.key for r in torn.select("key").distinct().collect()} >= {"hot"}
    assert alone.count() + torn.count() == 4000 and alone.count() > 0
    plan = alone._jdf.queryExecution().sparkPlan().toString()
    assert "Window" in plan and alone._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
