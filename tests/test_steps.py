"""Steps that loading shares: what is cut is compressed, empty tables cost no join."""

from pyspark.sql import functions as F

from curul.operators.matching import match_existing
from curul.plans import ingest
from curul.session import durable
from curul.sources import scans


def test_durable_rows_are_compressed_columns(spark):
    rows = spark.range(1000).select("id", F.lit("same long text " * 20).alias("text"), F.lit(None).cast("map<string,string>").alias("m"))
    kept = durable(rows)
    assert all(f.endswith(".zstd.parquet") for f in kept.inputFiles()) and kept.inputFiles()
    assert kept.columns == rows.columns and [tuple(r) for r in kept.orderBy("id").collect()] == [tuple(r) for r in rows.collect()]
    assert durable(rows.select("id", F.col("id"))).count() == 1000  # names that Parquet cannot hold
    assert durable(rows.select(F.lit(None).alias("n"))).count() == 1000


def test_matching_with_empty_tables_joins_nothing(spark):
    records = spark.sql(
        "SELECT 'k' AS source_record_key, 't' AS title_normalized, 'h' AS dedupe_hash, 'u' AS source_url, DATE '2020-01-01' AS presented_at, map('source_entry_id', '1') AS metadata"
    )
    found = match_existing(records, ingest.empty_tables(spark)["initiatives"], "gaceta_diputados")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_costly_text_is_evaluated_once(spark):
    texts = spark.createDataFrame([('x [{"id":"1","tipo":"Iniciativa"}] y', "a")], "raw string, label string")
    rows = scans.embedded_rows(texts, F.regexp_replace("raw", "x ", "z "), "label")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(raw") == 1
    assert [(r["source_label"], r["row_index"], r["row"]["id"], r["error"]) for r in rows.collect()] == [("a", 0, "1", None)]
