"""Incremental loading: pages that arrive in a landing folder, one snapshot per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from curul.functions.text import sha256
from curul.plans import ingest
from curul.schema import PAGE
from curul.sources.scans import seed_sources

#: A state store that keeps its keys on disk instead of in the executors' memory.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed_pages(
    spark: SparkSession, folder: str, schema: StructType = PAGE, pattern: str = "*.parquet", files_per_batch: int = 1000
) -> DataFrame:
    """Pages of a landing folder as a stream."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def distinct_pages(pages: DataFrame) -> DataFrame:
    """Each (address, content) once, however late it comes.

    What has been seen is keyed state on disk, in the checkpoint folder: two values a page, never dropped.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return pages.withColumn("content_hash", sha256("html")).dropDuplicates(["url", "content_hash"])


class Snapshots:
    """Versions of the tables below one folder. Batch n reads version n and writes version n + 1.

    A batch that is run again reads the same version and writes the same one, so a restart
    neither loses nor doubles anything, and the version being read is never overwritten.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, version: int, table: str) -> str:
        return f"{self.folder}/v{version:08d}/{table}"

    def read(self, version: int) -> dict[str, DataFrame]:
        if version == 0:
            tables = ingest.empty_tables(self.spark)
            tables["sources"] = seed_sources(self.spark).select("id", "system", "name", "base_url", "priority")
            return tables
        return {
            name: self.spark.read.schema(schema).parquet(self.path(version, name))
            for name, schema in ingest.TABLES.items()
        }

    def write(self, version: int, tables: dict[str, DataFrame]) -> None:
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(self.path(version, name))


def stream_source(
    pages: DataFrame,
    source: str,
    snapshots: Snapshots,
    checkpoint: str,
    run_ts: str,
    read: Callable[[DataFrame, str], tuple[DataFrame, DataFrame]] = ingest.read,
) -> StreamingQuery:
    """Load every new page of a source, batch by batch, until the landing folder is read; rejected pages go to their own table."""

    def process(batch: DataFrame, batch_id: int) -> None:
        records, rejected = read(batch, source)
        tables, _ = ingest.load(records, snapshots.read(batch_id), source, run_ts, rejected)
        snapshots.write(batch_id + 1, tables)

    return (
        distinct_pages(pages)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
