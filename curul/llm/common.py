"""Shared pieces of the training-data operators: table access, scratch tables, bounded sizes."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curul.session import shared_folder, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(check: str | None = None) -> Callable[[Query], Query]:
    """Register a query of this subpackage under its function name."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(tune(spark), folder)

        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if check:
            CHECKS[fn.__name__] = check
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``: other columns, whatever their names, never meet an operator's own."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Scratch:
    """Tables of one run below the cluster's shared folder, written once and dropped together.

    Parquet tables in a shared folder outlive any executor. ``drop`` is called when nothing lazy
    reads them any more; a result that must stay readable is cut with ``kept``, whose files Spark
    removes with the plan that owns them.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/curul-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str | None = None) -> DataFrame:
        path = f"{self.root}/{name or uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def kept(self, df: DataFrame) -> DataFrame:
        context = self.spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(shared_folder(self.spark))
        return df.checkpoint(eager=True)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def running(rows: DataFrame, amount: Column, order: Column, group: list[str] | None = None, name: str = "before", per_bucket: int = 20_000) -> DataFrame:
    """``name``: the sum of ``amount`` over the rows before this one in its group, without one task per group.

    A group is dealt into hash buckets of ``order``; a bucket starts at the sum of the buckets before
    it, and rows are summed inside their bucket only. The number of buckets follows the row count,
    so a group with a third of all rows spreads over the cluster.
    """
    group = group or []
    buckets = max(1, rows.count() // per_bucket)
    dealt = rows.withColumns({"_bucket": F.pmod(F.xxhash64(order), F.lit(buckets)), "_amount": amount, "_order": order})
    # One row per bucket: a group's window has as many rows as there are buckets.
    earlier = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_bucket").agg(F.sum("_amount").alias("_sum"))
    starts = sums.select(*group, "_bucket", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    inside = W.partitionBy(*group, "_bucket").orderBy("_order").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("_inside", F.coalesce(F.sum("_amount").over(inside), F.lit(0))).join(starts, [*group, "_bucket"])
    return placed.withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_amount", "_order", "_start", "_inside")
