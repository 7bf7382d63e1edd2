"""Report sinks: written from Spark, read back as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class BlockersFound(Exception):
    """Raised when a scorecard that must pass has failing checks."""


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Write a report to a new folder; an existing one is never overwritten."""
    df.write.mode("error").format(fmt).save(path)


def read_report(spark: SparkSession, path: str, schema: str, fmt: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(fmt).load(path)


def require_no_blockers(checks: DataFrame) -> DataFrame:
    """Stop when a check failed; there are seven."""
    failed = [r.key for r in checks.filter(F.col("status") == "fail").orderBy("position").collect()]  # of seven
    if failed:
        raise BlockersFound(", ".join(failed))
    return checks


def with_threshold(plans: DataFrame, min_confidence: float = 0.9) -> DataFrame:
    """Plans of a report that are certain enough to apply."""
    return plans.filter(F.col("confidence") >= F.lit(min_confidence))
