"""Staging views with the extra columns the operators read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions.commissions import raw_commission_text
from curul.functions.text import metadata_text
from curul.operators.links import ranked_links
from curul.operators.repairs import commission_assignments
from curul.sources.staging import stage

RUN_TS = "2026-01-01 00:00:00"
RUN_DATE = "2026-01-01"


def initiatives(spark: SparkSession, folder: str) -> DataFrame:
    """Initiatives with metadata and what the audit reads from it."""
    rows = stage(spark, folder, "st_initiatives")
    proponent = F.when(F.col("parser") == "senado-transparencia-json-v1", F.lit("Sen. Ana Ruiz"))
    metadata = F.map_filter(
        F.create_map(
            F.lit("parser"), F.col("parser"),
            F.lit("comision_turno"), F.col("comision_turno"),
            F.lit("cargo_proponente"), proponent,
        ),
        lambda _, v: v.isNotNull(),
    )
    authors = F.coalesce(*[metadata_text("metadata", k) for k in ("senadores_raw", "cargo_proponente", "authors_raw")])
    return (
        rows.withColumn("metadata", metadata)
        .withColumn("raw_commissions", raw_commission_text("metadata"))
        .withColumn("has_raw_authors", authors.isNotNull())
    )


def events(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "st_events")


def authors(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "st_authors")


def relations(spark: SparkSession, folder: str) -> DataFrame:
    return stage(spark, folder, "st_initiative_authors")


def links(spark: SparkSession, folder: str, inner: bool = False) -> DataFrame:
    """Source links with the system and priority of their source."""
    return ranked_links(
        stage(spark, folder, "st_source_links"),
        stage(spark, folder, "st_source_records"),
        stage(spark, folder, "st_sources"),
        inner=inner,
    )


def senate_assignments(spark: SparkSession, folder: str) -> DataFrame:
    """Commission assignments of the senate's initiatives."""
    return commission_assignments(initiatives(spark, folder).filter(F.col("originating_chamber") == "senado"))
