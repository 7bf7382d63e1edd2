"""Sources: tables, stored pages, JSON dumps and the seed table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curul.functions.text import as_col, normalize_text, row_id
from curul.functions.urls import local_file_url
from curul.operators.keyed import bound
from curul.schema import SOURCES_SEED

# --- fixed values: fields of the two JSON dumps (the misspelt title field is the source's own) --
TRANSPARENCY_FIELDS = (
    "legislatura",
    "duracion_legislatura",
    "anio_legislativo",
    "periodo_sesiones",
    "inicio_periodo",
    "fin_periodo",
    "num_sesion",
    "num_gaceta",
    "fecha_documento",
    "tipo_documento",
    "titulo_docuemnto",
    "organo",
    "cargo_proponente",
    "link_documento",
    "comision_turno",
    "tema_documento",
    "prorroga",
    "sentido_dictamen",
    "fecha_dictamen",
    "link_dictamen",
    "nota",
)
OPEN_DATA_FIELDS = (
    "id",
    "titulo",
    "fecha_presentacion",
    "sentido_dictamen",
    "url_gaceta",
    "estado",
    "sintesis",
    "legislatura",
    "senadores",
    "comisiones",
    "leyes_modifica",
    "tipo",
    "camara_origen",
    "fecha_aprobacion",
)
# --- end of fixed values ----------------------------------------------------------------------


def _text_row(fields: tuple[str, ...]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in fields])


TRANSPARENCY_ROW = _text_row(TRANSPARENCY_FIELDS)
OPEN_DATA_ROW = _text_row(OPEN_DATA_FIELDS)


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Scan a table, reading only the columns asked for."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def page_files(spark: SparkSession, folder: str, pattern: str = "*.html") -> DataFrame:
    """Stored pages, one file each, with the address told by the file name."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(folder)
    return files.select(
        local_file_url(F.col("_metadata.file_path")).alias("url"),
        F.col("value").alias("html"),
        F.col("_metadata.file_modification_time").alias("fetched_at"),
        F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("parent_url"),
        F.lit(None).cast("string").alias("session_date"),
    )


def _kept(rows: Column, keep: Callable[[Column], Column] | None) -> Column:
    return rows if keep is None else F.filter(rows, keep)


def json_envelopes(
    spark: SparkSession,
    path: str,
    row: T.StructType = TRANSPARENCY_ROW,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rows of ``{identificadores, data: [...]}`` files with the file's address and row number."""
    schema = T.StructType([T.StructField("data", T.ArrayType(row))])
    files = spark.read.schema(schema).option("multiLine", True).json(path)
    return files.select(
        F.col("_metadata.file_path").alias("source_json_url"),
        F.posexplode(_kept(F.col("data"), keep)).alias("row_index", "row"),
    )


def envelope_rows(
    df: DataFrame,
    text: Column | str,
    url: Column | str,
    row: T.StructType = TRANSPARENCY_ROW,
    keep: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """The same from a table that holds one envelope text per row."""
    schema = T.StructType([T.StructField("data", T.ArrayType(row))])
    return df.select(
        as_col(url).alias("source_json_url"),
        F.posexplode(_kept(F.from_json(as_col(text), schema).getField("data"), keep)).alias("row_index", "row"),
    )


def envelope_error(text: Column | str, row: T.StructType = TRANSPARENCY_ROW) -> Column:
    """Why an envelope text cannot be read: it is no valid JSON, or has no ``data``."""
    schema = T.StructType([T.StructField("data", T.ArrayType(row)), T.StructField("_broken", T.StringType())])
    parsed = F.from_json(as_col(text), schema, {"columnNameOfCorruptRecord": "_broken"})
    return F.when(parsed.isNull() | parsed["_broken"].isNotNull(), "no valid JSON").when(parsed["data"].isNull(), "no data")


def embedded_error(text: Column | str) -> Column:
    """Why no JSON array can be read from a text."""
    body = as_col(text)
    start, last = F.instr(body, "[{"), F.instr(F.reverse(body), "]}")
    payload = body.substr(start, F.length(body) - last - start + 2)
    return F.when((start == 0) | (last == 0), "no JSON array").when(F.try_parse_json(payload).isNull(), "no valid JSON")


def embedded_rows(
    df: DataFrame,
    text: Column | str,
    label: Column | str,
    row: T.StructType = OPEN_DATA_ROW,
    strict: bool = False,
) -> DataFrame:
    """Initiative rows of a JSON array inside other text: from the first ``[{`` to the last ``}]``.

    A text without such bounds, or whose array is no valid JSON, yields one row with ``error``
    set; ``strict`` stops instead.
    """
    # The text may be a costly expression and its rows are asked for several times: each step is evaluated once.
    held = bound(df.select(as_col(label).alias("source_label"), as_col(text).alias("_given")), _body=F.col("_given")).drop("_given")
    start = F.instr("_body", "[{")
    end = F.length("_body") - F.instr(F.reverse("_body"), "]}")
    bounded = (start > 0) & (F.instr(F.reverse("_body"), "]}") > 0)
    held = bound(held, _payload=F.when(bounded, F.col("_body").substr(start, end - start + 2))).drop("_body")
    # Permissive parsing turns a broken array into one record of nulls, so validity is asked apart.
    payload = F.col("_payload")
    parsed = F.when(F.try_parse_json(payload).isNotNull(), F.from_json(payload, T.ArrayType(row)))
    message = F.concat(F.lit("no JSON array in "), F.col("source_label"))
    if strict:
        parsed = F.coalesce(parsed, F.raise_error(message).cast(T.ArrayType(row)))
    held = bound(held, _parsed=parsed)
    rows = F.filter("_parsed", lambda r: normalize_text(F.coalesce(r["tipo"], F.lit(""))) == "iniciativa")
    return (
        held.select("source_label", rows.alias("rows"), F.when(F.col("_parsed").isNull(), message).alias("error"))
        .select("source_label", "error", F.posexplode_outer("rows").alias("row_index", "row"))
        .filter(F.col("row").isNotNull() | F.col("error").isNotNull())
    )


def seed_sources(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The five reference sources; a system that is already there stays as it is."""
    seed = spark.createDataFrame(
        list(SOURCES_SEED), "system string, name string, base_url string, priority int"
    ).withColumn("id", row_id("system"))
    if existing is None:
        return seed
    fresh = seed.join(existing.select("system"), "system", "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))
