"""Projections of the driver tables onto the legislative model.

One text per view, valid in Spark SQL and in DuckDB, so a query and its check start from the
same rows. In Spark each ``FROM`` name becomes a scan of the Parquet file.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {
    "st_sources": """
SELECT r_regionkey AS source_id,
       CASE r_regionkey WHEN 0 THEN 'sil' WHEN 1 THEN 'gaceta_diputados' WHEN 2 THEN 'gaceta_senado'
                        WHEN 3 THEN 'senado_transparencia' ELSE 'manual' END AS system,
       CASE r_regionkey WHEN 0 THEN 10 WHEN 1 THEN 20 WHEN 2 THEN 20 WHEN 3 THEN 30 ELSE 100 END AS priority
FROM region""",
    "st_source_records": """
SELECT s_suppkey AS source_record_id, n_regionkey AS source_id, 'initiative_html' AS record_type,
       concat('local://', s_name) AS source_url
FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "st_initiatives": """
SELECT o_orderkey AS id, concat('Que reforma la Ley de ', p_name) AS canonical_title,
       lower(concat('Que reforma la Ley de ', p_name)) AS title_normalized,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS presented_at,
       CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' WHEN o_orderstatus = 'O' THEN 'presented'
            WHEN o_orderstatus = 'P' THEN 'in_commissions' ELSE 'approved_origin' END AS normalized_status,
       CASE o_orderkey % 3 WHEN 0 THEN 'diputados' WHEN 1 THEN 'senado' ELSE NULL END AS originating_chamber,
       CASE o_orderkey % 5 WHEN 0 THEN 'Cámara de Diputados.'
            WHEN 1 THEN 'Comisiones Unidas de Gobernación; de Derechos Humanos y de Estudios Legislativos, Segunda.'
            WHEN 2 THEN 'Salud (Coordinadora) <br>Estudios Legislativos (Comisiones Unidas) <br>'
            WHEN 3 THEN NULL ELSE 'Justicia' END AS comision_turno,
       CASE WHEN o_orderkey % 2 = 0 THEN 'sil-results-table-v1' ELSE 'senado-transparencia-json-v1' END AS parser,
       o_orderdate AS created_at
FROM orders JOIN part ON p_partkey = o_orderkey % 200""",
    "st_events": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS event_id,
       l_orderkey AS initiative_id,
       CASE l_linenumber WHEN 1 THEN 'presentation' WHEN 2 THEN 'gaceta_publication' WHEN 3 THEN 'turn_to_commission'
            WHEN 4 THEN 'commission_opinion' WHEN 5 THEN 'approved_origin' WHEN 6 THEN 'dof_publication' ELSE 'other' END AS event_type,
       CASE l_linenumber WHEN 1 THEN 'presented' WHEN 2 THEN 'presented' WHEN 3 THEN 'in_commissions'
            WHEN 4 THEN 'opinion_issued' WHEN 5 THEN 'approved_origin' WHEN 6 THEN 'published_dof' ELSE 'unknown' END AS normalized_status_after,
       l_shipdate AS event_date
FROM lineitem""",
    "st_source_links": """
SELECT concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_suppkey AS STRING), '-', CAST(l_partkey AS STRING)) AS link_id,
       l_orderkey AS initiative_id, l_suppkey AS source_record_id,
       CASE WHEN l_returnflag = 'A' THEN 'Aprobada' WHEN l_returnflag = 'R' THEN 'Pendiente' ELSE NULL END AS source_status,
       CAST(1 - l_discount AS DECIMAL(4,3)) AS confidence, l_linenumber = 1 AS is_primary
FROM lineitem""",
    "st_authors": """
SELECT c_custkey AS id,
       CASE c_custkey % 3 WHEN 0 THEN concat('José Núñez ', w) WHEN 1 THEN concat('Sen. José Núñez ', w)
            ELSE concat('Jose Nunez ', w, ', PVEM') END AS full_name,
       CASE c_custkey % 3 WHEN 0 THEN concat('jose nunez ', w) WHEN 1 THEN concat('sen. jose nunez ', w)
            ELSE concat('jose nunez ', w, ', pvem') END AS name_normalized,
       CASE WHEN g % 2 = 0 THEN 'senado' ELSE 'diputados' END AS chamber
FROM (SELECT c_custkey, CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS g,
             translate(CAST(CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS STRING), '0123456789', 'bcdfghjkmn') AS w
      FROM customer) c""",
    "st_initiative_authors": """
SELECT o_orderkey AS initiative_id, o_custkey AS author_id, 'primary' AS role, 1 AS sort_order FROM orders""",
    # Signature texts, dates in words and status texts, spelled from the columns of orders.
    "st_record_texts": """
SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day,
       concat(CAST(day(o_orderdate) AS STRING), ' de ',
              CASE month(o_orderdate) WHEN 1 THEN 'enero' WHEN 2 THEN 'febrero' WHEN 3 THEN 'marzo'
                   WHEN 4 THEN 'abril' WHEN 5 THEN 'mayo' WHEN 6 THEN 'junio' WHEN 7 THEN 'julio'
                   WHEN 8 THEN 'agosto' WHEN 9 THEN 'septiembre' WHEN 10 THEN 'octubre'
                   WHEN 11 THEN 'noviembre' ELSE 'diciembre' END,
              ' de ', CAST(year(o_orderdate) AS STRING)) AS long_day,
       concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '-',
              CASE month(o_orderdate) WHEN 1 THEN 'ENE' WHEN 2 THEN 'FEB' WHEN 3 THEN 'MAR' WHEN 4 THEN 'ABR'
                   WHEN 5 THEN 'MAY' WHEN 6 THEN 'JUN' WHEN 7 THEN 'JUL' WHEN 8 THEN 'AGO' WHEN 9 THEN 'SEP'
                   WHEN 10 THEN 'OCT' WHEN 11 THEN 'NOV' ELSE 'DIC' END,
              '-', CAST(year(o_orderdate) AS STRING)) AS short_day,
       concat(CAST(day(o_orderdate) AS STRING), '/', CAST(month(o_orderdate) AS STRING), '/',
              CAST(year(o_orderdate) AS STRING)) AS slash_day,
       concat('Ana ', w) AS first_name, concat('Benito ', w, ' Ruiz') AS second_name,
       concat('Carla Peña ', w) AS third_name, title
FROM (SELECT o_orderkey, o_orderdate, concat('Que reforma la Ley de ', p_name) AS title,
             concat('Q', translate(CAST(o_custkey AS STRING), '0123456789', 'bdfghjkqvz')) AS w
      FROM orders JOIN part ON p_partkey = o_orderkey % 200) o""",
}

_TABLE_POSITION = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(BASE_TABLES) + r")\b", re.IGNORECASE)


def stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A staging view over the Parquet files of a folder."""
    text = VIEWS[name]
    return spark.sql(_TABLE_POSITION.sub(rf"\1 parquet.`{folder}/\2.parquet` AS \2", text))


def with_views(query: str) -> str:
    """A query text preceded by the staging views it names."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", query)]
    if not used:
        return query
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in used)
    body = query.strip()
    if body[:5].upper() == "WITH ":
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
