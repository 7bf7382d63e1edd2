"""Extraction over the stored pages, JSON texts, incremental reading."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions.text import word_xml_text
from curul.operators import extraction
from curul.operators.keyed import spread
from curul.plans import ingest, staged
from curul.plans.registry import query, sql_norm
from curul.session import shared_folder
from curul.sources import scans
from curul.sources.scans import table
from curul.sources.staging import stage
from curul.streaming.landing import distinct_pages, landed_pages


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages", "page_id", "url", "html")


LINKS_SQL = """
anchors AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=[^>]*>.*?</a>')) AS a,
   generate_subscripts(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=[^>]*>.*?</a>'), 1) - 1 AS place FROM pages),
hrefs AS (SELECT page_id, page_url, place, replace(regexp_extract(a, '(?is)href\\s*=\\s*"([^"]*)"', 1), '&amp;', '&') AS href,
   trim(regexp_replace(regexp_replace(a, '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')) AS label FROM anchors),
links AS (SELECT *, CASE WHEN href LIKE 'http%' THEN regexp_replace(href, '#.*$', '') WHEN href LIKE '/%' THEN concat(regexp_extract(page_url, '^(https?://[^/?]*)', 1), regexp_replace(href, '#.*$', '')) END AS url
  FROM hrefs WHERE href <> '' AND href NOT LIKE '#%' AND lower(href) NOT LIKE 'javascript:%')"""


@query(f"WITH {LINKS_SQL} SELECT page_id, CAST(place AS INTEGER) AS place, href, label, url FROM links")
def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links of all pages, resolved against their page."""
    return extraction.page_links(pages(spark, folder), "page_id").select("page_id", "place", "href", "label", "url")


# A staged site: the lower chamber's host, in which a link with a number leads to a detail page.
SITE_SQL = LINKS_SQL + """,
site AS (SELECT page_id, place, label, concat('https://gaceta.diputados.gob.mx', href) AS url FROM links WHERE href LIKE '/%'),
kinds AS (SELECT *, CASE WHEN regexp_matches(url, 'gaceta/iniciativas/\\d+/|gp\\d+_a', 'i') OR regexp_matches(label, '^que\\s+', 'i') THEN 'detail'
   WHEN regexp_matches(label, 'legislatura|iniciativas', 'i') THEN 'index' END AS kind FROM site)"""


@query(
    f"WITH {SITE_SQL.replace('FROM site)', '''FROM (SELECT page_id, place, url, CASE WHEN place % 3 = 0 THEN concat('Que ', label) WHEN place % 3 = 1 THEN concat(label, ' Iniciativas') ELSE label END AS label FROM site) s)''')}"
    " SELECT page_id, CAST(place AS INTEGER) AS place, kind FROM kinds WHERE kind IS NOT NULL"
)
def page_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of the pages that links of a site lead to."""
    links = extraction.page_links(pages(spark, folder), "page_id").filter(F.col("href").startswith("/"))
    turn = F.col("place") % 3
    label = F.when(turn == 0, F.concat(F.lit("Que "), "label")).when(turn == 1, F.concat("label", F.lit(" Iniciativas")))
    site = links.withColumn("url", F.concat(F.lit("https://gaceta.diputados.gob.mx"), "href")).withColumn(
        "label", F.coalesce(label, F.col("label"))
    )
    return extraction.classified_links(site, "gaceta_diputados").select("page_id", "place", "kind")


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, edges AS (SELECT DISTINCT page_url, url FROM links WHERE url IS NOT NULL
   UNION SELECT url, concat(url, '/next') FROM pages), walk(url, depth) AS (SELECT url, 0 FROM pages WHERE page_id % 2 = 0
   UNION SELECT e.url, w.depth + 1 FROM walk w JOIN edges e ON e.page_url = w.url WHERE w.depth < 2)
 SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1"""
)
def reachable_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages within two links of the seeds."""
    rows = pages(spark, folder)
    links = extraction.page_links(rows).select("page_url", "url")
    onward = rows.select(F.col("url").alias("page_url"), F.concat("url", F.lit("/next")).alias("url"))
    seeds = rows.filter(F.col("page_id") % 2 == 0)
    return extraction.reachable_pages(links.unionByName(onward), seeds, max_depth=2)


@query(
    f"""WITH RECURSIVE {LINKS_SQL}, edges AS (SELECT DISTINCT page_url, url FROM links WHERE url IS NOT NULL
   UNION SELECT url, concat(url, '/next') FROM pages), walk(url, depth) AS (SELECT url, 0 FROM pages
   UNION SELECT e.url, w.depth + 1 FROM walk w JOIN edges e ON e.page_url = w.url WHERE w.depth < 6)
 SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY 1"""
)
def reachable_closure(spark: SparkSession, folder: str) -> DataFrame:
    """All pages as seeds, links followed until nothing new is met."""
    rows = pages(spark, folder)
    links = extraction.page_links(rows).select("page_url", "url")
    onward = rows.select(F.col("url").alias("page_url"), F.concat("url", F.lit("/next")).alias("url"))
    return extraction.reachable_pages(links.unionByName(onward), rows)


@query()
def page_elements(spark: SparkSession, folder: str) -> DataFrame:
    """Elements per page and tag."""
    rows = extraction.elements_of(pages(spark, folder), fields="text")
    return rows.select("page_id", F.explode("elements").alias("e")).groupBy("page_id", "e.tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("e.text")).alias("n_chars")
    )


@query()
def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """One generic record per page with a title."""
    rows = extraction.generic_records(pages(spark, folder))
    return rows.select("source_url", "title", "title_normalized", "description", "dedupe_hash")


@query()
def page_details(spark: SparkSession, folder: str) -> DataFrame:
    rows = extraction.detail_records(pages(spark, folder))
    return rows.select("source_url", "title", "description", F.map_keys("metadata").alias("metadata_keys"))


# Staged popup pages: labels in table rows, terms and spoken form, built from orders.


def popup_pages(spark: SparkSession, folder: str) -> DataFrame:
    c, lit, text = F.concat, F.lit, F.col("id").cast("string")
    html = c(
        lit("<html><head><title>PopUp Contenido Asuntos</title></head><body><table><tr><th>Título</th><td>"), "title", lit(" del detalle "), text,
        lit("</td></tr><tr><td>Fecha de presentación</td><td>"), "slash_day",
        lit("</td></tr></table><dl><dt>Promovente</dt><dd>"), "first_name", lit("; "), "second_name",
        lit("</dd></dl><p>Sinopsis: Texto "), "third_name", lit("</p><span>Materia: Salud</span></body></html>"),
    )
    return spread(stage(spark, folder, "st_record_texts"), "id").select(
        "id",
        c(lit("https://sil.gobernacion.gob.mx/Librerias/pp_ContenidoAsuntos.php?Clave="), text).alias("url"),
        html.alias("html"),
    )


POPUP_SQL = "concat(title, ' del detalle ', id)"


@query(
    f"""WITH f AS (SELECT id, 0 AS place, 'title' AS field, {POPUP_SQL} AS value FROM st_record_texts UNION ALL SELECT id, 1, 'presentation_date', slash_day FROM st_record_texts
 UNION ALL SELECT id, 2, 'authors', concat(first_name, '; ', second_name) FROM st_record_texts UNION ALL SELECT id, 3, 'description', concat('Texto ', third_name) FROM st_record_texts
 UNION ALL SELECT id, 4, 'topic', 'Salud' FROM st_record_texts) SELECT id, CAST(place AS INTEGER) AS place, field, value FROM f"""
)
def page_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled values of popup pages."""
    return extraction.field_rows(popup_pages(spark, folder), "id", detail=True)


@query(
    f"""SELECT {POPUP_SQL} AS title, concat(first_name, '|', second_name) AS authors, CAST(day AS VARCHAR) AS presentation_date, concat('Texto ', third_name) AS description, 'Salud' AS topic FROM st_record_texts"""
)
def popup_details(spark: SparkSession, folder: str) -> DataFrame:
    """Details of popup pages."""
    rows = extraction.detail_records(popup_pages(spark, folder))
    return rows.select(
        "title", F.array_join("authors", "|").alias("authors"), "presentation_date", "description", F.col("metadata")["topic"].alias("topic")
    )


@query(
    f"""SELECT sha256(concat({sql_norm("concat(title, ' ', id)")}, '|', CAST(day AS VARCHAR))) AS dedupe_hash, {POPUP_SQL} AS title, 'Pendiente en Comisión' AS status_raw,
 CASE WHEN length(concat('Texto ', third_name)) > length(concat(title, ' ', id)) THEN concat('Texto ', third_name) ELSE concat(title, ' ', id) END AS description,
 'Salud' AS topic, concat('https://sil.gobernacion.gob.mx/Librerias/pp_ContenidoAsuntos.php?Clave=', id) AS detail_source_url FROM st_record_texts"""
)
def merged_details(spark: SparkSession, folder: str) -> DataFrame:
    """Results rows completed from their popup pages."""
    records = extraction.results_records(results_pages(spark, folder))
    rows = extraction.merge_details(records, extraction.detail_records(popup_pages(spark, folder)))
    meta = F.col("metadata")
    return rows.select(
        "dedupe_hash", "title", "status_raw", "description", meta["topic"].alias("topic"), meta["detail_source_url"].alias("detail_source_url")
    )


# Staged gazette pages: one list item per initiative, twenty to a page, built from orders.
GAZETTE_SQL = """
items AS (SELECT id, day, CAST(floor(id / 20) AS BIGINT) AS page, first_name, long_day, title,
  concat(title, ' y adiciona otra más, número ', id) AS full_title FROM st_record_texts)"""


def gazette_pages(spark: SparkSession, folder: str) -> DataFrame:
    c, lit = F.concat, F.lit
    item = c(
        lit("<li>"), "title", lit(" y adiciona otra más, número "), F.col("id").cast("string"),
        lit(".<br>Presentada por el diputado "), "first_name", lit(", PAN.<br>Turnada a la Comisión de Salud.<br>Gaceta Parlamentaria, número 7-"),
        F.col("id").cast("string"), lit(", del "), "long_day", lit(". ("), F.col("id").cast("string"), lit(")</li>"),
    )
    texts = spread(stage(spark, folder, "st_record_texts").withColumn("page", F.floor(F.col("id") / 20)), "page")
    rows = texts.select("id", "page", item.alias("item"))
    grouped = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "item"))).alias("items"))
    body = F.array_join(F.transform("items", lambda i: i["item"]), "\n")
    return grouped.select(
        c(lit("https://gaceta.diputados.gob.mx/Gaceta/Iniciativas/66/gp66_b_inis.html?p="), F.col("page").cast("string")).alias("url"),
        c(lit("<html><body><ul>"), body, lit("</ul></body></html>")).alias("html"),
        lit("2026-01-01 00:00:00").cast("timestamp").alias("fetched_at"),
    )


@query(
    f"""WITH {GAZETTE_SQL} SELECT concat('diputados:66:7-', id, ':', id) AS source_record_key, concat(full_title, '.') AS title, first_name AS authors,
 CAST(day AS VARCHAR) AS presentation_date, 'Turnada a la Comisión de Salud' AS status_raw, sha256(concat('diputados:66:7-', id, ':', id)) AS dedupe_hash,
 CAST(id AS VARCHAR) AS source_entry_id FROM items"""
)
def gazette_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the blocks of gazette list pages."""
    rows = extraction.chamber_list_records(gazette_pages(spark, folder))
    return rows.select(
        "source_record_key", "title", F.array_join("authors", "|").alias("authors"), "presentation_date", "status_raw",
        "dedupe_hash", F.col("metadata")["source_entry_id"].alias("source_entry_id"),
    )


@query(f"WITH {GAZETTE_SQL} SELECT page, count(*) AS blocks FROM items GROUP BY 1")
def page_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Initiative blocks per gazette page."""
    rows = extraction.block_rows(gazette_pages(spark, folder), "url")
    page = F.regexp_extract("url", r"p=(\d+)", 1).cast("long")
    return rows.groupBy(page.alias("page")).agg(F.count(F.lit(1)).alias("blocks"))


def results_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Results tables built from orders, twenty rows to a page."""
    c, lit, text = F.concat, F.lit, F.col("id").cast("string")
    cell = lambda *parts: c(lit("<td>"), *parts, lit("</td>"))
    row = c(
        lit('<tr><td><a href="javascript:void(0)" onclick="abrir(\'pp_ContenidoAsuntos.php?Clave='), text, lit("')\">"), text, lit("</a></td>"),
        cell(lit("Proposición")), cell("title", lit(" "), text), cell(lit("Senadores")), cell("slash_day"),
        cell("first_name", lit("; "), "second_name"), cell(lit("PAN")), cell(lit("LXVI")),
        cell(lit("1.- Comision de Salud 2.- Comision de Justicia")), cell(lit("Pendiente en Comisión")), cell(lit("Salud")), lit("</tr>"),
    )
    texts = spread(stage(spark, folder, "st_record_texts").withColumn("page", F.floor(F.col("id") / 20)), "page")
    rows = texts.select("id", "page", row.alias("row"))
    grouped = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "row"))).alias("rows"))
    return grouped.select(
        c(lit("https://sil.gobernacion.gob.mx/resultadosNumeraliaIniciativas.php?pagina="), F.col("page").cast("string")).alias("url"),
        c(lit("<table>"), F.array_join(F.transform("rows", lambda r: r["row"]), ""), lit("</table>")).alias("html"),
    )


@query(
    """SELECT concat(title, ' ', id) AS title, concat(first_name, '|', second_name) AS authors, CAST(day AS VARCHAR) AS presentation_date, 'Pendiente en Comisión' AS status_raw,
 'Senadores' AS chamber, 'Proposición' AS initiative_type, concat('https://sil.gobernacion.gob.mx/Librerias/pp_ContenidoAsuntos.php?Clave=', id) AS detail_url,
 '1.- Comision de Salud | 2.- Comision de Justicia' AS referred_to FROM st_record_texts"""
)
def results_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of results-table rows."""
    rows = extraction.results_records(results_pages(spark, folder))
    return rows.select(
        "title", F.array_join("authors", "|").alias("authors"), "presentation_date", "status_raw", "chamber", "initiative_type",
        F.col("metadata")["detail_url"].alias("detail_url"), F.col("metadata")["referred_to"].alias("referred_to"),
    )


def senate_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Senate documents built from orders, one entry each."""
    c, lit, text = F.concat, F.lit, F.col("id").cast("string")
    html = c(
        lit("<html><body>"), "long_day", lit(" / Gaceta: LXVI/2SPO-"), text, lit("\nINICIATIVAS:\nDe las senadoras y de los senadores "),
        "first_name", lit(", "), "second_name", lit(" y "), "third_name",
        lit(", del Grupo Parlamentario del Partido Verde, con proyecto de decreto por el que se reforma la Ley "), text,
        lit(".\nPROPOSICIONES: otra</body></html>"),
    )
    return spread(stage(spark, folder, "st_record_texts"), "id").select(
        c(lit("https://www.senado.gob.mx/66/gaceta_del_senado/documento/"), text).alias("url"), html.alias("html")
    )


@query(
    """SELECT concat('senado:documento:', id, ':entrada:0') AS source_record_key, concat('Por el que se reforma la Ley ', id) AS title,
 concat(first_name, '|', second_name, '|', third_name) AS authors, CAST(day AS VARCHAR) AS presentation_date, concat('LXVI/2SPO-', id) AS issue FROM st_record_texts"""
)
def senate_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of senate gazette documents."""
    rows = extraction.senate_records(senate_pages(spark, folder))
    return rows.select(
        "source_record_key", "title", F.array_join("authors", "|").alias("authors"), "presentation_date",
        F.col("metadata")["gaceta_issue_number"].alias("issue"),
    )


@query("SELECT page_id, sha256(html) AS content_hash FROM pages")
def unparsed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages without results rows, kept with their hash."""
    rows = pages(spark, folder)
    return extraction.unparsed_pages(rows, extraction.results_records(rows), "page_id").select("page_id", "content_hash")


# ---- JSON texts ------------------------------------------------------------------------------


def open_data_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Word-processing XML texts around JSON arrays, two rows each, only one an initiative."""
    c, lit, text = F.concat, F.lit, F.col("id").cast("string")
    row = lambda kind: F.to_json(
        F.struct(
            text.alias("id"), F.col("title").alias("titulo"), F.col("day").cast("string").alias("fecha_presentacion"),
            c("first_name", lit(" (PT)<br>"), "second_name", lit(" (PAN)<br>")).alias("senadores"),
            lit("Pendiente").alias("estado"), text.alias("url_gaceta"), lit(kind).alias("tipo"),
        )
    )
    payload = c(lit("Datos ["), row("Iniciativa"), lit(","), row("proposición"), lit("] fin"))
    xml = c(lit("<w:body><w:t>"), F.replace(F.replace(payload, F.lit("<"), F.lit("&lt;")), F.lit('"titulo"'), F.lit('</w:t><w:r/><w:t xml:space="preserve">"titulo"')), lit("</w:t></w:body>"))
    return stage(spark, folder, "st_record_texts").select("id", xml.alias("xml"))


@query(
    """SELECT concat('senado_datos_abiertos:https://www.senado.gob.mx/66/gaceta_del_senado/documento/', id) AS source_record_key, title,
 concat(first_name, '|', second_name) AS authors, CAST(day AS VARCHAR) AS presentation_date, 'Pendiente' AS status_raw FROM st_record_texts"""
)
def open_data_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON arrays embedded in document texts."""
    texts = open_data_texts(spark, folder).withColumn("text", word_xml_text("xml"))
    rows = scans.embedded_rows(texts, "text", F.col("id").cast("string"))
    return extraction.open_data_records(rows).select(
        "source_record_key", "title", F.array_join("authors", "|").alias("authors"), "presentation_date", "status_raw"
    )


@query(
    """SELECT concat('senado_transparencia:https://doc/', id) AS source_record_key, title, concat(first_name, '|', second_name) AS authors,
 CAST(day AS VARCHAR) AS presentation_date, 'Iniciativa' AS initiative_type, '1998' AS source_year FROM st_record_texts WHERE id % 3 > 0"""
)
def transparency_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records of JSON envelopes, one envelope per order; other bodies' rows are left out."""
    c, lit = F.concat, F.lit
    row = F.struct(
        lit("Iniciativa").alias("tipo_documento"),
        c("title", lit(".")).alias("titulo_docuemnto"),
        F.date_format("day", "dd/MM/yyyy").alias("fecha_documento"),
        F.when(F.col("id") % 3 > 0, "Cámara de Senadores").otherwise("Congreso").alias("organo"),
        c(lit("Sen. "), "first_name", lit(" y Sen. "), "second_name", lit(". PRI")).alias("cargo_proponente"),
        c(lit("https://doc/"), F.col("id").cast("string")).alias("link_documento"),
    )
    texts = stage(spark, folder, "st_record_texts").select(
        c(lit('{"identificadores":{},"data":['), F.to_json(row), lit("]}")).alias("text")
    )
    rows = scans.envelope_rows(
        texts, "text", lit("https://h/iniciativas_proposiciones_1998.json"), keep=extraction.is_senate_initiative
    )
    return extraction.transparency_records(rows).select(
        "source_record_key", "title", F.array_join("authors", "|").alias("authors"), "presentation_date", "initiative_type",
        F.col("metadata")["source_year"].alias("source_year"),
    )


# ---- incremental -----------------------------------------------------------------------------


@query("SELECT DISTINCT url, sha256(html) AS content_hash FROM pages")
def stream_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The pages table read as a stream, each (address, content) once."""
    work = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "pages").schema
    # A pattern, as a stream takes a path without one for a folder: the table may be one file or a folder of files.
    stream = landed_pages(spark, f"{folder}/pages.parque[t]", schema).withColumn(
        "fetched_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id"))
    )
    run = (
        distinct_pages(stream)
        .select("url", "content_hash")
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{work}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{work}/pages")
    )
    run.awaitTermination()
    return spark.read.schema("url string, content_hash string").parquet(f"{work}/pages")


# ---- discovery and loading -------------------------------------------------------------------


@query(
    """SELECT DISTINCT concat('resultados::1:', greatest(1, id * 3 + o), ':1') AS page_key,
 concat('https://sil.gobernacion.gob.mx/resultadosNumeraliaIniciativas.php?Serial=1&Reg=', greatest(1, id * 3 + o), '&pagina=1&Paginas=15') AS url
 FROM st_record_texts, (VALUES (0), (1), (2), (3), (4)) w(o)"""
)
def seed_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Seeds widened by the next record numbers, one address per results page."""
    base = F.lit("https://sil.gobernacion.gob.mx/resultadosNumeraliaIniciativas.php?Serial=1&Reg=")
    seeds = stage(spark, folder, "st_record_texts").select(F.concat(base, (F.col("id") * 3).cast("string")).alias("url"))
    return extraction.seed_pages(seeds).select("page_key", "url")


@query(
    """SELECT concat('http://www.senado.gob.mx/66/gaceta_del_senado/documento/', id) AS url, concat(title, ' ', id, '.') AS title_hint,
 CAST(day AS VARCHAR) AS session_date FROM st_record_texts"""
)
def session_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents linked from session pages, one session per order."""
    c, lit, text = F.concat, F.lit, F.col("id").cast("string")
    html = c(
        lit("<html><body><h1>Sesión del "), "long_day", lit(' </h1><ul><li><a href="/66/gaceta_del_senado/documento/'), text,
        lit('">Ver</a> '), "title", lit(" "), text, lit('. Se turnó a Salud</li><li><a href="/66/otra/1">Que nada</a></li></ul></body></html>'),
    )
    sessions = stage(spark, folder, "st_record_texts").select(
        c(lit("http://www.senado.gob.mx/66/gaceta_del_senado/s/"), text).alias("url"), html.alias("html")
    )
    return extraction.session_documents(sessions).select("url", "title_hint", "session_date")


@query(
    f"""WITH {GAZETTE_SQL} SELECT concat('diputados:66:7-', id, ':', id) AS source_record_key, concat(full_title, '.') AS canonical_title,
 'in_commissions' AS normalized_status, day AS presented_at, 'diputados' AS originating_chamber, CAST(1 AS BIGINT) AS links, CAST(1 AS BIGINT) AS primaries,
 CAST(3 AS BIGINT) AS events FROM items"""
)
def loaded_gazette(spark: SparkSession, folder: str) -> DataFrame:
    """Gazette pages parsed and loaded into empty tables: initiatives with their links and events."""
    source = "gaceta_diputados"
    tables = ingest.empty_tables(spark)
    tables["sources"] = scans.seed_sources(spark).select("id", "system", "name", "base_url", "priority")
    out, _ = ingest.load(ingest.parse(gazette_pages(spark, folder), source), tables, source, staged.RUN_TS)
    links = out["initiative_source_links"].groupBy(F.col("initiative_id").alias("id")).agg(
        F.count(F.lit(1)).alias("links"), F.count_if("is_primary").alias("primaries")
    )
    events = out["legislative_events"].groupBy(F.col("initiative_id").alias("id")).agg(F.count(F.lit(1)).alias("events"))
    return (
        out["initiatives"].join(links, "id").join(events, "id")
        .select(
            F.col("metadata")["source_record_key"].alias("source_record_key"), "canonical_title", "normalized_status",
            "presented_at", "originating_chamber", "links", "primaries", "events",
        )
    )
