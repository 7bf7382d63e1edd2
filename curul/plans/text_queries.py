"""Text, name, date, commission and status columns over the driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions import commissions, dates, names, status, text
from curul.operators import chat, documents as document_ops
from curul.operators.keyed import spread
from curul.plans import staged
from curul.plans.registry import query, sql_norm
from curul.sources.scans import table
from curul.sources.staging import stage


@query(
    f"SELECT doc_id, sha256({sql_norm('text')}) AS normalized_hash, length({sql_norm('text')}) AS normalized_length FROM documents"
)
def normalized_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Comparison form of whole documents."""
    rows = table(spark, folder, "documents", "doc_id", "text").select("doc_id", text.normalize_text("text").alias("n"))
    return rows.select(
        "doc_id", text.sha256("n").alias("normalized_hash"), F.length("n").cast("long").alias("normalized_length")
    )


@query(
    f"SELECT doc_id, sha256(text) AS content_hash, sha256(concat({sql_norm('source')}, '|', CASE WHEN lang = 'en' THEN lang ELSE 'no-date' END)) AS dedupe_hash FROM documents"
)
def record_hashes(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents", "doc_id", "text", "source", "lang")
    day = F.when(F.col("lang") == "en", F.col("lang"))
    return rows.select(
        "doc_id",
        text.sha256("text").alias("content_hash"),
        text.dedupe_hash(text.normalize_text("source"), day).alias("dedupe_hash"),
    )


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS plain FROM pages")
def stripped_pages(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pages", "page_id", "html")
    return rows.select("page_id", text.strip_html("html").alias("plain"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, event_type FROM events WHERE event_type IN ('click', 'view')")
def metadata_values(spark: SparkSession, folder: str) -> DataFrame:
    """A number and a filter read from schema-less metadata."""
    rows = table(spark, folder, "events", "event_id", "event_type", "props")
    parsed = rows.withColumn("meta", F.from_json("props", "map<string,string>"))
    kept = parsed.withColumn("meta", F.map_concat("meta", F.create_map(F.lit("parser"), F.col("event_type"))))
    return kept.filter(text.from_parser("meta", "click", "view")).select(
        "event_id", text.metadata_number("meta", "k").alias("k"), text.metadata_text("meta", "parser").alias("event_type")
    )


@query(
    """SELECT id, CAST(day AS VARCHAR) AS long_date, CAST(day AS VARCHAR) AS weekday_date, CAST(day AS VARCHAR) AS slash_date, CAST(day AS VARCHAR) AS iso_date,
 CAST(day AS VARCHAR) AS status_date, CAST(day AS VARCHAR) AS url_date, CAST(day AS VARCHAR) AS block_date, day AS typed FROM st_record_texts"""
)
def parsed_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates spelled in seven ways inside longer texts, read back."""
    rows = stage(spark, folder, "st_record_texts")
    later, c = F.lit(". Turnada el 31 de diciembre de 2099"), F.concat
    return rows.select(
        "id",
        dates.long_date(c(F.lit("Sesión del "), "long_day", F.lit(" en pleno"))).alias("long_date"),
        dates.weekday_date(c(F.lit("1 de enero de 1970, lunes "), "long_day")).alias("weekday_date"),
        dates.any_date(c(F.lit("Fecha: "), "slash_day", F.lit(" (sic)"))).alias("slash_date"),
        dates.any_date(c(F.lit("x "), F.col("day").cast("string"), F.lit(" 1/1/1970"))).alias("iso_date"),
        dates.status_date(c(F.lit("PENDIENTE EL "), "short_day")).alias("status_date"),
        dates.url_date(c(F.lit("https://h/"), F.date_format("day", "yyyy_MM_dd"), F.lit("/9"))).alias("url_date"),
        dates.block_date(c("title", F.lit(". Presentada por Ana el martes, "), "long_day", later)).alias("block_date"),
        dates.as_date(dates.long_date("long_day")).alias("typed"),
    )


def _signatures(spark: SparkSession, folder: str) -> DataFrame:
    return spread(stage(spark, folder, "st_record_texts"), "id")


THREE_SQL = "concat(first_name, '|', second_name, '|', third_name)"


@query(
    f"""SELECT id, {THREE_SQL} AS listed, {THREE_SQL} AS collective, {THREE_SQL} AS titled, concat(first_name, '|', second_name) AS co_signed,
 first_name AS single FROM st_record_texts"""
)
def proponent_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Proponent fields in five wordings, split into names."""
    rows, c, lit = _signatures(spark, folder), F.concat, F.lit
    joined = lambda value: F.array_join(value, "|")
    return rows.select(
        "id",
        joined(names.split_signers(c("first_name", lit("; "), "second_name", lit(" y "), "third_name"))).alias("listed"),
        joined(
            names.proponent_signers(
                c(lit("De las senadoras y senadores "), "first_name", lit(", "), "second_name", lit(" y "), "third_name",
                  lit(", del Grupo Parlamentario del Partido Verde. PVEM"))
            )
        ).alias("collective"),
        joined(
            names.proponent_signers(
                c(lit("Sen. "), "first_name", lit(", Sen. "), "second_name", lit(" y Sen. "), "third_name", lit(". PRI"))
            )
        ).alias("titled"),
        joined(
            names.proponent_signers(
                c(lit("Del Sen. "), "first_name", lit(" y suscrita por la Sen. "), "second_name", lit(". PAN"))
            )
        ).alias("co_signed"),
        joined(names.proponent_signers(c(lit("Dip. "), "first_name", lit(". MORENA")))).alias("single"),
    )


@query(
    f"""SELECT id, {THREE_SQL} AS entry, {THREE_SQL} AS open_data, concat(first_name, '|', second_name) AS chamber, {THREE_SQL} AS expanded FROM st_record_texts"""
)
def gazette_authors(spark: SparkSession, folder: str) -> DataFrame:
    """Signers of gazette entries, chamber blocks and open-data rows."""
    rows, c, lit = _signatures(spark, folder), F.concat, F.lit
    joined = lambda value: F.array_join(value, "|")
    return rows.select(
        "id",
        joined(
            names.entry_signers(
                c(lit("De las senadoras y de los senadores "), "first_name", lit(", "), "second_name", lit(" y "), "third_name",
                  lit(", del Grupo Parlamentario del Partido Acción Nacional, con proyecto de decreto por el que "), "title")
            )
        ).alias("entry"),
        joined(
            names.open_data_signers(
                c(lit("senadores "), "first_name", lit(" (PT)<br>"), "second_name", lit(" (PAN)<br>"), "first_name", lit("<br>"), "third_name")
            )
        ).alias("open_data"),
        joined(
            names.chamber_block_signers(
                c("title", lit(". Presentada por el diputado "), "first_name", lit(", PAN y la diputada "), "second_name",
                  lit(", MC; y suscrita por diversos diputados. Turnada a la Comisión de Salud."))
            )
        ).alias("chamber"),
        joined(
            names.expand_senate_names(
                F.array(c(lit("las senadoras y los senadores "), "first_name", lit(", "), "second_name"), c(lit("Sen. "), "third_name"), lit("Grupo Parlamentario del PAN"))
            )
        ).alias("expanded"),
    )


@query(
    f"""WITH parts AS (SELECT id, 0 AS place, first_name AS n FROM st_record_texts UNION ALL SELECT id, 1, second_name FROM st_record_texts
   UNION ALL SELECT id, 2, third_name FROM st_record_texts)
 SELECT id AS initiative_id, CAST(place + 1 AS INTEGER) AS sort_order, n AS full_name, {sql_norm('n')} AS name_normalized, 'primary' AS role FROM parts"""
)
def author_sort_order(spark: SparkSession, folder: str) -> DataFrame:
    """Names with role and place in the signature."""
    rows = _signatures(spark, folder)
    signed = F.concat("first_name", F.lit("; "), "second_name", F.lit("; "), "third_name", F.lit("; "), "first_name")
    listed = text.as_authors(text.unique_by(names.split_signers(signed)))
    return rows.select(F.col("id").alias("initiative_id"), F.posexplode(listed).alias("place", "a")).select(
        "initiative_id",
        (F.col("place") + 1).alias("sort_order"),
        "a.full_name",
        text.normalize_text("a.full_name").alias("name_normalized"),
        "a.role",
    )


@query(
    """WITH labels AS (SELECT id, presented_at, unnest(CASE id % 5 WHEN 1 THEN ['Gobernación', 'Derechos Humanos', 'Estudios Legislativos, Segunda']
   WHEN 2 THEN ['Salud', 'Estudios Legislativos'] WHEN 4 THEN ['Justicia'] ELSE [] END) AS name FROM st_initiatives WHERE originating_chamber = 'senado')
 SELECT id AS initiative_id, presented_at AS assigned_at, name, lower(strip_accents(name)) AS name_normalized, 'senado' AS chamber FROM labels"""
)
def commission_assignments(spark: SparkSession, folder: str) -> DataFrame:
    return staged.senate_assignments(spark, folder)


@query(
    """SELECT id, CASE id % 4 WHEN 0 THEN concat('Salud ', first_name, '|Hacienda') WHEN 1 THEN concat('Justicia ', second_name)
  WHEN 2 THEN concat('Cultura|Deporte ', first_name) ELSE 'Presidencia' END AS labels FROM st_record_texts"""
)
def chamber_commissions(spark: SparkSession, folder: str) -> DataFrame:
    """Commission lists of lower-chamber sentences."""
    rows, c, lit, kind = _signatures(spark, folder), F.concat, F.lit, F.col("id") % 4
    sentence = (
        F.when(kind == 0, c(lit("Turnada a las Comisiones Unidas de Salud "), "first_name", lit(", la Hacienda")))
        .when(kind == 1, c(lit("Turnada a la Comisión de Justicia "), "second_name"))
        .when(kind == 2, c(lit("Turnada a las Comisiones de Cultura y Deporte "), "first_name"))
        .otherwise(lit("Turnada a la Presidencia"))
    )
    return rows.select("id", F.array_join(commissions.chamber_commissions(sentence), "|").alias("labels"))


@query(
    """SELECT event_id, event_type, CASE event_type WHEN 'presentation' THEN 'presented' WHEN 'gaceta_publication' THEN 'presented' WHEN 'turn_to_commission' THEN 'in_commissions'
  WHEN 'commission_opinion' THEN 'opinion_issued' WHEN 'approved_origin' THEN 'approved_origin' WHEN 'dof_publication' THEN 'published_dof' ELSE 'unknown' END AS status,
  CASE event_type WHEN 'presentation' THEN 1 WHEN 'gaceta_publication' THEN 1 WHEN 'turn_to_commission' THEN 2 WHEN 'commission_opinion' THEN 3
  WHEN 'approved_origin' THEN 4 WHEN 'dof_publication' THEN 8 ELSE -1 END AS rank FROM st_events"""
)
def event_statuses(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged.events(spark, folder)
    state = status.event_status("event_type")
    return rows.select("event_id", "event_type", state.alias("status"), status.status_rank(state).alias("rank"))


RAW_STATUS_SQL = """CASE id % 5 WHEN 0 THEN concat('Publicado en el Diario Oficial EL ', short_day) WHEN 1 THEN concat('Aprobada el ', long_day)
  WHEN 2 THEN concat('Se turnó a la Comisión de ', first_name) WHEN 3 THEN concat('RETIRADA el ', slash_day) ELSE concat('Pendiente ', second_name) END"""


def raw_status() -> Column:
    kind, c, lit = F.col("id") % 5, F.concat, F.lit
    return (
        F.when(kind == 0, c(lit("Publicado en el Diario Oficial EL "), "short_day"))
        .when(kind == 1, c(lit("Aprobada el "), "long_day"))
        .when(kind == 2, c(lit("Se turnó a la Comisión de "), "first_name"))
        .when(kind == 3, c(lit("RETIRADA el "), "slash_day"))
        .otherwise(c(lit("Pendiente "), "second_name"))
    )


@query(
    """SELECT id, CASE id % 5 WHEN 0 THEN 'dof_publication' WHEN 1 THEN 'approved_origin' WHEN 3 THEN 'withdrawal' ELSE 'other' END AS sil,
 CASE id % 5 WHEN 3 THEN 'withdrawal' ELSE 'other' END AS gaceta_diputados,
 CASE id % 5 WHEN 0 THEN 'dof_publication' WHEN 1 THEN 'approved_origin' WHEN 2 THEN 'turn_to_commission' WHEN 3 THEN 'withdrawal' ELSE 'other' END AS gaceta_senado,
 CASE id % 5 WHEN 0 THEN 'published_dof' WHEN 1 THEN 'approved_origin' WHEN 2 THEN 'in_commissions' WHEN 3 THEN 'withdrawn' ELSE 'unknown' END AS record_status,
 CASE id % 4 WHEN 0 THEN 'diputados' WHEN 1 THEN 'senado' WHEN 2 THEN 'ejecutivo' ELSE 'otro' END AS chamber_wide,
 CASE id % 4 WHEN 1 THEN 'senado' END AS chamber_narrow FROM st_record_texts"""
)
def raw_status_events(spark: SparkSession, folder: str) -> DataFrame:
    """Event types, statuses and chambers read from raw texts by each source's rules."""
    rows = stage(spark, folder, "st_record_texts")
    kind = F.col("id") % 4
    chamber = (
        F.when(kind == 0, F.lit("Cámara de DIPÚTADAS"))
        .when(kind == 1, F.lit("Cámara de Senadores"))
        .when(kind == 2, F.lit("Titular del Ejecutivo"))
        .otherwise(F.lit("Congreso local"))
    )
    narrow = F.when(kind == 0, F.lit("Senado")).otherwise(chamber)
    return rows.select(
        "id",
        *[status.event_from_status(raw_status(), s).alias(s) for s in ("sil", "gaceta_diputados", "gaceta_senado")],
        status.record_status(raw_status(), "day", "senado_transparencia").alias("record_status"),
        status.chamber_wide(chamber).alias("chamber_wide"),
        status.chamber_narrow(narrow).alias("chamber_narrow"),
    )


@query(
    f"""WITH words AS (SELECT doc_id, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM documents),
 sized AS (SELECT doc_id, w, len(w) AS n FROM words WHERE len(w) > 0 AND w <> ['']),
 starts AS (SELECT doc_id, w, n, unnest(generate_series(0, greatest(CAST(ceil((n - 20) / 180) AS INTEGER) - 1, 0))) AS i FROM sized)
 SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, array_to_string(w[i * 180 + 1 : i * 180 + 200], ' ') AS content,
   CAST(len(w[i * 180 + 1 : i * 180 + 200]) AS INTEGER) AS token_count FROM starts"""
)
def chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    return document_ops.chunks(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


CHAT_NORM = "lower(strip_accents(text))"


@query(
    f"""SELECT conv_id, turn,
 regexp_matches({CHAT_NORM}, '\\b(19|20)\\d{{2}}\\b|\\b(enero|febrero|marzo|abril|mayo|junio|julio|agosto|septiembre|setiembre|octubre|noviembre|diciembre)\\b|\\b(desde|hasta|entre|periodo|legislatura|fecha|ano|anio|mes|dia|hoy|ayer|reciente|recientes|actual)\\b') AS date_limited,
 regexp_matches({CHAT_NORM}, '\\b(busca|buscar|encuentra|encontrar|lista|listar|cuantas|cuantos|filtra|filtrar|presentadas?|iniciativas?)\\b')
  AND regexp_matches({CHAT_NORM}, '\\b(iniciativa|iniciativas|autor|autores|proponente|proponentes|ejecutivo|senador|senadora|diputado|diputada)\\b') AS search_needed,
 regexp_matches({CHAT_NORM}, '(no se encontraron|no encontre|no se han registrado|no hay iniciativas)') AND turn % 3 > 0 AS contradicts_results
 FROM conversations"""
)
def chat_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "text").withColumn("found", F.col("turn") % 3)
    return chat.message_flags(rows, "text", "found").drop("text", "found")


@query(
    """SELECT conv_id, turn, role, left(text, 4000) AS text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn
 FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') WHERE rn <= 10"""
)
def chat_recent(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations", "conv_id", "turn", "role", "text")
    return chat.recent_history(rows).select("conv_id", "turn", "role", "text")
