"""Extraction: stored pages and dump rows to parsed records.

A page's elements lie in one row, so records are read by expressions over that row; nothing is
shuffled before the records are deduplicated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions import dates, names, urls
from curul.functions.html import FIELD_NAMES, with_elements
from curul.functions.text import (
    as_col,
    better_description,
    better_title,
    blank_to_null,
    capitalize_first,
    clean_optional,
    clean_text,
    clean_title,
    collapse,
    dedupe_hash,
    drop_first,
    enumerated_list,
    extract,
    extract_all,
    first_non_blank,
    joined_values,
    let,
    matches,
    normalize_text,
    replace,
    sha256,
    split,
    truncate,
)
from curul.operators.keyed import best_per_key, bound

# --- fixed values: field labels, phrases and parser names of the sources ----------------------
FIELD_LABELS = (
    ("title", "titulo|asunto|iniciativa"),
    ("authors", "autor|promovente|presentada por"),
    ("presentation_date", "fecha|presentacion"),
    ("status", "estatus|situacion|estado|tramite"),
    ("chamber", "camara|origen"),
    ("initiative_type", "tipo|clase|naturaleza"),
    ("description", "descripcion|sinopsis|resumen|objeto"),
)
DETAIL_LABELS = FIELD_LABELS[:-1] + (
    ("description", "descripcion|sinopsis|resumen|objeto|contenido"),
    ("topic", "materia|tema|topico"),
    ("referred_to", "turnad|comision|dictamen"),
)
NAVIGATION = "cerrar|imprimir|regresar|siguiente|anterior|inicio"
POPUP_TITLES = r"SIL - Sistema de Informaci[oó]n Legislativa|PopUp Contenido Asuntos"
RESULT_HEADINGS = "tipo.*asunto|camara|fecha|promovente|partido|legislatura"
RESULT_TITLES = r"^que\s+|decreto|reforma|ley"
RESULT_STATUS = r"EL\s+\d{2}-[A-Z]{3}-\d{4}|Pendiente|Publicado|Desechado|Devuelto"
RESULT_CHAMBERS = "senadores|diputados|camara"
RESULT_PARTIES = "^(?:PAN|PRI|PRD|PVEM|PT|MC|MORENA|PNA|PES)$"
RESULT_TYPES = "ley|decreto|constitucion|reglamento"
BLOCK_END = "Presentada por|Suscrita por|Turnada a|Gaceta Parlamentaria|$"
BLOCK_STATUS = "Turnada|Prórroga|Dictaminada|Publicad"
CHAMBER_TITLES = r"^que\s+|reforma|adiciona|deroga|expide"
SENATE_SECTION = (
    r"INICIATIVAS:\s*(.*?)(?=DICTÁMENES A DISCUSIÓN Y VOTACIÓN|PROPOSICIONES:|AGENDA POLÍTICA|EFEMÉRIDES|CITA|$)"
)
SENATE_SIGNERS = (
    r"Del Sen\.|Del senador|De la Sen\.|De la Senadora|De las senadoras y los senadores|"
    r"De las senadoras y de los senadores|De los senadores|De las senadoras"
)
SENATE_ENTRIES = "con proyecto de decreto|que reforma|por el que se expide|por el que se adiciona|por el que se reforma"
SENATE_END = "Se turnó|La Presidencia informó|ARCHIVOS PARA DESCARGAR|El contenido de esta página|$"
SENATE_HEADING = r"^Que\s+|^Oficio con el que remite"
SESSION_LINKS = r"Que\s+|iniciativa|proyecto de decreto|oficio con el que remite"
CHAMBER_NAME, SENATE_NAME, TYPE_NAME = "Cámara de Diputados", "Cámara de Senadores", "Iniciativa"
PARSERS = {
    "generic": "sil-html-heuristic-v1",
    "detail": "sil-detail-html-v1",
    "results": "sil-results-table-v1",
    "chamber_list": "diputados-gaceta-list-v1",
    "chamber_page": "diputados-gaceta-html-v1",
    "senate_document": "senado-gaceta-document-v2",
    "transparency": "senado-transparencia-json-v1",
    "open_data": "senado-datos-abiertos-local-v1",
}
# --- end of fixed values ----------------------------------------------------------------------

RECORD = (
    "source_url source_record_key title title_normalized authors presentation_date status_raw chamber "
    "initiative_type description dedupe_hash metadata"
).split()


def elements_of(pages: DataFrame, tags: str | None = None, fields: str | None = None) -> DataFrame:
    """Pages with the elements of some ``tags`` and the costly ``fields`` that a rule looks at, named with blanks between; all of them if not given."""
    if "elements" in pages.columns:
        return pages
    return with_elements(pages, tags and tags.split(), FIELD_NAMES if fields is None else fields.split())


def _tagged(*tags: str) -> Column:
    return F.filter("elements", lambda e: e["tag"].isin(*tags))


def _marked(*marks: str) -> Column:
    return F.filter("elements", lambda e: F.arrays_overlap(e["marks"], F.array(*[F.lit(m) for m in marks])))


def _first_text(found: Column) -> Column:
    return blank_to_null(F.get(found, F.lit(0))["text"])


def _meta_description() -> Column:
    return F.get(F.filter("elements", lambda e: (e["tag"] == "meta") & (e["name"] == "description")), F.lit(0))["content"]


def _metadata(**values: Column | str) -> Column:
    pairs = [x for k, v in values.items() for x in (F.lit(k), (F.lit(v) if isinstance(v, str) else v).cast("string"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


# ---- label and value pages -------------------------------------------------------------------


def _field_of(label: Column, table) -> Column:
    def by_pattern(text: Column) -> Column:
        field = F.lit(None).cast("string")
        for name, pattern in reversed(table):
            field = F.when(matches(text, pattern), name).otherwise(field)
        return field

    return let(normalize_text(label), by_pattern)


def page_fields(detail: bool = False) -> Column:
    """(field, value) pairs of a page: two-cell rows, terms with definitions, "label: value" texts.

    The last form is read on detail pages only.
    """
    table = DETAIL_LABELS if detail else FIELD_LABELS
    pair = lambda label, value: F.struct(label.alias("label"), value.alias("value"))
    rows = F.transform(
        F.filter("elements", lambda e: (e["tag"] == "tr") & (F.size(e["cells"]) >= 2)),
        lambda e: pair(F.get(e["cells"], F.lit(0)), F.get(e["cells"], F.lit(1))),
    )
    terms = F.transform(_tagged("dt"), lambda e: pair(e["text"], F.coalesce(e["follows"], F.lit(""))))
    pairs = F.concat(rows, terms)
    if detail:
        spoken = F.filter(_tagged("p", "div", "span"), lambda e: F.contains(e["text"], F.lit(":")))
        pairs = F.concat(
            pairs,
            F.transform(
                spoken,
                lambda e: pair(F.substring_index(e["text"], ":", 1), F.trim(F.regexp_replace(e["text"], r"^[^:]*:", ""))),
            ),
        )
    fields = F.transform(
        pairs, lambda p: F.struct(_field_of(p["label"], table).alias("field"), p["value"].alias("value"))
    )
    return F.filter(fields, lambda f: f["field"].isNotNull() & (f["value"] != ""))


def field_rows(pages: DataFrame, key: str, detail: bool = False) -> DataFrame:
    """(page, place, field, value) rows."""
    return elements_of(pages, "tr dt p div span", "text cells follows").select(key, F.posexplode(page_fields(detail)).alias("place", "f")).select(key, "place", "f.*")


def _field(name: str) -> Column:
    return joined_values(F.transform(F.filter("fields", lambda f: f["field"] == name), lambda f: f["value"]))


def generic_records(pages: DataFrame) -> DataFrame:
    """One record per page with a title, from its fields, headings and meta description."""
    df = bound(elements_of(pages, fields="text cells follows"), fields=page_fields())
    title = first_non_blank(_field("title"), _first_text(_tagged("h1")), _first_text(_marked("titulo", "title")))
    day = dates.any_date(F.coalesce(_field("presentation_date"), F.lit("")))
    df = bound(df, title=title, presentation_date=day).filter(F.col("title") != "")
    df = df.withColumn("title_normalized", normalize_text("title"))
    df = df.withColumn("dedupe_hash", dedupe_hash("title_normalized", "presentation_date"))
    description = first_non_blank(
        _field("description"), _meta_description(), _first_text(_marked("resumen", "descripcion", "sinopsis"))
    )
    return df.select(
        F.col("url").alias("source_url"),
        F.col("dedupe_hash").alias("source_record_key"),
        "title",
        "title_normalized",
        names.split_signers(_field("authors")).alias("authors"),
        "presentation_date",
        _field("status").alias("status_raw"),
        _field("chamber").alias("chamber"),
        _field("initiative_type").alias("initiative_type"),
        blank_to_null(description).alias("description"),
        "dedupe_hash",
        _metadata(parser=PARSERS["generic"], parentUrl=_column_or_null(df, "parent_url")).alias("metadata"),
    )


def longest_block() -> Column:
    """Longest text of a paragraph, cell or division over 80 characters that is no navigation."""
    blocks = F.transform(_tagged("p", "td", "div"), lambda e, i: F.struct(F.length(e["text"]).alias("n"), (-i).alias("i"), e["text"].alias("text")))
    kept = F.filter(blocks, lambda b: (b["n"] > 80) & ~matches(b["text"], NAVIGATION))
    return F.array_max(kept)["text"]


def detail_records(pages: DataFrame) -> DataFrame:
    """Details of popup pages; a page with neither title nor description gives none."""
    df = bound(elements_of(pages, fields="text cells follows parents"), fields=page_fields(detail=True))
    inside = lambda parent: F.filter("elements", lambda e: (e["tag"] == "b") & F.contains(e["parents"], F.lit(f" {parent} ")))
    headings = F.filter(
        "elements",
        lambda e: (e["tag"] == "b") | F.arrays_overlap(e["marks"], F.array(F.lit("titulo"), F.lit("title"), F.lit("encabezado"))),
    )
    raw = first_non_blank(
        _field("title"), _first_text(_tagged("h1")), _first_text(headings), _first_text(inside("center")),
        _first_text(inside("font")), _first_text(inside("td")), _first_text(_tagged("title")),
    )
    described = F.array_join(
        F.transform(_marked("objeto", "descripcion", "sinopsis"), lambda e: e["text"]), ""
    )
    description = first_non_blank(_field("description"), described, _meta_description(), longest_block())
    df = bound(df, raw_title=raw, description=blank_to_null(description))
    df = bound(df, title=F.when(~matches("raw_title", POPUP_TITLES), blank_to_null("raw_title")))
    df = df.filter(F.col("title").isNotNull() | F.col("description").isNotNull())
    return df.select(
        F.col("url").alias("source_url"),
        "title",
        normalize_text("title").alias("title_normalized"),
        names.split_signers(_field("authors")).alias("authors"),
        dates.any_date(F.coalesce(_field("presentation_date"), F.lit(""))).alias("presentation_date"),
        _field("status").alias("status_raw"),
        _field("chamber").alias("chamber"),
        _field("initiative_type").alias("initiative_type"),
        "description",
        _metadata(
            parser=PARSERS["detail"],
            parentUrl=_column_or_null(df, "parent_url"),
            extracted_title=F.col("title"),
            extracted_title_raw=blank_to_null("raw_title"),
            extracted_description_length=F.coalesce(F.length("description"), F.lit(0)),
            topic=_field("topic"),
            referred_to=_field("referred_to"),
        ).alias("metadata"),
    )


# ---- results tables --------------------------------------------------------------------------


def _find(cells: Column, pattern: str) -> Column:
    return F.get(F.filter(cells, lambda c: matches(c, pattern)), F.lit(0))


def _place(cells: Column, pattern: str) -> Column:
    """Zero-based place of the first cell that matches, -1 if none."""
    return F.array_position(F.transform(cells, lambda c: matches(c, pattern)), True) - 1


def detail_address(row_links: Column, row_html: Column, page_url: Column) -> Column:
    """Detail page of a results row: a record number in a link, else in the row's HTML."""

    def from_text(text: Column) -> Column:
        number = extract(text, r"Clave=(\d+)")
        direct = extract(text, r"(pp_ContenidoAsuntos\.php\?[^\"' )]+)")
        direct = replace(F.replace(F.replace(direct, F.lit("&amp;"), F.lit("&")), F.lit("&#38;"), F.lit("&")), r"(?:%22|&quot;|&#39;|[\"',]).*$")
        return F.coalesce(
            urls.absolute_url(page_url, F.concat(F.lit(urls.DETAIL_PAGE), number)), urls.absolute_url(page_url, direct)
        )

    found = F.filter(F.transform(row_links, from_text), lambda u: u.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), from_text(row_html))


def results_records(pages: DataFrame) -> DataFrame:
    """Records of the rows of results tables, the first of each key per page."""
    df = elements_of(pages, "tr", "data_cells html")
    rows = df.select(
        "url", _column_or_null(df, "parent_url").alias("parent_url"), F.posexplode(_tagged("tr")).alias("row", "e")
    ).select("url", "parent_url", "row", "e.links", "e.html", F.filter("e.data_cells", lambda c: c != "").alias("cells"))
    cells = F.col("cells")
    heading = matches(F.lower(F.array_join("cells", " ")), RESULT_HEADINGS)
    rows = bound(rows.filter(F.size("cells") >= 6), title=_find(cells, RESULT_TITLES), heading=heading)
    rows = rows.filter(F.col("title").isNotNull() & ~F.col("heading"))
    title_at = (F.array_position(cells, F.col("title")) - 1).cast("int")
    date_at = (F.array_position(F.transform(cells, dates.has_slash_date), True) - 1).cast("int")
    rows = bound(rows, title_at=title_at, date_at=date_at)
    kind = F.when(F.col("title_at") > 0, F.get(cells, F.col("title_at") - 1)).otherwise(_find(cells, RESULT_TYPES))
    author = F.get(cells, F.when(F.col("date_at") > 0, F.col("date_at") + 1).otherwise(F.col("title_at") + 1))
    day = F.when(F.col("date_at") >= 0, dates.slash_date(F.get(cells, F.greatest("date_at", F.lit(0)))))
    rows = bound(rows, presentation_date=day, title_normalized=normalize_text("title"))
    rows = rows.withColumn("dedupe_hash", dedupe_hash("title_normalized", "presentation_date"))
    out = rows.select(
        "row",
        F.col("url").alias("source_url"),
        F.col("dedupe_hash").alias("source_record_key"),
        "title",
        "title_normalized",
        names.split_signers(author).alias("authors"),
        "presentation_date",
        _find(cells, RESULT_STATUS).alias("status_raw"),
        _find(cells, RESULT_CHAMBERS).alias("chamber"),
        kind.alias("initiative_type"),
        F.col("title").alias("description"),
        "dedupe_hash",
        _metadata(
            parser=PARSERS["results"],
            parentUrl=F.col("parent_url"),
            detail_url=detail_address(F.col("links"), F.col("html"), F.col("url")),
            party=_find(cells, RESULT_PARTIES),
            legislature=_find(cells, "^LX"),
            referred_to=enumerated_list(_find(cells, "dictamen|comision")),
            topic=enumerated_list(F.element_at(cells, -1)),
        ).alias("metadata"),
    )
    return best_per_key(out, ["source_url", "dedupe_hash"], [F.col("row").asc()]).select(*RECORD)


def merge_details(records: DataFrame, details: DataFrame) -> DataFrame:
    """Records completed from their detail pages; the record keeps its identity."""
    one = best_per_key(details, ["source_url"], [F.length("description").desc_nulls_last(), F.col("title").asc_nulls_last()])
    right = one.select(*[F.col(c).alias(f"d_{c}") for c in one.columns])
    joined = records.withColumn("_detail", F.try_element_at("metadata", F.lit("detail_url"))).join(
        right, F.col("_detail") == F.col("d_source_url"), "left"
    )
    found = F.col("d_source_url").isNotNull()
    take = lambda c: F.coalesce(F.col(f"d_{c}"), F.col(c))
    title = F.when(better_title("d_title", "title"), F.col("d_title")).otherwise(F.col("title"))
    extra = _metadata(result_source_url=F.col("source_url"), detail_source_url=F.col("d_source_url"))
    laid_over = lambda below, above: F.map_zip_with(below, above, lambda _, a, b: F.coalesce(b, a))
    return joined.select(
        take("source_url").alias("source_url"),
        "source_record_key",
        title.alias("title"),
        F.coalesce("d_title_normalized", normalize_text(title)).alias("title_normalized"),
        F.when(F.size("d_authors") > 0, F.col("d_authors")).otherwise(F.col("authors")).alias("authors"),
        *[take(c).alias(c) for c in ("presentation_date", "status_raw", "chamber", "initiative_type")],
        F.when(better_description("d_description", "description"), F.col("d_description")).otherwise(F.col("description")).alias("description"),
        "dedupe_hash",
        F.when(found, laid_over(laid_over("metadata", "d_metadata"), extra)).otherwise(F.col("metadata")).alias("metadata"),
    )


# ---- lower-chamber gazette -------------------------------------------------------------------


def chamber_blocks() -> Column:
    """Texts of list items and paragraphs that open an initiative; else cut from the body."""
    long = lambda b: F.length(b) > 40
    items = F.filter(F.transform(_tagged("li", "p"), lambda e: e["text"]), lambda b: matches(b, r"^Que\s+") & long(b))
    cut = F.filter(F.transform(extract_all("body", r"Que\s+.*?(?=Que\s+|$)", ignore_case=False), lambda v: F.trim(v)), long)
    return let(items, lambda found: F.when(F.size(found) > 0, found).otherwise(cut))


def block_rows(pages: DataFrame, *keep: str) -> DataFrame:
    return elements_of(pages, "li p", "text").select(*keep, F.posexplode(chamber_blocks()).alias("block_index", "block"))


def _first_sentence(text: Column | str, pattern: str) -> Column:
    sentences = F.transform(F.split(as_col(text), r"\."), lambda v: F.trim(v))
    return F.get(F.filter(sentences, lambda s: matches(s, pattern)), F.lit(0))


def chamber_list_records(pages: DataFrame) -> DataFrame:
    """Records of the blocks of gazette list pages, the first of each key per page."""
    df = elements_of(pages, "li p", "text")
    rows = block_rows(df.withColumn("parent_url", _column_or_null(df, "parent_url")), "url", "parent_url")
    block = F.col("block")
    rows = bound(rows, title=clean_optional(extract(block, rf"^(Que\s+.*?)(?={BLOCK_END})")))
    rows = bound(
        rows.filter(F.col("title").isNotNull()),
        title_normalized=normalize_text("title"),
        presentation_date=dates.block_date(block),
        authors=names.chamber_block_signers(block),
        legislature=urls.chamber_legislature("url"),
        issue=urls.gazette_issue(block),
        entry=urls.entry_id(block),
    )
    key = urls.chamber_key("legislature", "issue", "entry", "title_normalized", "presentation_date", F.col("authors"))
    rest = blank_to_null(F.trim(drop_first(block, "title")))
    out = rows.withColumn("source_record_key", key).select(
        "block_index",
        F.col("url").alias("source_url"),
        "source_record_key",
        "title",
        "title_normalized",
        "authors",
        "presentation_date",
        _first_sentence(block, BLOCK_STATUS).alias("status_raw"),
        F.lit(CHAMBER_NAME).alias("chamber"),
        F.lit(TYPE_NAME).alias("initiative_type"),
        F.coalesce(rest, F.col("title")).alias("description"),
        sha256("source_record_key").alias("dedupe_hash"),
        _metadata(
            parser=PARSERS["chamber_list"],
            parentUrl=F.col("parent_url"),
            detail_url=F.col("url"),
            source_legislature=F.col("legislature"),
            source_page_url=F.col("url"),
            source_block_index=F.col("block_index"),
            source_entry_id=F.col("entry"),
            gaceta_issue_number=F.col("issue"),
            block_text=truncate(block, 2000),
        ).alias("metadata"),
    )
    return best_per_key(out, ["source_url", "dedupe_hash"], [F.col("block_index").asc()]).select(*RECORD)


def chamber_page_records(pages: DataFrame) -> DataFrame:
    """One record per single-initiative gazette page."""
    df = elements_of(pages)
    headings = F.filter(
        F.array(*[_first_text(_tagged(t)) for t in ("h1", "h2", "b", "title")]),
        lambda t: t.isNotNull() & matches(t, CHAMBER_TITLES),
    )
    df = bound(df, title=F.get(headings, F.lit(0))).filter(F.col("title").isNotNull())
    paragraphs = F.filter(
        F.transform(_tagged("p"), lambda e: e["text"]), lambda t: (F.length(t) > 80) & (t != F.col("title"))
    )
    df = df.withColumn("title_normalized", normalize_text("title")).withColumn("presentation_date", dates.long_date("body"))
    df = df.withColumn("dedupe_hash", dedupe_hash("title_normalized", "presentation_date"))
    return df.select(
        F.col("url").alias("source_url"),
        F.col("dedupe_hash").alias("source_record_key"),
        "title",
        "title_normalized",
        names.chamber_block_signers("body", sentence_only=True).alias("authors"),
        "presentation_date",
        _first_sentence("body", BLOCK_STATUS).alias("status_raw"),
        F.lit(CHAMBER_NAME).alias("chamber"),
        F.lit(TYPE_NAME).alias("initiative_type"),
        F.coalesce(
            clean_optional(_meta_description()), F.get(paragraphs, F.lit(0)), blank_to_null(truncate("body", 400))
        ).alias("description"),
        "dedupe_hash",
        _metadata(
            parser=PARSERS["chamber_page"], parentUrl=_column_or_null(df, "parent_url"), detail_url=F.col("url")
        ).alias("metadata"),
    )


# ---- senate gazette --------------------------------------------------------------------------


def senate_entries(body: Column | str) -> Column:
    """Entries of the initiatives section, each from its signers to the next ones."""
    section = collapse(F.coalesce(extract(body, SENATE_SECTION), F.lit("")))
    found = extract_all(section, rf"(?s)(?:{SENATE_SIGNERS}).*?(?=(?:{SENATE_SIGNERS})\s|$)")
    return F.filter(F.transform(found, lambda v: F.trim(v)), lambda e: matches(e, SENATE_ENTRIES))


def _entry_title(entry: Column) -> Column:
    raw = F.coalesce(
        clean_optional(extract(entry, r"con proyecto de decreto\s+(.*)$")), clean_optional(extract(entry, r",\s*(que\s+reforma.*)$"))
    )
    return capitalize_first(replace(raw, r"\.$"))


def _senate_status(text: Column | str) -> Column:
    return F.coalesce(_first_sentence(text, "^Se turnó"), _first_sentence(text, "^La Presidencia informó"))


def _standalone_title() -> Column:
    """Title of a document without entries: a heading, else the opening sentence of the body."""
    headings = F.filter(
        F.transform(_tagged("h1", "h2", "h3", "strong", "b"), lambda e: e["text"]), lambda t: matches(t, SENATE_HEADING)
    )
    return F.coalesce(
        F.get(headings, F.lit(0)),
        clean_optional(extract("body", rf"(Que\s+.*?)(?={SENATE_END})")),
        clean_optional(extract("body", rf"(Oficio con el que remite.*?)(?={SENATE_END})")),
    )


def senate_records(pages: DataFrame) -> DataFrame:
    """Records of senate documents: one per entry, or one for a document without entries.

    Both forms leave a page as one array, so every page is read once.
    """
    df = elements_of(pages, "h1 h2 h3 strong b", "text")
    record = lambda text, title, authors, description, block: F.struct(
        text.alias("text"),
        title.alias("title"),
        authors.alias("authors"),
        description.alias("description"),
        block.alias("block_text"),
    )
    from_entry = lambda e: record(e, _entry_title(e), names.entry_signers(e), e, truncate(e, 2000))
    no_text = F.lit(None).cast("string")
    alone = let(
        _standalone_title(),
        lambda title: F.array(
            record(
                F.col("body"),
                title,
                names.document_signers("body"),
                blank_to_null(truncate(collapse(drop_first("body", title)), 3000)),
                no_text,
            )
        ),
    )
    rows = df.select(
        "url",
        F.coalesce(_column_or_null(df, "session_date"), dates.long_date("body"), dates.url_date("url")).alias("presentation_date"),
        urls.senate_issue("body").alias("issue"),
        urls.senate_document_id("url").alias("document_id"),
        F.posexplode(
            let(
                senate_entries("body"),
                lambda found: F.when(F.size(found) > 0, F.transform(found, from_entry)).otherwise(alone),
            )
        ).alias("entry_index", "r"),
    ).select("url", "presentation_date", "issue", "document_id", "entry_index", "r.*")
    rows = rows.filter(F.col("title").isNotNull() & (F.col("title") != ""))
    rows = rows.withColumn("title_normalized", normalize_text("title"))
    key = urls.senate_key("document_id", "title_normalized", "presentation_date", "entry_index")
    return rows.withColumn("source_record_key", key).select(
        F.col("url").alias("source_url"),
        "source_record_key",
        "title",
        "title_normalized",
        "authors",
        "presentation_date",
        _senate_status("text").alias("status_raw"),
        F.lit(SENATE_NAME).alias("chamber"),
        F.lit(TYPE_NAME).alias("initiative_type"),
        "description",
        sha256("source_record_key").alias("dedupe_hash"),
        _metadata(
            parser=PARSERS["senate_document"],
            source_page_url=F.col("url"),
            source_document_id=F.col("document_id"),
            source_session_date=F.col("presentation_date"),
            source_entry_index=F.col("entry_index"),
            gaceta_issue_number=F.col("issue"),
            block_text=F.col("block_text"),
        ).alias("metadata"),
    )


def session_documents(pages: DataFrame) -> DataFrame:
    """Documents linked from session pages: address, title hint, summary, session date."""
    df = elements_of(pages, "a", "text container")
    linked = df.select(
        "url",
        F.coalesce(_column_or_null(df, "session_date"), dates.long_date("body")).alias("session_date"),
        F.posexplode(F.filter(_tagged("a"), lambda e: e["href"].isNotNull() & (e["href"] != ""))).alias("place", "e"),
    ).select(
        F.col("url").alias("page_url"),
        "session_date",
        "place",
        urls.absolute_url("url", "e.href").alias("url"),
        collapse(F.concat_ws(" ", F.nullif("e.text", F.lit("")), F.nullif("e.container", F.lit("")))).alias("combined"),
        blank_to_null("e.container").alias("summary_hint"),
    )
    kept = linked.filter(matches("url", r"/documento/\d+") & matches("combined", SESSION_LINKS))
    hint = F.coalesce(
        clean_optional(extract("combined", r"(Que\s+.*?)(?=Se turnó|La Presidencia informó|ARCHIVOS PARA DESCARGAR|$)")),
        F.when(matches("combined", "^Oficio con el que remite"), truncate("combined", 400)),
    )
    return best_per_key(kept, ["page_url", "url"], [F.col("place").asc()]).select(
        "page_url", "url", hint.alias("title_hint"), "summary_hint", "session_date"
    )


# ---- dump rows -------------------------------------------------------------------------------


def is_senate_initiative(row: Column) -> Column:
    """Dump rows to keep: initiatives whose body names the senators."""
    text = lambda name: normalize_text(F.coalesce(row[name], F.lit("")))
    return text("tipo_documento").startswith("iniciativa") & F.contains(text("organo"), F.lit("senadores"))


def transparency_records(rows: DataFrame) -> DataFrame:
    """Records of senate JSON dumps.

    ``rows`` hold source_json_url, row_index and the ``row`` struct; read them with
    ``keep=is_senate_initiative`` so that the row index counts the kept rows of a file.
    """
    row = lambda name: F.col(f"row.{name}")
    kept = rows.filter(is_senate_initiative(F.col("row")))
    optional = lambda name: clean_optional(row(name))
    df = (
        kept.withColumn("title", clean_title(F.coalesce(row("titulo_docuemnto"), F.lit(""))))
        .withColumn("title_normalized", normalize_text("title"))
        .withColumn("presentation_date", dates.exact_slash_date(row("fecha_documento")))
        .withColumn("source_url", F.coalesce(clean_optional(row("link_documento")), F.col("source_json_url")))
    )
    key = urls.transparency_key("source_url", "title_normalized", "presentation_date", "row_index")
    carried = (
        "legislatura anio_legislativo periodo_sesiones inicio_periodo fin_periodo num_sesion num_gaceta organo "
        "cargo_proponente comision_turno prorroga fecha_dictamen link_dictamen nota"
    ).split()
    return df.withColumn("source_record_key", key).select(
        "source_url",
        "source_record_key",
        "title",
        "title_normalized",
        names.proponent_signers(row("cargo_proponente")).alias("authors"),
        "presentation_date",
        F.coalesce(optional("sentido_dictamen"), optional("nota")).alias("status_raw"),
        F.lit(SENATE_NAME).alias("chamber"),
        F.coalesce(optional("tipo_documento"), F.lit(TYPE_NAME)).alias("initiative_type"),
        F.coalesce(optional("tema_documento"), optional("nota")).alias("description"),
        urls.content_hash("source_record_key", F.to_json("row")).alias("dedupe_hash"),
        _metadata(
            parser=PARSERS["transparency"],
            source_json_url=F.col("source_json_url"),
            source_year=dates.file_year("source_json_url"),
            source_row_index=F.col("row_index"),
            legislatura_duracion=optional("duracion_legislatura"),
            **{name: optional(name) for name in carried},
        ).alias("metadata"),
    )


def open_data_records(rows: DataFrame) -> DataFrame:
    """Records of open-data rows; ``rows`` hold source_label, row_index and the ``row`` struct."""
    row = lambda name: F.col(f"row.{name}")
    cleaned = lambda name: blank_to_null(clean_text(row(name)))
    df = (
        rows.filter(F.col("row").isNotNull())
        .withColumn("gazette", urls.gazette_url(row("url_gaceta")))
        .withColumn("title", clean_text(row("titulo")))
        .withColumn("title_normalized", normalize_text("title"))
    )
    local = F.concat(
        F.lit("local://senado-datos-abiertos/"), F.url_encode(F.regexp_extract("source_label", r"([^/]*)\z", 1)), F.lit("#"), row("id")
    )
    return df.withColumn("source_record_key", urls.open_data_key("gazette", row("id"), "row_index")).select(
        F.coalesce("gazette", local).alias("source_url"),
        "source_record_key",
        "title",
        "title_normalized",
        names.open_data_signers(row("senadores")).alias("authors"),
        dates.exact_iso_date(row("fecha_presentacion")).alias("presentation_date"),
        F.coalesce(cleaned("estado"), cleaned("sentido_dictamen")).alias("status_raw"),
        F.lit(SENATE_NAME).alias("chamber"),
        F.lit(TYPE_NAME).alias("initiative_type"),
        cleaned("sintesis").alias("description"),
        urls.content_hash("source_record_key", F.to_json("row")).alias("dedupe_hash"),
        _metadata(
            parser=PARSERS["open_data"],
            local_file_path=F.col("source_label"),
            source_row_id=row("id"),
            source_row_index=F.col("row_index"),
            source_gaceta_id=cleaned("url_gaceta"),
            legislatura=cleaned("legislatura"),
            estado=cleaned("estado"),
            senadores_raw=row("senadores"),
            comisiones_raw=row("comisiones"),
            leyes_modifica_raw=row("leyes_modifica"),
            camara_origen=cleaned("camara_origen"),
            fecha_aprobacion=dates.exact_iso_date(row("fecha_aprobacion")),
            source_kind="docx_json_export",
        ).alias("metadata"),
    )


# ---- mapping, fallback, links ----------------------------------------------------------------


def mapped(records: DataFrame) -> DataFrame:
    """Parsed records under the names of the canonical table."""
    renamed = {"title": "canonical_title", "description": "summary", "presentation_date": "presented_at", "status_raw": "raw_status"}
    return records.withColumnsRenamed(renamed).withColumn("presented_at", dates.as_date("presented_at"))


def unparsed_pages(pages: DataFrame, records: DataFrame, *keep: str) -> DataFrame:
    """Pages that gave no record, each row kept with the hash of its own body and the columns ``keep``."""
    parsed = records.select(F.col("source_url").alias("url")).distinct()
    return pages.join(parsed, "url", "left_anti").select(
        F.col("url").alias("source_url"), F.col("url").alias("source_record_key"), sha256("html").alias("content_hash"), "html", *keep
    )


def page_links(pages: DataFrame, *keep: str) -> DataFrame:
    """Followable links of pages: (keep..., place, href, label, url), read from the markup."""
    anchors = F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*?href\s*=[^>]*>.*?</a>"), F.lit(0))
    quoted = r"(?is)href\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    href = F.concat(*[F.regexp_extract("a", quoted, i) for i in (1, 2, 3)])
    rows = pages.select("url", *keep, F.posexplode(anchors).alias("place", "a"))
    rows = rows.select(
        F.col("url").alias("page_url"),
        *keep,
        "place",
        F.replace(href, F.lit("&amp;"), F.lit("&")).alias("href"),
        collapse(F.regexp_replace("a", r"<[^>]+>", "")).alias("label"),
    )
    return rows.filter(urls.is_followable("href")).withColumn("url", urls.absolute_url("page_url", "href"))


def raw_links(pages: DataFrame, *keep: str) -> DataFrame:
    """Senate addresses anywhere in the markup, for pages whose links cannot be read."""
    found = F.array_distinct(extract_all("html", urls.SENATE_RAW_LINKS))
    rows = pages.select(F.col("url").alias("page_url"), *keep, F.explode(found).alias("href"))
    return rows.withColumn("url", urls.canonical_senate_url(urls.absolute_url("page_url", "href")))


def classified_links(links: DataFrame, source: str) -> DataFrame:
    """Links with the kind of page they lead to; unknown kinds are left out."""
    if source == "gaceta_senado":
        links = links.withColumn("url", urls.canonical_senate_url("url"))
    kinds = links.withColumn("kind", urls.page_kind("url", "label", source)).filter(F.col("kind").isNotNull())
    if source == "sil":
        return kinds.withColumn("url", urls.results_url("url"))
    return kinds


def seed_pages(seeds: DataFrame, size: int = 5) -> DataFrame:
    """Seeds widened to the next record numbers of their results pages, one per page key."""
    grown = seeds.select(F.col("url").alias("seed"), F.posexplode(urls.seed_window("url", size)).alias("place", "url"))
    return best_per_key(
        grown.withColumn("page_key", urls.results_key("url")), ["page_key"], [F.col("place").asc(), F.col("seed").asc()]
    )


def reachable_pages(links: DataFrame, seeds: DataFrame, max_depth: int | None = None, limit: int | None = None) -> DataFrame:
    """Pages reached from the seeds over stored links: (url, depth).

    A round joins the frontier with the links and drops what was reached before, until nothing new is
    found or ``max_depth`` is met. Each round writes its new pages only, through reliable storage.
    ``limit`` keeps the first pages by depth and address.
    """
    from curul.session import durable

    edges = durable(links.select("page_url", "url").distinct())
    frontier = reached = durable(seeds.select("url").distinct().withColumn("depth", F.lit(0)))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        fresh = (
            edges.join(frontier.select(F.col("url").alias("page_url")), "page_url", "left_semi")
            .select("url")
            .distinct()
            .join(reached.select("url"), "url", "left_anti")
            .withColumn("depth", F.lit(depth))
        )
        frontier = durable(fresh)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return reached.orderBy("depth", "url").limit(limit) if limit else reached


def capped(rows: DataFrame, position: str, most: int | None) -> DataFrame:
    """The first ``most`` items of a run by position; no cap, no cut."""
    return rows if most is None else rows.orderBy(position).limit(most)
