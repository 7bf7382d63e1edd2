"""Addresses: resolving links, canonical forms, page kinds and the ids inside addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from curul.functions.text import (
    as_col,
    blank_to_null,
    clean_text,
    extract,
    let,
    matches,
    normalize_text,
    sha256,
)

# --- fixed values: hosts, address forms and key formats of the sources ------------------------
BASE_URLS = {
    "sil": "https://sil.gobernacion.gob.mx",
    "gaceta_diputados": "https://gaceta.diputados.gob.mx",
    "gaceta_senado": "https://www.senado.gob.mx",
}
SENATE_HOSTS = ("www.senado.gob.mx", "senado.gob.mx")
SENATE_DOCUMENT = "https://www.senado.gob.mx/66/gaceta_del_senado/documento/"
TRANSPARENCY_PAGE = (
    "https://transparenciaparlamentaria.senado.gob.mx/transparencia_parlamentaria/?a=data&c=iniciativas"
)
RESULTS_PAGE = r"resultadosNumeraliaIniciativas\.php"
DETAIL_PAGE = "/Librerias/pp_ContenidoAsuntos.php?Clave="
SENATE_DOCUMENT_PATH = r"/gaceta_del_senado/documento/\d+|/informacion/gaceta/documento/\d+"
SENATE_SESSION_PATH = r"/gaceta_del_senado/\d{4}_\d{2}_\d{2}/\d+|/informacion/gaceta/sesion/\d+"
SENATE_RAW_LINKS = (
    r"(?:https?://(?:www\.)?senado\.gob\.mx)?/66/gaceta_del_senado/(?:documento/\d+|\d{4}_\d{2}_\d{2}/\d+)"
    r"|/informacion/gaceta/(?:documento|sesion)/\d+"
)
CHAMBER_DETAIL = r"Gaceta/Iniciativas/\d+/|gp\d+_a"
CHAMBER_INDEX = r"gp_iniciativas\.html|gp_b_indice\.html|gp\d+_b_inis\.html|base/inis/"
PAGINATION_LABEL = r"siguiente|next|resultados|pagina|page|\d+"
PAGINATION_URL = rf"page=|pagina=|offset=|index2?\.php|{RESULTS_PAGE}"
# --- end of fixed values ----------------------------------------------------------------------


def _without_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    segments = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    start = F.array().cast("array<string>")

    def step(kept: Column, segment: Column) -> Column:
        parent = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(segment == "..", parent).when(segment == ".", kept).otherwise(
            F.concat(kept, F.array(segment))
        )

    folded = F.aggregate(segments, start, step)
    closing = F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(folded, "/"), closing)


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Resolve a link against its page, without the fragment."""
    page = F.regexp_replace(as_col(base), r"#.*\z", "")
    link = F.regexp_replace(F.trim(as_col(href)), r"#.*\z", "")
    complete = lambda to: F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]+\z"), F.concat(to, F.lit("/"))).otherwise(to)
    return let(
        link,
        lambda to: F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), complete(to)).otherwise(
            let(page, lambda here: _resolved(here, to))
        ),
    )


def _resolved(page: Column, link: Column) -> Column:
    origin = F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?]*)", 1)
    path = F.regexp_extract(page, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*(/[^?]*)", 1)
    bare = F.regexp_extract(page, r"^([^?]*)", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, r"^(.*/)", 1))
    target = F.when(link.startswith("/"), link).otherwise(F.concat(folder, link))
    target_path = F.regexp_extract(target, r"^([^?]*)", 1)
    resolved = F.when(
        target_path.rlike(r"/\.{1,2}(?:/|\z)"),
        F.concat(_without_dots(target_path), F.regexp_extract(target, r"(\?.*)", 1)),
    ).otherwise(target)
    return (
        F.when(origin == "", link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(page, r"^([^:]*:)", 1), link))
        .when(link == "", page)
        .when(link.startswith("?"), F.concat(bare, F.when(path == "", "/").otherwise(""), link))
        .otherwise(F.concat(origin, resolved))
    )


def url_host(url: Column | str) -> Column:
    return F.lower(F.nullif(F.regexp_extract(as_col(url), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)", 1), F.lit("")))


def canonical_senate_url(url: Column | str) -> Column:
    """One scheme and one host for every spelling of the senate's address."""
    address = as_col(url)
    moved = F.regexp_replace(address, r"^[A-Za-z]+://[^/?#:]+", "https://www.senado.gob.mx")
    return F.when(is_senate_url(address), moved).otherwise(address)


def is_senate_url(url: Column | str) -> Column:
    return F.coalesce(url_host(url).isin(*SENATE_HOSTS), F.lit(False))


def is_followable(href: Column | str) -> Column:
    """Links that lead to another page: no fragments, no scripts."""
    link = as_col(href)
    return (link != "") & ~link.startswith("#") & ~F.lower(link).startswith("javascript:")


def query_value(url: Column | str, key: str) -> Column:
    return F.try_parse_url(as_col(url), F.lit("QUERY"), F.lit(key))


def is_results_page(url: Column | str) -> Column:
    return matches(url, RESULTS_PAGE)


def _with_query(url: Column, key: str, value: str, only_if_missing: bool = False) -> Column:
    present = url.rlike(rf"[?&]{key}=")
    changed = url if only_if_missing else F.regexp_replace(url, rf"([?&]{key}=)[^&]*", f"$1{value}")
    joiner = F.when(F.contains(url, F.lit("?")), "&").otherwise("?")
    return F.when(present, changed).otherwise(F.concat(url, joiner, F.lit(f"{key}={value}")))


def results_url(url: Column | str) -> Column:
    """Results page address with 15 rows a page and an explicit page number."""
    address = as_col(url)
    sized = _with_query(_with_query(address, "Paginas", "15"), "pagina", "1", only_if_missing=True)
    return F.when(is_results_page(address), sized).otherwise(address)


def results_key(url: Column | str) -> Column:
    """Key under which two addresses are the same results page."""
    address = as_col(url)
    parts = [F.coalesce(query_value(address, k), F.lit(d)) for k, d in (("Origen", ""), ("Serial", ""), ("Reg", "1"), ("pagina", "1"))]
    return F.when(is_results_page(address), F.concat_ws(":", F.lit("resultados"), *parts)).otherwise(address)


def seed_window(url: Column | str, size: int = 5) -> Column:
    """The addresses of the next record numbers of a results page, as an array."""
    address = as_col(url)
    first = F.coalesce(query_value(address, "Reg").try_cast("int"), F.lit(1))
    base = _with_query(_with_query(address, "pagina", "1"), "Paginas", "15")

    def numbered(reg: Column) -> Column:
        value = F.greatest(F.lit(1), reg).cast("string")
        replaced = F.concat(
            F.regexp_extract(base, r"^(.*[?&]Reg=)", 1), value, F.regexp_extract(base, r"[?&]Reg=[^&]*(.*)\z", 1)
        )
        return F.when(base.rlike(r"[?&]Reg="), replaced).otherwise(F.concat(base, F.lit("&Reg="), value))

    return F.when(
        is_results_page(address), F.transform(F.sequence(first, first + (size - 1)), numbered)
    ).otherwise(F.array().cast("array<string>"))


def gazette_url(value: Column | str) -> Column:
    """A gazette id or address to an address; null for anything else."""
    text = clean_text(value)
    return F.when(matches(text, r"^https?://"), text).when(
        text.rlike(r"^\d+\z"), F.concat(F.lit(SENATE_DOCUMENT), text)
    )


def local_file_url(file_name: Column | str, area: str = "senado-gaceta") -> Column:
    """Address of a page kept as a file: a long number in the name is a document id."""
    name = F.regexp_extract(as_col(file_name), r"([^/]*)\z", 1)
    document = F.regexp_extract(name, r"(\d{5,})", 1)
    encoded = F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))
    return F.when(document != "", F.concat(F.lit(SENATE_DOCUMENT), document)).otherwise(
        F.concat(F.lit(f"local://{area}/"), encoded)
    )


def senate_document_id(url: Column | str) -> Column:
    return extract(url, r"/documento/(\d+)")


def chamber_legislature(url: Column | str) -> Column:
    return F.coalesce(extract(url, r"/Gaceta/Iniciativas/(\d+)/"), extract(url, r"/base/inis/(\d+)/"))


def gazette_issue(text: Column | str) -> Column:
    """Issue number in a lower-chamber block."""
    return blank_to_null(F.trim(extract(text, r"Gaceta Parlamentaria,\s*número\s*([^,]+),")))


def senate_issue(text: Column | str) -> Column:
    return extract(text, r"Gaceta:\s*(\S+)")


def entry_id(text: Column | str) -> Column:
    """The number in brackets that closes a block."""
    return extract(text, r"\((\d+)\)\s*$")


def chamber_key(legislature, issue, entry, title_normalized, date, author_names: Column) -> Column:
    """Key of a lower-chamber record: gazette coordinates, else title, date and authors."""
    legislature, issue, entry = as_col(legislature), as_col(issue), as_col(entry)
    exact = F.concat_ws(":", F.lit("diputados"), legislature, normalize_text(issue), entry)
    names = F.array_join(F.transform(author_names, normalize_text), "|")
    fallback = F.concat_ws(
        ":",
        F.lit("diputados:fallback"),
        as_col(title_normalized),
        F.coalesce(as_col(date), F.lit("no-date")),
        F.when(names != "", names).otherwise("no-authors"),
    )
    complete = legislature.isNotNull() & issue.isNotNull() & entry.isNotNull()
    return F.when(complete, exact).otherwise(fallback)


def senate_key(document_id, title_normalized, date, entry_index) -> Column:
    """Key of a senate gazette record: document and entry, else title, date and entry."""
    index = as_col(entry_index).cast("string")
    return F.when(
        as_col(document_id).isNotNull(),
        F.concat_ws(":", F.lit("senado:documento"), as_col(document_id), F.lit("entrada"), index),
    ).otherwise(
        F.concat_ws(
            ":",
            F.lit("senado:fallback"),
            as_col(title_normalized),
            F.coalesce(as_col(date), F.lit("no-date")),
            index,
        )
    )


def transparency_key(url, title_normalized, date, row_index) -> Column:
    address = as_col(url)
    usable = address.isNotNull() & (address != "") & (address != TRANSPARENCY_PAGE)
    fallback = F.concat_ws(
        ":",
        F.lit("senado_transparencia:fallback"),
        as_col(title_normalized),
        F.coalesce(as_col(date), F.lit("no-date")),
        as_col(row_index).cast("string"),
    )
    return F.when(usable, F.concat(F.lit("senado_transparencia:"), address)).otherwise(fallback)


def open_data_key(url, row_id, row_index) -> Column:
    fallback = F.concat_ws(
        ":", F.lit("senado_datos_abiertos:fallback"), as_col(row_id), as_col(row_index).cast("string")
    )
    return F.coalesce(F.concat(F.lit("senado_datos_abiertos:"), as_col(url)), fallback)


def page_kind(url: Column | str, label: Column | str, source: str) -> Column:
    """What a link leads to in one source; null for links that are not followed."""
    address, text = as_col(url), as_col(label)
    if source == "gaceta_senado":
        return (
            F.when(~is_senate_url(address), None)
            .when(matches(address, SENATE_DOCUMENT_PATH), "document")
            .when(matches(address, SENATE_SESSION_PATH), "session")
            .when(matches(text, "gaceta|calendario"), "index")
        )
    inside = address.startswith(BASE_URLS[source])
    if source == "gaceta_diputados":
        return (
            F.when(~inside, None)
            .when(matches(address, CHAMBER_DETAIL) | matches(text, r"^que\s+"), "detail")
            .when(matches(address, CHAMBER_INDEX) | matches(text, "legislatura|iniciativas"), "index")
        )
    return (
        F.when(~inside, None)
        .when(is_results_page(address), "results")
        .when(matches(text, PAGINATION_LABEL) | matches(address, PAGINATION_URL), "pagination")
    )


def content_hash(*parts: Column | str) -> Column:
    return sha256(F.concat_ws("|", *[as_col(p) for p in parts]))
