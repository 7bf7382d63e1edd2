"""Main text of web pages by inferred wrappers.

Pages of one host come from the same templates. A page is a stream of tags and texts in which
repeated groups are folded into one; streams of a host are aligned one after the other, tags or groups that
only some have become optional, and texts that differ become slots. What stays the same text in
the same place of all pages is the template's own, and is not part of an article.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table

PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)([^>]*)>|<[!?][^>]*>|[^<]+|<", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

# Fixed value lists of HTML: elements without content, and those that end a block of text.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
OUTSIDE = frozenset("aside button dialog footer form head header menu nav select".split())
#: Words of class, id and role that name what is no article.
OTHER = frozenset(
    "ad ads advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header masthead menu modal nav navbar navigation "
    "newsletter notice popup promo promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
SURE = 3
HOSTS_HELD = 500
LONGEST_GROUP = 6


def pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of a page: ``open`` and ``close`` tags and ``text``; comments and raw elements are passed over."""
    for m in PIECES.finditer(page):
        if m.group(3):
            yield ("close" if m.group(2) else "open", m.group(3).lower(), m.group(4))
        elif m.group(0)[0] != "<" or m.group(0) == "<":
            yield ("text", "", m.group(0))


def aside(name: str, attributes: str) -> bool:
    if name in OUTSIDE:
        return True
    return any(w in OTHER for m in ATTRIBUTE.finditer(attributes) for w in re.split(r"[\W_]+", (m.group(2) or m.group(3) or m.group(4) or "").lower()))


def blocks(page: str) -> Iterator[tuple[str, str, bool]]:
    """(path, text, wanted) of each block of text in page order; ``path`` is its open block elements.

    Texts inside one block run together; white space is one space. Wanted is what stands inside an
    article or main element, if the page has any, and not inside an element that names another part.
    """
    inner = re.search(r"<(?:article|main)\b", page, re.IGNORECASE) is not None
    open_, text = [], []  # (name, whether it is another part, whether it is an article)

    def ended() -> Iterator[tuple[str, str, bool]]:
        words = " ".join("".join(text).split())
        text.clear()
        if words:
            good = not any(o[1] for o in open_) and (not inner or any(o[2] for o in open_))
            yield "/".join(o[0] for o in open_ if o[0] in BLOCK), words, good

    for kind, name, rest in pieces(page):
        if kind == "text":
            text.append(html.unescape(rest))
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            yield from ended()
        if kind == "open":
            if name in BLOCK and name not in ("body", "html"):  # a block ends an open paragraph
                for at in range(len(open_) - 1, -1, -1):
                    if open_[at][0] == "p":
                        del open_[at:]
                        break
                    if open_[at][0] in BLOCK:
                        break
            if name not in VOID and not rest.endswith("/"):
                open_.append((name, aside(name, rest), name in ("article", "main")))
        else:
            for at in range(len(open_) - 1, -1, -1):
                if open_[at][0] == name:
                    del open_[at:]
                    break
    yield from ended()


def stream(page: str) -> list:
    """A page as [path, text number or None] with neighbouring repeats of up to six blocks folded into one of slots."""
    out: list = []
    for path, text, _ in blocks(page):
        out.append([path, zlib.crc32(text.encode("utf-8", "replace"))])
        for n in range(1, LONGEST_GROUP + 1):
            if len(out) >= 2 * n and [t[0] for t in out[-n:]] == [t[0] for t in out[-2 * n : -n]]:
                del out[-n:]
                for t in out[-n:]:
                    t[1] = None
                break
    return out


def aligned(a: dict, b: dict) -> dict:
    """One wrapper of two: tokens of both in order, optional where only one has them, slots where texts differ.

    A wrapper is ``n``, how many different streams it is of, and tokens [path, text or None, optional]. Equal
    streams, as copies of a page give, count once.
    """
    if a["tokens"] == b["tokens"]:
        return a if a["n"] >= b["n"] else b
    x, y = a["tokens"], b["tokens"]
    out = []
    for kind, i, j, k, m in SequenceMatcher(None, [t[0] for t in x], [t[0] for t in y], autojunk=False).get_opcodes():
        if kind == "equal":
            out += [[s[0], s[1] if s[1] == t[1] else None, s[2] or t[2]] for s, t in zip(x[i:j], y[k:m], strict=True)]
        else:
            out += [[t[0], None, True] for t in x[i:j] + y[k:m]]
    folded: list = []  # optional parts of many pages repeat: they are folded like a page's
    for t in out:
        if folded and t[2] and folded[-1][2] and folded[-1][0] == t[0]:
            folded[-1][1] = None
        else:
            folded.append(t)
    return {"n": a["n"] + b["n"], "tokens": folded}


WRAPPER_DDL = "host string, wrapper string"


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), F.lit(""))


def wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, from all of its pages.

    A task aligns the pages it reads before anything is shuffled, so a host with a third of all pages
    sends one wrapper a task; those are then aligned per host.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                one = {"n": 1, "tokens": [[p, t, False] for p, t in stream(page.as_py() or "")]}
                held[host] = aligned(held[host], one) if host in held else one
            if len(held) > HOSTS_HELD:
                yield _sent(held)
                held = {}
        yield _sent(held)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}
        for batch in batches:
            for host, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                one = json.loads(text)
                if host not in held and held:  # sorted by host: the one before is complete
                    yield _sent(held)
                    held = {}
                held[host] = aligned(held[host], one) if host in held else one
        yield _sent(held)

    sent = pages.select("host", "html").mapInArrow(read, WRAPPER_DDL)
    return sent.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(join, WRAPPER_DDL)


def _sent(held: dict[str, dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w in held.values()], pa.string())], names=["host", "wrapper"])


def main_text(page: str, wrapper: dict | None) -> str:
    """The wanted blocks of a page that are not its template's own, two line ends between them."""
    own = {(path, text) for path, text, optional in wrapper["tokens"] if text is not None and not optional} if wrapper and wrapper["n"] >= SURE else set()
    return "\n\n".join(t for path, t, good in blocks(page) if good and (not own or (path, zlib.crc32(t.encode("utf-8", "replace"))) not in own))


def extracted(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url and ``text``, the article's blocks.

    Defined cases: null or empty html, and pages without article, give the empty text; a null url, or one
    without a host, belongs to the host ""; rows that repeat give their text each. Fewer than three different pages of a host
    tell nothing about its template, and no text is taken for it.
    """
    scratch = Scratch(pages.sparkSession)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    learned = scratch.table(wrappers(rows))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[str | None, dict | None] = (None, None)
        for batch in batches:
            out = []
            for page, text in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                if text != known[0]:
                    known = (text, json.loads(text) if text else None)
                out.append(main_text(page.as_py() or "", known[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    joined = rows.join(learned, "host", "left").select("page_id", "url", "html", "wrapper")
    kind = pages.schema["page_id"].dataType.simpleString()
    result = scratch.kept(joined.mapInArrow(read, f"page_id {kind}, url string, text string"))
    scratch.drop()
    return result


@query()
def op7_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """The article of every page."""
    return extracted(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
