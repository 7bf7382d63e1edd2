"""Stored pages to element arrays: the one place where HTML is read in Python.

The standard library's tokenizer runs per Arrow batch inside the tasks. It only yields elements
with their text and attributes; every rule about them is a column expression.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# --- fixed values: how HTML closes elements, and what the rules look at ------------------------
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
    "main nav ol p pre section table ul".split()
)
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
KEPT = frozenset("h1 h2 h3 b strong title meta p div span li dt dd tr td a".split())
CONTAINERS = frozenset("li article section div tr".split())
MARKED = frozenset("titulo title encabezado objeto descripcion sinopsis resumen".split())
# --- end of fixed values ----------------------------------------------------------------------

FIELD_NAMES = (
    "tag", "text", "href", "onclick", "marks", "name", "content", "parents", "follows", "cells", "data_cells",
    "links", "html", "container",
)
LISTS = frozenset(("marks", "cells", "data_cells", "links"))
ELEMENT = "struct<" + ", ".join(f"{n}: {'array<string>' if n in LISTS else 'string'}" for n in FIELD_NAMES) + ">"
#: Tags without attributes in their usual spelling; none of them switches the tokenizer to raw text.
PLAIN_TAGS = KEPT - {"title"} | CLOSES_PARAGRAPH - {"hr"}
PLAIN_START, PLAIN_END = re.compile("<([a-z][a-z0-9]*)>"), re.compile("</([a-z][a-z0-9]*)>")


def _squeeze(text: str) -> str:
    return " ".join(text.replace("\ufeff", " ").split())


class _Element:
    """A tag with the span of text pieces and of source it covers; ``path`` spells the tags it lies in."""

    __slots__ = ("tag", "attrs", "up", "path", "begin", "start", "end", "stop")


class _Reader(HTMLParser):
    """Flat list of elements, each with the span of text pieces it covers."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[_Element] = []
        self.pieces: list[str] = []
        self.in_body: list[bool] = []
        self.stack: list[_Element] = []
        self.open: Counter[str] = Counter()
        self.cells: dict[int, list[_Element]] = {}
        self.anchors: dict[int, list[str]] = {}
        self.texts: dict[tuple[int, int], str] = {}
        self.at = 0
        self.feed(source)
        self.close()
        while self.stack:
            self._pop(len(source))

    def updatepos(self, i, j):
        """Offsets are asked for, not lines."""
        if j > i:
            self.at += j - i
        return j

    def parse_starttag(self, i):
        plain = PLAIN_START.match(self.rawdata, i)
        if plain is None or plain[1] not in PLAIN_TAGS:
            return super().parse_starttag(i)
        self.lasttag = plain[1]
        self.handle_starttag(plain[1], ())
        return plain.end()

    def parse_endtag(self, i):
        plain = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if plain is None or plain[1] not in PLAIN_TAGS:
            return super().parse_endtag(i)
        self.handle_endtag(plain[1])
        return plain.end()

    def _pop(self, offset: int) -> None:
        element = self.stack.pop()
        self.open[element.tag] -= 1
        element.end, element.stop = len(self.pieces), offset

    def _close_through(self, tags, barriers=()) -> None:
        if not any(self.open[tag] for tag in tags):
            return
        for depth in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[depth].tag
            if tag in barriers:
                return
            if tag in tags:
                while len(self.stack) > depth:
                    self._pop(self.at)
                if not barriers:
                    return

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_PARAGRAPH:
            self._close_through(("p",), {"table", "td", "th", "button"})
        if tag in SIBLINGS:
            self._close_through(*SIBLINGS[tag])
        element = _Element()
        element.tag, element.attrs = tag, dict(attrs)
        element.up = self.stack[-1] if self.stack else None
        element.path = f"{element.up.path}{element.up.tag} " if element.up else " "
        element.begin = element.end = len(self.pieces)
        element.start = element.stop = self.at
        self.elements.append(element)
        if self.open["tr"]:
            self._tell_rows(element)
        if tag not in VOID:
            self.stack.append(element)
            self.open[tag] += 1

    def _tell_rows(self, element: _Element) -> None:
        """Table rows know the cells and the links in them."""
        tag, attrs = element.tag, element.attrs
        link = attrs.get("href") if tag == "a" else None
        link = link or (attrs.get("onclick") if tag in ("a", "img") else None)
        if not link and tag not in ("td", "th"):
            return
        for above in self.stack:
            if above.tag == "tr":
                if tag in ("td", "th"):
                    self.cells.setdefault(id(above), []).append(element)
                if link:
                    self.anchors.setdefault(id(above), []).append(link)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("div", "p", "span", "a", "li", "td", "tr"):
            self._pop(self.at)

    def handle_endtag(self, tag):
        if self.open[tag]:
            self._close_through((tag,))

    def handle_data(self, data):
        opened = self.open
        if not (opened["script"] or opened["style"]):
            self.pieces.append(data)
            self.in_body.append(not (opened["head"] or opened["title"]))

    def text(self, element: _Element) -> str:
        """Text of an element on one line; a cell, its row's list and its links ask for the same span."""
        span = element.begin, element.end
        if span not in self.texts:
            self.texts[span] = _squeeze("".join(self.pieces[element.begin : element.end]))
        return self.texts[span]


def _describe(source: str, tags: frozenset[str] | None = None, fields: frozenset[str] = frozenset(FIELD_NAMES)) -> tuple[list[tuple], str]:
    """Elements of a page that some rule may ask for, in the order of ``FIELD_NAMES``, and its body text.

    With ``tags`` only elements of these tags; a field not asked for by ``fields`` is null.
    """
    reader = _Reader(source)
    body = _squeeze("".join(p for p, b in zip(reader.pieces, reader.in_body) if b))
    follows, later = {}, {}
    if "follows" in fields and any(e.tag == "dt" for e in reader.elements):
        for element in reversed(reader.elements):
            if element.tag == "dt":
                follows[id(element)] = later.get(element.path)
            later[element.path] = element
    out = []
    for element in reader.elements:
        tag, attrs = element.tag, element.attrs
        if tags is not None and tag not in tags:
            continue
        marks = [m.lower() for m in (attrs.get("class") or "").split()] + [(attrs.get("id") or "").lower()] if attrs else []
        marks = [m for m in marks if m in MARKED]
        if tag not in KEPT and not marks:
            continue
        row = dict.fromkeys(FIELD_NAMES)
        row["tag"], row["marks"] = tag, marks
        if "text" in fields:
            row["text"] = reader.text(element)
        if attrs:
            row["href"], row["onclick"], row["name"], row["content"] = attrs.get("href"), attrs.get("onclick"), attrs.get("name"), attrs.get("content")
        if "parents" in fields:
            row["parents"] = element.path if element.up else "  "
        if tag == "tr":
            inner = reader.cells.get(id(element), [])
            if "cells" in fields:
                row["cells"] = [reader.text(c) for c in inner]
            if "data_cells" in fields:
                row["data_cells"] = [reader.text(c) for c in inner if c.tag == "td"]
            row["links"] = reader.anchors.get(id(element), [])
            if "html" in fields:
                row["html"] = source[element.start : element.stop]
        elif tag == "dt":
            after = follows.get(id(element))
            if after is not None and after.tag == "dd":
                row["follows"] = reader.text(after)
        elif tag == "a" and attrs.get("href") and "container" in fields:
            holder = element.up
            while holder is not None and holder.tag not in CONTAINERS:
                holder = holder.up
            row["container"] = "" if holder is None else reader.text(holder)
        out.append(tuple(row.values()))
    return out, body


TEXT_LIST = pa.list_(pa.string())
FIELDS = {name: TEXT_LIST if name in LISTS else pa.string() for name in FIELD_NAMES}
TEXT, CONTAINER = FIELD_NAMES.index("text"), FIELD_NAMES.index("container")


BATCH_CHARS = 1 << 20


def _attempt(html: str, *asked: frozenset[str] | None) -> tuple[list[tuple], str, str | None]:
    """Elements, body text and what went wrong: a page whose markup cannot be read has no elements."""
    try:
        return *_describe(html, *asked), None
    except Exception as error:  # whatever the tokenizer stumbles on is the page's own outcome, not the job's
        return [], "", f"{type(error).__name__}: {error}"


def with_elements(pages: DataFrame, tags: Iterable[str] | None = None, fields: Iterable[str] = FIELD_NAMES) -> DataFrame:
    """Pages with ``elements`` (in document order) and ``body`` text in place of the HTML.

    A caller that asks for some ``tags`` or ``fields`` only gets just these (other fields may be null), as Catalyst cannot prune what
    Python makes. A page whose markup cannot be read has no elements and an empty body; ``read_errors`` says why. Output goes on
    every million characters of markup or of described text, so a task holds that much and one page at a time.
    """
    asked = (None if tags is None else frozenset(tags), frozenset(fields))
    kept = [f for f in pages.schema.fields if f.name != "html"]
    names = [f.name for f in kept]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def part(batch: pa.RecordBatch, described: list[tuple[list[tuple], str]]) -> pa.RecordBatch:
        offsets = [0]
        for elements, _ in described:
            offsets.append(offsets[-1] + len(elements))
        arrays = [pa.array([e[i] for elements, _ in described for e in elements], kind) for i, kind in enumerate(FIELDS.values())]
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(arrays, names=list(FIELDS)))
        bodies = pa.array([body for _, body in described], pa.string())
        return pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], lists, bodies], names=[*names, "elements", "body"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, size, described = 0, 0, []
            for i, html in enumerate(batch.column("html")):
                text = html.as_py() or ""
                described.append(_attempt(text, *asked)[:2])
                # Every link repeats its container and nested elements repeat their text.
                size += len(text) + sum(len(e[TEXT] or "") + len(e[CONTAINER] or "") for e in described[-1][0])
                if size >= BATCH_CHARS:
                    yield part(batch.slice(first, i + 1 - first), described)
                    first, size, described = i + 1, 0, []
            if described:
                yield part(batch.slice(first), described)

    return pages.mapInArrow(read, f"{schema}, elements array<{ELEMENT}>, body string")


def read_errors(pages: DataFrame) -> DataFrame:
    """(url, html, error): why the markup of a page cannot be read, null where it can."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [_attempt(html.as_py() or "")[2] for html in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("url"), batch.column("html"), pa.array(errors, pa.string())], names=["url", "html", "error"]
            )

    return pages.select("url", "html").mapInArrow(read, "url string, html string, error string")
