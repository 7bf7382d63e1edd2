"""Toxicity scores from a learned lexicon, fuzzy matching and context windows.

Terms and word stems that mark toxic rows are learned from labels and kept in a trie. A token is run
against the trie with the rows of a Levenshtein automaton, so a misspelled term is found in one
walk. Each match is weighed by term, distance and by whether its context window quotes or uses it;
the weights are log-odds measured on the labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table, texts

FOLDS = 5
SAMPLE = 12_000
TOKEN = re.compile(r"[^\W_]+")
STEM = (4, 8)
FUZZY_FROM = 5
KNOWN_TOKENS = 500_000
CONTEXT = 3
# Fixed word list: what announces that somebody else's words follow.
REPORTING = {"said", "says", "called", "calls", "word", "term", "quote", "quoted", "wrote", "dit", "mot", "dijo", "palabra", "sagte", "wort"}
QUOTES = "\"“”„«»‘’"

Entry = tuple[str, bool]  # text, whether it is a stem


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0


def features(text: str) -> set[Entry]:
    """Words of a text and the stems they begin with."""
    out: set[Entry] = set()
    for word in set(TOKEN.findall(text.lower())):
        out.add((word, False))
        out.update((word[:n], True) for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))
    return out


class Lexicon:
    """A trie of terms and stems, walked by a token's Levenshtein automaton of distance one."""

    def __init__(self, entries: list[Entry]):
        self.root: dict = {}
        self.known: dict[str, tuple] = {}
        for text, stem in entries:
            node = self.root
            for letter in text:
                node = node.setdefault(letter, {})
            node[stem] = text  # keys True and False never meet letters
        longer = [t for t, _ in entries if len(t) >= FUZZY_FROM]
        # One edit leaves the first two letters or the three after them as they are, at most one place off.
        self.heads = {t[:2] for t in longer}
        self.middles = {t[2:5] for t in longer}

    def near(self, token: str) -> tuple:
        """(term, distance) of every entry that the token matches, the nearest per entry; remembered per token."""
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= KNOWN_TOKENS:
                self.known.clear()
            self.known[token] = got = self._walk(token)
        return got

    def _walk(self, token: str) -> tuple:
        found: dict[str, int] = {}
        node = self.root
        for i, letter in enumerate(token):
            node = node.get(letter)
            if node is None:
                break
            if True in node:
                found[node[True]] = 0
            if i + 1 == len(token) and False in node:
                found[node[False]] = 0
        if not found and len(token) >= FUZZY_FROM - 1 and (token[:2] in self.heads or any(token[k : k + 3] in self.middles for k in (1, 2, 3))):
            self._fuzzy(token, found)
        return tuple(found.items())

    def _fuzzy(self, token: str, found: dict[str, int]) -> None:
        """States are (place in the trie, letters read, edits so far, depth); one edit is a letter more, less or changed."""
        n, todo = len(token), [(self.root, 0, 0, 0)]
        while todo:
            node, i, edits, depth = todo.pop()
            if edits and depth >= FUZZY_FROM:
                if True in node:
                    found.setdefault(node[True], 1)
                if i == n and False in node:
                    found.setdefault(node[False], 1)
            if i < n and token[i] in node:
                todo.append((node[token[i]], i + 1, edits, depth + 1))
            if not edits:
                if i < n:
                    todo.append((node, i + 1, 1, depth))
                for letter, below in node.items():
                    if letter is not True and letter is not False:
                        todo.append((below, i, 1, depth + 1))
                        if i < n and letter != token[i]:
                            todo.append((below, i + 1, 1, depth + 1))


def places(text: str) -> set[tuple[str, int]]:
    """Each feature of a text with a hash of the words around it.

    Copies of a text repeat its places, so a word that is common only because its text was copied has few.
    """
    words = ["", *TOKEN.findall(text.lower()), ""]
    out = set()
    for before, word, after in zip(words, words[1:], words[2:], strict=False):
        at = zlib.crc32(f"{before} {word} {after}".encode())
        out.add((f"0{word}", at))
        out.update((f"1{word[:n]}", at) for n in range(STEM[0], min(STEM[1], len(word) - 1) + 1))
    return out


def matches(text: str, lexicon: Lexicon) -> set[str]:
    """What a text shows: ``term/distance/use`` or ``term/distance/quote``, each once.

    A match is quoted if its window of three words on either side holds a quotation mark on both
    sides of it or a reporting word before it.
    """
    text = text.lower()
    words = TOKEN.findall(text)
    hits = {w for w in set(words) if lexicon.near(w)}
    if not hits:
        return set()
    out = set()
    spans = list(TOKEN.finditer(text))
    for i, m in enumerate(spans):
        if m.group() in hits:
            left = text[spans[max(0, i - CONTEXT)].start() : m.start()]
            right = text[m.end() : spans[min(len(spans) - 1, i + CONTEXT)].end()]
            quoted = any(q in left for q in QUOTES) and any(q in right for q in QUOTES) or any(words[j] in REPORTING for j in range(max(0, i - CONTEXT), i))
            out.update(f"{term}/{distance}/{'quote' if quoted else 'use'}" for term, distance in lexicon.near(m.group()))
    return out


def _counted(rows: DataFrame, shown) -> dict[str, tuple[int, int]]:
    """In how many toxic and other rows each shown thing is; summed within a task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                totals[toxic].update(shown(text.as_py() or ""))
        names = sorted(set(totals[0]) | set(totals[1]))
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([totals[y][n] for n in part], pa.int64()) for y in (1, 0))], names=["name", "pos", "neg"])

    out = rows.select("text", "toxic").mapInArrow(count, "name string, pos long, neg long")
    return out.groupBy("name").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _log_odds(pos: float, neg: float, toxic: int, other: int) -> float:
    return math.log((pos + 0.5) / (toxic + 1)) - math.log((neg + 0.5) / (other + 1))


def _surprise(pos: int, neg: int, base: float) -> float:
    """Minus the log of a bound on the chance of so many toxic rows among pos + neg (Chernoff)."""
    q = pos / (pos + neg)
    return (pos + neg) * sum(p * math.log(p / b) for p, b in ((q, base), (1 - q, 1 - base)) if p > 0)


class Model:
    """Lexicon, weights and the two base rates of a fitted scorer; small, and the same for every row."""

    def __init__(self, entries: list[Entry], weights: dict[str, float], prior: float, none: float):
        self.entries, self.weights, self.prior, self.none = entries, weights, prior, none

    def scorer(self):
        lexicon = Lexicon(self.entries)

        def score(text: str) -> float:
            shown = [self.weights[m] for m in matches(text, lexicon) if m in self.weights]
            if not shown:
                return self.none
            z = max(-30.0, min(30.0, self.prior + sum(shown)))
            return 1 / (1 + math.exp(-z))

        return score


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, share: float = 0.01, ratio: float = 20.0, doubt: float = 0.01) -> Model:
    """Learn from at most ``sample`` labelled rows outside the held-out fold, chosen by a hash of doc_id.

    An entry is at three different places at least, and at ``share`` as many as there are toxic rows, is ``ratio`` times as common there as in
    other rows, and would be so by chance, among all words tried, with a probability below ``doubt``. The
    share bounds the candidates by words per row / share, whatever the corpus holds.
    With labels of one kind only, or none, every score is the base rate, one half if nothing is known.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"))  # ``sample`` rows of two numbers
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        scratch.drop()
        return Model([], {}, 0.0, (toxic + 0.5) / (toxic + other + 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = list(places(text.as_py() or ""))
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["name", "place"])

    least = max(3, math.ceil(share * toxic))
    spread = rows.where("toxic = 1").select("text").mapInArrow(placed, "name string, place long").distinct().groupBy("name").agg(F.count("*").alias("n"))
    support = {r["name"]: r["n"] for r in spread.where(f"n >= {least}").collect()}
    wanted = set(support)
    counted = {r["name"]: (r["pos"], r["neg"]) for r in _counted(rows, lambda t: {f"{int(stem)}{w}" for w, stem in features(t)} & wanted).collect()}
    surprise = math.log(max(1, len(counted)) / doubt)
    base = toxic / (toxic + other)
    strong = {
        n for n, (pos, neg) in counted.items()
        if pos and _log_odds(pos, neg, toxic, other) >= math.log(ratio) and _surprise(min(pos, support[n]), neg, base) >= surprise
    }
    # The longest form that is as common says most; an entry that a remaining stem covers says nothing more.
    longer: dict[str, int] = {}
    for n in strong:
        for k in range(STEM[0], len(n) - 1 + (n[0] == "0")):
            longer[n[1 : k + 1]] = max(longer.get(n[1 : k + 1], 0), counted[n][0])
    best = {n for n in strong if n[0] == "0" or longer.get(n[1:], 0) < 0.9 * counted[n][0]}
    entries = [(n[1:], n[0] == "1") for n in sorted(best) if not any(f"1{n[1 : k + 1]}" in best for k in range(STEM[0], len(n) - 1 + (n[0] == "0")))]

    def shown():
        lexicon = Lexicon(entries)
        return lambda t: matches(t, lexicon) or {""}

    ready = {}

    def once(t: str) -> set[str]:
        if "shown" not in ready:
            ready["shown"] = shown()
        return ready["shown"](t)

    seen = {r["name"]: (r["pos"], r["neg"]) for r in _counted(rows, once).collect()}  # four for each entry at most
    scratch.drop()
    bare = seen.pop("", (0, 0))
    # A misspelling of a term is believed on evidence of its own.
    weights = {
        n: _log_odds(pos, neg, toxic, other) for n, (pos, neg) in seen.items()
        if "/0/" in n or pos and _log_odds(pos, neg, toxic, other) >= math.log(ratio) and _surprise(pos, neg, base) >= surprise
    }
    return Model(entries, weights, math.log((toxic + 0.5) / (other + 0.5)), (bare[0] + 0.5) / (sum(bare) + 1))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with ``score``: whole texts, one after the other; null is the empty text."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            values = [of(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def filtered(docs: DataFrame, model: Model, most: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``most``, whole and in their own columns."""
    names = docs.columns
    inner = docs.toDF(*(f"c{i}" for i in range(len(names))))  # clashing names would be ambiguous
    at = names.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(t.as_py() or "") < most for t in batch.column(at)], pa.bool_()))

    return inner.mapInArrow(keep, inner.schema).toDF(*names)


@query()
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = texts(table(spark, folder, "documents"))
    model = fit(docs, table(spark, folder, "labels"))
    return scored(docs, model).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
