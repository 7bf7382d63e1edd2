"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio.

One model is of random strings, learned from the values that the fixed patterns find anywhere in the
corpus; the other is of ordinary text, learned from all that lies outside long tokens. A token that the first explains far
better than the second is a secret that no pattern names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table, texts
from curul.llm.words import slices

# Fixed: the contract's patterns, their order and least lengths.
KINDS = (
    ("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]{24,}"), 0, 24),
)
#: Long tokens; bare numbers, as of cards and accounts, are no keys.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])(?![0-9-]+(?![A-Za-z0-9+/_=-]))[A-Za-z0-9+/_=-]{16,}")

#: Letters by class: the token alphabet, then all others as one.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CLASSES = len(ALPHABET) + 1
CLASS = np.full(256, CLASSES - 1, np.int64)
CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))

SPAN = "struct<kind: string, start: long, stop: long, value: string>"
SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("value", pa.string())]))


def found(text: str) -> tuple[list[dict], list[dict]]:
    """Spans of the fixed kinds, by start and kind, and the other tokens of the alphabet long enough to be secrets."""
    spans = [
        {"kind": kind, "start": m.start(), "stop": m.end(), "value": m.group(group)}
        for kind, pattern, group, least in KINDS for m in pattern.finditer(text) if len(m.group(group)) >= least
    ]
    spans.sort(key=lambda s: s["start"])  # stable: kinds stay in their order
    taken = [(s["start"], s["stop"]) for s in spans]
    rest = [
        {"kind": "markov", "start": m.start(), "stop": m.end(), "value": m.group()}
        for m in TOKEN.finditer(text) if not any(a < m.end() and m.start() < b for a, b in taken)
    ]
    return spans, rest


def pairs_of(value: str) -> np.ndarray:
    """Counts of neighbouring characters of a token."""
    c = CLASS[np.frombuffer(value.encode(), np.uint8)]
    return np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)


def candidates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, spans and rest; and, in rows of their own, counts of neighbouring characters of all text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        names = ["doc_id", "spans", "rest", "pairs"]
        for batch in batches:
            for _, data, _ in slices(batch.column(1)):
                c = CLASS[data]
                pairs += np.bincount(c[:-1] * CLASSES + c[1:], minlength=len(pairs)) if len(c) > 1 else 0
            out = [found(t.as_py() or "") for t in batch.column(1)]
            # Ordinary text is what lies outside named and long tokens: a secret doesn't vouch for itself.
            for value in (s["value"] for o in out for part in o for s in part):
                pairs -= pairs_of(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], SPAN_TYPE), pa.array([o[1] for o in out], SPAN_TYPE), pa.nulls(len(out), pa.list_(pa.int64()))], names=names
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, SPAN_TYPE), pa.nulls(1, SPAN_TYPE), pa.array([pairs.tolist()], pa.list_(pa.int64()))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, f"doc_id long, spans array<{SPAN}>, rest array<{SPAN}>, pairs array<long>")


def learned(scanned: DataFrame) -> np.ndarray:
    """Log-likelihood ratio of each pair of neighbouring characters: random against ordinary.

    Counts are over all documents and of a fixed size. Values found many times count once.
    """
    values = scanned.select(F.explode("spans").alias("s")).select("s.value").distinct()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for value in batch.column(0):
                pairs += pairs_of(value.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tolist()], pa.list_(pa.int64()))], names=["pairs"])

    def total(rows: DataFrame) -> np.ndarray:
        out = np.zeros((CLASSES, CLASSES))
        # One row per first character, with its counts as columns: a task sends on as many rows as there are classes.
        lines = F.transform(F.sequence(F.lit(0), F.lit(CLASSES - 1)), lambda c: F.slice("pairs", c * CLASSES + 1, F.lit(CLASSES)))
        by_first = rows.select(F.posexplode(lines).alias("first", "n")).groupBy("first").agg(*(F.sum(F.col("n")[c]).alias(f"n{c}") for c in range(CLASSES)))
        for r in by_first.collect():
            out[r["first"]] = r[1:]
        return out

    random, ordinary = total(values.mapInArrow(count, "pairs array<long>")), total(scanned.where("pairs is not null"))
    random[:-1, :-1] += 4 / CLASSES  # even odds over the alphabet, for what no value showed

    def model(counts: np.ndarray) -> np.ndarray:
        # Pairs that are seldom or never seen follow the single characters' shares.
        counts = np.maximum(counts, 0)
        single = counts.sum(axis=0) + 0.5
        return (counts + 20 * single / single.sum()) / (counts.sum(axis=1, keepdims=True) + 20)

    return np.log(model(random)) - np.log(model(ordinary))


def secret_spans(docs: DataFrame, least: float = 20.0, each: float = 1.0) -> DataFrame:
    """Per row: doc_id and ``spans`` (kind, start, stop, value), fixed kinds and ``markov``, by start.

    A token is a secret if its log-likelihood ratio is ``least`` or more and ``each`` a character. Positions are code
    points, the end exclusive. Null and empty texts have no spans; rows that repeat are scanned each.
    """
    scratch = Scratch(docs.sparkSession)
    scanned = scratch.table(candidates(docs))
    ratio = learned(scanned)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for spans, rest in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for s in rest:
                    c = CLASS[np.frombuffer(s["value"].encode(), np.uint8)]
                    score = ratio[c[:-1], c[1:]].sum()
                    if score >= least and score >= each * (len(c) - 1):
                        spans.append(s)
                out.append(sorted(spans, key=lambda s: s["start"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, SPAN_TYPE)], names=["doc_id", "spans"])

    result = scratch.kept(scanned.where("pairs is null").select("doc_id", "spans", "rest").mapInArrow(judge, f"doc_id long, spans array<{SPAN}>"))
    scratch.drop()
    return result


@query()
def op3_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in all documents."""
    rows = secret_spans(texts(table(spark, folder, "documents")))
    shown = "concat_ws(',', transform({}, s -> concat(s.kind, ':', s.start, ':', s.stop)))"
    base = "filter(spans, s -> s.kind <> 'markov')"
    return rows.select(
        "doc_id",
        *(F.expr(f"cast(size(filter(spans, s -> s.kind = '{kind}')) as bigint)").alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(F.expr(shown.format(base)), 256).alias("base_sha256"),
        F.expr(shown.format("spans")).alias("spans"),
    )
