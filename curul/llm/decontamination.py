"""Benchmark decontamination as a prefix-filtered set join.

Each benchmark item is cut into windows of 13 words (a shorter item is one window). A window's
shingles are ordered by their rarity in the corpus, and since a window must be contained whole, its
prefix is its rarest shingle alone: documents are joined to windows on that shingle, the shingle's
places give the only possible start, bounds drop starts outside the text, and the words themselves
are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curul.llm.common import Scratch, query, table, texts
from curul.llm.words import NOT_ALNUM, U64, Words, slices

WINDOW = 13
SHINGLE = 5
FILTER_BITS = 24

RUN_DDL = "doc_id long, text_hash long, n_words long, runs array<struct<start: long, size: int, words: array<string>>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int32()), ("words", pa.list_(pa.string()))]))


def words_of(text: Column) -> Column:
    """The contract's words of a short text, as an array: only ASCII letters are lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), upper, lower), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0))


def grams(words: str, size: str) -> str:
    """SQL: the runs of ``size`` words of an array, as texts in order."""
    return f"transform(sequence(0, size({words}) - {size}), i -> concat_ws(' ', slice({words}, i + 1, {size})))"


def windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, size, text, shingle size, shingles) of every distinct window of every item; items without words have none."""
    cut = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where("size(words) > 0")
    sized = cut.withColumn("size", F.least(F.size("words"), F.lit(window)))
    starts = sized.select("item_id", "size", "words", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("size"))).alias("from"))
    one = starts.select("item_id", "size", F.expr("slice(words, from + 1, size)").alias("words"))
    return one.select(
        "item_id", "size", F.least("size", F.lit(shingle)).alias("gram"), F.concat_ws(" ", "words").alias("window"), F.expr(grams("words", f"least(size, {shingle})")).alias("shingles")
    ).distinct()


def membership(shingles: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A bitmap of 2**bits places with the benchmark's shingles set.

    Its size is fixed by ``bits``, whatever the benchmark's: more shingles only let more documents'
    shingles through to the join, which decides. Hashing runs in tasks; the driver gets at most
    2**bits / 64 words of the bitmap.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch.column(0)):
                words = Words(data, offsets, NOT_ALNUM)
                out = []
                for size in np.unique(words.counts):
                    if size:
                        hashes, within = words.shingles(int(size))
                        out.append(hashes[within & (words.counts[words.row[: len(hashes)]] == size)])
                if out:
                    at = np.unique(np.concatenate(out) >> U64(64 - bits)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((at & 63).astype(np.int32))], names=["word", "bit"])

    found = shingles.select("shingle").mapInArrow(places, "word long, bit int").groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("set"))
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    for word, value in found.collect():
        bitmap[word] = value
    return bitmap


def shared_runs(docs: DataFrame, bitmap: np.ndarray, sizes: list[tuple[int, int]], bits: int = FILTER_BITS) -> DataFrame:
    """One row per document: its word count and the stretches of words that may hold a window.

    ``sizes`` are the (window, shingle) sizes there are. A window of 13 words needs nine shingles in a row that all
    pass the bitmap, so a stretch has at least that many; texts are read whole, in pieces of a few MB.
    """
    context = docs.sparkSession.sparkContext
    sent = context.broadcast(bitmap)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.view(np.uint64)
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets, NOT_ALNUM)
                row_start = np.concatenate([[0], np.cumsum(words.counts)])
                raw, runs = words.bytes.tobytes(), [[] for _ in range(len(offsets) - 1)]
                for size, gram in sizes:
                    hashes, within = words.shingles(gram)
                    at = hashes >> U64(64 - bits)
                    ok = within & ((place[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1)).astype(bool)
                    owner = np.concatenate([[0], np.where(ok, words.row[: len(ok)] + 1, 0), [0]])
                    turn = np.flatnonzero(np.diff(owner))  # stretches begin, end or pass into the next text here
                    for a, b in zip(turn[:-1], turn[1:], strict=True):
                        if owner[a + 1] and b - a >= size - gram + 1:
                            r = words.row[a]
                            spans = zip(words.starts[a : b + gram - 1].tolist(), words.stops[a : b + gram - 1].tolist(), strict=True)
                            runs[r].append({"start": int(a - row_start[r]), "size": size, "words": [raw[s:e].decode("utf-8", "replace") for s, e in spans]})
                n = len(runs)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, n), pa.array(np.arange(n)), pa.array(words.counts.astype(np.int64)), pa.array(runs, RUN_TYPE)], names=["doc_id", "text_hash", "n_words", "runs"]
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, RUN_DDL).drop("text_hash")


def occurrences(runs: DataFrame, cuts: DataFrame) -> DataFrame:
    """(row, start, size, item_id) of every place where a document holds a window."""
    stretches = runs.select("row", F.explode("runs").alias("run")).select("row", "run.*")
    gram = F.least("size", F.lit(SHINGLE))
    held = stretches.select("row", "start", "size", "words", F.posexplode(F.expr(grams("words", f"least(size, {SHINGLE})"))).alias("place", "shingle"))
    # How often each shingle of the benchmark is met in the corpus: combined before the shuffle.
    counts = held.groupBy("size", "shingle").agg(F.count("*").alias("met"))
    places = cuts.select("size", "window", F.posexplode("shingles").alias("offset", "shingle")).distinct().join(counts, ["size", "shingle"], "left")
    rarest = places.groupBy("size", "window").agg(F.min(F.struct(F.coalesce("met", F.lit(0)).alias("met"), "shingle", "offset")).alias("first"))
    needed = rarest.where("first.met > 0").select("size", "window", F.col("first.shingle").alias("shingle"), F.col("first.offset").alias("offset"))
    found = (
        held.withColumn("gram", gram)
        .join(needed, ["size", "shingle"])
        .where("place >= offset and place - offset + size <= size(words)")
        .where("concat_ws(' ', slice(words, place - offset + 1, size)) = window")
        .select("row", (F.col("start") + F.col("place") - F.col("offset")).alias("start"), "size", "window")
    )
    return found


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, share: int = 20) -> DataFrame:
    """Per row of ``docs``: words, hit words, items found and whether one word in ``share`` is hit.

    Defined cases: null text or text without words has none and is clean; items without words are
    never found; items that repeat count once by item_id; rows that repeat are judged each.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    cuts = scratch.table(windows(items, window))
    sizes = [(r["size"], r["gram"]) for r in cuts.select("size", "gram").distinct().collect()]  # ``window`` of them at most
    bitmap = membership(cuts.select(F.explode("shingles").alias("shingle")))
    runs = scratch.table(shared_runs(docs, bitmap, sizes).withColumn("row", F.monotonically_increasing_id()))
    found = scratch.table(occurrences(runs, cuts))
    # Words under any window: windows in order of their start, each adding what lies beyond the ones before.
    before = W.partitionBy("row").orderBy("start", "size").rowsBetween(W.unboundedPreceding, -1)
    reach = F.coalesce(F.max(F.col("start") + F.col("size")).over(before), F.lit(0))
    covered = (
        found.select("row", "start", "size").distinct().withColumn("fresh", F.greatest(F.lit(0), F.col("start") + F.col("size") - F.greatest("start", reach)))
        .groupBy("row").agg(F.sum("fresh").alias("n_hit"))
    )
    named = found.select("row", "size", "window").distinct().join(cuts.select("size", "window", "item_id"), ["size", "window"])
    names = named.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    none = F.array().cast("array<string>")
    result = (
        runs.select("row", "doc_id", "n_words").join(covered, "row", "left").join(names, "row", "left")
        .select(
            "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none).alias("items"),
        )
        .withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words")))
    )
    kept = scratch.kept(result)
    scratch.drop()
    return kept


SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


@query(
    f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS w FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {SQL_WORDS} AS w FROM benchmark),
     s AS (SELECT item_id, w, least(len(w), {WINDOW}) AS size FROM b WHERE len(w) > 0),
     x AS (SELECT DISTINCT item_id, size, list_aggregate(w[f : f + size - 1], 'string_agg', ' ') AS win
           FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS f FROM s)),
     g AS (SELECT doc_id, size, f, list_aggregate(w[f : f + size - 1], 'string_agg', ' ') AS win
           FROM (SELECT doc_id, w, z.size, unnest(range(1, len(w) - z.size + 2)) AS f FROM d, (SELECT DISTINCT size FROM x) z WHERE len(w) >= z.size)),
     h AS (SELECT g.doc_id, g.f, g.size, x.item_id FROM g JOIN x USING (size, win)),
     n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(f, f + size)) AS p FROM h) GROUP BY doc_id),
     i AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)"""
)
def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """All documents against all benchmark items."""
    judged = decontaminated(texts(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )
