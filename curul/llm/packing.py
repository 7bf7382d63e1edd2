"""Packing token sequences by cutting-stock column generation.

A document's ids are cut into full sequences and one remainder. Remainders are the items of a
one-dimensional cutting-stock problem: its linear program is over a histogram of length classes,
whose size is fixed whatever the corpus holds, and its columns are priced by a knapsack dynamic
program. Rounded patterns are handed to documents by their rank within a class, in joins.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import cache, reduce
from operator import and_

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curul.llm.common import Scratch, query, running, table, texts

SIZE = 2048
STEP = 8
END_ID = 1
WORDS_KEPT = 400_000

#: The character by which a byte-level vocabulary writes each byte: printable ones are themselves, the others follow U+0100.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = "".join(chr(b) if b in _SHOWN else chr(256 + sum(o not in _SHOWN for o in range(b))) for b in range(256))

PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Known(dict):
    """Values by key, each worked out when it is first asked for."""

    def __init__(self, work: Callable[[str], bytes]):
        self.work = work

    def __missing__(self, key: str) -> bytes:
        value = self[key] = self.work(key)
        return value

    def trim(self) -> None:
        """Beyond ``WORDS_KEPT``, all but the eldest go: frequent ones are met early."""
        if len(self) > WORDS_KEPT:
            while len(self) > WORDS_KEPT // 4:
                self.popitem()


class BlankAfterSpace(Exception):
    """A space before white space is no cut between pre-tokens."""


class Ids:
    """Ids of a byte-level BPE as little-endian 32-bit bytes.

    Text is cut before each space; a cut is also one between pre-tokens where no white space follows it, as a pre-token has
    a space only in front. Each distinct chunk between cuts is split into the vocabulary's pre-tokens, and each distinct one
    of these is encoded, once. Tables of at most ``WORDS_KEPT`` of either are kept, and of a text's own. A text with white
    space after a space is split whole; one that contains a special token's string goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        import regex

        self.tokenizer = Tokenizer.from_file(path)
        self.tokens = self.tokenizer.model.tokenize
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.blank = regex.compile(r"\s").match
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.chunks = Known(self._word), Known(self._chunk)

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        ids = [t.id for t in self.tokens(word.encode().decode("latin-1").translate(BYTE_CHARS))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        # Letters alone are one pre-token; later blocks than these are left to the pattern's own tables.
        if chunk.isalpha() and max(chunk) < "\u0250":
            return self.words[" " + chunk]
        if not chunk or chunk[0].isspace() or self.blank(chunk):
            raise BlankAfterSpace
        return self._split(" " + chunk)

    def _split(self, text: str) -> bytes:
        words = self.words
        return b"".join([words[w] for w in self.split(text)])

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._encode(text)
        first, *rest = text.split(" ")
        chunks = self.chunks
        try:
            out = self._split(first) + b"".join([chunks[c] for c in rest])
        except BlankAfterSpace:
            out = self._split(text)
        chunks.trim()
        self.words.trim()
        return out


@cache
def ids_of(path: str) -> Ids:
    """One for a Python worker, whose tasks share what it has encoded."""
    return Ids(path)


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """Full pieces of ``size`` ids and one remainder per document, each with its ids' CRC-32.

    Null and empty texts are the end id alone. Cuts depend on the document only, so ids are
    made once, and neither ids nor texts are shuffled.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(text.as_py() or "") + end
                n = len(data) // 4
                out += [(doc, at, min(size, n - at), zlib.crc32(data[4 * at : 4 * (at + size)]), n) for at in range(0, n, size)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, PIECE_DDL)


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: class i weighs i + 1 and is worth ``values[i]``; how often each is taken."""
    best = np.zeros(capacity + 1)
    took = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        gains = values[:c] + best[c - 1 :: -1][:c] if c <= len(values) else values + best[c - 1 : c - 1 - len(values) : -1]
        i = int(gains.argmax())
        best[c], took[c] = gains[i], i + 1
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], 0
    pattern, c = np.zeros(len(values), np.int64), capacity
    while c > 0:
        if took[c]:
            pattern[took[c] - 1] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def first_basis(demand: np.ndarray, classes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns (pattern by class) that use up the demand, their inverse and amounts.

    A class goes with its complement and the surplus alone, so the inverse is written down by pairs.
    """
    m = len(classes)
    fits = capacity // (classes + 1)
    place = {int(c) + 1: i for i, c in enumerate(classes)}
    basis, inverse, amount = np.zeros((m, m)), np.zeros((m, m)), np.zeros(m)
    for size, i in place.items():
        other = place.get(capacity - size)
        if other is None or other == i:
            basis[i, i], inverse[i, i], amount[i] = fits[i], 1 / fits[i], demand[size - 1] / fits[i]
        elif size < capacity - size:
            small, large = demand[size - 1], demand[capacity - size - 1]
            surplus = i if small >= large else other
            basis[i, other] = basis[other, other] = 1
            amount[other] = min(small, large)
            basis[surplus, i] = fits[surplus]
            scarce = other if surplus == i else i
            inverse[other, scarce] = 1
            inverse[i, surplus], inverse[i, scarce] = 1 / fits[surplus], -1 / fits[surplus]
            amount[i] = abs(small - large) / fits[surplus]
    return basis, inverse, amount


def generated_patterns(demand: np.ndarray, capacity: int, tolerance: float = 0.005, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Columns and their amounts: the cutting-stock linear program, by the revised simplex method.

    A round prices all patterns by a knapsack over the duals, smoothed towards those with the best
    bound so far, and brings in the best pattern. It ends within ``tolerance`` of the bound, when no
    pattern is worth more than one sequence, or after ``rounds``; any basis is a feasible answer.
    """
    classes = np.flatnonzero(demand)
    m = len(classes)
    if not m:
        return np.zeros((0, len(demand)), np.int64), np.zeros(0)
    need = demand[classes]
    basis, inverse, amount = first_basis(demand, classes, capacity)
    centre = (classes + 1) / capacity
    bound = float((centre * need).sum())
    values = np.zeros(len(demand))
    for _ in range(rounds):
        if amount.sum() <= bound * (1 + tolerance):
            break
        duals = inverse.sum(axis=0)
        for share in (0.9, 0.6, 0.3, 0.0):
            smooth = np.maximum(share * centre + (1 - share) * duals, 0)
            values[classes] = smooth
            worth, pattern = best_pattern(values, capacity)
            if worth > 0 and (smooth * need).sum() / worth > bound:
                bound, centre = float((smooth * need).sum() / worth), smooth / worth
            column = pattern[classes].astype(float)
            if (duals * column).sum() > 1 + 1e-9:
                break
        else:
            break
        change = (inverse * column).sum(axis=1)
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leaves = int(ratio.argmin())
        amount = np.maximum(amount - ratio[leaves] * change, 0)
        amount[leaves] = ratio[leaves] if np.isfinite(ratio[leaves]) else 0
        basis[:, leaves] = column
        row = inverse[leaves] / change[leaves]
        inverse = inverse - np.outer(change, row)
        inverse[leaves] = row
    out = np.zeros((m, len(demand)), np.int64)
    out[:, classes] = np.rint(basis.T).astype(np.int64)
    return out, amount


def rounded_patterns(demand: np.ndarray, capacity: int, waste: float = 0.01) -> list[tuple[np.ndarray, int]]:
    """Patterns and whole numbers of sequences, within the demand.

    Amounts are rounded down, and patterns that leave more than ``waste`` of a sequence empty are
    not used. What they would have held is for ``packed`` to cut.
    """
    left, plan = demand.astype(np.int64).copy(), []
    for pattern, x in zip(*generated_patterns(demand, capacity), strict=True):
        some = pattern > 0
        times = min(int(x + 1e-6), int((left[some] // pattern[some]).min()))
        if times > 0 and pattern @ np.arange(1, len(pattern) + 1) >= (1 - waste) * capacity:
            left -= pattern * times
            plan.append((pattern, times))
    return plan


def remainders(docs: DataFrame, tokenizer: str, size: int) -> DataFrame:
    """The last piece of each document with its ids, for the few that are cut once more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ids_of(tokenizer), np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = ids(text.as_py() or "") + end
                start = (len(data) // 4 - 1) // size * size
                out.append((doc, start, zlib.crc32(data[4 * start :]), len(data) // 4, data[4 * start :]))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "ids_crc32", "doc_tokens", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(cut, "doc_id long, start long, ids_crc32 long, doc_tokens long, ids binary")


def packed(docs: DataFrame, tokenizer: str, size: int = SIZE, step: int = STEP) -> DataFrame:
    """One row per piece: where it starts in its document, its sequence and its place there.

    Lengths are classed by ``step`` ids, so a pattern wastes at most step - 1 ids an item. The
    histogram has size / step classes; it and the plan are the only things the driver sees.
    Remainders that no good pattern takes are laid end to end and cut where a sequence is full:
    the documents at those cuts, one per sequence at most, are encoded again for their checksums.
    Null and empty texts are the end id alone; rows that repeat, and null doc_ids, are packed like
    any other row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    # A slot's owner is a row, not a doc_id: rows may repeat.
    cut = scratch.table(pieces(docs, tokenizer, size).withColumns({"row": F.monotonically_increasing_id(), "class": F.ceil(F.col("length") / step).cast("int")}))
    capacity = size // step
    demand = np.zeros(capacity, np.int64)
    for r in cut.groupBy("class").agg(F.count("*").alias("n")).collect():
        demand[r["class"] - 1] = r["n"]
    # The last class fills a sequence alone and needs no program.
    full, demand[-1] = int(demand[-1]), 0
    plan = ([(np.eye(1, capacity, capacity - 1, dtype=np.int64)[0], full)] if full else []) + rounded_patterns(demand, capacity)
    rows, first, taken = [], 0, np.zeros(capacity, np.int64)
    for pattern, times in plan:
        before = 0
        for c in map(int, np.flatnonzero(pattern)[::-1]):
            each = int(pattern[c])
            rows.append((c + 1, int(taken[c]), int(taken[c]) + each * times, each, first, before))
            taken[c] += each * times
            before += each
        first += times
    handed = spark.createDataFrame(rows, "class int, low long, high long, each long, first long, before long")
    order = scratch.table(running(cut, F.lit(1), F.col("row"), ["class"], "rank"))
    placed = (
        order.join(F.broadcast(handed), "class")  # size / step patterns of a few classes each at most
        .where("rank >= low and rank < high")
        .selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", "first + (rank - low) div each as sequence_id", "before + (rank - low) % each as slot")
    )
    # A sequence holds at most ``size`` pieces.
    ahead = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    patterned = placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")

    used = spark.createDataFrame([(c + 1, int(n)) for c, n in enumerate(taken)], "class int, used long")
    rest = order.join(F.broadcast(used), "class").where("rank >= used")  # one row per class
    laid = scratch.table(running(rest, F.col("length"), F.col("row"), name="at"))
    room = F.lit(size) - F.col("at") % size
    laid = laid.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("at").cast("long")).alias("at"), F.least(room, "length").cast("long").alias("head"))
    whole = laid.where("head = length").selectExpr("doc_id", "start", "length", "ids_crc32", "doc_tokens", f"{first} + at div {size} as sequence_id", f"at % {size} as offset")
    torn = laid.where("head < length")
    # Null ids are equal here: all rows without one are read again, with no join, so they do not meet in one task.
    again = docs.join(torn.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text")
    if torn.where("doc_id is null").limit(1).count():
        again = again.unionByName(docs.where("doc_id is null").select("doc_id", "text"))
    same = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    known = remainders(again, tokenizer, size).distinct().withColumnsRenamed({c: f"known_{c}" for c in same})
    both = torn.join(known, reduce(and_, (F.col(c).eqNullSafe(F.col(f"known_{c}")) for c in same))).select(
        "doc_id",
        "doc_tokens",
        F.explode(
            F.array(
                F.struct(F.col("start"), F.col("head").alias("length"), F.expr("substring(ids, 1, 4 * cast(head as int))").alias("ids"), F.col("at")),
                F.struct((F.col("start") + F.col("head")).alias("start"), (F.col("length") - F.col("head")).alias("length"), F.expr("substring(ids, 4 * cast(head as int) + 1)").alias("ids"), (F.col("at") + F.col("head")).alias("at")),
            )
        ).alias("p"),
    )
    halves = both.selectExpr("doc_id", "p.start", "p.length", "crc32(p.ids) as ids_crc32", "doc_tokens", f"{first} + p.at div {size} as sequence_id", f"p.at % {size} as offset")
    result = scratch.kept(patterned.unionByName(whole).unionByName(halves))
    scratch.drop()
    return result


@query()
def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 ids."""
    return packed(texts(table(spark, folder, "documents")), public_tokenizers.path("byte_bpe_50k.json"))
