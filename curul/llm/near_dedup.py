"""Near-duplicate documents by MinHash.

Every text is read whole into its set of word shingles; many universal hash minima of the set form
a signature, and bands of it the candidate groups. Copies with equal sets are one node from there
on. Within a band group, nodes are compared with one central member, verified on signatures and
then on full sets, and joined by alternating stars. Only members that this leaves apart
are compared with each other, after an exact bound has set aside those that cannot have a partner.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table, texts
from curul.llm.graphs import alternating_stars
from curul.llm.groups import resolved, verified
from curul.llm.words import SPACE, U64, Words, mixed, slices

SHINGLE = 5
LEAST = 85
#: Minima in a signature, at most, and the chances at which the bands and the signatures lose a pair that just reaches the limit.
MINIMA, UNMET, UNLIKE = 126, 6e-5, 1e-4
#: 2^24 places of the bitmap that keeps texts without a candidate from being shuffled: 262,144 words of 64 at most.
FILTER_BITS = 24


def banding(least: int = LEAST) -> tuple[int, int]:
    """Bands and rows: the longest bands that leave a pair of similarity ``least`` % unmet with a chance of UNMET at most."""
    for rows in range(MINIMA, 1, -1):
        if (1 - (least / 100) ** rows) ** (MINIMA // rows) <= UNMET:
            return MINIMA // rows, rows
    return MINIMA, 1


def agreement(minima: int, least: int = LEAST) -> int:
    """The most places that a pair of similarity ``least`` % agrees in with all but a chance of UNLIKE."""
    share, lost = least / 100, 0.0
    for k in range(minima + 1):
        lost += comb(minima, k) * share**k * (1 - share) ** (minima - k)
        if lost > UNLIKE:
            return k
    return minima


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, one after the other, and where each text's begin.

    A text of fewer than ``size`` words has its whole sequence as the one shingle; none has none.
    """
    hashes, within = words.shingles(size)
    rows = words.row[: len(hashes)][within]
    hashes = hashes[within]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        firsts = np.concatenate([[0], np.cumsum(words.counts)])
        whole = np.zeros(len(short), U64)
        for k, r in enumerate(short):
            own = words.hashes[firsts[r] : firsts[r + 1]]
            whole[k] = mixed(np.array([(own * mixed(np.arange(101, 101 + len(own), dtype=U64))).sum() + U64(len(own))], U64))[0]
        rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    if len(hashes):
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])])
        rows, hashes = rows[new], hashes[new]
    return hashes, np.searchsorted(rows, np.arange(len(words.counts) + 1))


def universal(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and additions of ``count`` multiply-add hash functions on 64 bits."""
    draws = np.random.default_rng(seed)
    return draws.integers(1, 1 << 63, count, dtype=np.uint64) * U64(2) + U64(1), draws.integers(0, 1 << 63, count, dtype=np.uint64)


def signature(hashes: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over a set, in its 32 high bits; a long set is taken in parts."""
    least = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(hashes), 2048):
        part = (hashes[None, i : i + 2048] * times[:, None] + plus[:, None]) >> U64(32)
        np.minimum(least, part.min(axis=1).astype(np.uint32), out=least)
    return least


SIGNED_DDL = "doc_id long, n_shingles long, set_a long, set_b long, signature binary, bands array<long>"


def signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """Per row: size and two hashes of its shingle set, signature and band keys (none for an empty set)."""
    times, plus = universal(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_no = mixed(np.arange(1, bands + 1, dtype=U64))
        spread = mixed(np.arange(201, 201 + rows, dtype=U64))
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                hashes, at = shingle_sets(Words(data, offsets, SPACE))
                n = len(at) - 1
                sigs, keys, sums = [], [], []
                for i in range(n):
                    own = hashes[at[i] : at[i + 1]]
                    sums.append((np.int64(own.sum(dtype=U64).astype(np.int64)), np.int64(mixed(own ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64).astype(np.int64))))
                    if len(own):
                        sig = signature(own, times, plus)
                        sigs.append(sig.tobytes())
                        keys.append(mixed((sig.reshape(bands, rows).astype(U64) * spread).sum(axis=1) + band_no).astype(np.int64))
                    else:
                        sigs.append(b"")
                        keys.append(np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n), pa.array(np.diff(at)), pa.array([s[0] for s in sums], pa.int64()), pa.array([s[1] for s in sums], pa.int64()),
                        pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "set_a", "set_b", "signature", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(sign, SIGNED_DDL)


def sets_of(docs: DataFrame) -> DataFrame:
    """(id, hashes) of each row: the full shingle sets, for candidates only."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                hashes, at = shingle_sets(Words(data, offsets, SPACE))
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(lists)), lists], names=["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "id long, hashes array<long>")


def holding(docs: DataFrame, ids: DataFrame, bits: int = FILTER_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is among ``ids``; the others stay where they are read.

    A bitmap of 2^bits places, whatever the number of ids, passes the rows whose id may be there; only these are shuffled for the exact
    join. It is broadcast as words of 64 places, 2^(bits - 6) rows at most. With ids many times its places it passes all rows and the
    join does all the work: the result is the same.
    """
    place = lambda key: F.shiftrightunsigned(F.xxhash64(key), 64 - bits)
    marks = ids.select(place("id").alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("set"))
    keyed = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null").withColumn("at", place("doc_id"))
    near = keyed.join(F.broadcast(marks), F.shiftright("at", 6) == F.col("word")).where("(shiftrightunsigned(set, CAST(at & 63 AS INT)) & 1) = 1")
    return near.select("doc_id", "text").join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")


def agreeing(pairs: DataFrame, signs: DataFrame, places: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in ``places`` places or more."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32)
                keep.append((x == y).sum() >= places)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = (signs.select(F.col("id").alias(k), F.col("signature").alias(f"sign_{k}")) for k in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sign_a", "sign_b").mapInArrow(agree, "a long, b long")


def components(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(signed rows, (node, component) of the sets with a link, named by their smallest doc_id)."""
    bands, per_band = banding(least)
    places = agreement(bands * per_band, least)
    rows = scratch.table(signed(docs, bands, per_band))
    # Equal sets are one node, named by their smallest doc_id; a group of copies is one row before any comparison.
    nodes = scratch.table(
        rows.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b")
        .agg(F.min("doc_id").alias("id"), F.first("signature").alias("signature"), F.first("bands").alias("bands")).where("id is not null")
    )

    def prepare(ids: DataFrame):
        ids = scratch.table(ids)
        sets = scratch.table(sets_of(holding(docs, ids)).distinct())
        # Only nodes that met another are compared: their signatures are taken out once, not at every check.
        signs = scratch.table(nodes.select("id", "signature").join(ids, "id", "left_semi"))
        return lambda pairs: verified(scratch.table(agreeing(pairs, signs, places)), sets, least), sets

    return rows, resolved(nodes.select("id", F.explode("bands").alias("key")), prepare, alternating_stars, least, scratch)


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the size of its set, its component and whether it is the one kept.

    Defined cases: null, empty and blank texts have an empty set and are linked with nothing;
    rows that share a doc_id are one node, linked by any of their texts; a row without doc_id is its
    own group with a null component, and is kept; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows, found = components(docs, scratch, least)
    # Equal sets: each row goes to its node, each node to its component.
    node = rows.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    named = rows.drop("signature", "bands").join(node, ["n_shingles", "set_a", "set_b"], "left").withColumn("node", F.coalesce("node", "doc_id"))
    result = named.join(found, "node", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")).alias("component_id"))
    kept = scratch.kept(result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
    scratch.drop()
    return kept


@query()
def op4_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    return near_duplicates(texts(table(spark, folder, "documents")))
