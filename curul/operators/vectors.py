"""Vector search by cosine similarity: exact over all rows, and by inverted lists of a coarse quantiser."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.operators.keyed import best_per_key

#: Query vectors that the tasks hold at once.
QUERIES_PER_PASS = 1024
#: Rows whose scores with all of these a task holds at once, whatever the size of an Arrow batch.
ROWS_AT_ONCE = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def blocks(places: np.ndarray) -> list[np.ndarray]:
    return [places[i : i + ROWS_AT_ONCE] for i in range(0, len(places), ROWS_AT_ONCE)]


class Best:
    """The k best rows of each query that a task has met so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores, self.keys = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)

    def add(self, which: np.ndarray, scores: np.ndarray, keys: np.ndarray) -> None:
        """``scores`` of the queries ``which`` (rows) with the rows ``keys`` (columns)."""
        all_scores = np.hstack([scores, self.scores[which]])
        all_keys = np.hstack([np.broadcast_to(keys, scores.shape), self.keys[which]])
        order = np.lexsort((all_keys, -all_scores), axis=1)[:, : self.k]
        self.scores[which], self.keys[which] = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_keys, order, axis=1)

    def batch(self, ids: np.ndarray, key: str) -> pa.RecordBatch:
        real = np.isfinite(self.scores)
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, real.sum(axis=1))), pa.array(self.keys[real]), pa.array(self.scores[real])], names=["query_id", key, "score"])


def _scan(rows: DataFrame, key: str, ids: np.ndarray, queries: np.ndarray, k: int, asked: np.ndarray | None = None) -> DataFrame:
    """(query_id, key, score): each task's k best of ``rows`` (key, vector[, list]) by query, sent on once.

    ``asked`` says which lists (columns) a query (rows) looks into; without it, all rows are looked at.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            names, vectors = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), unit(matrix(batch.column(1)))
            lists = np.zeros(len(names), np.int64) if asked is None else batch.column(2).to_numpy(zero_copy_only=False)
            for one in np.unique(lists):
                own = lists == one
                which = np.arange(len(ids)) if asked is None else np.flatnonzero(asked[:, one])
                if len(which):
                    for some in blocks(np.flatnonzero(own)):
                        best.add(which, queries[which] @ vectors[some].T, names[some])
        yield best.batch(ids, key)

    return rows.mapInArrow(score, f"query_id long, {key} long, score double")


def _passes(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The query table (query_id, vector) in blocks of a fixed size; no more than a block is on the driver at once."""
    rows = queries.toLocalIterator(prefetchPartitions=True)
    while block := list(islice(rows, QUERIES_PER_PASS)):
        yield np.array([r[0] for r in block], np.int64), unit(np.array([r[1] for r in block], np.float64))


def _united(parts: list[DataFrame], spark: SparkSession, key: str, k: int) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], f"query_id long, {key} long, score double")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return best_per_key(out, ["query_id"], [F.col("score").desc(), F.col(key).asc()], k=k)


def top_similar(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, key, score): the k nearest rows of each query, exact.

    ``queries`` is a table of query_id and vector, taken in blocks of a fixed size. A task keeps the best k
    rows of each query and sends these on, so the shuffle follows tasks and queries, not the vectors.
    """
    present = vectors.select(F.col(key).cast("long").alias(key), vector).where(F.col(vector).isNotNull())
    return _united([_scan(present, key, ids, block, k) for ids, block in _passes(queries)], vectors.sparkSession, key, k)


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(query_id, vector): the mean vector of each label, however many there are."""
    means = vectors.select(label, F.posexplode(vector).alias("i", "v")).groupBy(label, "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    # A list of one vector's entries.
    parts = means.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("parts"))
    return parts.select(F.col(label).cast("long").alias("query_id"), F.transform("parts", lambda p: p["m"]).alias("vector"))


# ---- inverted lists --------------------------------------------------------------------------


def write_lists(
    vectors: DataFrame, key: str, vector: str, path: str, lists: int | None = None, sample: int = 100_000, rounds: int = 12, seed: int = 3,
    asked: int = 200, k: int = 10, least: float = 0.95,
) -> None:
    """Write the vectors by nearest centre: one partition folder a list.

    Centres are k-means centres of unit vectors, fitted in ``rounds`` on at most ``sample`` rows, those of the smallest hash;
    every row with a vector is written. ``lists`` is the square root of the row count if not given. A list of many
    rows is written by several tasks. The number of lists to probe is set on ``asked`` rows whose exact ``k`` neighbours are known.
    """
    rows = vectors.select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("vector")).where(F.col(vector).isNotNull())
    n = rows.count()
    count = lists or max(1, round(n**0.5))
    shown = rows.orderBy(F.xxhash64(key), key).limit(sample)
    centres = np.zeros((1, 1))
    if n:
        trained = KMeans(featuresCol="v", k=count, maxIter=rounds, seed=seed, distanceMeasure="cosine").fit(shown.select(array_to_vector("vector").alias("v")))
        centres = unit(np.array(trained.clusterCenters()))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows_of = unit(matrix(batch.column(1)))
                nearest = np.concatenate([np.argmax(rows_of[some] @ centres.T, axis=1) for some in blocks(np.arange(len(rows_of)))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest)], names=[key, "vector", "list"])

    placed = rows.mapInArrow(assign, f"{key} long, vector array<double>, list int")
    dealt = placed.repartition("list", F.pmod(F.xxhash64(key), F.lit(max(1, n // (count * 100_000)))))
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/lists")
    spark = vectors.sparkSession
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    probes = _probes(spark.read.parquet(f"{path}/lists"), key, centres, asked, k, least) if n else 1
    spark.createDataFrame([(n, probes)], "rows long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


def _probes(placed: DataFrame, key: str, centres: np.ndarray, asked: int, k: int, least: float) -> int:
    """How many lists ``asked`` rows must look into to find a share of ``least`` of their exact k nearest."""
    queries = placed.orderBy(F.xxhash64(F.lit(1), key), key).limit(asked).select(F.col(key).alias("query_id"), "vector")
    exact = top_similar(placed, key, "vector", queries, k).join(placed.select(key, "list"), key).select("query_id", "list")
    # ``asked`` times k rows at most.
    ranks = {r["query_id"]: np.argsort(np.argsort(-(centres @ unit(np.array([r["vector"]]))[0]), kind="stable")) for r in queries.collect()}
    found = np.sort([ranks[r["query_id"]][r["list"]] for r in exact.collect()])
    return int(found[min(len(found) - 1, int(np.ceil(least * len(found))))]) + 1


def probed(spark: SparkSession, path: str, key: str, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
    """(query_id, key, score): the k nearest rows of each query among its ``probes`` nearest lists, scored exactly.

    Without ``probes``, as many lists as the written sample needed. Only lists that a block of queries asks for are read.
    A row of another list is missed: ``recall`` measures how many are.
    """
    centres = np.array([r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("list").collect()])
    probes = probes or spark.read.parquet(f"{path}/figures").first()["probes"]
    parts = []
    for ids, block in _passes(queries):
        nearest = np.argsort(-(block @ centres.T), axis=1, kind="stable")[:, :probes]
        asked = np.zeros((len(ids), len(centres)), bool)
        np.put_along_axis(asked, nearest, True, axis=1)
        wanted = np.flatnonzero(asked.any(axis=0)).tolist()
        rows = spark.read.parquet(f"{path}/lists").where(F.col("list").isin(*wanted)).select(key, "vector", "list")
        parts.append(_scan(rows, key, ids, block, k, asked))
    return _united(parts, spark, key, k)


def recall(found: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """(query_id, exact, found): how many of each query's exact neighbours were found."""
    hits = found.select("query_id", key, F.lit(1).alias("hit"))
    return exact.join(hits, ["query_id", key], "left").groupBy("query_id").agg(F.count("*").alias("exact"), F.count("hit").alias("found"))
