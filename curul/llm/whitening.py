"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

The centred matrix X is never formed whole: a step makes one distributed product Xv and one Xᵀu. A left
vector u is as long as the table, so it is not stored; it is X times a short vector w, and
each task makes its own rows of it again. Both sides are reorthogonalised against all vectors before, the left
twice, by inner products that the passes bring along. The small bidiagonal matrix is decomposed on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.llm.common import Scratch, query, table

# Fixed by the contract: the integer scale of an entry.
TIMES, PLUS = 1024, 100_000
#: Entries of this size and more have no integer form within a double's exact range.
LARGEST = float(1 << 42)
COMPONENTS = 8
#: Rounding level: residuals of converged triplets and lengths of vectors that are none.
CONVERGED, NOTHING = 1e-15, 1e-13
#: Directions whose share of the largest variance is below this have none.
FLAT = 1e-18
LONG_MAX = (1 << 63) - 1


def usable(vectors: DataFrame, entries: str) -> DataFrame:
    """(vec_id, x) of the rows whose vector holds numbers only, all of the commonest length (the longer of equally common ones)."""
    c = F.col(entries).cast("array<double>")
    fine = F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < LARGEST))
    kept = vectors.select("vec_id", c.alias("entries")).where((F.size(c) > 0) & fine)
    lengths = kept.groupBy(F.size("entries").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if lengths is None:
        return kept.select("vec_id", F.array().cast("array<long>").alias("x"))
    integral = F.transform("entries", lambda e: F.floor(e * TIMES).cast("long") + PLUS)
    return kept.where(F.size("entries") == lengths["d"]).select("vec_id", integral.alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """The rows of a list column, without a Python object per entry."""
    return np.asarray(column.flatten()).reshape(-1, d)


class Centre:
    """Exact sums S of n integer rows: S = n * q + r, so that n * x - S = n * (x - q) - r has small terms."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.d = n, len(sums)
        self.q = np.array([s // n for s in sums], np.int64)
        self.r = np.array([s % n for s in sums], np.int64)
        self.shift = self.r / n

    def rows(self, x: np.ndarray) -> np.ndarray:
        """x - S / n, rounded once."""
        return (x - self.q).astype(np.float64) - self.shift

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exact; null beyond 64 bits."""
        y = x - self.q
        top = int(np.abs(y).max(initial=0))
        if self.d * top * max(top, int(self.r.max(initial=0))) < LONG_MAX:
            squares, mixed = (y * y).sum(axis=1).tolist(), (y * self.r).sum(axis=1).tolist()
        else:
            wide = y.astype(object)
            squares, mixed = (wide * wide).sum(axis=1).tolist(), (wide * self.r.astype(object)).sum(axis=1).tolist()
        rest = sum(v * v for v in self.r.tolist())
        out = [self.n * self.n * a - 2 * self.n * b + rest for a, b in zip(squares, mixed, strict=True)]
        return [v if v <= LONG_MAX else None for v in out]


def totals(rows: DataFrame, d: int) -> Centre | None:
    """Row count and exact sums by dimension: partial sums by task in two halves of 26 and more bits, added as decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for batch in batches:
            x = matrix(batch.column(0), d)
            n += len(x)
            high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
            sums = [s + (h << 26) + l for s, h, l in zip(sums, high, low, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([str(n), *map(str, sums)])], names=["at", "amount"])

    added = rows.select("x").mapInArrow(partial, "at int, amount string").groupBy("at").agg(F.sum(F.col("amount").cast("decimal(38,0)")).alias("amount"))
    found = {r["at"]: int(r["amount"]) for r in added.collect()}
    return Centre(found[-1], [found[k] for k in range(d)]) if found else None


def summed(rows: DataFrame, centre: Centre, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all tasks of ``of`` (centred rows), a vector of ``size`` numbers; the driver gets one row a number."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            out += of(centre.rows(matrix(batch.column(0), centre.d)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(out)], names=["at", "amount"])

    out = np.zeros(size)
    for r in rows.select("x").mapInArrow(partial, "at int, amount double").groupBy("at").agg(F.sum("amount").alias("amount")).collect():
        out[r["at"]] = r["amount"]
    return out


def fresh(draws: np.random.Generator, basis: list[np.ndarray], d: int) -> np.ndarray:
    """A unit vector orthogonal to the basis."""
    v = draws.standard_normal(d)
    for _ in range(2):
        for b in basis:
            v = v - b * (b @ v)
        v /= np.linalg.norm(v)
    return v


def bidiagonalised(rows: DataFrame, centre: Centre, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(unit components as rows, singular values) of the ``wanted`` largest triplets of the centred matrix.

    Ends when these have converged to rounding or the row space is used up. A space that ends early
    (equal or no variance in the rest) is left for a fresh direction, so repeated values are found too.
    """
    d, draws = centre.d, np.random.default_rng(seed)
    right, left, images = [fresh(draws, [], d)], np.zeros((d, 0)), np.zeros((d, 0))  # v; w of u = Xw; Xᵀu
    alphas, betas, scale = [], [], 0.0
    while True:
        v, w_all = right[-1], left
        # Xv and its products with the left vectors before.
        along = summed(rows, centre, lambda x: (x @ w_all).T @ (x @ v), w_all.shape[1]) if w_all.shape[1] else np.zeros(0)
        w = v - w_all @ along
        both = np.column_stack([w_all, w])
        # The left vector's length and what is left of its overlaps, and Xᵀ of it.
        k = both.shape[1]

        def pass_two(x: np.ndarray, both: np.ndarray = both) -> np.ndarray:
            u = x @ both
            return np.concatenate([u.T @ u[:, -1], x.T @ u[:, -1]])

        out = summed(rows, centre, pass_two, k + d)
        overlap, square, image = out[: k - 1], out[k - 1], out[k:]
        w, image = w - w_all @ overlap, image - images @ overlap
        alpha = float(np.sqrt(max(0.0, square - overlap @ overlap)))
        scale = max(scale, alpha)
        if alpha <= NOTHING * scale or alpha == 0.0:
            alpha, w, image = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, image = w / alpha, image / alpha
        alphas.append(alpha)
        left, images = np.column_stack([left, w]), np.column_stack([images, image])
        following = image
        for _ in range(2):
            for b in right:
                following = following - b * (b @ following)
        beta = float(np.linalg.norm(following))
        scale = max(scale, beta)
        ended = beta <= NOTHING * scale or alpha == 0.0
        small = np.diag(alphas) + np.diag(betas, 1)
        p, sigma, q = np.linalg.svd(small)
        top = min(wanted, d)
        settled = len(alphas) >= top and not ended and bool(np.all(beta * np.abs(p[-1, :top]) <= CONVERGED * sigma[0]))
        if len(alphas) == d or settled:
            return (q[:top] @ np.array(right)), sigma[:top]
        betas.append(0.0 if ended else beta)
        right.append(fresh(draws, right, d) if ended else following / beta)


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, entries: str = "embedding", rows_a_task: int = 20_000) -> DataFrame:
    """Per usable row and component: n, deviation, whitened, explained and identity_error.

    ``vectors`` has vec_id and ``entries``, a list of numbers; other columns are not read. Defined cases: a
    vector that is null, empty, or holds null, NaN, infinity or an entry of 2^42 and more in size is left out, and so
    is one whose length is not the commonest one; equal rows each count; a null vec_id stays null; directions without variance
    (all of them, where all vectors are equal or there is one) are no components; an empty table gives no rows;
    ``deviation`` is null beyond 64 bits.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    stored = scratch.table(usable(vectors.select(F.col("vec_id").cast("long"), F.col(entries)), entries))
    first = stored.first()
    centre = totals(stored, len(first["x"])) if first is not None else None
    if centre is None:
        return spark.createDataFrame([], RESULT)
    # Small files are read together: a pass is one product a task, not one a file.
    parts = max(spark.sparkContext.defaultParallelism, centre.n // rows_a_task)
    rows = stored.coalesce(parts)
    trace = float(summed(rows, centre, lambda x: np.array([(x * x).sum()]), 1)[0]) / centre.n
    axes, sigma = bidiagonalised(rows, centre, components) if trace > 0 else (np.zeros((0, centre.d)), np.zeros(0))
    variance = sigma**2 / centre.n
    real = variance > FLAT * variance.max(initial=0.0)
    axes, variance = axes[real], variance[real]
    k = len(variance)
    if not k:
        scratch.drop()
        return spark.createDataFrame([], RESULT)
    scaled = axes.T / np.sqrt(variance)

    def moments(x: np.ndarray) -> np.ndarray:
        z = x @ scaled
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    found = summed(rows, centre, moments, k + k * k) / centre.n
    covariance = found[k:].reshape(k, k) - np.outer(found[:k], found[:k])
    error = float(np.abs(covariance - np.eye(k)).max())
    explained = variance / trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1), centre.d)
            m = len(x)
            z = centre.rows(x) @ scaled
            ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
            far = pa.array(centre.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.RecordBatch.from_arrays(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, centre.n, np.int64)), far,
                    pa.array(z.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=[part.split()[0] for part in RESULT.split(", ")],
            )

    result = scratch.kept(rows.mapInArrow(project, RESULT))
    scratch.drop()
    return result


@query()
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings on the eight directions of largest variance, each scaled to variance one."""
    return whitened(table(spark, folder, "embeddings"))
