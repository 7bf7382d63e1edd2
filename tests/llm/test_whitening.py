"""Whitening against an eigendecomposition of the exact covariance, and its defined cases."""

import math
from fractions import Fraction

import numpy as np
import pytest

from curul.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n int, component string"


def frame(spark, vectors, ids=None):
    rows = [(i if ids is None else ids[i], v, "x", 1, "c") for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, SCHEMA)


def integers(vectors):
    return np.array([[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors], dtype=object)


def check(got, vectors, components=8):
    x = integers(vectors)
    n, d = x.shape
    sums = x.sum(axis=0)
    centred = np.array([[float(Fraction(int(v)) - Fraction(int(s), n)) for v, s in zip(row, sums, strict=True)] for row in x])
    covariance = centred.T @ centred / n
    e, q = np.linalg.eigh(covariance)
    e, q = e[::-1], q[:, ::-1]
    k = min(components, int((e > 1e-9 * e[0]).sum()))
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(rows) == len(got) == n * k
    for j in range(k):
        mine = np.array([rows[i, j + 1].whitened for i in range(n)])
        assert abs(rows[0, j + 1].explained / (e[j] / np.trace(covariance)) - 1) < 1e-9
        alone = all(abs(e[j] - e[i]) > 1e-6 * e[0] for i in range(d) if i != j)
        if alone:
            theirs = centred @ q[:, j] / math.sqrt(e[j])
            assert min(np.abs(mine - theirs).max(), np.abs(mine + theirs).max()) < 1e-7
    z = np.array([[rows[i, j + 1].whitened for j in range(k)] for i in range(n)])
    assert np.abs(z.T @ z / n - np.eye(k)).max() < 1e-8
    for i in range(n):
        exact = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True))
        assert rows[i, 1].deviation == exact and rows[i, 1].n == n and rows[i, 1].identity_error < 1e-8


def test_equals_an_eigendecomposition(spark):
    draws = np.random.default_rng(3)
    vectors = (draws.standard_normal((60, 12)) * np.linspace(1, 0.05, 12)).tolist()
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_fewer_rows_than_dimensions_and_repeated_rows(spark):
    draws = np.random.default_rng(4)
    vectors = draws.standard_normal((5, 12)).tolist()
    check(whitening.whitened(frame(spark, vectors + vectors)).collect(), vectors + vectors)


def test_repeated_variances_are_all_found(spark):
    vectors = [[sign if i == j else 0.0 for j in range(6)] for i in range(6) for sign in (1.0, -1.0)]
    check(whitening.whitened(frame(spark, vectors)).collect(), vectors)


def test_whole_table(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in rows] == list(range(len(rows)))
    check(whitening.op13_embedding_whitening(spark, small).collect(), [r.embedding for r in rows])


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0], [1.0, 2.0]], [[]], [[None, 1.0], [float("nan"), 1.0], [float("inf"), 2.0]]])
def test_nothing_to_whiten(spark, vectors):
    assert whitening.whitened(frame(spark, vectors)).count() == 0


def test_unusable_vectors_are_left_out(spark):
    draws = np.random.default_rng(6)
    good = draws.standard_normal((9, 3)).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("-inf"), 2.0], [1.0, 2.0], [1e30, 1.0, 1.0]]
    check(whitening.whitened(frame(spark, good + bad)).collect(), good)
    ids = {r.vec_id for r in whitening.whitened(frame(spark, good, [None, *range(8)])).collect()}
    assert ids == {None, *range(8)}


def test_large_entries_are_exact(spark):
    vectors = [[3.0e9, -1.0e9], [1.0, 2.0], [2.5e9, 7.0]]
    got = whitening.whitened(frame(spark, vectors)).collect()
    x = integers(vectors)
    sums = x.sum(axis=0)
    want = {i: sum((3 * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(3)}
    assert {r.vec_id: r.deviation for r in got} == {i: w if w < 1 << 63 else None for i, w in want.items()}
