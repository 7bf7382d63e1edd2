"""Writing the index: terms counted in their row, bounds that hold after rounding."""

import math

from pyspark.sql import functions as F

from curul.operators import index
from curul.operators.index import term_counts


def test_terms_are_counted_without_an_exchange(spark):
    data = [(["b", "a", "b", "ñ", "b"],), ([],), (None,), (["x"],)]
    rows = spark.createDataFrame(data, "words array<string>").select(term_counts(F.col("words")).alias("t"))
    got = [[(t.term, t.tf) for t in r.t or []] for r in rows.collect()]
    assert got == [[("a", 1), ("b", 3), ("ñ", 1)], [], [], [("x", 1)]]
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_bounds_hold(spark, tmp_path):
    texts = [(i, " ".join(f"w{i * j % 13}" for j in range(i % 9 + 1))) for i in range(60)] + [(60, None), (61, "")]
    path = str(tmp_path / "ix")
    index.write_index(spark.createDataFrame(texts, "id int, t string"), "id", "t", path, grams=False)
    postings, bounds = (spark.read.parquet(f"{path}/{n}").collect() for n in ("postings", "bounds"))
    want = {(i, w): t.split().count(w) for i, t in texts if t for w in t.split()}
    assert {(p.key, p.term): p.tf for p in postings} == want
    mean = spark.read.parquet(f"{path}/figures").first().mean_size
    most = {(b.term, b.block): b.most for b in bounds}
    true = {}
    for p in postings:
        value = p.tf * (index.K1 + 1) / (p.tf + index.K1 * (1 - index.B + index.B * p["size"] / mean))
        true[p.term, p.block] = max(value, true.get((p.term, p.block), 0))
    assert set(true) == set(most) and all(true[k] <= most[k] and math.isclose(true[k], most[k], rel_tol=1e-6) for k in true)
