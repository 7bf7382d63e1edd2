"""The written index against scans of the texts, and the inverted lists against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from curul.operators import index, search, vectors


@pytest.fixture(scope="module")
def titled(spark):
    draws = random.Random(4)
    words = ["agua", "ley", "minas", "reforma", "núñez", "río", "educación", "energía", "x1", "salud"]
    rows = [(i, " ".join(draws.choices(words, weights=range(10, 0, -1), k=draws.choice([0, 1, 3, 8, 40])))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "¡!"), (503, "Aguas-negras de la ENERGÍA")]
    return spark.createDataFrame(rows, "id long, t string")


@pytest.fixture(scope="module")
def written(spark, titled, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    small = {"BUCKET_ROWS": 500, "BLOCK_ROWS": 20, "SLICE_ROWS": 150}
    kept = {name: getattr(index, name) for name in small}
    for name, value in small.items():
        setattr(index, name, value)
    index.write_index(titled, "id", "t", path)
    for name, value in kept.items():
        setattr(index, name, value)
    return index.TextIndex(spark, path)


def scores(df, *names):
    return {r[0]: tuple(round(v, 9) for v in r[1:]) for r in df.select(*names).collect()}


@pytest.mark.parametrize("request_text", ["agua", "reforma energia salud", "no_such agua", "nothing", "", "¿?"])
def test_scores_equal_a_scan(titled, written, request_text):
    want = scores(search.keyword_scores(titled, "t", request_text).where("rank_score > 0"), "id", "rank_score")
    assert scores(written.keyword(request_text), "key", "rank_score") == want
    both = scores(search.scored(titled.where("t is not null"), request_text, "t"), "id", "rank_score", "trigram_score", "final_score")
    got = scores(written.scored(request_text), "key", "rank_score", "trigram_score", "final_score")
    assert got.keys() == both.keys() and all(got[k][1] == both[k][1] for k in got)


@pytest.mark.parametrize("k", [1, 7, 60, 1000])
def test_bounds_lose_nothing(monkeypatch, written, k):
    monkeypatch.setattr(index, "FIRST_BLOCKS", 2)
    every = sorted(((-s[0], key) for key, s in scores(written.keyword("salud energia rio"), "key", "rank_score").items()))
    best = [(round(-r.rank_score, 9), r.key) for r in written.best("salud energia rio", k).collect()]
    assert sorted(best) == every[:k]


def test_kept_rows_have_figures_of_their_own(titled, written):
    kept = titled.where("id % 3 = 0 and t is not null")
    want = scores(search.scored(kept, "agua minas", "t"), "id", "rank_score", "trigram_score", "final_score")
    assert scores(written.scored("agua minas", kept.select(F.col("id").alias("key"))), "key", "rank_score", "trigram_score", "final_score") == want


@pytest.mark.parametrize("part", ["guas-neg", "negras de", "a", "energia", "s-n", "de la e"])
def test_rows_that_hold_a_part_are_candidates(titled, written, part):
    holding = {r.id for r in titled.where(F.contains(F.lower(F.translate("t", "íúóéÍ", "iuoei")), F.lit(search.normalized(part)))).collect()}
    assert holding <= {r.key for r in written.containing(part).collect()}


def test_a_request_reads_its_own_lists(written):
    plan = written.lists("postings", ["agua"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,agua)" in plan.replace("In(term, [agua])", "EqualTo(term,agua)")


def test_empty_table(spark, tmp_path):
    index.write_index(spark.createDataFrame([], "id long, t string"), "id", "t", str(tmp_path / "i"))
    empty = index.TextIndex(spark, str(tmp_path / "i"))
    assert empty.keyword("agua").count() == empty.best("agua", 3).count() == empty.scored("agua").count() == 0


def test_inverted_lists(spark, tmp_path):
    draws = random.Random(1)
    centres = [[draws.gauss(0, 3) for _ in range(8)] for _ in range(12)]
    rows = [(i, [c + draws.gauss(0, 0.4) for c in draws.choice(centres)]) for i in range(900)] + [(2000, None)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    asked = table.where("id % 50 = 0 and v is not null").select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    path = str(tmp_path / "lists")
    vectors.write_lists(table, "id", "v", path, lists=20)
    assert spark.read.parquet(f"{path}/lists").count() == 900
    exact = vectors.top_similar(table, "id", "v", asked, 10)
    assert {tuple(r) for r in vectors.probed(spark, path, "id", asked, 10, probes=20).select("query_id", "id").collect()} == {tuple(r) for r in exact.select("query_id", "id").collect()}
    by_query = vectors.recall(vectors.probed(spark, path, "id", asked, 10), exact, "id").collect()
    assert sum(r.found for r in by_query) >= 0.9 * sum(r.exact for r in by_query) and {r.exact for r in by_query} == {10}
    probes = spark.read.parquet(f"{path}/figures").first().probes
    assert probes < 20
    assert vectors.top_similar(table, "id", "v", asked.limit(0), 10).count() == 0


def test_queries_beyond_one_pass(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_PASS", 4)
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(10)], "id long, v array<double>")
    got = vectors.top_similar(table, "id", "v", table.select(F.col("id").alias("query_id"), F.col("v").alias("vector")), 1).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(i, i) for i in range(10)]
