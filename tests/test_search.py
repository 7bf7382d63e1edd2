import math
import random

import pytest
from pyspark.sql import functions as F

from curul.functions.text import trigram_similarity, trigrams
from curul.operators import chat, details, documents, search, vectors
from curul.operators.keyed import packed
from curul.sources.reports import read_report, with_threshold, write_report


def initiative_rows(spark):
    rows = [("1", "Que reforma la Ley de Aguas", "presented", "senado", "2020-01-01"), ("2", "Que expide la Ley de Minas", "presented", "diputados", None), ("3", "Ley de Aguas Nacionales", "draft", "senado", "2021-01-01")]
    df = spark.createDataFrame(rows, "id string, canonical_title string, normalized_status string, originating_chamber string, day string")
    return df.withColumn("presented_at", F.col("day").cast("date")).withColumn("created_at", F.lit(0)).drop("day")


def author_tables(spark):
    authors = spark.createDataFrame([("a", "José Núñez", "jose nunez"), ("b", "Ejecutivo Federal", "ejecutivo federal")], "id string, full_name string, name_normalized string")
    relations = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "initiative_id string, author_id string")
    return {"authors": authors, "relations": relations}


def ids(df):
    return [r.id for r in df.collect()]


def test_null_dates_differ_between_listings(spark):
    rows, tables = initiative_rows(spark), author_tables(spark)
    assert ids(search.listing(rows, search.Filters(), 10)) == ["2", "3", "1"]
    by_author = search.Filters(author="titular del Poder Ejecutivo")
    assert ids(search.listing_constrained(rows, by_author, 10, **tables)) == ["3", "2"]
    assert ids(search.listing(rows, search.Filters(chamber="senado", date_from="2020-06-01"), 10)) == ["3"]


def test_dispatch(spark):
    rows, tables = initiative_rows(spark), author_tables(spark)
    assert ids(search.search(rows, "aguas", **tables))[:2] == ["3", "1"]
    assert ids(search.search(rows, "ley de josé núñez", **tables)) == ["1"]
    assert ids(search.search(rows, "José Núñez", **tables)) == ["1"]
    assert ids(search.search(rows, "ley", search.Filters(status="draft"), **tables)) == ["3"]
    assert ids(search.search(rows, None, search.Filters(status="presented"))) == ["2", "1"]


def test_embedded_author_takes_longest_run(spark):
    authors = author_tables(spark)["authors"]
    assert tuple(search.embedded_author(authors, "leyes de José Núñez agua").first()) == ("jose nunez", "leyes de agua")
    assert search.embedded_author(authors, "nada que ver aqui").collect() == []


def test_results_tell_what_matched(spark):
    rows = spark.createDataFrame([("1", 0.5, 0.1, 0.3), ("2", 0.0, 0.5, None), ("3", None, None, None)], "id string, rank_score double, trigram_score double, final_score double")
    df = rows.selectExpr("*", "'t' canonical_title", "'x' normalized_status", "null presented_at", "cast(null as string) summary", "'m' matter_topic")
    got = {r.id: (list(r.matched_on), r.score, r.snippet) for r in search.as_results(df).collect()}
    assert got == {"1": (["keyword"], 0.3, "m"), "2": (["fuzzy"], 0.0, "m"), "3": (["ranked"], 0.0, "m")}


def test_keyword_score_by_hand(spark):
    df = spark.createDataFrame([(1, "agua agua rio"), (2, "rio"), (3, "")], "id int, t string")
    got = {r.id: r.rank_score for r in search.keyword_scores(df, "t", "agua").collect()}
    idf, mean = math.log(1 + (3 - 1 + 0.5) / 1.5), 4 / 3
    assert got[1] == pytest.approx(idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / mean)))
    assert got[2] == got[3] == 0


def test_trigram_similarity(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    score = df.select(trigram_similarity(trigrams("a"), trigrams("b")).alias("s")).first().s
    assert score == pytest.approx(4 / 11)


def test_fusion(spark):
    a = spark.createDataFrame([(1, 9.0), (2, 8.0)], "id int, score double")
    b = spark.createDataFrame([(2, 1.0), (3, 0.5)], "id int, score double")
    got = {r.id: r.fused_score for r in search.fused([a, b], "id").collect()}
    assert got == {1: pytest.approx(1 / 61), 2: pytest.approx(1 / 62 + 1 / 61), 3: pytest.approx(1 / 62)}


def test_nearest_vectors_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    queries = [(q, [rng.gauss(0, 1) for _ in range(8)]) for q in range(3)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    asked = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = vectors.top_similar(df, "id", "v", asked, 5).collect()
    assert len(got) == 15
    for q, vector in queries:
        best = sorted(rows, key=lambda r: (-cosine(vector, r[1]), r[0]))[:5]
        assert {r.id for r in got if r.query_id == q} == {r[0] for r in best}


def test_chunks_cover_the_text(spark):
    words = [f"w{i}" for i in range(95)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, ""), (3, "solo")], "id int, t string")
    rows = documents.chunks(df, "id", "t", size=30, overlap=10).orderBy("id", "chunk_index").collect()
    first = [r for r in rows if r.id == 1]
    assert [r.chunk_index for r in first] == [0, 1, 2, 3, 4] or [r.chunk_index for r in first] == [0, 1, 2, 3]
    seen = [w for r in first for w in r.content.split()]
    assert set(seen) == set(words) and all(r.token_count <= 30 for r in first)
    assert first[1].content.split()[0] == "w20" and [r.id for r in rows if r.id != 1] == [3]


def test_child_lists_are_cut_by_place(spark):
    df = spark.range(2500).selectExpr("'k' key", "id").union(spark.createDataFrame([("s", 1), (None, 3), (None, 2)], "key string, id long")).repartition(7)
    rows = packed(df, "key", F.col("id"), [-F.col("id")], "ids").collect()
    assert [(r.part, list(r.ids), r.total) for r in rows if r.key == "s"] == [(0, [1], 1)]
    big = sorted((r for r in rows if r.key == "k"), key=lambda r: r.part)
    assert [len(r.ids) for r in big] == [1000, 1000, 500] and {r.total for r in big} == {2500}
    assert [list(r.ids) for r in rows if r.key is None] == [[3, 2]]


def test_child_lists_follow_their_order(spark):
    df = spark.range(2500).selectExpr("id % 3 key", "id", "cast(id % 7 as string) mark").repartition(5)
    rows = packed(df, "key", F.col("id"), [F.col("mark"), F.col("id")], "ids", page=100).orderBy("key", "part").collect()
    for key in range(3):
        assert [i for r in rows if r.key == key for i in r.ids] == sorted((i for i in range(2500) if i % 3 == key), key=lambda i: (str(i % 7), i))


def test_an_event_with_very_many_links_is_one_row(spark):
    events = spark.createDataFrame([("e", "i"), ("f", "i")], "event_id string, initiative_id string")
    links = spark.range(2300).selectExpr("'e' event_id", "id source_record_id")
    records = spark.range(2300).selectExpr("id source_record_id", "1 source_id", "concat('u', id) source_url", "'t' record_type")
    sources = spark.createDataFrame([(1, "sil")], "source_id int, system string")
    got = {r.event_id: (len(r.source_links or []), r.source_link_count) for r in details.timeline(events, links, records, sources).collect()}
    assert got == {"e": (1000, 2300), "f": (0, 0)}
    assert details.event_sources(links, records, sources).count() == 3


def test_unknown_initiative_is_an_error(spark):
    df = spark.createDataFrame([("a",)], "initiative_id string")
    assert details.require(df, "a").count() == 1
    with pytest.raises(details.InitiativeNotFound):
        details.require(df, "z")


def test_chat_flags(spark):
    rows = [("Busca iniciativas de agua desde 2020", 0), ("No se encontraron iniciativas", 3), ("hola", 1)]
    df = chat.message_flags(spark.createDataFrame(rows, "text string, n int"), "text", "n")
    assert [tuple(r)[2:] for r in df.collect()] == [(True, True, False), (False, True, True), (False, False, False)]


def test_recent_history(spark):
    rows = [(1, i, "user" if i % 2 else "tool", "x" * 5000 if i == 29 else str(i)) for i in range(30)]
    got = chat.recent_history(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()
    assert sorted(r.turn for r in got) == list(range(11, 30, 2)) and max(len(r.text) for r in got) == 4000


def test_report_round_trip(spark, tmp_path):
    path = str(tmp_path / "plans")
    write_report(spark.createDataFrame([("a", 0.95), ("b", 0.5)], "id string, confidence double"), path)
    assert ids(with_threshold(read_report(spark, path, "id string, confidence double"))) == ["a"]
    with pytest.raises(Exception):
        write_report(spark.range(1), path)
