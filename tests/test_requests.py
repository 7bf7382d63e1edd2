"""Requests that name an author, in batch and one by one; the whole audit report."""

from pyspark.sql import functions as F

from curul.operators import audit, search

NAMES = [("Eva Luna Paz", "eva luna paz"), ("Óscar de la Hoz", "oscar de la hoz"), ("ana  sol", "ana  sol"), (None, "iris mar")]
REQUESTS = [
    "iniciativas de Eva Luna sobre agua", "EVA LUNA PAZ", "va lun", "oscar de la hoz y eva luna", "de la", "ana sol", "luna", "", None,
    "paz eva luna eva luna paz fin", "iris m 100% agua", "x y z",
]


def authors(spark):
    return spark.createDataFrame([(i, *n) for i, n in enumerate(NAMES)], "id int, full_name string, name_normalized string")


def test_batch_equals_one_by_one(spark):
    names = authors(spark)
    asked = spark.createDataFrame(list(enumerate(REQUESTS)), "place int, words string")
    got = {r.place: (r.author, r.rest) for r in search.embedded_authors(asked, names, "place", "words").collect()}
    wanted = {}
    for i, text in enumerate(REQUESTS):
        one = search.embedded_author(names, text).collect() if text else []
        if one:
            wanted[i] = (one[0].author, one[0].rest)
    assert got == wanted and {0, 1, 2, 3, 4, 9, 10} <= set(got) and not {5, 6, 7, 8, 11} & set(got)
    assert search.embedded_authors(asked.limit(0), names, "place", "words").count() == 0
    assert search.embedded_authors(asked, names.limit(0), "place", "words").count() == 0


def test_a_report_counts_all_and_shows_twenty(spark):
    rows = spark.range(25).select(
        "id", F.concat(F.lit("t"), "id").alias("canonical_title"), F.concat(F.lit("t"), "id").alias("title_normalized"), F.lit("presented").alias("normalized_status"),
        F.when(F.col("id") != 3, F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int"))).alias("presented_at"), F.lit("senado").alias("originating_chamber"),
        F.lit("p").alias("parser"), F.lit("").alias("raw_commissions"), F.lit(True).alias("has_raw_authors"),
    )
    links = spark.createDataFrame([], "link_id string, initiative_id long, system string, source_priority int, confidence double, is_primary boolean, source_status string")
    events = spark.createDataFrame([], "initiative_id long, event_type string, normalized_status_after string, event_date timestamp")
    people = spark.createDataFrame([], "id long, full_name string, name_normalized string, chamber string")
    report = audit.report(audit.profile(rows, links, events), rows, people).collect()
    gaps = sorted((r.rank, r.subject) for r in report if r.check_key == "presentationEventGaps")
    assert gaps == [(i + 1, str(24 - i)) for i in range(20)]
    assert {r["count"] for r in report if r.check_key == "presentationEventGaps"} == {24}
    others = [r for r in report if r.check_key != "presentationEventGaps"]
    assert len(others) == 8 and all(r["count"] == 0 and r["rank"] is None for r in others)


def test_name_runs_are_never_broadcast(spark, monkeypatch, capsys):
    """However small the planner takes the names' runs and the hits for, they are joined by sorting: no driver holds them."""
    monkeypatch.setattr(search, "durable", lambda df: df)
    asked = spark.createDataFrame(list(enumerate(REQUESTS)), "place int, words string")
    search.embedded_authors(asked, authors(spark), "place", "words").explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
