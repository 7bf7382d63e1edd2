import pytest
from pyspark.sql import functions as F

from curul.operators import audit, clusters
from curul.sources.reports import BlockersFound, require_no_blockers


def fixture_tables(spark):
    initiatives = spark.createDataFrame(
        [("i1", "presented", "senado-gaceta-document-local-v2", "Justicia"), ("i2", "in_commissions", "sil", "Cámara de Diputados.")],
        "id string, normalized_status string, parser string, raw_commissions string",
    ).selectExpr("*", "'Ley de prueba' canonical_title", "'ley de prueba' title_normalized", "date'2026-01-01' presented_at", "'senado' originating_chamber", "false has_raw_authors")
    links = spark.createDataFrame(
        [("l1", "i1", "senado_transparencia", 30, "Ley de prueba", "Pendiente", 0.9, False), ("l2", "i1", "sil", 10, "Ley de Prueba", "Aprobada", 0.8, False)],
        "link_id string, initiative_id string, system string, source_priority int, source_title string, source_status string, confidence double, is_primary boolean",
    )
    events = spark.createDataFrame([("i1", "approved_origin", "2026-01-10", "approved_origin")], "initiative_id string, event_type string, event_date string, normalized_status_after string")
    commissions = spark.createDataFrame([("i1", "c1")], "initiative_id string, commission_id string")
    authors = spark.createDataFrame(
        [("a1", "Saul Monreal Avila", "saul monreal avila", "senado"), ("a2", "Saúl Monreal Ávila", "saul monreal avila", "senado")],
        "id string, full_name string, name_normalized string, chamber string",
    )
    return initiatives, links, events, commissions, authors


def test_audit_counts(spark):
    initiatives, links, events, commissions, authors = fixture_tables(spark)
    profiled = audit.profile(initiatives, links, events, commissions)
    counts = {r.check_key: r["count"] for r in audit.check_counts(profiled, initiatives, authors).collect()}
    assert counts == {
        "duplicateInitiativeClusters": 1, "statusEventMismatches": 1, "statusBehindEvents": 1, "statusAheadOfEvents": 0,
        "commissionNormalizationGaps": 0, "sourceConflicts": 1, "primarySourceAnomalies": 1, "presentationEventGaps": 2, "authorVariantClusters": 1,
    }
    assert clusters.variant_clusters(authors).count() == 1


def card(spark, **counts):
    rows = [(k, counts.get(k, 0)) for k, *_ in audit.SCORECARD]
    return audit.scorecard(spark.createDataFrame(rows, "check_key string, count long"))


def test_scorecard_warns(spark):
    checks = card(spark, authorVariantClusters=3)
    assert tuple(audit.scorecard_status(checks).first()) == ("warn", 0, 1)
    require_no_blockers(checks)


def test_scorecard_fails_with_blockers_in_order(spark):
    checks = card(spark, duplicateInitiativeClusters=1, primarySourceAnomalies=2)
    assert audit.scorecard_status(checks).first().status == "fail"
    failed = [r.key for r in checks.filter(F.col("status") == "fail").orderBy("position").collect()]
    assert failed == ["duplicateInitiativeClusters", "primarySourceAnomalies"]
    with pytest.raises(BlockersFound):
        require_no_blockers(checks)
