import functools

from pyspark.sql import functions as F

from curul.operators import clusters, links, matching

AUTHOR = "id string, full_name string, name_normalized string, chamber string"


def author_tables(spark, people, relations):
    authors = spark.createDataFrame([(i, n, n.lower(), c) for i, n, c in people], AUTHOR)
    rows = [(f"i{k}", a) for a, n in relations.items() for k in range(n)]
    return authors, spark.createDataFrame(rows, "initiative_id string, author_id string")


def test_cleanest_most_used_name_is_canonical(spark):
    people = [("a1", "Alejandro Gonzalez Yanez", "senado"), ("a2", "Sen. Alejandro González Yáñez", "senado"), ("a3", "Alejandro González Yáñez", "senado")]
    ranked = clusters.ranked_variants(*author_tables(spark, people, {"a1": 2, "a2": 1, "a3": 4}))
    assert [r.id for r in ranked.orderBy(*clusters.variant_order()).collect()] == ["a3", "a1", "a2"]
    (row,) = clusters.variant_suggestions(ranked).collect()
    assert row.canonical_author_id == "a3" and row.n_authors == 3


def test_order_equals_comparator_where_it_is_consistent(spark):
    people = [(f"p{i}", n, None) for i, n in enumerate(["Ana Ruiz", "ana ruiz,", "Sen. Ana Ruiz", "Ana  Ruiz", "Dip. Ana Ruiz:", "Ana Ruiz del"])]
    counts = {f"p{i}": (i * 7) % 5 for i in range(len(people))}
    ranked = clusters.ranked_variants(*author_tables(spark, people, counts)).collect()

    def compare(a, b):
        if abs(b.quality - a.quality) >= 3:
            return b.quality - a.quality
        return (b.initiative_count - a.initiative_count) or (b.quality - a.quality)

    for row in ranked:
        assert row.defeats == sum(compare(other, row) < 0 for other in ranked)
    wins = sorted(ranked, key=functools.cmp_to_key(compare))
    if all(compare(a, b) <= 0 for i, a in enumerate(wins) for b in wins[i:]):
        assert [r.defeats for r in wins] == sorted(r.defeats for r in ranked)


def test_list_like_names_are_not_merged(spark):
    people = [("a1", "De legisladoras legisladores", "senado"), ("a2", "De las legisladoras los legisladores", "senado"),
              ("b1", "Saúl Monreal Ávila", "senado"), ("b2", "Sen. Saúl Monreal Ávila", "senado")]
    ranked = clusters.ranked_variants(*author_tables(spark, people, {"a1": 2, "a2": 2, "b1": 90}))
    suggestions = clusters.variant_suggestions(ranked)
    assert suggestions.count() == 2
    plan = clusters.safe_author_merges(ranked, suggestions, 0.9).collect()
    assert [(r.alias_author_id, r.canonical_author_id) for r in plan] == [("b2", "b1")]


def test_richer_duplicate_is_canonical(spark):
    rows = [
        ("m", 2, "i1", "Ley", "unknown", "senado-datos-abiertos-local-v1", 40, 1, 0, 1, 0),
        ("m", 2, "i2", "Ley", "in_commissions", "senado-transparencia-json-v1", 20, 2, 2, 2, 1),
    ]
    names = "match_key string, cluster_size long, id string, canonical_title string, normalized_status string, parser string, source_priority int, link_count long, event_count long, author_count long, commission_count long"
    candidates = spark.createDataFrame(rows, names)
    (plan,) = clusters.duplicate_plans(candidates).collect()
    assert (plan.canonical_initiative_id, plan.confidence) == ("i2", 0.99)
    assert plan.reason.startswith("parser=senado-transparencia-json-v1; sourcePriority=20; status=in_commissions")
    (pair,) = clusters.duplicate_pairs(candidates, clusters.duplicate_plans(candidates)).collect()
    assert pair.duplicate_initiative_id == "i1"


def link_frame(spark, rows):
    return spark.createDataFrame(rows, "link_id string, initiative_id string, system string, source_priority int, confidence double, is_primary boolean")


def test_primary_link_by_priority_then_confidence(spark):
    rows = link_frame(spark, [
        ("b", "i1", "senado_transparencia", 30, 0.95, True), ("a", "i1", "sil", 10, 0.8, False),
        ("c", "i2", "gaceta_senado", 20, 0.8, False), ("d", "i2", "gaceta_senado", 20, 1.0, True),
    ])
    assert {r.initiative_id: r.link_id for r in links.primary_links(rows).collect()} == {"i1": "a", "i2": "d"}
    report = {r.initiative_id: r for r in links.rebalance_report(links.rebalanced_links(rows)).collect()}
    assert report["i1"].changed and not report["i2"].changed and report["i1"].link_count == 2


def test_broken_links_keep_defaults(spark):
    given = spark.createDataFrame([("l1", "i1", "s1", 1.0, False), ("l2", "i1", "gone", None, False)], "link_id string, initiative_id string, source_record_id string, confidence double, is_primary boolean")
    records = spark.createDataFrame([("s1", "x")], "source_record_id string, source_id string")
    sources = spark.createDataFrame([("x", "sil", 10)], "source_id string, system string, priority int")
    outer = {r.link_id: r for r in links.ranked_links(given, records, sources).collect()}
    assert (outer["l1"].system, outer["l1"].source_priority) == ("sil", 10)
    assert (outer["l2"].system, outer["l2"].source_priority, outer["l2"].confidence) == (None, 999, 0.0)
    assert links.ranked_links(given, records, sources, inner=True).count() == 1


def test_strong_candidate_is_attached(spark):
    signals = spark.createDataFrame([(0.95, 0.9, 0.8, 0.9, 1.0, 0.7)], list(matching.WEIGHTS))
    assert matching.decide(signals).first().decision == "attach"


def test_hot_cluster_keeps_every_member(spark):
    """A third of all rows in one cluster: every copy is in the result, whatever its size."""
    rows = spark.range(3000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "ley").otherwise(F.concat(F.lit("ley "), F.col("id").cast("string"))).alias("title_normalized"),
        F.lit(None).cast("date").alias("presented_at"),
        F.lit(None).cast("string").alias("originating_chamber"),
    )
    (cluster,) = clusters.duplicate_clusters(rows).collect()
    assert (cluster.match_key, cluster.cluster_size) == ("ley|no-date|no-chamber", 1000)
    assert clusters.duplicate_members(rows).count() == 1000


def test_group_limits_come_before_the_exchange(spark):
    ranked = link_frame(spark, [("a", "i", "sil", 1, 1.0, True)])
    plan = links.primary_links(ranked)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan
