"""Author variants, merges, artifact clean-up and author repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions.names import loose_key, merge_key
from curul.operators import clusters, merges, repairs
from curul.operators.keyed import counts
from curul.plans import staged
from curul.plans.audit_queries import KEYED_SQL, VARIANTS_SQL
from curul.plans.registry import query
from curul.sources.staging import stage

# Merge plans of the staged authors reach this confidence; the default of 0.9 leaves few.
STAGED_CONFIDENCE = 0.75

WORDS_SQL = "len(string_split(trim(regexp_replace(lower(strip_accents(full_name)), '\\s+', ' ', 'g')), ' '))"
QUALITY_SQL = f"""(CASE WHEN regexp_matches(full_name, '^((el|la|los|las)\\s+)?(sen|sen\\.|senador|senadora|dip|dip\\.|diputado|diputada)\\b', 'i') THEN -4 ELSE 4 END
 + CASE WHEN regexp_matches(full_name, '[,:]$') THEN 0 ELSE 1 END
 + CASE WHEN regexp_matches(full_name, '\\b(del|de la|de los|de las)\\s*$', 'i') THEN 0 ELSE 1 END
 + CASE WHEN regexp_matches(full_name, '^[A-ZÁÉÍÓÚÑ][\\p{{L}}\\s.''-]+$') THEN 1 ELSE 0 END - greatest(0, {WORDS_SQL} - 4))"""
MERGE_KEY_SQL = """trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(full_name)), '^(sen\\.|dip\\.)\\s+', ''), '[,\\s]+(morena|pvem|pan|pri|pt|mc|prd|pes|verde|movimiento ciudadano|partido verde ecologista de mexico)$', ''), '[.,;:()]', ' ', 'g'))"""
# The preference of one member over another, written out pair by pair.
RANKED_VARIANTS_SQL = f"""WITH {KEYED_SQL}, {VARIANTS_SQL},
members AS (SELECT k.*, coalesce(c.n, 0) AS initiative_count, CAST({QUALITY_SQL} AS INTEGER) AS quality
  FROM keyed k JOIN variants v USING (cluster_key) LEFT JOIN (SELECT author_id, count(*) AS n FROM st_initiative_authors GROUP BY 1) c ON c.author_id = k.id),
ranked AS (SELECT m.cluster_key, m.id, m.full_name, m.loose_key, m.chamber, m.initiative_count, m.quality,
   (SELECT count(*) FROM members o WHERE o.cluster_key = m.cluster_key AND (o.quality - m.quality >= 3 OR (abs(o.quality - m.quality) < 3
      AND (o.initiative_count > m.initiative_count OR (o.initiative_count = m.initiative_count AND o.quality > m.quality))))) AS defeats
  FROM members m),
placed AS (SELECT *, row_number() OVER (PARTITION BY cluster_key ORDER BY defeats, lower(strip_accents(full_name)), full_name, id) AS rn,
   sum(greatest(initiative_count, 1)) OVER (PARTITION BY cluster_key) AS total, count(*) OVER (PARTITION BY cluster_key) AS n FROM ranked),
suggestions AS (SELECT a.cluster_key, a.loose_key, a.chamber, a.id AS canonical_author_id, a.full_name AS canonical_full_name,
   CAST(a.total AS BIGINT) AS total_relations, a.n AS n_authors,
   round(least(0.99, CAST(0.45 AS DOUBLE) + greatest(a.initiative_count, 1) / a.total * CAST(0.4 AS DOUBLE)
     + least(greatest(a.quality - b.quality, 0), 4) * CAST(0.03 AS DOUBLE)), 2) AS confidence
  FROM placed a JOIN placed b ON a.cluster_key = b.cluster_key AND a.rn = 1 AND b.rn = 2),
safe AS (SELECT cluster_key, min({MERGE_KEY_SQL}) AS canonical_key FROM ranked GROUP BY 1 HAVING count(DISTINCT {MERGE_KEY_SQL}) = 1),
merge AS (SELECT r.id AS alias_author_id, r.full_name AS alias_name, s.canonical_author_id, s.canonical_full_name, s.confidence, f.canonical_key
  FROM suggestions s JOIN safe f USING (cluster_key) JOIN ranked r USING (cluster_key)
  WHERE s.confidence >= {STAGED_CONFIDENCE} AND r.id <> s.canonical_author_id)"""
MERGE_COLUMNS = "alias_author_id alias_name canonical_author_id canonical_full_name confidence canonical_key".split()


def ranked_variants(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.ranked_variants(staged.authors(spark, folder), staged.relations(spark, folder))


def merge_plan(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ranked_variants(spark, folder)
    plan = clusters.safe_author_merges(ranked, clusters.variant_suggestions(ranked), STAGED_CONFIDENCE)
    return plan.select(*MERGE_COLUMNS)


@query("SELECT author_id, count(*) AS initiative_count FROM st_initiative_authors GROUP BY 1")
def author_initiative_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts(staged.relations(spark, folder), "author_id", "initiative_count")


@query(f"WITH {KEYED_SQL} SELECT id, loose_key, {MERGE_KEY_SQL} AS merge_key FROM keyed")
def author_keys(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged.authors(spark, folder)
    return rows.select("id", loose_key("full_name").alias("loose_key"), merge_key("full_name").alias("merge_key"))


@query(f"WITH {KEYED_SQL}, {VARIANTS_SQL} SELECT * FROM variants")
def author_variant_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.variant_clusters(staged.authors(spark, folder))


@query(f"WITH {KEYED_SQL}, {VARIANTS_SQL} SELECT cluster_key, full_name, count(*) AS n_authors FROM keyed JOIN variants v USING (cluster_key) GROUP BY 1, 2")
def author_variant_names(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.variant_names(staged.authors(spark, folder))


@query(RANKED_VARIANTS_SQL + " SELECT cluster_key, id, full_name, initiative_count, quality, CAST(defeats AS BIGINT) AS defeats FROM ranked")
def author_alias_order(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_variants(spark, folder).select(
        "cluster_key", "id", "full_name", "initiative_count", "quality", "defeats"
    )


@query(RANKED_VARIANTS_SQL + " SELECT * FROM suggestions")
def author_variants(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.variant_suggestions(ranked_variants(spark, folder))


@query(RANKED_VARIANTS_SQL + " SELECT * FROM merge")
def safe_author_merges(spark: SparkSession, folder: str) -> DataFrame:
    return merge_plan(spark, folder)


@query(
    RANKED_VARIANTS_SQL
    + """ SELECT r.initiative_id, coalesce(m.canonical_author_id, r.author_id) AS author_id, r.role, r.sort_order
 FROM st_initiative_authors r LEFT JOIN merge m ON m.alias_author_id = r.author_id"""
)
def author_merge_relations(spark: SparkSession, folder: str) -> DataFrame:
    """Relations after the merge (each staged initiative has one author, so none collide)."""
    plan = merge_plan(spark, folder)
    return merges.apply_author_merge(plan, staged.relations(spark, folder), staged.authors(spark, folder))[0]


@query(RANKED_VARIANTS_SQL + " SELECT a.* FROM st_authors a WHERE a.id NOT IN (SELECT alias_author_id FROM merge)")
def author_merge_authors(spark: SparkSession, folder: str) -> DataFrame:
    plan = merge_plan(spark, folder)
    return merges.apply_author_merge(plan, staged.relations(spark, folder), staged.authors(spark, folder))[1]


@query(
    RANKED_VARIANTS_SQL
    + """ SELECT count(DISTINCT canonical_author_id) AS safe_clusters, count(*) AS aliases,
 CAST(coalesce(sum(n), 0) AS BIGINT) AS relations_moved, count(*) FILTER (n IS NULL) AS aliases_without_relations
 FROM merge LEFT JOIN (SELECT author_id, count(*) AS n FROM st_initiative_authors GROUP BY 1) c ON c.author_id = alias_author_id"""
)
def author_merge_counters(spark: SparkSession, folder: str) -> DataFrame:
    return merges.author_merge_counters(merge_plan(spark, folder), staged.relations(spark, folder))


# ---- artifact authors ------------------------------------------------------------------------

# Staged authors as parsing residues: a third carry a collective prefix, some are group names only.
ARTIFACTS_SQL = """
art AS (SELECT id, CASE id % 6 WHEN 0 THEN concat('senadores ', full_name) WHEN 1 THEN 'Grupo Parlamentario del PAN'
   WHEN 2 THEN concat('las senadoras y de los senadores ', full_name) ELSE full_name END AS full_name, name_normalized, chamber,
   CASE id % 6 WHEN 0 THEN full_name WHEN 2 THEN full_name END AS person FROM st_authors)"""


def artifact_authors(spark: SparkSession, folder: str) -> DataFrame:
    rows = staged.authors(spark, folder)
    kind = F.col("id") % 6
    return rows.withColumn(
        "full_name",
        F.when(kind == 0, F.concat(F.lit("senadores "), F.col("full_name")))
        .when(kind == 1, "Grupo Parlamentario del PAN")
        .when(kind == 2, F.concat(F.lit("las senadoras y de los senadores "), F.col("full_name")))
        .otherwise(F.col("full_name")),
    )


@query(
    f"WITH {ARTIFACTS_SQL} SELECT r.initiative_id, r.author_id, CASE WHEN id % 6 = 1 THEN 'delete' ELSE 'rewrite' END AS action, "
    "coalesce(person, full_name) AS canonical_full_name FROM st_initiative_authors r JOIN art ON art.id = r.author_id WHERE id % 6 < 3"
)
def artifact_author_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = repairs.artifact_plan(staged.relations(spark, folder), artifact_authors(spark, folder))
    return plan.select("initiative_id", "author_id", "action", "canonical_full_name")


@query(
    f"""WITH {ARTIFACTS_SQL},
 named AS (SELECT r.initiative_id, CASE WHEN id % 6 < 3 THEN person ELSE full_name END AS author_name, chamber
   FROM st_initiative_authors r JOIN art ON art.id = r.author_id WHERE id % 6 <> 1)
 SELECT initiative_id, trim(lower(strip_accents(author_name))) AS author_name, chamber FROM named"""
)
def artifact_author_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """Who signs each initiative after the clean-up."""
    from curul.functions.text import normalize_text

    people = artifact_authors(spark, folder).withColumn("id", F.col("id").cast("string"))
    signed = staged.relations(spark, folder).withColumn("author_id", F.col("author_id").cast("string"))
    plan = repairs.artifact_plan(signed, people)
    fixed, grown = repairs.apply_artifact_plan(plan, signed, people)
    names = grown.select(F.col("id").alias("author_id"), normalize_text("full_name").alias("author_name"), "chamber")
    return fixed.join(names, "author_id").select("initiative_id", "author_name", "chamber")


@query(
    """SELECT i.id AS initiative_id, CAST(1 AS INTEGER) AS sort_order, 'Ana Ruiz' AS full_name FROM st_initiatives i
 WHERE parser = 'senado-transparencia-json-v1'"""
)
def author_repairs(spark: SparkSession, folder: str) -> DataFrame:
    """Initiatives whose stored authors differ from their proponent text, with the wanted list."""
    rows = staged.initiatives(spark, folder).withColumn("cargo_proponente", F.col("metadata")["cargo_proponente"])
    wanted = repairs.author_repairs(rows, staged.relations(spark, folder), staged.authors(spark, folder))
    return wanted.select("initiative_id", "sort_order", "full_name")
