"""Listings, ranked search, details, timelines and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.operators import details, search, vectors
from curul.operators.index import author_hits
from curul.plans import indexes, staged
from curul.plans.registry import query, sql_norm
from curul.sources.scans import table
from curul.sources.staging import stage

TITLE_QUERY = "reforma ley red widget"
DOCUMENT_QUERY = "leaux thing der onthsh que"
AUTHOR_QUERY = "José Núñez b"


def _tokens_sql(text: str) -> str:
    return f"regexp_extract_all({sql_norm(text)}, '[\\p{{L}}\\p{{N}}]+')"


def _grams_sql(tokens: str) -> str:
    return (
        f"list_distinct(flatten(list_transform({tokens}, lambda w: "
        f"list_transform(generate_series(1, length(w) + 1), lambda i: substr('  ' || w || ' ', i, 3)))))"
    )


def _bm25_sql(table_sql: str, key: str, text: str, request: str, keep: str = "") -> str:
    """CTEs ``bm`` (key, rank_score) by the published formula."""
    terms = ", ".join(f"('{t}')" for t in search.request_terms(request))
    return f"""toks AS (SELECT {key} AS k, {_tokens_sql(text)} AS t{keep} FROM {table_sql}),
 figures AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM toks),
 terms(term) AS (VALUES {terms}),
 tf AS (SELECT k, term, len(list_filter(t, lambda x: x = term)) AS f, len(t) AS size FROM toks, terms),
 df AS (SELECT term, count(*) FILTER (f > 0) AS d FROM tf GROUP BY 1),
 bm AS (SELECT k, sum(CASE WHEN f > 0 THEN ln(1 + (n - d + 0.5) / (d + 0.5)) * f * CAST(2.2 AS DOUBLE) / (f + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * size / mean)) ELSE 0 END) AS rank_score
   FROM tf JOIN df USING (term), figures GROUP BY 1)"""


# ---- listings --------------------------------------------------------------------------------

LISTED = "id canonical_title normalized_status presented_at".split()


@query(
    """SELECT id, canonical_title, normalized_status, presented_at FROM st_initiatives WHERE normalized_status = 'presented' AND originating_chamber = 'senado'
 AND presented_at BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' AND canonical_title ILIKE '%LEY DE%' ORDER BY presented_at DESC NULLS FIRST, created_at DESC, id LIMIT 50 OFFSET 10"""
)
def listing_filtered(spark: SparkSession, folder: str) -> DataFrame:
    filters = search.Filters(status="presented", chamber="senado", date_from="1995-01-01", date_to="1997-12-31")
    rows = search.listing(stage(spark, folder, "st_initiatives"), filters, limit=50, offset=10, title="LEY DE")
    return rows.select(*LISTED)


@query(
    """SELECT id, canonical_title, normalized_status, presented_at FROM st_initiatives ORDER BY presented_at DESC NULLS FIRST, created_at DESC, id LIMIT 100"""
)
def listing_latest(spark: SparkSession, folder: str) -> DataFrame:
    return search.listing(stage(spark, folder, "st_initiatives"), search.Filters(), limit=100).select(*LISTED)


def _commissions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    assigned = staged.senate_assignments(spark, folder)
    commissions = assigned.select("name", "name_normalized").distinct().withColumn("id", F.sha2("name_normalized", 256))
    rows = assigned.select("initiative_id", F.sha2("name_normalized", 256).alias("commission_id"))
    return commissions, rows


AUTHOR_IDS_SQL = "SELECT initiative_id FROM st_initiative_authors WHERE author_id IN (SELECT id FROM st_authors WHERE full_name ILIKE '%José Núñez%' OR name_normalized ILIKE '%jose nunez%')"


@query(
    f"""SELECT id, canonical_title, normalized_status, presented_at FROM st_initiatives WHERE normalized_status <> 'x' AND id IN ({AUTHOR_IDS_SQL})
 AND originating_chamber = 'senado' AND id % 5 = 1 ORDER BY presented_at DESC NULLS LAST, canonical_title, id LIMIT 60"""
)
def listing_constrained(spark: SparkSession, folder: str) -> DataFrame:
    commissions, assignments = _commissions(spark, folder)
    rows = search.listing_constrained(
        stage(spark, folder, "st_initiatives"),
        search.Filters(author="José Núñez", commission="gobernacion"),
        limit=60,
        authors=staged.authors(spark, folder),
        relations=staged.relations(spark, folder),
        commissions=commissions,
        assignments=assignments,
    )
    return rows.select(*LISTED)


@query("SELECT id FROM st_authors WHERE full_name ILIKE '%núñez b_%' OR name_normalized ILIKE '%nunez b_%'")
def name_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return search.name_lookup(staged.authors(spark, folder), "full_name", "núñez b_").select("id")


# ---- ranked search ---------------------------------------------------------------------------


@query(
    f"""WITH {_bm25_sql('documents', 'doc_id', 'text', DOCUMENT_QUERY)} SELECT k AS doc_id, round(rank_score, 6) AS rank_score FROM bm
 WHERE rank_score > 0 ORDER BY rank_score DESC, k LIMIT 100"""
)
def keyword_search(spark: SparkSession, folder: str) -> DataFrame:
    """The hundred best documents for a request, from the lists of its terms; whole texts are indexed."""
    best = indexes.documents(spark, folder).best(DOCUMENT_QUERY, 100)
    return best.select(F.col("key").alias("doc_id"), F.round("rank_score", 6).alias("rank_score"))


@query(
    f"""WITH q AS (SELECT {_grams_sql(_tokens_sql("'" + TITLE_QUERY + "'"))} AS g),
 t AS (SELECT id, {_grams_sql(_tokens_sql('canonical_title'))} AS g FROM st_initiatives)
 SELECT id, round(len(list_intersect(t.g, q.g)) / (len(t.g) + len(q.g) - len(list_intersect(t.g, q.g))), 6) AS trigram_score FROM t, q"""
)
def trigram_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = search.trigram_scores(stage(spark, folder, "st_initiatives"), "canonical_title", TITLE_QUERY)
    return rows.select("id", F.round("trigram_score", 6).alias("trigram_score"))


def _search_sql(where: str) -> str:
    return f"""WITH kept AS (SELECT * FROM st_initiatives WHERE {where}),
 {_bm25_sql('kept', 'id', 'canonical_title', TITLE_QUERY)},
 q AS (SELECT {_grams_sql(_tokens_sql("'" + TITLE_QUERY + "'"))} AS g),
 t AS (SELECT id, canonical_title, {_grams_sql(_tokens_sql('canonical_title'))} AS g FROM kept),
 s AS (SELECT id, canonical_title, rank_score, len(list_intersect(t.g, q.g)) / (len(t.g) + len(q.g) - len(list_intersect(t.g, q.g))) AS trigram_score FROM t JOIN bm ON bm.k = t.id, q),
 f AS (SELECT *, CAST(0.6 AS DOUBLE) * (rank_score / (rank_score + 1)) + CAST(0.4 AS DOUBLE) * trigram_score AS final_score FROM s WHERE rank_score > 0 OR trigram_score > 0.2)"""


@query(_search_sql("true") + " SELECT id, canonical_title, round(final_score, 6) AS score, 'keyword,fuzzy' AS matched_on FROM f WHERE trigram_score > 0.2 ORDER BY round(final_score, 9) DESC, id LIMIT 50")
def topic_search(spark: SparkSession, folder: str) -> DataFrame:
    """The fifty best titles by word and by letters; the initiatives are read for these fifty."""
    hits = indexes.titles(spark, folder).scored(TITLE_QUERY)
    best = hits.orderBy(F.round("final_score", 9).desc(), "key").limit(50)
    rows = stage(spark, folder, "st_initiatives").join(best.withColumnRenamed("key", "id"), "id")
    return search.as_results(rows).select(
        "id", "canonical_title", F.round("score", 6).alias("score"), F.array_join("matched_on", ",").alias("matched_on")
    )


@query(_search_sql("normalized_status = 'presented' AND presented_at >= DATE '1996-01-01'") + f" SELECT id, round(final_score, 6) AS final_score FROM f")
def search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    """Every hit among the initiatives that pass the filters."""
    filters = search.Filters(status="presented", date_from="1996-01-01")
    kept = search.scalar_filters(stage(spark, folder, "st_initiatives"), filters).select(F.col("id").alias("key"))
    rows = indexes.titles(spark, folder).scored(TITLE_QUERY, kept)
    return rows.select(F.col("key").alias("id"), F.round("final_score", 6).alias("final_score"))


@query(
    _search_sql(f"originating_chamber = 'senado' AND id % 5 = 1 AND id IN ({AUTHOR_IDS_SQL})") + " SELECT id, round(rank_score, 6) AS rank_score, round(final_score, 6) AS final_score FROM f"
)
def search_constrained(spark: SparkSession, folder: str) -> DataFrame:
    """Every hit among the initiatives of an author and of a commission."""
    commissions, assignments = _commissions(spark, folder)
    filters = search.Filters(author="José Núñez", commission="gobernacion")
    kept = search.constrained(
        stage(spark, folder, "st_initiatives"), filters, staged.authors(spark, folder), staged.relations(spark, folder), commissions, assignments
    ).select(F.col("id").alias("key"))
    rows = indexes.titles(spark, folder).scored(TITLE_QUERY, kept)
    return rows.select(F.col("key").alias("id"), F.round("rank_score", 6).alias("rank_score"), F.round("final_score", 6).alias("final_score"))


@query(
    f"""WITH q AS (SELECT {_grams_sql(_tokens_sql("'" + AUTHOR_QUERY + "'"))} AS g),
 t AS (SELECT id, full_name, name_normalized, {_grams_sql(_tokens_sql('full_name'))} AS g FROM st_authors),
 a AS (SELECT id AS author_id, full_name AS author_name, len(list_intersect(t.g, q.g)) / (len(t.g) + len(q.g) - len(list_intersect(t.g, q.g))) AS score, name_normalized FROM t, q),
 hits AS (SELECT * FROM a WHERE score >= 0.3 OR contains(name_normalized, 'jose nunez b'))
 SELECT r.initiative_id, r.author_id, author_name, round(score, 6) AS match_score FROM hits JOIN st_initiative_authors r USING (author_id) JOIN st_initiatives i ON i.id = r.initiative_id
 ORDER BY score DESC, presented_at DESC NULLS LAST, initiative_id, author_id LIMIT 100"""
)
def author_search(spark: SparkSession, folder: str) -> DataFrame:
    """Initiatives of the authors whose name is like the request, found by shared trigrams."""
    hits = author_hits(indexes.names(spark, folder), staged.authors(spark, folder), AUTHOR_QUERY)
    rows = search.authored(hits, staged.relations(spark, folder), stage(spark, folder, "st_initiatives"), 100)
    return rows.select("initiative_id", "author_id", "author_name", F.round("match_score", 6).alias("match_score"))


@query("SELECT 'jose nunez' AS author, 'iniciativas de sobre agua' AS rest WHERE EXISTS (SELECT 1 FROM st_authors WHERE full_name ILIKE '%jose nunez%')")
def embedded_author(spark: SparkSession, folder: str) -> DataFrame:
    return search.embedded_author(staged.authors(spark, folder), "Iniciativas de José Núñez sobre agua")


# Conversation turns as requests: some name an author in full, some by parts of words, some not at all.
REQUESTS_SQL = """SELECT concat(conv_id, '-', turn) AS request_id, CASE conv_id % 4 WHEN 0 THEN concat(text, ' Sen. José Núñez ', w, ' agua') WHEN 1 THEN concat('jose nun ', text)
 WHEN 2 THEN concat('ez ', w, ' ', text, ' José Núñez') ELSE text END AS request
FROM (SELECT *, translate(CAST(conv_id AS STRING), '0123456789', 'bcdfghjkmn') AS w FROM conversations) c"""


@query(
    f"""WITH req AS ({REQUESTS_SQL}), wl AS (SELECT request_id, list_filter(string_split({sql_norm('request')}, ' '), lambda x: x <> '') AS ws FROM req),
 places AS (SELECT request_id, ws, unnest(range(len(ws) - 1)) AS p FROM wl WHERE len(ws) > 1),
 runs AS (SELECT request_id, size, p, array_to_string(ws[p + 1 : p + size], ' ') AS run FROM places, (VALUES (2), (3), (4)) z(size) WHERE p + size <= len(ws)),
 known AS (SELECT run FROM (SELECT DISTINCT run FROM runs) r WHERE EXISTS (SELECT 1 FROM st_authors a WHERE contains(lower(full_name), run) OR contains(lower(name_normalized), run))),
 best AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY size DESC, p) AS rn FROM runs WHERE run IN (SELECT run FROM known))
 SELECT request_id, run AS author, array_to_string(list_concat(ws[1 : p], ws[p + size + 1 :]), ' ') AS rest FROM best JOIN wl USING (request_id) WHERE rn = 1"""
)
def embedded_authors(spark: SparkSession, folder: str) -> DataFrame:
    """The authors that a whole table of requests names."""
    view = REQUESTS_SQL.replace("FROM conversations", f"FROM parquet.`{folder}/conversations.parquet`")
    return search.embedded_authors(spark.sql(view), staged.authors(spark, folder), "request_id", "request")


@query(
    f"""WITH toks AS (SELECT doc_id, unnest({_tokens_sql('text')}) AS term FROM documents)
 SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences FROM toks GROUP BY 1"""
)
def term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Document frequency and occurrences of every term: the head of the inverted index."""
    rows = search.postings(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return rows.groupBy("term").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("tf").alias("occurrences")
    )


@query(
    f"""WITH {_bm25_sql('documents', 'doc_id', 'text', DOCUMENT_QUERY)},
 a AS (SELECT k, row_number() OVER (ORDER BY round(rank_score, 9) DESC, k) AS r FROM bm WHERE rank_score > 0),
 b AS (SELECT doc_id AS k, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS r FROM documents)
 SELECT coalesce(a.k, b.k) AS doc_id, round(coalesce(1.0 / (60 + CAST(a.r AS DOUBLE)), 0) + coalesce(1.0 / (60 + CAST(b.r AS DOUBLE)), 0), 9) AS fused_score FROM a FULL JOIN b ON a.k = b.k"""
)
def hybrid_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two ranked lists of documents, by keyword and by length, fused by reciprocal rank."""
    docs = table(spark, folder, "documents", "doc_id", "text", "n_chars")
    words = search.keyword_scores(docs, "text", DOCUMENT_QUERY).filter(F.col("rank_score") > 0)
    by_word = words.select("doc_id", F.round("rank_score", 9).alias("score"))
    by_length = docs.select("doc_id", F.col("n_chars").alias("score"))
    rows = search.fused([by_word, by_length], "doc_id")
    return rows.select("doc_id", F.round("fused_score", 9).alias("fused_score"))


@query(
    """WITH m AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS v, unnest(generate_series(1, len(embedding))) AS i FROM embeddings),
 c AS (SELECT label, list(v ORDER BY i) AS q FROM (SELECT label, i, avg(v) AS v FROM m GROUP BY 1, 2) GROUP BY 1),
 s AS (SELECT c.label, vec_id, list_cosine_similarity(c.q, CAST(embedding AS DOUBLE[])) AS score FROM embeddings e, c),
 r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s)
 SELECT CAST(label AS BIGINT) AS query_id, vec_id, round(score, 6) AS score FROM r WHERE rn <= 10"""
)
def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten vectors nearest to the mean of each label."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding", "label")
    best = vectors.top_similar(rows, "vec_id", "embedding", vectors.centroids(rows, "label", "embedding"), 10)
    return best.select("query_id", "vec_id", F.round("score", 6).alias("score"))


RECALL_SQL = "SELECT count(*) AS queries, CAST(sum(least(10, (SELECT count(*) FROM embeddings))) AS BIGINT) AS neighbours, true AS enough FROM embeddings WHERE vec_id % 50 = 0"


@query(RECALL_SQL)
def vector_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Search by inverted lists held against the exact search: every fiftieth vector asks all rows; nine of ten neighbours at least are found."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    exact = vectors.top_similar(rows, "vec_id", "embedding", asked, 10)
    found = vectors.probed(spark, indexes.vector_lists(spark, folder), "vec_id", asked, 10)
    by_query = vectors.recall(found, exact, "vec_id")
    return by_query.agg(F.count("*").alias("queries"), F.sum("exact").alias("neighbours"), (F.sum("found") >= 0.9 * F.sum("exact")).alias("enough"))


@query(
    """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0),
 s AS (SELECT query_id, vec_id, list_cosine_similarity(v, CAST(embedding AS DOUBLE[])) AS score FROM embeddings, q),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s)
 SELECT query_id, vec_id, round(score, 6) AS score FROM r WHERE rn <= 3"""
)
def vector_lists_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The three nearest vectors of every fiftieth one, from the inverted lists, all of which are probed."""
    rows = table(spark, folder, "embeddings", "vec_id", "embedding")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = vectors.probed(spark, indexes.vector_lists(spark, folder), "vec_id", asked, 3, probes=1 << 30)
    return best.select("query_id", "vec_id", F.round("score", 6).alias("score"))


# ---- detail and timeline ---------------------------------------------------------------------


@query(
    """SELECT id AS initiative_id, canonical_title, normalized_status, presented_at,
 (SELECT count(*) FROM st_initiative_authors a WHERE a.initiative_id = i.id) AS author_count,
 (SELECT count(*) FROM st_source_links a WHERE a.initiative_id = i.id) AS source_link_count,
 (SELECT count(*) FROM st_events a WHERE a.initiative_id = i.id) AS event_count, CAST(0 AS BIGINT) AS document_count FROM st_initiatives i"""
)
def detail(spark: SparkSession, folder: str) -> DataFrame:
    rows = details.detail_headers(
        stage(spark, folder, "st_initiatives"),
        staged.relations(spark, folder),
        stage(spark, folder, "st_source_links"),
        staged.events(spark, folder),
    )
    return rows.select(
        "initiative_id", "canonical_title", "normalized_status", "presented_at", "author_count",
        "source_link_count", "event_count", "document_count",
    )


@query(
    """SELECT l.initiative_id, string_agg(concat(s.system, ' ', r.source_url), '; ' ORDER BY s.priority, l.link_id) AS source_links, count(*) AS n
 FROM st_source_links l JOIN st_source_records r USING (source_record_id) JOIN st_sources s USING (source_id) GROUP BY 1"""
)
def detail_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Nested source links of every initiative."""
    rows = details.detail_sources(
        stage(spark, folder, "st_source_links"), stage(spark, folder, "st_source_records"), stage(spark, folder, "st_sources"), page=None
    )
    shown = F.transform("source_links", lambda s: F.concat_ws(" ", s["system"], s["source_url"]))
    return rows.select(
        "initiative_id", F.array_join(shown, "; ").alias("source_links"), F.size("source_links").cast("long").alias("n")
    )


@query(
    "SELECT r.initiative_id, concat(a.id, ' ', a.full_name, ' ', r.role) AS authors FROM st_initiative_authors r JOIN st_authors a ON a.id = r.author_id"
)
def detail_authors(spark: SparkSession, folder: str) -> DataFrame:
    rows = details.detail_authors(staged.relations(spark, folder), staged.authors(spark, folder))
    shown = F.transform("authors", lambda a: F.concat_ws(" ", a["author_id"].cast("string"), a["full_name"], a["role"]))
    return rows.select("initiative_id", F.array_join(shown, "; ").alias("authors"))


@query(
    """SELECT e.event_id, e.initiative_id, e.event_type, e.event_date, coalesce(l.links, '') AS source_links FROM st_events e LEFT JOIN
 (SELECT link_id, string_agg(concat(s.system, ' ', r.source_url), '; ' ORDER BY s.system, source_record_id) AS links FROM st_source_links
  JOIN st_source_records r USING (source_record_id) JOIN st_sources s USING (source_id) GROUP BY 1) l ON l.link_id = e.event_id"""
)
def timeline(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all initiatives with their nested sources."""
    event_links = stage(spark, folder, "st_source_links").select(F.col("link_id").alias("event_id"), "source_record_id")
    rows = details.timeline(
        staged.events(spark, folder), event_links, stage(spark, folder, "st_source_records"), stage(spark, folder, "st_sources"), page=None
    )
    shown = F.transform("source_links", lambda s: F.concat_ws(" ", s["system"], s["source_url"]))
    return rows.select(
        "event_id", "initiative_id", "event_type", "event_date", F.coalesce(F.array_join(shown, "; "), F.lit("")).alias("source_links")
    )
