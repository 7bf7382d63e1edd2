"""A written inverted index: postings by term, trigram postings, and score bounds by block.

A request reads the lists of its own terms and trigrams only: the tables are partitioned by a hash of the term and
sorted by term inside, so Parquet prunes to a few files and row groups. No text is read for scoring.

==========  =====================================================================================
documents   key, size (tokens), grams (distinct trigrams), block
postings    bucket, term, block, key, tf, size
terms       bucket, term, documents, occurrences
bounds      bucket, term, block, most: the largest contribution of the term, without its weight, in the block
trigrams    bucket, term (three letters), key, grams
figures     one row: documents, mean size, buckets
==========  =====================================================================================
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curul.functions.text import as_col, let, tokens, trigrams
from curul.operators.keyed import bound
from curul.operators.search import AUTHOR_BAR, B, FUZZY_BAR, K1, final_score, normalized, request_terms

#: Rows of a bucket of the written tables, documents of a block, and of a slice of one term's list.
BUCKET_ROWS, BLOCK_ROWS, SLICE_ROWS = 2_000_000, 2_000, 1_000_000
#: Blocks that are scored first, to learn what a row must reach.
FIRST_BLOCKS = 8
#: Bounds and scores are sums in different orders; a bound this much below the bar still counts.
ROUNDING = 1e-9


COLUMNS = {
    "postings": "bucket int, term string, block long, key {key}, tf long, size int",
    "terms": "bucket int, term string, documents long, occurrences long",
    "bounds": "bucket int, term string, block long, most double",
    "trigrams": "bucket int, term string, key {key}, grams int",
}


def read_lists(documents: DataFrame, path: str, name: str) -> DataFrame:
    """A written table of lists, keyed as ``documents`` is; an empty one has no file to tell its columns."""
    key = documents.schema["key"].dataType.simpleString()
    return documents.sparkSession.read.schema(COLUMNS[name].format(key=key)).parquet(f"{path}/{name}")


# Formulas are SQL texts: a request then costs a few calls to the planner, however many terms it has.
def share(tf: str, size: str, mean: str) -> str:
    """What a term adds to a row's score, without the term's weight."""
    return f"({tf} * {K1 + 1}D / ({tf} + {K1}D * ({1 - B}D + {B}D * {size} / {mean})))"


def weight(n: str, matching: str) -> str:
    return f"ln(1 + ({n} - {matching} + 0.5D) / ({matching} + 0.5D))"


def term_counts(words: Column) -> Column:
    """Each different word of a list with how often it is there, as (term, tf): a sorted list is read once, nothing is shuffled."""

    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: (i < n) & ((i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))))
        return let(begins, lambda at: F.transform(at, lambda i, j: F.struct(F.get(ordered, i).alias("term"), (F.coalesce(F.get(at, j + 1), n) - i).cast("long").alias("tf"))))

    return let(F.sort_array(words), runs)


def write_index(df: DataFrame, key: str, text: Column | str, path: str, grams: bool = True) -> None:
    """Write the index of a table's texts; the key is unique; a null text has no terms and no part in the mean size.

    One pass makes terms and trigrams of each text; the lists are dealt by bucket and slice, so a term in every
    text is written by several tasks. ``grams=False`` leaves the trigrams out, for long texts.
    """
    spark = df.sparkSession
    made = {"_tokens": tokens("_text"), "_grams": trigrams("_text") if grams else F.array().cast("array<string>")}
    rows = bound(df.select(as_col(key).alias("key"), as_col(text).alias("_text")), **made)
    made = rows.select("key", F.size("_tokens").alias("size"), F.size("_grams").alias("grams"), term_counts(F.col("_tokens")).alias("_terms"), "_grams")
    made.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/_made")
    rows = spark.read.parquet(f"{path}/_made")
    n, mean, words, letters = rows.agg(F.count("*"), F.avg("size"), F.sum("size"), F.sum("grams")).first()
    buckets = max(8, (words or 0) // BUCKET_ROWS, (letters or 0) // BUCKET_ROWS)
    slices, mean = max(1, n // SLICE_ROWS), max(mean or 1.0, 1.0e-9)
    # A block holds texts of like length, whose contributions are alike. Small numbers, as every posting has one.
    parts = max(1, n // BLOCK_ROWS)
    block = F.floor(F.log2(F.col("size") + 1)) * F.lit(parts) + F.pmod(F.xxhash64("key"), F.lit(parts))
    block, place = block.cast("long").alias("block"), F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")

    def written(part: DataFrame, name: str, *order: str, told: Column | None = None) -> None:
        """Buckets and ``told`` follow from other columns and are added behind the exchange; columns with a leading _ end there."""
        dealt = part.repartition(place, F.pmod(F.xxhash64("key"), F.lit(slices))) if "key" in part.columns else part.repartition(place)
        dealt = dealt.select(place, *(c for c in dealt.columns if c[0] != "_"), *([] if told is None else [told]))
        dealt.sortWithinPartitions("bucket", *order).write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/{name}")

    rows.select("key", "size", "grams", block).write.mode("overwrite").parquet(f"{path}/documents")
    written(rows.select("key", "size", F.explode("_terms").alias("_t")).select("_t.term", "key", "_t.tf", "size"), "postings", "term", "block", told=block)
    lists = read_lists(rows, path, "postings")
    written(lists.groupBy("term").agg(F.count("*").alias("documents"), F.sum("tf").alias("occurrences")), "terms", "term")
    # Half a double is shuffled: a bound is rounded up to single precision, and so stays one.
    most = (F.expr(share("tf", "size", f"{mean!r}D")) * F.lit(1 + 2.0**-23)).cast("float")
    written(lists.groupBy("term", "block").agg(F.max(most).alias("_most")), "bounds", "term", told=F.col("_most").cast("double").alias("most"))
    if grams:
        written(rows.select("key", "grams", F.explode("_grams").alias("term")), "trigrams", "term")
    spark.createDataFrame([(n, float(mean), int(buckets))], "documents long, mean_size double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/figures")


class TextIndex:
    """A written index, read by request. ``kept`` restricts a request to a table of keys, with the collection figures of these."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        figures = "documents long, mean_size double, buckets int"
        self.n, self.mean, self.buckets = spark.read.schema(figures).parquet(f"{path}/figures").first()
        self.documents = spark.read.parquet(f"{path}/documents")
        self.tables: dict[str, DataFrame] = {}

    def lists(self, name: str, terms: list[str]) -> DataFrame:
        """The rows of some terms: a partition filter on their buckets and a pushed filter on the terms."""
        if name not in self.tables:
            self.tables[name] = read_lists(self.documents, self.path, name)
        quoted = [f"'{t}'" for t in terms]  # letters, digits and blanks
        places = ", ".join(f"cast(pmod(xxhash64({t}), {self.buckets}) as int)" for t in quoted)
        return self.tables[name].where(f"bucket in ({places}) and term in ({', '.join(quoted)})")

    def counts(self, terms: list[str], kept: DataFrame | None, blocks: DataFrame | None = None) -> DataFrame:
        """(key, size, tf0, tf1, ...) of the rows that hold any of the terms."""
        rows = self.lists("postings", terms)
        if blocks is not None:
            rows = rows.join(blocks.select("block"), "block", "left_semi")
        if kept is not None:
            rows = rows.join(kept.select("key"), "key", "left_semi")
        return rows.groupBy("key", "size").agg(*(F.expr(f"coalesce(max(if(term = '{t}', tf, null)), 0) as tf{i}") for i, t in enumerate(terms)))

    def figures(self, terms: list[str], kept: DataFrame | None) -> Column:
        """One struct: rows, mean size, and the rows that hold each term; of the whole index, a read of one row a term, else a scalar subquery."""
        if kept is None:
            held = {r["term"]: r["documents"] for r in self.lists("terms", terms).select("term", "documents").collect()}
            return F.expr("named_struct(" + ", ".join([f"'n', {self.n}L, 'mean', {self.mean!r}D", *(f"'d{i}', {held.get(t, 0)}L" for i, t in enumerate(terms))]) + ")")
        sizes = self.documents.join(kept.select("key"), "key", "left_semi").agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
        held = self.counts(terms, kept).agg(*(F.expr(f"count_if(tf{i} > 0) as d{i}") for i in range(len(terms))))
        whole = sizes.select(F.struct("n", "mean")).scalar()
        return held.select(F.struct(whole["n"].alias("n"), whole["mean"].alias("mean"), *held.columns)).scalar()

    def ranked(self, counts: DataFrame, terms: list[str], figures: Column) -> DataFrame:
        parts = (f"if(tf{i} > 0, {weight('_f.n', f'_f.d{i}')} * {share(f'tf{i}', 'size', '_f.mean')}, 0D)" for i in range(len(terms)))
        return counts.withColumn("_f", figures).selectExpr("key", f"{' + '.join(parts)} as rank_score")

    def keyword(self, query: str, kept: DataFrame | None = None) -> DataFrame:
        """(key, rank_score) of every row that holds a term of the request."""
        terms = request_terms(query)
        if not terms:
            return self.documents.select("key", F.lit(0.0).alias("rank_score")).limit(0)
        return self.ranked(self.counts(terms, kept), terms, self.figures(terms, kept))

    def best(self, query: str, k: int) -> DataFrame:
        """The ``k`` rows of highest rank_score, then smallest key, exact: blocks whose bound is below the k-th best score of a few first blocks are not scored."""
        terms = request_terms(query)
        if not terms:
            return self.keyword(query)
        figures = self.figures(terms, None)
        weights = " ".join(f"when '{t}' then {weight('_f.n', f'_f.d{i}')}" for i, t in enumerate(terms))
        bounds = self.lists("bounds", terms).withColumn("_f", figures).groupBy("block").agg(F.expr(f"sum(most * case term {weights} end) as bound"))
        first = bounds.orderBy(F.desc("bound"), "block").limit(FIRST_BLOCKS)
        reached = self.ranked(self.counts(terms, None, first), terms, figures).orderBy(F.desc("rank_score")).limit(k)
        bar = reached.agg(F.when(F.count("*") == k, F.min("rank_score")).otherwise(F.lit(0.0))).scalar()
        able = bounds.where(F.col("bound") * (1 + ROUNDING) >= bar)
        return self.ranked(self.counts(terms, None, able), terms, figures).orderBy(F.desc("rank_score"), "key").limit(k)

    def letters(self, query: str, bar: float = 0.0, kept: DataFrame | None = None) -> DataFrame:
        """(key, trigram_score) of the rows whose trigram similarity with the request is above ``bar``, by counting shared trigrams.

        A row's own count says how many it must share: similarity above s needs shared * (1 + s) > s * (own + request's).
        """
        mine = request_trigrams(query)
        if not mine:
            return self.documents.select("key", F.lit(0.0).alias("trigram_score")).limit(0)
        rows = self.lists("trigrams", mine)
        if kept is not None:
            rows = rows.join(kept.select("key"), "key", "left_semi")
        counted = rows.groupBy("key", "grams").agg(F.count("*").alias("shared"))
        enough = counted.where(F.col("shared") * (1 + bar) > bar * (F.col("grams") + len(mine)) - ROUNDING)
        return enough.select("key", (F.col("shared") / (F.col("grams") + len(mine) - F.col("shared"))).alias("trigram_score")).where(F.col("trigram_score") > bar)

    def scored(self, query: str, kept: DataFrame | None = None) -> DataFrame:
        """(key, rank_score, trigram_score, final_score) of the rows that match by word or closely enough by letters."""
        words, letters = self.keyword(query, kept), self.letters(query, kept=kept)
        # Who shares a word shares its trigrams.
        both = letters.join(words, "key", "left").withColumn("rank_score", F.coalesce("rank_score", F.lit(0.0)))
        hits = both.where((F.col("rank_score") > 0) | (F.col("trigram_score") > FUZZY_BAR))
        return hits.withColumn("final_score", final_score("rank_score", "trigram_score"))

    def containing(self, query: str) -> DataFrame:
        """(key) of the rows that hold every trigram that a text holding the request must hold; all rows if it has none."""
        needed = inner_trigrams(query)
        documents = self.documents.select("key")
        if not needed:
            return documents
        return self.lists("trigrams", needed).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(needed)).select("key")


def request_trigrams(query: str) -> list[str]:
    """The distinct trigrams of a request's words, padded as the tables' are."""
    padded = [f"  {word} " for word in request_terms(query)]
    return list(dict.fromkeys(p[i : i + 3] for p in padded for i in range(len(p) - 2)))


def inner_trigrams(query: str) -> list[str]:
    """Trigrams of every text that holds the request as a part: a first word may go on to the left, a last one to the right."""
    plain = normalized(query)
    words = [w for w in "".join(c if c.isalnum() else " " for c in plain).split(" ") if w]
    out = []
    for i, word in enumerate(words):
        starts = i > 0 or not plain[:1].isalnum()
        ends = i < len(words) - 1 or not plain[-1:].isalnum()
        padded = ("  " if starts else "") + word + (" " if ends else "")
        out += [padded[j : j + 3] for j in range(len(padded) - 2)]
    return list(dict.fromkeys(out))


def author_hits(index: TextIndex, authors: DataFrame, query: str, bar: float = AUTHOR_BAR) -> DataFrame:
    """Authors (id, full_name, match_score) whose name is like the request or holds it; names are read for candidates only.

    The index is of ``full_name``, whose comparison form is ``name_normalized``.
    """
    near = index.letters(query).withColumnRenamed("trigram_score", "match_score")
    wanted = near.where(F.col("match_score") >= bar).select("key").union(index.containing(query)).distinct()
    rows = authors.join(wanted, authors["id"] == wanted["key"]).drop("key").join(near, F.col("id") == near["key"], "left").drop("key")
    held = F.contains("name_normalized", F.lit(normalized(query)))
    return rows.withColumn("match_score", F.coalesce("match_score", F.lit(0.0))).where((F.col("match_score") >= bar) | held)
