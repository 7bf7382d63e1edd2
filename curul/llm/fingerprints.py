"""Document fingerprints by winnowing, in DataFrame expressions only.

Every k-gram of a text is hashed; of each window of w neighbouring hashes the smallest is chosen, the
rightmost of equals, with its position. Any two texts that share w + k - 1 characters in a row share a chosen hash.
A value carries the hash in its high bits and the position, counted down, in its low ones, so one
minimum settles both; window minima come from log2(w) steps that double the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from curul.llm.common import let, query, table, texts

GRAM = 12
WINDOW = 16
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1


BLOCK = 16


def chosen_by_block(rows: DataFrame, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``rows`` with a text ``txt``, one row per ``block`` windows, and ``picked``: the values chosen in those.

    A text shorter than a gram is one gram, one with fewer grams than a window is one window, the
    empty text has one block and nothing chosen. ``window`` is a power of two. Texts may be as long as 2**28 characters.
    All hashes and minima of a block are columns, so they run as compiled code; two blocks may choose
    the same value, and null stands for no window.
    """
    kept = [c for c in rows.columns if c != "txt"]
    grams = F.greatest(F.length("txt") - (gram - 1), F.least(F.length("txt"), F.lit(1)))
    many = block + window - 1
    windows = F.greatest(F.lit(1), F.col("grams") - (window - 1))
    sized = rows.select(*kept, "txt", grams.alias("grams")).withColumn("blocks", ((windows - 1) / block).cast("int"))

    def pieces(wide: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.col("blocks")), lambda b: F.substring(wide, b * (4 * block) + 1, F.lit(4 * (many + gram - 1))))

    # The text itself does not go along with its blocks.
    cut = sized.select(*kept, "grams", F.posexplode(let(F.encode("txt", "UTF-32"), pieces)).alias("block", "piece"))
    cut = cut.select(*kept, "grams", (F.col("block") * block).alias("from"), "piece")

    def value(j: int) -> Column:
        hashed = F.xxhash64(F.expr(f"substring(piece, {4 * j + 1}, {4 * gram})")).bitwiseAND(F.lit(~PLACES))
        return F.when(F.col("from") + j < F.col("grams"), hashed + (F.lit(PLACES).cast("long") - F.col("from") - j)).alias(f"v{j}")

    level = cut.select(*kept, "grams", "from", *map(value, range(many)))
    step = 1
    while step < window:
        many -= step
        level = level.select(*kept, "grams", "from", *(F.least(f"v{j}", f"v{j + step}").alias(f"v{j}") for j in range(many)))
        step *= 2
    # A window that reaches beyond the last gram is none, unless it is the only one.
    whole = [F.when((F.col("from") + j + window <= F.col("grams")) | (F.col("from") + j == 0), F.col(f"v{j}")) for j in range(block)]
    return level.select(*kept, "from", F.array_distinct(F.array(*whole)).alias("picked"))


def hashes_of(values: Column) -> Column:
    return F.array_distinct(F.transform(values, lambda v: F.shiftright(v, PLACE_BITS)))


def positions(values: Column) -> Column:
    """(hash, position) of each chosen value: the fingerprint that matches can be located with."""
    return F.transform(values, lambda v: F.struct(F.shiftright(v, PLACE_BITS).alias("hash"), (F.lit(PLACES) - v.bitwiseAND(F.lit(PLACES))).alias("at")))


def digest(values: Column) -> Column:
    """A short name of a whole fingerprint, hashes and positions."""
    return F.concat(*(F.lpad(F.lower(F.hex(F.xxhash64(F.lit(seed), values))), 16, "0") for seed in (1, 2)))


def likeness(a: Column, b: Column) -> Column:
    """Share of the hashes of either fingerprint that both have; two empty ones are alike."""

    def share(x: Column, y: Column) -> Column:
        both = F.size(F.array_intersect(x, y))
        return F.when(F.size(x) + F.size(y) == 0, 1.0).otherwise(both / (F.size(x) + F.size(y) - both))

    return let(hashes_of(a), lambda x: let(hashes_of(b), lambda y: share(x, y)))


def with_next(docs: DataFrame, per_bucket: int = 2000, most: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text) with bucket and order for a window in which each row meets the next.

    Rows are dealt by ranges of doc_id between its own quantiles. A range's first document is dealt to the
    range before as well, marked ``ghost``, and the very first to the last range, so no range needs another.
    """
    order = F.coalesce("doc_id", F.lit((1 << 63) - 1))
    keyed = docs.withColumns({"order": order, "text": F.coalesce("text", F.lit(""))})
    about = keyed.agg(F.count("*").alias("n"), F.min("order").alias("first")).first()
    buckets = min(most, max(1, about["n"] // per_bucket))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = keyed.agg(F.percentile_approx("order", F.array(*map(F.lit, shares)), 10 * most)).first()[0] if shares else []
    cuts = sorted({c for c in cuts or [] if c > about["first"]})
    bounds = F.array(*map(F.lit, cuts)).cast("array<bigint>")
    own = F.size(F.filter(bounds, lambda b: b <= F.col("order")))
    at = [F.struct(own.alias("bucket"), F.lit(0).alias("ghost"))]
    at.append(F.when(F.array_contains(bounds, F.col("order")), F.struct((own - 1).alias("bucket"), F.lit(1).alias("ghost"))))
    at.append(F.when(F.col("order") == F.lit(about["first"]), F.struct(F.lit(len(cuts)).alias("bucket"), F.lit(2).alias("ghost"))))
    return keyed.withColumn("at", F.explode(F.array_compact(F.array(*at)))).select("doc_id", "text", "order", "at.bucket", "at.ghost")


def fingerprinted(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, size, digest of its edited form, and the chosen values of its text, that form and the next text.

    The edited text ends in the beginning of the next document's, by ascending doc_id, in place of its last quarter.
    Defined cases: null text is the empty text; a null doc_id comes last; rows with one doc_id follow
    each other in the order of a hash of their text; the only row is its own next; an empty table gives no rows.
    """
    dealt = with_next(docs)
    ahead = W.partitionBy("bucket").orderBy("ghost", "order", F.xxhash64("text"))
    quarter = F.floor(F.length("text") / 4).cast("int")
    following = dealt.select("doc_id", "text", "bucket", "ghost", F.row_number().over(ahead).alias("row"), F.lead("text").over(ahead).alias("next"))
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - quarter), F.substring("next", F.lit(1), quarter))
    both = following.select("doc_id", "bucket", "ghost", "row", F.posexplode(F.array("text", F.when(F.col("ghost") == 0, edited))).alias("form", "txt")).where("txt is not null")
    picked = chosen_by_block(both.select("*", F.length("txt").alias("n_chars"), F.when(F.col("form") == 1, F.sha2(F.encode("txt", "UTF-8"), 256)).alias("sha")), gram, window)
    once = F.col("from") == 0  # what belongs to the text goes along with its first block only

    def values(form: int) -> Column:
        return F.array_except(F.flatten(F.collect_list(F.when(F.col("form") == form, F.col("picked")))), F.array(F.lit(None).cast("bigint")))

    # All of a row's blocks are where the row is: no shuffle, and a row's values are bounded by its text.
    rows = picked.groupBy("bucket", "ghost", "row").agg(
        F.max(F.when(once & (F.col("form") == 0), F.col("doc_id"))).alias("doc_id"),
        F.max(F.when(once & (F.col("form") == 0), F.col("n_chars"))).cast("long").alias("n_chars"),
        F.max(F.when(once, F.col("sha"))).alias("edited_sha256"),
        F.sort_array(values(0)).alias("values"),
        F.sort_array(values(1)).alias("edited_values"),
    )
    return rows.withColumn("next_values", F.lead("values").over(W.partitionBy("bucket").orderBy("row"))).where("ghost = 0").drop("bucket", "ghost", "row")


@query()
def op2_document_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts, and likenesses to those and to the next document."""
    rows = fingerprinted(texts(table(spark, folder, "documents")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        digest(F.col("values")).alias("fingerprint"), digest(F.col("edited_values")).alias("edited_fingerprint"),
        likeness(F.col("values"), F.col("edited_values")).alias("near_edited"), likeness(F.col("values"), F.col("next_values")).alias("near_next"),
        F.size("values").cast("long").alias("n_chosen"),
    )
