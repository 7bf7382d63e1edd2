"""Matching incoming records to existing initiatives, and the attach / review / create decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.text import as_col, matches, metadata_text, trigram_similarity, trigrams
from curul.operators.keyed import best_per_key, bound
from curul.session import durable

# --- fixed values: signal weights, thresholds, the sources' constant signals, match rules -----
WEIGHTS = {
    "title_similarity": 0.35,
    "alias_similarity": 0.15,
    "author_overlap": 0.15,
    "date_proximity": 0.15,
    "chamber_consistency": 0.1,
    "affected_norm_overlap": 0.1,
}
ATTACH, REVIEW = 0.85, 0.6
CHAMBER_SIGNAL = {"sil": 0.5, "gaceta_diputados": 1.0, "gaceta_senado": 1.0, "senado_transparencia": 1.0}
POPUP_TITLES = r"SIL - Sistema de Informaci[oó]n Legislativa|PopUp Contenido Asuntos"
DETAIL_PARSER = "sil-detail-html-v1"


@dataclass(frozen=True)
class Rule:
    """Equal values of (incoming column, existing column) pairs; date and title are named too."""

    on: tuple[tuple[str, str], ...]
    date: str | None = None  # None: not compared; "equal": nulls never match; "null_safe"
    title: bool = False


MATCH_RULES: dict[str, tuple[tuple[Rule, ...], ...]] = {
    "sil": (
        (
            Rule((("detail_source_url", "detail_source_url"),), date="equal"),
            Rule((("detail_source_url", "detail_url"),), date="equal"),
            Rule((("result_source_url", "result_source_url"),), date="equal"),
        ),
        (Rule((("dedupe_hash", "sil_dedupe_hash"),), date="null_safe", title=True),),
        (Rule((), date="null_safe", title=True),),
    ),
    "gaceta_diputados": (
        (
            Rule(
                (
                    ("source_entry_id", "source_entry_id"),
                    ("gaceta_issue_number", "gaceta_issue_number"),
                    ("source_legislature", "source_legislature"),
                ),
                date="equal",
            ),
        ),
        (
            Rule(
                (
                    ("source_page_url", "source_page_url"),
                    ("source_block_index", "source_block_index"),
                    ("source_legislature", "source_legislature"),
                ),
                date="equal",
            ),
        ),
        (Rule((("dedupe_hash", "diputados_dedupe_hash"),), date="equal", title=True),),
        (Rule((), date="equal", title=True),),
    ),
    "gaceta_senado": (
        (
            Rule((("dedupe_hash", "senado_dedupe_hash"),), title=True),
            Rule((("source_document_id", "source_document_id"),), title=True),
        ),
    ),
    "senado_transparencia": (
        (
            Rule((("dedupe_hash", "senado_dedupe_hash"),), title=True),
            Rule((("source_record_key", "source_record_key"),), title=True),
            Rule((("source_url", "source_document_url"),), title=True),
        ),
    ),
}
# --- end of fixed values ----------------------------------------------------------------------

RECORD_COLUMNS = {"dedupe_hash", "source_record_key", "source_url"}


def match_score(title: Column | str, parser: Column | str) -> Column:
    """Preference among several matches: a real title over a popup's, then the detail parser."""
    real = ~matches(F.coalesce(as_col(title), F.lit("")), POPUP_TITLES)
    return F.when(real, 10).otherwise(0) + F.when(as_col(parser) == DETAIL_PARSER, 2).otherwise(0)


def match_existing(records: DataFrame, initiatives: DataFrame, source: str) -> DataFrame:
    """(source_record_key, matched_id, rule) for the records that match an initiative.

    Each rule is an equi-join against the best initiative per key, so a key shared by very many
    initiatives gives one candidate and no pairs. The first rule that matches decides, then the
    preference score (for sil), then the smallest id.
    """
    scored = match_score("canonical_title", F.try_element_at("metadata", F.lit("parser")))
    existing = initiatives.withColumn("_score", scored if source == "sil" else F.lit(0))
    found = None
    for rank, group in enumerate(MATCH_RULES[source]):
        for rule in group:
            part = _rule_matches(records, existing, rule, source).withColumn("rule", F.lit(rank))
            found = part if found is None else found.unionByName(part)
    best = best_per_key(
        found, ["source_record_key"], [F.col("rule").asc(), F.col("_score").desc(), F.col("matched_id").asc()]
    )
    return best.select("source_record_key", "matched_id", "rule")


def _rule_matches(records: DataFrame, existing: DataFrame, rule: Rule, source: str) -> DataFrame:
    left = {}
    right = {}
    for i, (mine, theirs) in enumerate(rule.on):
        value = F.col(mine) if mine in RECORD_COLUMNS else metadata_text("metadata", mine)
        if source == "sil" and mine == "detail_source_url":
            value = F.coalesce(value, metadata_text("metadata", "detail_url"))
        left[f"_k{i}"] = value
        right[f"_k{i}"] = metadata_text("metadata", theirs)
    if source == "sil" and rule.on and rule.on[0][0] == "result_source_url":
        # This rule only applies to records that know their detail page.
        known = F.coalesce(metadata_text("metadata", "detail_source_url"), metadata_text("metadata", "detail_url"))
        records = records.filter(known.isNotNull())
    if rule.title:
        left["_title"], right["_title"] = F.col("title_normalized"), F.col("title_normalized")
    if rule.date:
        date = F.col("presented_at").cast("string")
        if rule.date == "null_safe":
            date = F.coalesce(date, F.lit("no-date"))
        left["_date"], right["_date"] = date, date
    keys = list(left)
    incoming = records.select("source_record_key", *[c.alias(k) for k, c in left.items()]).dropna(subset=keys)
    candidates = existing.select(
        F.col("id").alias("matched_id"), "_score", *[c.alias(k) for k, c in right.items()]
    ).dropna(subset=keys)
    unique = best_per_key(candidates, keys, [F.col("_score").desc(), F.col("matched_id").asc()])
    return incoming.join(unique, keys).select("source_record_key", "matched_id", "_score")


def constant_signals(records: DataFrame, source: str) -> DataFrame:
    """The fixed signals a source gives every candidate."""
    values = {name: 0.0 for name in WEIGHTS}
    values.update(title_similarity=1.0, date_proximity=1.0, chamber_consistency=CHAMBER_SIGNAL[source])
    for name, value in values.items():
        records = records.withColumn(name, F.lit(value))
    return records


def near_candidates(records: DataFrame, existing: DataFrame, least: float = 0.7, days: int = 30) -> DataFrame:
    """Pairs of a record and an initiative whose titles share ``least`` of their trigrams and whose dates are at most ``days`` apart.

    A set-similarity join of the different titles: each title's trigrams are ordered by rarity among those of the initiatives, and two titles that
    are near enough share one of their first few, whose number follows from ``least`` and the title's length. Only these, together with the
    bands of dates a title occurs in, are joined; lengths too far apart are passed over, and what is left is verified on whole sets, once a pair
    of titles. Records and initiatives then meet by near titles and band, so pairs leave the last join and are never shuffled. Titles
    without trigrams and rows without a date pair with nothing. The result has left_ and right_ columns for ``measured_signals``, and the
    similarities of the texts, measured once for equal texts.
    """
    # Dates in bands of ``days``: two that are near enough are in the same band or in neighbouring ones.
    band = F.floor(F.unix_date("presented_at") / F.lit(max(1, days)))
    key = F.unhex(F.md5("title"))
    dated = lambda df: df.where(F.col("presented_at").isNotNull() & F.col("title").isNotNull())
    records, existing = dated(records), dated(existing)

    def sets(df: DataFrame) -> DataFrame:
        return bound(df.select("title").distinct().select(key.alias("_key"), "title"), _grams=trigrams("title")).where(F.size("_grams") > 0).drop("title")

    left, right = durable(sets(records)), durable(sets(existing))
    often = right.select(F.explode("_grams").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))

    def firsts(df: DataFrame) -> DataFrame:
        """One row per rare trigram of a title; a title of n trigrams needs its n - ceil(least * n) + 1 rarest."""
        listed = df.select("_key", F.size("_grams").alias("size"), F.explode("_grams").alias("gram")).join(often, "gram", "left")
        # A list of one title's trigrams.
        ranked = listed.groupBy("_key", "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))).alias("by"))
        needed = F.col("size") - F.ceil(F.lit(least) * F.col("size") - 1e-9).cast("int") + 1
        return ranked.select("_key", "size", F.explode(F.slice("by", F.lit(1), needed)).alias("g")).select("_key", "size", F.col("g.gram").alias("gram"))

    around = F.explode(F.array(band - 1, band, band + 1)).alias("band")
    mine = firsts(left).join(records.select(key.alias("_key"), around).distinct(), "_key")
    theirs = firsts(right).join(existing.select(key.alias("_key"), band.alias("band")).distinct(), "_key")
    a, b = (df.select("gram", "band", F.col("_key").alias(f"{side}_key"), F.col("size").alias(f"{side}_size")) for df, side in ((mine, "a"), (theirs, "b")))
    met = a.join(b, ["gram", "band"]).where(F.least("a_size", "b_size") >= F.lit(least) * F.greatest("a_size", "b_size") - 1e-9)
    pairs = met.select("a_key", "b_key").distinct()
    a_sets, b_sets = (df.select(F.col("_key").alias(f"{side}_key"), F.col("_grams").alias(f"{side}_grams")) for df, side in ((left, "a"), (right, "b")))
    alike = bound(pairs.join(a_sets, "a_key").join(b_sets, "b_key"), title_similarity=trigram_similarity(F.col("a_grams"), F.col("b_grams")))
    sure = alike.where(F.col("title_similarity") >= least).drop("a_grams")
    alias = F.coalesce("alias", F.lit("")).alias("a_alias")
    spelled = records.select(key.alias("a_key"), alias).distinct().join(sure, "a_key")
    texts = bound(spelled, alias_similarity=trigram_similarity(trigrams("a_alias"), F.col("b_grams"))).drop("b_grams")

    def sided(df: DataFrame, side: str, name: str) -> DataFrame:
        return df.select(name, *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != name), *([key.alias("a_key"), alias, around] if side == "left" else [key.alias("b_key"), band.alias("band")]))

    asked = sided(records, "left", "record_id").join(texts, ["a_key", "a_alias"])
    both = asked.join(sided(existing, "right", "id").hint("merge"), ["b_key", "band"])
    near = both.where(F.abs(F.datediff("left_presented_at", "right_presented_at")) <= days)
    return near.drop("a_key", "b_key", "a_alias", "band")


def measured_signals(pairs: DataFrame) -> DataFrame:
    """Signals measured on matched pairs instead of assumed.

    Pairs hold left_/right_ title, alias, authors (array), presented_at, chamber and norms (array). Similarities that came with
    them, as those of ``near_candidates``, are kept.
    """
    alike = lambda a, b: trigram_similarity(trigrams(F.coalesce(F.col(a), F.lit(""))), trigrams(F.coalesce(F.col(b), F.lit(""))))

    def overlap(a: str, b: str) -> Column:
        shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
        return F.when(either > 0, shared / either).otherwise(F.lit(0.0))

    days = F.abs(F.datediff("left_presented_at", "right_presented_at"))
    texts = {"title_similarity": "left_title", "alias_similarity": "left_alias"}
    return (
        pairs.withColumns({name: alike(mine, "right_title") for name, mine in texts.items() if name not in pairs.columns})
        .withColumn("author_overlap", overlap("left_authors", "right_authors"))
        .withColumn("date_proximity", F.coalesce(1 / (1 + days), F.lit(0.0)))
        .withColumn(
            "chamber_consistency", F.when(F.col("left_chamber").eqNullSafe(F.col("right_chamber")), 1.0).otherwise(0.0)
        )
        .withColumn("affected_norm_overlap", overlap("left_norms", "right_norms"))
    )


def decide(candidates: DataFrame) -> DataFrame:
    """Weighted sum of the six signals and the decision it leads to."""
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) * weight
    return candidates.withColumn("confidence", score).withColumn(
        "decision",
        F.when(F.col("confidence") >= ATTACH, "attach").when(F.col("confidence") >= REVIEW, "review").otherwise("create"),
    )
