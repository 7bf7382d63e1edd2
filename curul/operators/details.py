"""Detail and timeline of initiatives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.operators.keyed import packed
from curul.operators.links import ranked_links


class InitiativeNotFound(Exception):
    """The asked-for initiative does not exist."""


def require(details: DataFrame, initiative_id) -> DataFrame:
    """The rows of one initiative; an unknown id is an error."""
    one = details.filter(F.col("initiative_id") == initiative_id)
    if not one.take(1):
        raise InitiativeNotFound(str(initiative_id))
    return one


def detail_headers(
    initiatives: DataFrame,
    relations: DataFrame,
    links: DataFrame,
    events: DataFrame,
    documents: DataFrame | None = None,
    norms: DataFrame | None = None,
) -> DataFrame:
    """Initiatives with the number of children of each kind, aggregated before the join."""
    out = initiatives.withColumnRenamed("id", "initiative_id")
    children = {"author": relations, "source_link": links, "event": events, "document": documents, "norm": norms}
    for name, child in children.items():
        column = f"{name}_count"
        if child is None:
            out = out.withColumn(column, F.lit(0).cast("long"))
            continue
        per_initiative = child.groupBy("initiative_id").agg(F.count(F.lit(1)).alias(column))
        out = out.join(per_initiative, "initiative_id", "left").withColumn(
            column, F.coalesce(F.col(column), F.lit(0).cast("long"))
        )
    return out


def detail_authors(relations: DataFrame, authors: DataFrame) -> DataFrame:
    """Nested authors per initiative in signature order, in pages."""
    joined = relations.join(
        authors.select(F.col("id").alias("author_id"), "full_name"), "author_id"
    )
    entry = F.struct("author_id", "full_name", "role")
    return packed(joined, "initiative_id", entry, [F.col("sort_order"), F.col("author_id")], "authors")


def detail_sources(links: DataFrame, records: DataFrame, sources: DataFrame, page: int | None = 1000) -> DataFrame:
    """Nested source links per initiative, best source first, in pages, or all in one row without a ``page``."""
    ranked = ranked_links(links, records, sources)
    entry = F.struct("system", "source_url", "confidence")
    return packed(ranked, "initiative_id", entry, [F.col("source_priority"), F.col("link_id")], "source_links", page)


def detail_norms(norms: DataFrame) -> DataFrame:
    entry = F.struct("norm_name", "article_reference", "action")
    return packed(norms, "initiative_id", entry, [F.col("norm_name"), F.col("article_reference")], "affected_norms")


def timeline(
    events: DataFrame, event_links: DataFrame, records: DataFrame, sources: DataFrame, page: int | None = 1000
) -> DataFrame:
    """Events with their nested source links, one row per event; ``timeline_order`` is the order to read it in.

    ``source_links`` has an event's first links, a page of them, and ``source_link_count`` tells how many there are;
    ``event_sources`` has all pages. Without a ``page`` it has all links.
    """
    nested = event_sources(event_links, records, sources, page).where("part = 0").drop("part").withColumnRenamed("total", "source_link_count")
    return events.join(nested, "event_id", "left").withColumn("source_link_count", F.coalesce("source_link_count", F.lit(0).cast("long")))


def event_sources(event_links: DataFrame, records: DataFrame, sources: DataFrame, page: int | None = 1000) -> DataFrame:
    """(event_id, part, source_links, total): the source links of every event in pages, or all in one row without a ``page``."""
    described = records.select("source_record_id", "source_id", "source_url", "record_type").join(
        sources.select("source_id", "system"), "source_id"
    )
    joined = event_links.join(described, "source_record_id")
    entry = F.struct("system", "source_url", "record_type")
    return packed(joined, "event_id", entry, [F.col("system"), F.col("source_record_id")], "source_links", page)


def timeline_order() -> list[Column]:
    """Reading order of a timeline."""
    return [
        F.col("initiative_id").asc(),
        F.col("event_date").asc(),
        F.col("sequence_in_day").asc_nulls_last(),
        F.col("event_id").asc(),
    ]
