"""Keyed building blocks shared by the operators.

None of them gathers a whole group: a group's best rows are cut down on the map side first
(Spark plans ``row_number() <= k`` as a group limit before the exchange), counts and extremes
combine before the exchange, and lookups join against one row per key, where adaptive execution
can split a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curul.session import durable


def bound(df: DataFrame, **values: Column) -> DataFrame:
    """Columns that are evaluated once, whatever filters and projections follow.

    A plain projection may be merged into its consumers, which then evaluate a costly expression
    at every use; a generator with one row is not.
    """
    kept = [c for c in df.columns if c not in values]
    row = F.struct(*[value.alias(name) for name, value in values.items()])
    once = df.select(*kept, F.explode(F.array(row)).alias("_row"))
    return once.select(*kept, *[F.col(f"_row.{name}").alias(name) for name in values])


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt by ``keys`` over as many tasks as a shuffle has, for work that costs much more a row than its bytes tell.

    A small file is one task's scan, and adaptive execution makes few tasks of few bytes; neither sees what a regular expression or Python costs.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``k`` rows of each key; ``rank`` keeps the position under that name."""
    position = rank or "_position"
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(position) <= k)
    return kept if rank else kept.drop(position)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition under which null equals null."""
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


def without(df: DataFrame, others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not among the others, nulls compared as equal."""
    right = others.select(*[F.col(k).alias(f"_r_{k}") for k in keys])
    condition = F.lit(True)
    for key in keys:
        condition = condition & df[key].eqNullSafe(right[f"_r_{key}"])
    return df.join(right, condition, "left_anti")


def counts(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows per key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def with_count(df: DataFrame, key: str, children: DataFrame, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, zero if none."""
    per_key = counts(children, child_key, name).withColumnRenamed(child_key, key)
    return df.join(per_key, key, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0).cast("long")))


def numbered(df: DataFrame, key: str, order: Sequence[Column], name: str, total: str = "total", parts: int | None = None) -> DataFrame:
    """``name``: the place of each row among its key's rows in ``order``, from 0, without one task per key; ``total``: their number.

    Rows are dealt by range of (key, order) and sorted, so a hot key spreads over tasks and a key's rows in a task are
    numbered in a row; a key begins in a task after its rows in the tasks before. The dealing is written once, as both steps must see the same.
    """
    alone, torn = numbered_apart(df, key, order, name, total, parts)
    return alone.unionByName(torn)


def numbered_apart(df: DataFrame, key: str, order: Sequence[Column], name: str, total: str, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows of ``numbered`` whose key lies in one task, numbered by one exchange of the key, and those of the few keys in several."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(parts, F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    dealt = durable(dealt.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    # A key in several tasks is the last of one and the first of another: two rows a task tell which these are, at most one a task.
    ends = dealt.groupBy("_part").agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi")).select(F.explode(F.array("_lo", "_hi")).alias("_id")).distinct()
    met = dealt.join(F.broadcast(ends), "_id", "left_semi").groupBy(key).agg(F.count_distinct("_part").alias("_n"))
    several = durable(met.where("_n > 1").select(F.col(key).alias("_key")))
    same = dealt[key].eqNullSafe(F.col("_key"))

    whole = Window.partitionBy(key)
    alone = dealt.join(F.broadcast(several), same, "left_anti")
    alone = alone.withColumns({name: (F.row_number().over(whole.orderBy("_id")) - 1).cast("long"), total: F.count(F.lit(1)).over(whole)})

    split = dealt.join(F.broadcast(several), same, "left_semi")
    sizes = split.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    # One row per key and task that holds it.
    earlier = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")
    starts = sizes.select(F.col(key).alias("_key"), F.col("_part").alias("_in"), before.alias("_shift"), F.sum("_n").over(whole).alias(total))
    torn = split.join(F.broadcast(starts), same & (F.col("_part") == F.col("_in"))).withColumn(name, F.col("_id") + F.col("_shift"))
    return alone.drop("_part", "_id"), torn.drop("_part", "_id", "_in", "_key", "_shift")


def packed(df: DataFrame, key: str, entries: Column, order: Sequence[Column], name: str, page: int | None = 1000) -> DataFrame:
    """Children nested as pages of ``page`` entries: (key, part, name, total).

    Pages are cut by place in ``order`` at every size: page 0 has the first ``page`` entries, the last page the rest. No row holds
    more than a page and no task more than its share of a key. ``total`` is the number of the key's entries. Where ``page`` is None
    a key's entries are one row's, whatever their number.
    """
    marks = [o.alias(f"o{i}") for i, o in enumerate(order)]
    rows = df.select(key, F.struct(*marks, entries.alias("entry")).alias("_e"))
    part = (F.lit(0) if page is None else F.floor(F.col("_place") / F.lit(page)).cast("int")).alias("part")

    def pages(numbers: DataFrame) -> DataFrame:
        return numbers.groupBy(key, part).agg(F.array_sort(F.collect_list(F.struct("_place", "_e.entry"))).alias("_es"), F.max("_total").alias("total"))

    alone, torn = numbered_apart(rows, key, [F.col(f"_e.o{i}") for i in range(len(order))], "_place", "_total")
    return pages(alone).unionByName(pages(torn)).select(key, "part", F.transform("_es", lambda e: e["entry"]).alias(name), "total")
