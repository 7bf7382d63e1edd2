"""Table snapshots: upsert on a natural key, cascade delete, replace-all, find-or-create.

Parquet has no MERGE. Each function takes the tables as DataFrames and returns the next
snapshot, to be written to a new folder.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curul.functions.text import row_id
from curul.operators.keyed import best_per_key, without
from curul.schema import FOREIGN_KEYS


def upsert(
    existing: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    mode: str = "update",
    position: str | None = None,
    preserve: Sequence[str] = (),
    unique: bool = False,
) -> DataFrame:
    """Next snapshot of a table.

    ``update``: an incoming row replaces the existing one, the last of several incoming rows
    wins, and the ``preserve`` columns (ids, creation times) stay as they were. ``keep``: an
    existing row stays and the first incoming row is added where there is none. ``unique``: no two incoming
    rows share a key, so they need no exchange to choose one.
    """
    columns = existing.columns
    if position:
        order = [F.col(position).desc() if mode == "update" else F.col(position).asc()]
    else:
        order = [F.col(c).asc() for c in incoming.columns if c not in key] or [F.lit(1).asc()]
    fresh = incoming if unique else best_per_key(incoming, key, order)
    if mode == "keep":
        return existing.unionByName(without(fresh, existing, key).select(*columns))
    if mode != "update":
        raise ValueError(f"unknown mode {mode}")
    if preserve:
        old = existing.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[F.col(c).alias(f"_p_{c}") for c in preserve])
        condition = F.lit(True)
        for k in key:
            condition = condition & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        fresh = fresh.join(old, condition, "left")
        for c in preserve:
            fresh = fresh.withColumn(c, F.coalesce(F.col(f"_p_{c}"), F.col(c)))
    return without(existing, fresh, key).unionByName(fresh.select(*columns))


def merge_columns(
    existing: DataFrame, incoming: DataFrame, key: Sequence[str], policy: Mapping[str, str], position: str | None = None, unique: bool = False
) -> DataFrame:
    """Next snapshot of a table whose columns each have a rule of their own, in one join on the key.

    ``replace`` (also for columns without a rule): the incoming value, null or not. ``keep``: an existing row keeps its own.
    ``fill``: an existing row keeps its value unless that is null. ``known``: the incoming value unless that is null. Rows that
    nothing comes in for pass through; the last of several incoming rows by ``position`` decides, unless they are ``unique``.
    Nulls in the key are equal.
    """
    unknown = set(policy) - set(existing.columns)
    if unknown or set(policy.values()) - {"replace", "keep", "fill", "known"}:
        raise ValueError(f"no such column or rule: {sorted(unknown) or dict(policy)}")
    columns = existing.columns
    order = [F.col(position).desc()] if position else [F.col(c).asc() for c in incoming.columns if c not in key] or [F.lit(1).asc()]
    fresh = incoming if unique else best_per_key(incoming, key, order)
    condition = F.lit(True)
    for k in key:
        condition = condition & F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}"))
    old, new = existing.select(F.struct(*columns).alias("_old")), fresh.select(F.struct(*columns).alias("_new"))

    def value(column: str) -> Column:
        mine, theirs = F.col(f"_old.{column}"), F.col(f"_new.{column}")
        rule = "replace" if column in key else policy.get(column, "replace")
        if rule == "keep":
            return F.when(F.col("_old").isNotNull(), mine).otherwise(theirs)
        if rule == "replace":
            return F.when(F.col("_new").isNotNull(), theirs).otherwise(mine)
        return F.coalesce(mine, theirs) if rule == "fill" else F.coalesce(theirs, mine)

    return old.join(new, condition, "full_outer").select(*[value(c).alias(c) for c in columns])


def upsert_outcomes(existing: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per incoming key: inserted or updated."""
    fresh = incoming.select(*key).distinct()
    inserted = without(fresh, existing, key).withColumn("outcome", F.lit("inserted"))
    right = existing.select(*[F.col(k).alias(f"_r_{k}") for k in key])
    condition = F.lit(True)
    for k in key:
        condition = condition & fresh[k].eqNullSafe(right[f"_r_{k}"])
    updated = fresh.join(right, condition, "left_semi").withColumn("outcome", F.lit("updated"))
    return inserted.unionByName(updated)


def cascade_delete(tables: dict[str, DataFrame], table: str, ids: DataFrame) -> dict[str, DataFrame]:
    """Delete rows of a table by ``id`` and follow the foreign keys of the model.

    Children are deleted with their parent, or lose the reference where the model says so.
    """
    out = dict(tables)
    doomed = ids.select("id").distinct()
    for fk in FOREIGN_KEYS:
        if fk.parent != table or fk.child not in out or fk.column not in out[fk.child].columns:
            continue
        child = out[fk.child]
        hit = doomed.select(F.col("id").alias(fk.column))
        if fk.on_delete == "cascade":
            if "id" in child.columns and any(f.parent == fk.child for f in FOREIGN_KEYS):
                lost = child.join(hit, fk.column, "left_semi").select("id")
                out = cascade_delete(out, fk.child, lost)
            else:
                out[fk.child] = child.join(hit, fk.column, "left_anti").select(*child.columns)
        elif fk.on_delete == "set_null":
            marked = child.join(hit.withColumn("_hit", F.lit(True)), fk.column, "left")
            out[fk.child] = marked.withColumn(
                fk.column, F.when(F.col("_hit").isNull(), F.col(fk.column))
            ).select(*child.columns)
    parent = out[table]
    out[table] = parent.join(doomed, "id", "left_anti").select(*parent.columns)
    return out


def replace_children(children: DataFrame, touched: DataFrame, fresh: DataFrame, key: str = "initiative_id") -> DataFrame:
    """All children of the touched parents replaced by new ones."""
    kept = children.join(touched.select(key).distinct(), key, "left_anti")
    return kept.select(*children.columns).unionByName(fresh.select(*children.columns))


def find_or_create(dimension: DataFrame, wanted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Dimension with a new row for every wanted key it lacks; ids come from the key."""
    spelled = best_per_key(wanted, key, [F.col(c).asc() for c in wanted.columns if c not in key] or [F.lit(1).asc()])
    missing = without(spelled, dimension, key)
    created = missing.withColumn("id", row_id(*key).cast(dimension.schema["id"].dataType))
    return dimension.unionByName(created, allowMissingColumns=True)
