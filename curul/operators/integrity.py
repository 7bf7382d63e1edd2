"""Integrity audits: unique keys, foreign keys, enumerations, required values, number ranges."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curul.schema import FOREIGN_KEYS, NATURAL_KEYS


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_key: str = "id") -> DataFrame:
    """Child rows whose reference points nowhere; a null reference is none."""
    referenced = parent.select(F.col(parent_key).alias(column)).distinct()
    return child.filter(F.col(column).isNotNull()).join(referenced, column, "left_anti")


def bad_values(
    df: DataFrame,
    enums: dict[str, Iterable[str]] | None = None,
    required: Sequence[str] = (),
    decimals: dict[str, tuple[int, int]] | None = None,
) -> DataFrame:
    """Number of bad rows per rule: unknown enumeration value, missing value, number out of range."""
    rules = {}
    for column, allowed in (enums or {}).items():
        rules[f"enum:{column}"] = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    for column in required:
        rules[f"required:{column}"] = F.col(column).isNull()
    for column, (precision, scale) in (decimals or {}).items():
        fits = F.col(column).try_cast(f"decimal({precision},{scale})")
        rules[f"decimal:{column}"] = F.col(column).isNotNull() & fits.isNull()
    one_row = df.agg(*[F.count_if(condition).alias(name) for name, condition in rules.items()])
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]
    return one_row.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")


def audit_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Violations of every natural and foreign key of the model among the given tables."""
    parts = []
    for name, key in NATURAL_KEYS.items():
        if name in tables and set(key) <= set(tables[name].columns):
            broken = unique_violations(tables[name], key).agg(F.count(F.lit(1)).alias("violations"))
            parts.append(broken.select(F.lit(f"unique:{name}").alias("rule"), "violations"))
    for fk in FOREIGN_KEYS:
        if fk.child in tables and fk.parent in tables and fk.column in tables[fk.child].columns:
            lost = orphan_rows(tables[fk.child], fk.column, tables[fk.parent]).agg(
                F.count(F.lit(1)).alias("violations")
            )
            parts.append(lost.select(F.lit(f"reference:{fk.child}.{fk.column}").alias("rule"), "violations"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
