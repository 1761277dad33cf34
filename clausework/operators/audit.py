"""Integrity rules that a database would enforce, as queries over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.vectors import norm
from clausework.schemas import VECTOR_WIDTH


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child keys without a parent and how many rows have them; counted before the join."""
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    counted = child.filter(present).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return counted.join(parent.select(*keys), keys, "left_anti")


def rule_violations(df: DataFrame, required: list[str], max_lengths: dict[str, int]) -> DataFrame:
    """One row per (column, rule) with its violation count, from a single pass."""
    checks = [(c, "not_null", F.col(c).isNull()) for c in required]
    checks += [(c, "max_length", F.length(c) > n) for c, n in max_lengths.items()]
    one_row = df.agg(*[F.count(F.when(bad, 1)).alias(f"_{i}") for i, (_, _, bad) in enumerate(checks)])
    rows = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"_{i}").alias("violations"))
        for i, (c, rule, _) in enumerate(checks)
    ])
    return one_row.select(F.inline(rows))


def current_violations(
    versions: DataFrame, contracts: DataFrame | None = None, key: str = "contract_id", current: str = "is_current"
) -> DataFrame:
    """Contracts with no current version, or more than one; with ``contracts``, also those without any version."""
    marks = versions.select(key, F.col(current).cast("int").alias("_current"))
    if contracts is not None:
        marks = marks.unionByName(contracts.select(key, F.lit(0).alias("_current")))
    return marks.groupBy(key).agg(
        F.coalesce(F.sum("_current"), F.lit(0)).alias("current_versions")
    ).filter("current_versions <> 1")


def vector_violations(df: DataFrame, vec: str = "vector_embed", width: int = VECTOR_WIDTH, tolerance: float = 1e-3) -> DataFrame:
    """Stored vectors of the wrong width or not of unit length."""
    return (
        df.filter(F.col(vec).isNotNull())
        .withColumns({"width": F.size(vec), "norm": norm(F.col(vec))})
        .filter((F.col("width") != width) | (F.abs(F.col("norm") - 1) > tolerance))
    )
