"""One item per key out of many replies, and coverage of the requested keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.functions.text import trimmed


def reconcile(
    items: DataFrame,
    owner: list[str],
    key: str = "parameter_key",
    value: str = "value",
    order: str = "item_no",
) -> DataFrame:
    """Per (owner, key) keep the first item, replaced by each later item with more text.

    A challenger's trimmed length must exceed the incumbent's untrimmed length, so only the first
    item of each distinct trimmed length can ever win. The map-side combined reduction to those
    leaves at most one small number triple per distinct length for the fold, however large the
    group; the texts of the winners are fetched by a join that a hot key cannot skew, because it
    includes ``order``. (owner, order) must be unique; items should be a stored table, as they
    are read twice. ``first_no`` is where the key first appeared.
    """
    group = [*owner, key]
    firsts = measured(items, value).groupBy(*group, "_len").agg(
        F.min(order).alias("_no"), F.min_by(F.length(value), order).alias("_raw")
    )
    return by_shuffle(items, _winners(firsts, group).withColumnRenamed("_winner", order), [*group, order])


def by_shuffle(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of stored rows that is never broadcast.

    Spark judges a stored table by its compressed files; texts and vectors that repeat are a hundred times
    larger in memory, where the driver would have to hold them.
    """
    return left.join(right.hint("merge"), on, how)


def _winners(firsts: DataFrame, group: list[str]) -> DataFrame:
    """``group``, number of the winning item and ``first_no``, from the first item (_no, _len, _raw) of each length."""
    candidates = F.array_sort(F.collect_list(F.struct("_no", "_len", "_raw")))
    winner = F.aggregate(
        F.col("_items"),
        F.struct(F.lit(-1).cast("long").alias("no"), F.lit(0).alias("raw")),
        lambda kept, x: F.when(
            x["_len"] > kept["raw"], F.struct(x["_no"].cast("long").alias("no"), x["_raw"].alias("raw"))
        ).otherwise(kept),
        lambda kept: kept["no"],
    )
    return (
        firsts.groupBy(*group)
        .agg(candidates.alias("_items"), F.min("_no").alias("first_no"))
        .select(*group, winner.alias("_winner"), "first_no")
    )


def candidates(items: DataFrame, group: list[str], value: str = "value", order: str = "item_no") -> DataFrame:
    """What must be kept of items to reconcile them with later ones: per group the first of each trimmed length.

    All but the ``group`` columns and ``order`` come as columns of the first item, next to its ``_len``.
    """
    return _firsts(measured(items, value), group, order).select(*group, "_len", *[c for c in items.columns if c not in group])


def measured(items: DataFrame, value: str = "value") -> DataFrame:
    """Items with text, and its trimmed length as ``_len``."""
    return items.withColumn("_len", F.length(trimmed(F.col(value)))).filter(F.col("_len") > 0)


def merge_candidates(stored: DataFrame, arrived: DataFrame, group: list[str], order: str = "item_no") -> DataFrame:
    """Candidates of all items, from stored ones and those, or all measured items, of a new part.

    Either way equal lengths are combined map-side; a part that arrives twice changes nothing.
    """
    return _firsts(stored.unionByName(arrived.select(*stored.columns)), group, order).select(*stored.columns)


def _firsts(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    others = [c for c in rows.columns if c not in (*group, "_len", order)]
    return rows.groupBy(*group, "_len").agg(
        F.min(order).alias(order), F.min_by(F.struct(*others), order).alias("_first")
    ).select(*group, "_len", order, "_first.*")


def reconciled(kept: DataFrame, group: list[str], value: str = "value", order: str = "item_no") -> DataFrame:
    """The winning item of each group and ``first_no``, from candidates; as ``reconcile`` of all items."""
    firsts = kept.select(*group, "_len", F.col(order).alias("_no"), F.length(value).alias("_raw"))
    return by_shuffle(kept.drop("_len"), _winners(firsts, group).withColumnRenamed("_winner", order), [*group, order])


def key_coverage(
    owners: DataFrame, parameters: DataFrame, owner: list[str], keys: list[str] | Column, key: str = "parameter_key"
) -> DataFrame:
    """Every owner with every requested key and whether it is ``missing``.

    ``keys`` is one list for all, or an array column of ``owners`` with each owner's own.
    """
    asked = F.array(*[F.lit(k) for k in keys]) if isinstance(keys, list) else F.array_distinct(keys)
    known = parameters.filter(F.col(key).isin(keys)) if isinstance(keys, list) else parameters
    # Repeated keys of an owner are combined map-side.
    present = known.select(*owner, key).distinct().withColumn("_has", F.lit(True))
    return (
        owners.select(*owner, F.explode(asked).alias(key))
        .join(present, [*owner, key], "left")
        .select(*owner, key, F.col("_has").isNull().alias("missing"))
    )
