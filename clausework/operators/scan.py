"""Running aggregates per key that stay parallel when one key holds most of the rows.

A plain window puts every row of a key into one task. Here keys above a row limit are found
first (a map-side combined count); their rows are range-partitioned by (key, order) so that one
key spreads over many slices, each slice is scanned on its own, and the slice totals, one row per
(key, slice), carry the prefix across slices. All other keys keep the one-shuffle window.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.session import checkpointed

# Rows of one key that a single task sorts comfortably.
ROWS_PER_TASK = 2_000_000
# Up to this many hot keys are broadcast; a longer list is joined like any table.
MAX_HOT_KEYS = 100_000
# "Not looked for yet", where None means that there are no hot keys.
UNKNOWN = object()


@dataclass(frozen=True)
class Carry:
    """One running value: ``sum``, ``last`` (non-null) or ``total`` (sum of the whole key)."""

    kind: str
    value: Column
    include_row: bool = True


def same_key(left: DataFrame, right: DataFrame, pairs) -> Column:
    """Null-safe equality over (left, right) column name pairs."""
    return reduce(lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs])


def hot_keys(
    df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, weight: Column | None = None
) -> DataFrame | None:
    """Keys (as ``_hot_<key>``) with too many rows for one task and their ``_rows``; None if there are none.

    With ``weight`` the limit is on its sum, such as characters, instead of rows. The answer costs
    a pass over ``df``: ask once, of a table rather than of something derived, and hand it on.
    """
    counts = df.groupBy(*keys).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("_rows"))
    hot = checkpointed(
        counts.filter(F.col("_rows") > rows_per_task).select(*[F.col(k).alias(f"_hot_{k}") for k in keys], "_rows")
    )
    return None if hot.isEmpty() else hot


def _few(hot):
    return hot.limit(MAX_HOT_KEYS + 1).count() <= MAX_HOT_KEYS


def _divide(df, keys, hot):
    on = same_key(df, hot, [(k, f"_hot_{k}") for k in keys])
    small = F.broadcast(hot) if _few(hot) else hot
    return df.join(small, on, "left_anti"), df.join(small, on, "left_semi")


def split_hot(
    df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK, weight: Column | None = None, hot=UNKNOWN
):
    """(rows of ordinary keys, rows of hot keys or None, number of hot rows)."""
    hot = hot_keys(df, keys, rows_per_task, weight) if hot is UNKNOWN else hot
    if hot is None:
        return df, None, 0
    return *_divide(df, keys, hot), hot.agg(F.sum("_rows")).first()[0]


def lookup(
    df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", rows_per_task: int = ROWS_PER_TASK, hot=UNKNOWN
) -> DataFrame:
    """Join to a table that has at most one row per key.

    Rows of hot keys are not shuffled: the few table rows they need are broadcast to them. ``hot``
    is what ``hot_keys`` said of these keys, if that is known.
    """
    hot = hot_keys(df, keys, rows_per_task) if hot is UNKNOWN else hot
    if hot is None or not _few(hot):
        return df.join(table, keys, how)
    usual, many = _divide(df, keys, hot)
    needed = table.join(
        F.broadcast(hot), same_key(table, hot, [(k, f"_hot_{k}") for k in keys]), "left_semi"
    )
    return usual.join(table, keys, how).unionByName(many.join(F.broadcast(needed), keys, how))


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    carries: dict[str, Carry],
    rows_per_task: int = ROWS_PER_TASK,
    hot=UNKNOWN,
) -> DataFrame:
    """Add one column per carry, scanning each key's rows in ascending ``order``; ``hot`` as in ``lookup``."""
    cold, hot, hot_rows = split_hot(df, keys, rows_per_task, hot=hot)
    if hot is None:
        return _scan(cold, keys, order, carries)
    return _scan(cold, keys, order, carries).unionByName(
        _sliced_scan(hot, keys, order, carries, max(2, -(-hot_rows // rows_per_task)))
    )


def _frame(keys, order, carry):
    w = Window.partitionBy(*keys).orderBy(*order)
    if carry.kind == "total":
        return Window.partitionBy(*keys)
    return w.rowsBetween(Window.unboundedPreceding, 0 if carry.include_row else -1)


def _over(carry, frame):
    if carry.kind == "last":
        return F.last(carry.value, ignorenulls=True).over(frame)
    return F.coalesce(F.sum(carry.value).over(frame), F.lit(0))


def _scan(df, keys, order, carries):
    return df.select(
        "*", *[_over(c, _frame(keys, order, c)).alias(name) for name, c in carries.items()]
    )


def _sliced_scan(df, keys, order, carries, slices):
    # The checkpoint pins each row to its slice: both readers below see the same assignment,
    # also after an executor is lost.
    sliced = checkpointed(
        df.repartitionByRange(slices, *keys, *order).withColumn("_slice", F.spark_partition_id())
    )
    at = F.struct(*order)
    totals = sliced.groupBy(*keys, "_slice").agg(*[
        (
            F.max_by(c.value, F.when(c.value.isNotNull(), at))
            if c.kind == "last"
            else F.sum(c.value)
        ).alias(name)
        for name, c in carries.items()
    ])
    # At most ``slices`` rows per key from here on.
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *[F.col(k).alias(f"_in_{k}") for k in [*keys, "_slice"]],
        *[
            (
                F.last(name, ignorenulls=True).over(before)
                if c.kind == "last"
                else F.sum(name).over(Window.partitionBy(*keys) if c.kind == "total" else before)
            ).alias(f"_in_{name}")
            for name, c in carries.items()
        ],
    )
    local = _scan(
        sliced, [*keys, "_slice"], order, {n: c for n, c in carries.items() if c.kind != "total"}
    )
    on = same_key(local, carried, [(k, f"_in_{k}") for k in [*keys, "_slice"]])
    joined = local.join(carried, on, "left")
    return joined.select(*df.columns, *[
        {
            "last": lambda n: F.coalesce(F.col(n), F.col(f"_in_{n}")),
            "sum": lambda n: F.col(n) + F.coalesce(F.col(f"_in_{n}"), F.lit(0)),
            "total": lambda n: F.coalesce(F.col(f"_in_{n}"), F.lit(0)),
        }[c.kind](name).alias(name)
        for name, c in carries.items()
    ])


def reachable(roots: DataFrame, jump: DataFrame, keys: list[str], pos: str = "_pos", next_pos: str = "_next") -> DataFrame:
    """Positions on the chains that start at ``roots`` and follow ``jump`` (keys, pos, next), without the roots.

    Each round doubles the stride, so a chain of n links takes log2(n) rounds of equi-joins on
    unique keys.
    """
    reached, found = roots.select(*keys, pos), None
    while True:
        new = checkpointed(
            reached.join(jump, [*keys, pos]).select(*keys, F.col(next_pos).alias(pos)).distinct()
        )
        if new.isEmpty():
            return roots.select(*keys, pos).limit(0) if found is None else found
        found = new if found is None else checkpointed(found.unionByName(new).distinct())
        reached = checkpointed(reached.unionByName(new).distinct())
        onward = jump.select(*keys, F.col(pos).alias(next_pos), F.col(next_pos).alias("_beyond"))
        jump = checkpointed(
            jump.join(onward, [*keys, next_pos]).select(*keys, pos, F.col("_beyond").alias(next_pos))
        )


def number_rows(df: DataFrame, order: list[str], name: str, start: int = 1, slices: int = 0) -> DataFrame:
    """Number all rows in ``order`` without a single-task sort: places in sorted slices plus slice offsets.

    One shuffle. Range sampling reads ``df`` twice, so pass a stored table if it is costly.
    """
    spark = df.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Partition number above 33 bits, place in the sorted partition below.
    place = F.monotonically_increasing_id()
    sliced = checkpointed(
        df.repartitionByRange(slices, *order).sortWithinPartitions(*order).withColumn("_place", place)
    ).withColumns({"_slice": F.shiftright("_place", 33), "_n": F.col("_place").bitwiseAND((1 << 33) - 1) + 1})
    # One row per slice: the only unpartitioned window, over ``slices`` rows.
    offsets = sliced.groupBy("_slice").count().select(
        F.col("_slice").alias("_at"),
        F.coalesce(
            F.sum("count").over(
                Window.partitionBy(F.lit(0)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ).alias("_offset"),
    )
    return sliced.join(F.broadcast(offsets), F.col("_slice") == F.col("_at")).select(
        *df.columns, (F.col("_offset") + F.col("_n") + F.lit(start - 1)).cast("long").alias(name)
    )
