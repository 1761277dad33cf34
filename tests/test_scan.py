import random

import pytest
from pyspark.sql import functions as F

from clausework.operators.scan import Carry, lookup, number_rows, running, split_hot


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        key = None if i % 10 == 9 else "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        # Order values tie in the first column and are unique together.
        data.append((key, rng.randrange(5), i, rng.randrange(10), rng.choice([None, "x", "y"])))
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, a int, b int, v int, s string").cache()


def carries():
    return {
        "total_so_far": Carry("sum", F.col("v")),
        "before": Carry("sum", F.col("v"), include_row=False),
        "latest": Carry("last", F.col("s")),
        "earlier": Carry("last", F.col("s"), include_row=False),
        "all": Carry("total", F.col("v")),
    }


def test_sliced_scan_equals_window(spark, rows):
    def result(limit):
        return {r.b: r for r in running(rows, ["k"], ["a", "b"], carries(), limit).collect()}

    whole, sliced = result(10**9), result(100)
    assert len(whole) == 3000 and whole == sliced


def test_hot_keys_include_null(rows):
    cold, hot, count = split_hot(rows, ["k"], 100)
    assert {r.k for r in hot.select("k").distinct().collect()} == {None, "hot"}
    assert count == hot.count() and cold.count() + count == 3000


def test_no_hot_key_is_one_shuffle(rows, plan):
    shown = plan(running(rows, ["k"], ["a", "b"], carries()))
    assert shown.count("Exchange hashpartitioning") <= 2  # listed once in the tree, once in detail


def test_number_rows(rows):
    got = number_rows(rows, ["a", "b"], "n", start=11, slices=7).orderBy("n").collect()
    assert [r.n for r in got] == list(range(11, 3011))
    assert [(r.a, r.b) for r in got] == sorted((r.a, r.b) for r in got)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_lookup_of_hot_keys_equals_join(spark, rows, plan, how):
    table = spark.createDataFrame([("hot", 1), ("k1", 2), ("other", 3), (None, 4)], "k string, w int")
    plain = rows.join(table, ["k"], how)
    split = lookup(rows, table, ["k"], how, rows_per_task=100)
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    assert split.count() == (3000 if how == "left" else plain.count())
    assert "BroadcastHashJoin" in plan(split)
