import os
import random

import pytest
from pyspark.sql import functions as F

from clausework.functions.replies import reply_items, spatial_struct
from clausework.operators.reconcile import key_coverage, reconcile
from clausework.plans.catalog import QUERIES

REPLIES = [
    ('{"parameters":[{"key":"a","value":"x"},5,{"name":"b","value":"y"}]}', [("a", "x"), ("b", "y")]),
    ('[{"value":"z"}]', [("param_1", "z")]),
    ('{"parameters":[5,{"value":"z"}]}', [("param_2", "z")]),
    ('{"parameters":[{"key":"a","value":0},{"key":"b","value":"0"}]}', [("a", ""), ("b", "0")]),
    ('{"parameters":[{"key":"a","value":false},{"key":"b","value":"false"}]}', [("a", ""), ("b", "false")]),
    ('{"parameters":[{"key":true,"value":1.0},{"key":7,"value":12.50}]}', [("True", "1.0"), ("7", "12.5")]),
    ('{"parameters":[{"key":[],"name":{},"value":[1]},{"key":"","name":"n","value":null}]}', [("param_1", "[1]"), ("n", "")]),
    ('{"parameters":[{"key":"a","key":"q","value":"last wins"}]}', [("q", "last wins")]),
    ('{"parameters":[{"Key":"a","KEY":"b","value":"x"}]}', [("param_1", "x")]),
    ('{"Parameters":[{"key":"a"}]}', []),
    ("{bad", []), ("{}", []), ('{"parameters":null}', []), ('{"parameters":{"k":{}}}', []),
    ('{"parameters":3}', []), ("5", []), ('"s"', []), ("null", []), ("", []), (None, []), ("[null, [1], \"x\"]", []),
]


def test_reply_items(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(REPLIES)], "id int, response string")
    got = {}
    for r in sorted(reply_items(df).collect(), key=lambda r: (r.id, r.pos)):
        got.setdefault(r.id, []).append((r.parameter_key, r.value))
    assert [got.get(i, []) for i in range(len(REPLIES))] == [want for _, want in REPLIES]


def test_spatial(spark):
    reply = '[{"key":"a","value":"x","spatial":{"page":2,"x_min":1,"y_min":2.5,"x_max":3,"y_max":4}},{"key":"b","value":"y","spatial":null}]'
    df = spark.createDataFrame([(reply,)], "response string")
    boxes = reply_items(df).select("pos", spatial_struct(F.col("spatial")).alias("box")).orderBy("pos").collect()
    assert boxes[0].box.asDict() == {
        "page": 2, "x_min": 1.0, "y_min": 2.5, "x_max": 3.0, "y_max": 4.0, "page_width": None, "page_height": None,
    }
    assert boxes[1].box.page is None
    assert reply_items(df).filter("pos = 1 AND spatial IS NULL").count() == 1


def kept_by_hand(items):
    kept = {}
    for key, value in items:
        if value.strip() and (key not in kept or len(value.strip()) > len(kept[key])):
            kept[key] = value
    return list(kept.items())


def run(spark, lists):
    rows = [(i, n, k, v) for i, items in enumerate(lists) for n, (k, v) in enumerate(items)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "owner int, item_no long, parameter_key string, value string")
    done = reconcile(df, ["owner"]).collect()
    return [
        [(r.parameter_key, r.value) for r in sorted(done, key=lambda r: r.first_no) if r.owner == i]
        for i in range(len(lists))
    ]


def test_reconcile_golden(spark):
    first = [("k1", "abc "), ("k1", "abcd"), ("k2", "x")]
    lists = [first, [*first, ("k1", "abcdef"), ("k2", "y")], [("k1", "  ")]]
    assert run(spark, lists) == [
        [("k1", "abc "), ("k2", "x")], [("k1", "abcdef"), ("k2", "x")], [],
    ]


def test_reconcile_equals_fold(spark):
    rng = random.Random(7)
    lists = [
        [
            (rng.choice("abc"), " " * rng.randrange(4) + "v" * rng.randrange(8) + " " * rng.randrange(4))
            for _ in range(rng.randrange(60))
        ]
        for _ in range(60)
    ]
    assert run(spark, lists) == [kept_by_hand(items) for items in lists]


def test_reconcile_groups_hold_lengths_not_items(spark):
    """A group of many items reaches the fold as one entry per distinct length."""
    items = spark.range(20000).select(
        F.lit(1).alias("owner"), F.col("id").alias("item_no"), F.lit("k").alias("parameter_key"),
        F.repeat(F.lit("x"), (1 + F.col("id") % 7).cast("int")).alias("value"),
    )
    row = reconcile(items, ["owner"]).first()
    assert (row.item_no, row.first_no, row.value) == (6, 0, "x" * 7)


def test_key_coverage(spark):
    owners = spark.createDataFrame([(1,), (2,)], "c int")
    have = spark.createDataFrame([(1, "a"), (1, "a"), (1, "z"), (3, "b")], "c int, parameter_key string")
    got = {(r.c, r.parameter_key): r.missing for r in key_coverage(owners, have, ["c"], ["a", "b"]).collect()}
    assert got == {(1, "a"): False, (1, "b"): True, (2, "a"): True, (2, "b"): True}


def test_numbers_are_spelled_like_python(spark):
    import json
    import struct

    rng = random.Random(6)
    numbers = ["1e-7", "1e20", "0.00001", "0.0001", "1e16", "123456789012345.5", "9999999999999998.0", "1.5e300", "5e-324", "-2.50", "100.0", "1e5"]
    numbers += [repr(rng.uniform(-1, 1) * 10.0 ** rng.randrange(-12, 22)) for _ in range(200)]
    numbers += [repr(x) for x in struct.unpack("<50d", rng.randbytes(400)) if x == x and abs(x) < 1e308]
    df = spark.createDataFrame([(i, f'[{{"value": {n}}}]') for i, n in enumerate(numbers)], "id int, response string")
    got = {r.id: r.value for r in reply_items(df).collect()}
    different = [(n, got[i], str(json.loads(n))) for i, n in enumerate(numbers) if got[i] != str(json.loads(n))]
    assert not different


def test_strings_and_whole_floats_keep_their_kind(spark):
    import json

    values = ['"0"', '"1.50"', '"1e5"', '"a\\"b"', '"\\\\"', '"\\u00e9\\n"', '"null"', '"[]"', "100.0", "100", "-754260373148249783.0", "754260373148249783.0",
              "754260373148249783", "0.00001", "-0.00002", "1.25e-10", "1e100", "2.5E+20", "-0.0", "0e5", "[]", "{}", "[1]", "true", "false", "null"]
    df = spark.createDataFrame([(i, f'[{{"value": {v}}}]') for i, v in enumerate(values)], "id int, response string")
    got = {r.id: r.value for r in reply_items(df).collect()}
    assert got == {i: str(json.loads(v)) if json.loads(v) else "" for i, v in enumerate(values)}


def test_the_type_of_a_field_is_asked_once(spark, plan):
    """Once for each of key, name and value, however often the plan looks at them."""
    df = spark.createDataFrame([('[{"value": 1}]',)], "response string")
    project = next(x for x in plan(reply_items(df)).split("\n\n") if "schemaOfVariant" in x)
    assert project.count("schemaOfVariant(") == 3


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="test tables not present")
def test_parsing_stays_in_generated_code(spark):
    spark.conf.set("spark.sql.codegen.fallback", "false")  # code that cannot be compiled is an error
    try:
        for name in ("reply_items_parsed", "extract_rules"):
            assert QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
