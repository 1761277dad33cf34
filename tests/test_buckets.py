"""Bucketed tables: versions, untouched files, repeated changes, hot buckets."""

import pytest
from pyspark.sql import functions as F

from clausework.operators import review
from clausework.plans import upsert
from clausework.sources.buckets import BucketedTable

PAIR = "id string, v int"


def pairs(spark, rows):
    return spark.createDataFrame(rows, PAIR)


def content(table, version=None):
    return sorted((r.id, r.v) for r in table.read(version).collect())


def test_a_table_before_its_first_version_is_empty(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], buckets=4)
    assert table.version() is None and table.read().collect() == [] and table.folders() == {}
    table.upsert(pairs(spark, []))
    assert table.version() == 0 and content(table) == []


def test_upserts_make_versions_that_share_untouched_files(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], buckets=16)
    table.write(pairs(spark, [(f"k{i}", i) for i in range(200)]))
    before = set(table.read().inputFiles())
    table.upsert(pairs(spark, [("k7", -7), ("new", 1)]))
    want = sorted([(f"k{i}", -7 if i == 7 else i) for i in range(200)] + [("new", 1)])
    assert content(table) == want and content(table, 0) == sorted((f"k{i}", i) for i in range(200))
    touched = table.touched(pairs(spark, [("k7", 0), ("new", 0)]))
    after = set(table.read().inputFiles())
    assert len(touched) <= 2 and before - after == {f for f in before if any(f"/_bucket={b}/" in f for b in touched)}
    # A row that goes takes its bucket's folder along if it was the last one.
    table.update(lambda rows: rows.filter("id LIKE 'none%'"), table.read())
    assert content(table) == [] and table.folders() == {} and table.version() == 2


def test_a_repeated_change_finds_its_version(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], buckets=4)
    table.upsert(pairs(spark, [("a", 1)]), 0)
    table.upsert(pairs(spark, [("a", 2), ("b", 2)]), 3)
    table.upsert(pairs(spark, [("a", 9)]), 3)
    assert content(table) == [("a", 2), ("b", 2)] and table.version(before=3) == 0 and content(table, 0) == [("a", 1)]
    with pytest.raises(ValueError):
        BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], buckets=8).read()


def test_an_unfinished_version_is_not_seen(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], buckets=4)
    table.write(pairs(spark, [("a", 1)]))
    (tmp_path / "t" / "data" / "version=1" / "_bucket=0").mkdir(parents=True)
    pairs(spark, [("torn", 1)]).write.mode("overwrite").parquet(str(tmp_path / "t" / "data" / "version=1" / "_bucket=0"))
    assert content(table) == [("a", 1)]
    table.upsert(pairs(spark, [("b", 2)]))
    assert content(table) == [("a", 1), ("b", 2)]


def test_a_hot_bucket_is_written_by_several_tasks(spark, tmp_path):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        rows = spark.range(60_000).select(F.lit("hot").alias("id"), F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("int").alias("v"))
        table = BucketedTable(spark, str(tmp_path / "t"), PAIR, ["id"], ["id", "v"], buckets=4)
        table.write(rows.repartition(8))
        assert len(table.read().inputFiles()) > 1 and table.read().count() == 60_000
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)


PARAMETERS = "parameter_id long, contract_id string, version_number int, original_extract string, user_override string, combined_score double"


def test_overrides_and_accepts_equal_those_of_the_whole_table(spark, tmp_path):
    rows = [(i, f"c{i % 40}", i % 3, f"o{i}", None if i % 4 else "", 1.0 if i % 2 else 0.5) for i in range(600)]
    parameters = spark.createDataFrame(rows, PARAMETERS)
    table = upsert.parameter_table(spark, str(tmp_path / "t"), PARAMETERS, 32)
    table.write(parameters)
    scored = spark.createDataFrame(
        [(5, "x", 0.1, 200), (45, None, 0.2, 200), (9999, "y", None, 404)],
        "parameter_id long, user_override string, combined_score double, status int")
    first = set(table.read().inputFiles())
    upsert.override_parameters(table, scored)
    want = review.apply_overrides(parameters, scored)
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    kept = first & set(table.read().inputFiles())
    assert len(first) - 1 == len(kept)  # both parameters are of contract c5
    granted = spark.createDataFrame([("c7", 1), ("c7", 1), ("gone", 0)], "contract_id string, version_number int")
    upsert.accept_versions(table, granted)
    hit = (F.col("contract_id") == "c7") & (F.col("version_number") == 1)
    want = review.accept(want, hit & review.acceptable(F.col("user_override"), F.col("combined_score")))
    assert sorted(map(str, table.read().collect())) == sorted(map(str, want.collect()))
    assert table.read().filter("user_override LIKE 'o%'").count() > 0
