import pytest
from pyspark.sql import functions as F

from clausework.operators import audit, ledger
from clausework.schemas import REQUIRED, MAX_LENGTHS, VERSIONS


def test_insert_keeps_known_and_first_arrival(spark):
    known = spark.createDataFrame([("a", "old")], "contract_id string, contract_type string")
    incoming = spark.createDataFrame(
        [(2, "a", "new"), (3, "b", "second"), (1, "b", "first"), (9, "c", None)], "seq int, contract_id string, contract_type string"
    )
    got = {r.contract_id: r.contract_type for r in ledger.insert_if_absent(known, incoming, "seq").collect()}
    assert got == {"a": "old", "b": "first", "c": None}


@pytest.mark.parametrize("rows_per_task", [2_000_000, 3])
def test_create_versions(spark, rows_per_task):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    versions = spark.createDataFrame(
        [("a", 1, "X", False, "e1", at), ("a", 4, "Y", True, "e4", at), ("z", 1, "Z", True, "ez", at)], VERSIONS
    )
    requests = spark.createDataFrame(
        [(i, "a", "PENDING_APPROVAL") for i in range(5)] + [(7, "n", None)], "seq int, contract_id string, workflow_state string"
    )
    after = ledger.create_versions(requests, versions, ["seq"], rows_per_task=rows_per_task)
    got = {(r.contract_id, r.version_number): (r.workflow_state, r.is_current) for r in after.collect()}
    assert got == {
        ("a", 1): ("X", False), ("a", 4): ("Y", False), ("z", 1): ("Z", True), ("n", 1): ("STAGED_DRAFT", True),
        **{("a", 5 + i): ("PENDING_APPROVAL", i == 4) for i in range(5)},
    }
    assert after.select("etag").distinct().count() == 9
    assert audit.current_violations(after).count() == 0


def test_etag_status(spark):
    rows = [(None, "t", 200), ("", "t", 200), ("t", "t", 200), ("u", "t", 409), ("u", None, 409)]
    df = spark.createDataFrame(rows, "sent string, tag string, want int")
    assert all(r.got == r.want for r in df.withColumn("got", ledger.etag_status(F.col("sent"), F.col("tag"))).collect())


def test_etag_fits_the_column(spark):
    longest = ledger.etag(F.lit("c"), F.lit(2**31 - 1), F.lit(2**63 - 1))
    assert spark.range(1).select(F.length(longest)).first()[0] <= MAX_LENGTHS["contract_versions"]["etag"]


def test_audits(spark):
    versions = spark.createDataFrame(
        [("a", 1, "S", True, "e"), ("a", 1, "S", True, "e"), ("b", 1, "S" * 31, False, None)],
        "contract_id string, version_number int, workflow_state string, is_current boolean, etag string",
    ).withColumn("created_at", F.current_timestamp())
    assert [(r.contract_id, r.copies) for r in audit.duplicate_keys(versions, ["contract_id", "version_number"]).collect()] == [("a", 2)]
    found = {(r.column_name, r.rule): r.violations for r in audit.rule_violations(
        versions, REQUIRED["contract_versions"], MAX_LENGTHS["contract_versions"]).collect()}
    assert {k for k, v in found.items() if v} == {("etag", "not_null"), ("workflow_state", "max_length")}
    assert {(r.contract_id, r.current_versions) for r in audit.current_violations(versions).collect()} == {("a", 2), ("b", 0)}
    contracts = spark.createDataFrame([("a",)], "contract_id string")
    assert [(r.contract_id, r["rows"]) for r in audit.orphans(versions, contracts, ["contract_id"]).collect()] == [("b", 1)]
    vecs = spark.createDataFrame([(1, [0.6, 0.8]), (2, [1.0]), (3, [3.0, 4.0]), (4, None)], "i int, vector_embed array<float>")
    assert {r.i for r in audit.vector_violations(vecs, width=2).collect()} == {2, 3}


def test_requests_without_an_id_make_contracts_of_their_own(spark):
    known = spark.createDataFrame([("a", "old")], "contract_id string, contract_type string")
    incoming = spark.createDataFrame(
        [(1, None, "x"), (2, "", "y"), (3, None, "z"), (4, "a", "new"), (5, "b", "first"), (6, "b", "second")],
        "seq long, contract_id string, contract_type string",
    )
    rows = ledger.insert_if_absent(known, incoming, "seq").collect()
    assert sorted(r.contract_type for r in rows) == ["first", "old", "x", "y", "z"]
    assert len({r.contract_id for r in rows}) == 5 and all(r.contract_id for r in rows)


def test_two_rows_of_a_version_are_an_error(spark):
    versions = spark.createDataFrame([("a", 1, "s"), ("b", 1, "x"), ("b", 1, "y")], "contract_id string, version_number int, workflow_state string")
    asked = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "contract_id string, version_number int")
    got = {r.contract_id: (r.status, r.workflow_state) for r in ledger.lookup_versions(asked, versions).collect()}
    assert got == {"a": (200, "s"), "b": (500, None), "c": (404, None)}
    assert {(r.contract_id, r.status) for r in ledger.listing_status(asked, versions).collect()} == {("a", 200), ("b", 500), ("c", 404)}


def test_two_feeds_that_count_alike_make_contracts_of_their_own(spark):
    contracts = spark.createDataFrame([("a", "t")], "contract_id string, contract_type string")
    incoming = spark.createDataFrame([(None, "x", 1), ("", "y", 2), ("a", "z", 3)], "contract_id string, contract_type string, seq long")
    first = ledger.insert_if_absent(contracts, incoming, "seq", feed="one")
    both = ledger.insert_if_absent(first, incoming, "seq", feed="two")
    assert sorted(r.contract_type for r in both.collect()) == ["t", "x", "x", "y", "y"]
    again = ledger.insert_if_absent(both, incoming, "seq", feed="two")
    assert again.count() == both.count()
