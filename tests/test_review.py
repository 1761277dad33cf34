import pytest
from pyspark.sql import functions as F

from clausework.functions.scores import combined_score, review_status, score_label, text_precision
from clausework.operators import review

PARAMETERS = (
    "parameter_id long, contract_id string, version_number int, original_extract string, "
    "user_override string, combined_score double, vector_embed array<float>"
)
ACCEPT = [  # override, score, server accepts, preview accepts
    (None, 0.99, True, True),
    (None, 0.98, False, True),
    (None, None, False, True),
    ("", 1.0, False, True),
    ("  ", 1.0, False, True),
    ("x", 1.0, False, False),
]


@pytest.fixture
def parameters(spark):
    return spark.createDataFrame(
        [(i, "c", 1, "o", override, score, None) for i, (override, score, _, _) in enumerate(ACCEPT)], PARAMETERS
    )


def test_accept_and_preview(parameters):
    for run, column in ((review.batch_accept, 2), (review.accept_preview, 3)):
        for r in run(parameters).collect():
            case = ACCEPT[r.parameter_id]
            expected = ("o", 1.0) if case[column] else (case[0], case[1])
            assert (r.user_override, r.combined_score) == expected


def test_accept_is_idempotent(parameters):
    once = review.batch_accept(parameters)
    assert sorted(review.batch_accept(once).collect()) == sorted(once.collect())


def test_divergence(parameters):
    assert {r.parameter_id for r in review.accept_divergence(parameters).collect()} == {1, 2, 3, 4}


def test_accept_requests(spark, parameters):
    versions = spark.createDataFrame([("c", 1, "t1"), ("d", 1, "t2")], "contract_id string, version_number int, etag string")
    requests = spark.createDataFrame(
        [(0, "c", 1, None), (1, "c", 1, "t1"), (2, "c", 1, "old"), (3, "c", 2, None), (4, "d", 1, "")],
        "n int, contract_id string, version_number int, if_match string",
    )
    replies, after = review.accept_requests(requests, versions, parameters, order="n")
    got = {r.n: (r.status, r.updated) for r in replies.collect()}
    assert got == {0: (200, 1), 1: (200, 0), 2: (409, None), 3: (404, None), 4: (200, 0)}
    assert after.filter("user_override = 'o'").count() == 1
    _, untouched = review.accept_requests(requests.filter("n = 2"), versions, parameters, order="n")
    assert untouched.filter("user_override = 'o'").count() == 0


def test_repeated_accepts_count_rows_without_an_original_again(spark):
    rows = [(i, "c", 1, o, None, 1.0, None) for i, o in enumerate(["a", "b", None])]
    parameters = spark.createDataFrame(rows, PARAMETERS)
    versions = spark.createDataFrame([("c", 1, "t")], "contract_id string, version_number int, etag string")
    requests = spark.createDataFrame(
        [(1, "c", 1, "old"), (2, "c", 1, "t"), (3, "c", 1, None), (4, "c", 1, "t")],
        "seq long, contract_id string, version_number int, if_match string",
    )
    replies, after = review.accept_requests(requests, versions, parameters)
    assert {r.seq: (r.status, r.updated) for r in replies.collect()} == {1: (409, None), 2: (200, 3), 3: (200, 1), 4: (200, 1)}
    assert {r.user_override for r in after.collect()} == {"a", "b", None}


RATIOS = [
    ("", "", 1.0), ("abc", "", 0.0), ("", "abc", 0.0), ("abcd", "bcde", 0.75), ("tide", "diet", 0.25), ("diet", "tide", 0.5),
    ("ab" * 150, "ab" * 150 + "b", None),
]


def test_text_precision(spark):
    import difflib

    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(RATIOS)], "i int, a string, b string")
    got = {r.i: r.t for r in df.withColumn("t", text_precision(F.col("a"), F.col("b"))).collect()}
    for i, (a, b, want) in enumerate(RATIOS):
        assert got[i] == (difflib.SequenceMatcher(None, a, b).ratio() if want is None else want)


def test_override_scores(spark):
    unit, zero = [0.6, 0.8], [0.0, 0.0]
    cases = [  # original, override, stored vector, override vector, score
        ("tide", "diet", None, unit, 0.15),
        ("diet", "tide", None, unit, 0.30),
        ("Five k", "five  K", unit, unit, 1.0),
        ("same", "same", None, unit, 0.6),
        ("same", "same", zero, unit, 0.6),
        ("abc", None, unit, unit, 0.0),
        ("abc", "", unit, unit, 0.0),
        ("", "", unit, unit, 0.6),
        (None, None, unit, unit, 0.6),
    ]
    parameters = spark.createDataFrame(
        [(i, "c", 1, o, None, 1.0, vec) for i, (o, _, vec, _, _) in enumerate(cases)], PARAMETERS
    )
    overrides = spark.createDataFrame(
        [(1, i, "earlier", zero) for i in range(len(cases))]
        + [(2, i, new, vec) for i, (_, new, _, vec, _) in enumerate(cases)] + [(1, 99, "x", unit)],
        "seq long, parameter_id long, user_override string, override_embed array<float>",
    )
    scored = review.score_overrides(overrides, parameters)
    got = {r.parameter_id: r for r in scored.collect()}
    assert got[99].status == 404 and got[99].combined_score is None
    for i, case in enumerate(cases):
        assert got[i].combined_score == pytest.approx(case[4], abs=1e-7)
    after = {r.parameter_id: r for r in review.apply_overrides(parameters, scored).collect()}
    assert len(after) == len(cases)
    assert [after[i].user_override for i in range(len(cases))] == [c[1] for c in cases]


def test_only_overridden_rows_are_replaced(spark):
    parameters = spark.createDataFrame([(1, "c", 1, "a", "kept", 0.5, None), (2, "c", 1, "a", "old", 0.5, None)], PARAMETERS)
    scored = spark.createDataFrame([(2, None, 200, 0.1)], "parameter_id long, user_override string, status int, combined_score double")
    got = {r.parameter_id: (r.user_override, r.combined_score) for r in review.apply_overrides(parameters, scored).collect()}
    assert got == {1: ("kept", 0.5), 2: (None, 0.1)}


def test_embedder_is_given_the_raw_override(spark):
    from clausework.plans.enrich import embed_hashing

    parameters = embed_hashing(
        spark.createDataFrame([(1, "pay USD 5k")], "parameter_id long, original_extract string"), "original_extract", "vector_embed"
    )
    overrides = spark.createDataFrame([(1, 1, "pay USD 5k")], "seq long, parameter_id long, user_override string")
    scored = review.score_overrides(overrides, parameters, lambda df: embed_hashing(df, "user_override", "override_embed"))
    assert scored.first().combined_score == pytest.approx(1.0, abs=1e-6)


def test_labels(spark):
    values = [None, 0.99, 0.98, 0.125, 0.375, 1.005, 0.285, 1.0, -0.125, 0.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s double")
    got = {r.i: (r.status, r.label) for r in df.select(
        "i", review_status(F.col("s")).alias("status"), score_label(F.col("s")).alias("label")).collect()}
    assert [got[i][1] for i in range(len(values))] == ["--", "0.99", "0.98", "0.13", "0.38", "1.00", "0.28", "1.00", "-0.13", "0.00"]
    assert [got[i][0] for i in range(3)] == ["", "high", ""]
    score = spark.range(1).select(combined_score(F.lit(0.5), F.lit(0.25)), combined_score(F.lit(1.0), F.lit(0.0), 0.3)).first()
    assert score[0] == pytest.approx(0.4) and score[1] == pytest.approx(0.3)
