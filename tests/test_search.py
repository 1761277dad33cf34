import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.functions import vectors
from clausework.operators.search import nearest, search_parameters


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:140] = x[7]  # ties
    q = np.concatenate([x[:3], rng.normal(size=(20, 16)).astype(np.float32)])
    stored = spark.createDataFrame(
        [(i, f"k{i}", f"text {i}", [float(v) for v in row]) for i, row in enumerate(x)] + [(9999, "k", "t", None)],
        "parameter_id long, parameter_key string, original_extract string, vector_embed array<float>",
    ).repartition(6).cache()
    asked = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(q)], "query_id long, query_vec array<float>"
    )
    return x.astype(float), q.astype(float), stored, asked


def by_hand(x, q, k):
    out = {}
    for i, row in enumerate(q):
        d = np.sqrt(((x - row) ** 2).sum(axis=1))
        out[i] = [int(j) for j in np.lexsort((np.arange(len(d)), d))[:k]]
    return out


def places(df):
    out = {}
    for r in df.orderBy("query_id", "distance", "vector_id").collect():
        out.setdefault(r.query_id, []).append(r.vector_id)
    return out


@pytest.mark.parametrize("k", [1, 5, 50, 1000])
def test_broadcast_block(data, k):
    x, q, stored, asked = data
    assert places(nearest(stored, asked, k)) == by_hand(x, q, k)


@pytest.mark.parametrize("k", [5, 300])
def test_block_grid(data, k):
    """Queries beyond the block limit and vectors beyond the cell limit give the same answer."""
    x, q, stored, asked = data
    assert places(nearest(stored, asked, k, block_bytes=600, cell_bytes=20_000)) == by_hand(x, q, k)


def test_single_query_is_take_ordered(data, plan):
    _, _, stored, asked = data
    df = nearest(stored, asked.filter("query_id = 0"), 5)
    assert "TakeOrderedAndProject" in plan(df) and "Window" not in plan(df)


def test_many_queries_limit_before_the_shuffle(data, plan):
    _, _, stored, asked = data
    shown = plan(nearest(stored, asked, 5))
    assert "WindowGroupLimit" in shown and "NestedLoop" not in shown and "Cartesian" not in shown


def test_k_bounds(data):
    _, _, stored, asked = data
    assert nearest(stored, asked, 0).count() == 0
    with pytest.raises(ValueError):
        nearest(stored, asked, -1)
    assert nearest(stored, asked.limit(0), 5).count() == 0


def test_scores(data):
    _, _, stored, asked = data
    best = search_parameters(stored, asked.filter("query_id = 1"), 3).orderBy(F.desc("score")).collect()
    assert (best[0].parameter_id, best[0].parameter_key, best[0].original_extract) == (1, "k1", "text 1")
    assert best[0].score == 1.0 and best[1].score < 1


def test_vector_functions(spark):
    rows = [([], [1.0]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0]), ([1.0, 1.0], [1.0]), (None, [1.0])]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<float>, b array<float>")
    got = [r[0] for r in df.orderBy("i").select(vectors.cosine_similarity(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0.0, 0.0, 1.0] and got[4] == 0.0
    assert abs(got[3] - 1 / np.sqrt(2)) < 1e-12  # norms over all components, product over the shared ones
    scored = spark.createDataFrame([(0.0,), (1.0,), (3.0,)], "d double").select(vectors.search_score(F.col("d")))
    assert [r[0] for r in scored.collect()] == [1.0, 0.5, 0.25]
