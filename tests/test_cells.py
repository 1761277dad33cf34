"""Approximate neighbours against exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausework.operators import cells
from clausework.operators.search import nearest

SCHEMA = "parameter_id long, vector_embed array<float>"


def clustered(spark, n=3000, width=12, centres=30):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(centres, width)) * 6
    rows = [(i, (middle[i % centres] + rng.normal(size=width)).tolist()) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None)], SCHEMA)


def asked(stored, every=20):
    return stored.filter(F.col("vector_embed").isNotNull() & (F.col("parameter_id") % every == 0)).select(
        F.col("parameter_id").alias("query_id"), F.col("vector_embed").alias("query_vec"))


def test_recall_with_few_of_the_cells(spark, tmp_path):
    stored = clustered(spark)
    index = cells.build_cells(stored, str(tmp_path / "lists"))
    assert index.lists(spark).count() == 3000 and len(index.centres) == 55
    queries = asked(stored)
    probes = cells.probes_for(index, queries)
    assert probes < 20
    found = cells.nearest_in_cells(index, queries, probes).cache()
    exact = nearest(stored, queries)
    row = cells.recall_of(found, exact).first()
    assert row.neighbours == 150 * 5 and row.recall >= 0.9
    # What is found has its exact distance, and with all cells probed nothing is missed.
    distance = {(r.query_id, r.vector_id): r.distance for r in exact.collect()}
    assert all(r.distance == pytest.approx(distance[r.query_id, r.vector_id], abs=1e-5) for r in found.collect() if (r.query_id, r.vector_id) in distance)
    assert cells.recall_of(cells.nearest_in_cells(index, queries, 55), exact).first().recall == 1


def test_hot_cells_are_dealt_out(spark, tmp_path, monkeypatch):
    """A third of the vectors are one point, and most queries ask for it."""
    rng = np.random.default_rng(4)
    rows = [(i, [1.0, 1.0, 1.0] if i % 3 == 0 else rng.normal(size=3).tolist()) for i in range(1500)]
    stored = spark.createDataFrame(rows, SCHEMA)
    index = cells.build_cells(stored, str(tmp_path / "lists"))
    queries = asked(stored, 3)
    inner = cells._cell

    def watched(k):
        scan = inner(k)

        def run(vectors, some):
            if max(len(vectors), len(some)) > 150:
                raise ValueError("a task holds too much")
            return scan(vectors, some)

        return run

    monkeypatch.setattr(cells, "_cell", watched)
    found = cells.nearest_in_cells(index, queries, len(index.centres), chunk=64, block=64)
    exact = nearest(stored, queries)
    a, b = ({(r.query_id, r.vector_id) for r in df.collect()} for df in (found, exact))
    assert a == b


def test_nothing_stored_and_nothing_asked(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = cells.build_cells(none, str(tmp_path / "none"))
    assert cells.nearest_in_cells(index, asked(none), 3).count() == 0 and cells.probes_for(index, asked(none)) == 1
    stored = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5])], SCHEMA)
    index = cells.build_cells(stored, str(tmp_path / "two"), cells=1)
    assert [r.vector_id for r in cells.nearest_in_cells(index, asked(stored, 1), 9, k=1).orderBy("query_id").collect()] == [1, 2]
