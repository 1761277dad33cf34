"""Approximate nearest neighbours: an inverted file of k-means cells, probed cells re-ranked exactly.

Cells are fitted on a bounded sample; every vector is then filed under its nearest centre, in a table
sorted by cell. A query looks only into the cells whose centres are nearest to it, and what it finds
there is ranked by exact distance. A cell with many vectors is dealt into chunks and one that many
queries probe into blocks of them, so a task holds a bounded part of either, whatever is hot; no pairs
leave a task, only each query's best. How many cells to probe is settled by measurement: the exact
neighbours of a bounded sample of queries tell how far down the list of cells they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.operators.search import BEST, _cell, nearest
from clausework.schemas import SEARCH_K

# Rows that cells are fitted on, cells, and queries that the number of probes is settled by: at most so many.
SAMPLE_ROWS, MAX_CELLS, SAMPLE_QUERIES = 20_000, 4096, 200
# Vectors of a chunk and queries of a block that meet in one task.
CHUNK, BLOCK = 8192, 1024
RECALL = 0.95


@dataclass
class Cells:
    """Where the lists are, and the centres of the cells."""

    path: str
    centres: np.ndarray

    def lists(self, spark: SparkSession) -> DataFrame:
        """vector_id, vector, cell."""
        return spark.read.schema("vector_id long, vector array<float>, cell int").parquet(self.path)


def _nearest_cells(centres: np.ndarray, vectors: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` cells nearest to each vector, nearest first, ties by number."""
    gap = (centres**2).sum(axis=1)[None, :] - 2 * vectors @ centres.T
    return np.argsort(gap, axis=1, kind="stable")[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _filed(rows: DataFrame, vector: str, centres: np.ndarray, n: int) -> DataFrame:
    """``rows`` once for each of their ``n`` nearest cells, with ``cell`` and its ``place`` from 0."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _nearest_cells(shared.value, _matrix(batch.column(vector)), n)
                taken = batch.take(pa.array(np.repeat(np.arange(len(found)), found.shape[1])))
                more = [pa.array(found.ravel().astype(np.int32)), pa.array(np.tile(np.arange(found.shape[1], dtype=np.int32), len(found)))]
                yield pa.RecordBatch.from_arrays([*taken.columns, *more], [*batch.schema.names, "cell", "place"])

    fields = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes)
    return rows.mapInArrow(run, f"{fields}, cell int, place int")


def build_cells(
    vectors: DataFrame, path: str, vector_id: str = "parameter_id", vector: str = "vector_embed", cells: int | None = None,
    sample_rows: int = SAMPLE_ROWS, seed: int = 5,
) -> Cells:
    """File all vectors (those that are null take no part) at ``path``; by default there are as many cells as the root of their number."""
    stored = vectors.filter(F.col(vector).isNotNull()).select(
        F.col(vector_id).cast("long").alias("vector_id"), F.col(vector).cast("array<float>").alias("vector")
    )
    n = stored.count()
    cells = cells or min(MAX_CELLS, max(1, round(n**0.5)))
    sample = stored.orderBy(F.xxhash64("vector_id"), "vector_id").limit(sample_rows).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    if not n:
        centres = np.zeros((1, 1))
    else:
        # A centre has the width of a vector; there are at most MAX_CELLS.
        centres = np.array(KMeans(k=max(2, cells), seed=seed, maxIter=10, initMode="random").fit(sample).clusterCenters())
    filed = _filed(stored, "vector", centres, 1).drop("place")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    filed.repartitionByRange(parts, "cell", "vector_id").sortWithinPartitions("cell").write.parquet(path)
    return Cells(path, centres)


def nearest_in_cells(index: Cells, queries: DataFrame, probes: int, k: int = SEARCH_K, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """query_id, vector_id, distance of the k nearest vectors in the ``probes`` cells nearest to each query (query_id, query_vec)."""
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query_vec").cast("array<float>").alias("query_vec"))
    if k < 1:
        return spark.createDataFrame([], BEST)
    lists = index.lists(spark)
    probing = _filed(asked, "query_vec", index.centres, probes).drop("place")
    # Two numbers a cell, so at most MAX_CELLS rows.
    sizes = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / chunk).cast("int").alias("chunks"))
    wanted = probing.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    both = F.broadcast(sizes.join(wanted, "cell"))
    one = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    v = lists.join(both, "cell").withColumn("_chunk", one("vector_id", "chunks")).withColumn("_block", each("blocks"))
    q = probing.join(both, "cell").withColumn("_block", one("query_id", "blocks")).withColumn("_chunk", each("chunks"))
    on = ["cell", "_chunk", "_block"]
    found = v.select(*on, "vector_id", "vector").groupBy(*on).cogroup(q.select(*on, "query_id", "query_vec").groupBy(*on)).applyInPandas(_cell(k), BEST)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vector_id"))
    return found.withColumn("_place", place).filter(F.col("_place") <= k).drop("_place")


def probes_for(index: Cells, queries: DataFrame, k: int = SEARCH_K, recall: float = RECALL, sample_queries: int = SAMPLE_QUERIES) -> int:
    """Cells to probe for ``recall`` of the exact neighbours, by those of a sample of the queries, taken by hash."""
    spark = queries.sparkSession
    some = queries.select("query_id", "query_vec").orderBy(F.xxhash64("query_id"), "query_id").limit(sample_queries)
    lists = index.lists(spark)
    exact = nearest(lists, some, k, "vector_id", "vector")
    # The cells of the neighbours, in each query's own order of all cells: k numbers a query.
    ranked = _filed(some.select("query_id", F.col("query_vec").cast("array<float>").alias("query_vec")), "query_vec", index.centres, len(index.centres))
    places = exact.join(lists.select("vector_id", "cell"), "vector_id").join(ranked.select("query_id", "cell", "place"), ["query_id", "cell"])
    found = sorted(r[0] for r in places.select("place").collect())
    return found[min(len(found) - 1, int(np.ceil(recall * len(found))))] + 1 if found else 1


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours there are, those found, and the share."""
    both = exact.select("query_id", "vector_id").join(found.select("query_id", "vector_id", F.lit(1).alias("hit")), ["query_id", "vector_id"], "left")
    return both.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide("found", "neighbours")
    )
