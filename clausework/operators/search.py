"""Exact nearest neighbours by L2 distance over stored vectors.

Every task scans its share of the vectors in Arrow batches and keeps only the k best per query,
so what reaches the shuffle is k rows per query and task, never the query-vector pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausework.functions.vectors import search_score
from clausework.schemas import SEARCH_K

# A query block that every task may hold; more queries go through the block grid.
BLOCK_BYTES = 32 << 20
# Vectors of one grid cell.
CELL_BYTES = 256 << 20

# Winners that are sent to every task instead of shuffling the parameter table.
BROADCAST_ROWS = 1_000_000

BEST = "query_id long, vector_id long, distance double"


def _keeper(k: int):
    """Top-k state for a block of queries, as a closure so workers need no copy of this package."""

    def start(query_ids, query_vecs):
        import numpy as np

        q = np.asarray(query_vecs, dtype=np.float64)
        qq = np.einsum("ij,ij->i", q, q)
        best = [(np.empty(0, np.int64), np.empty(0)) for _ in query_ids]
        bars = np.full(len(query_ids), np.inf)
        # Rows per step, so that the distance table of a step stays at 32 MB.
        step = max(1, min(4096, (4 << 20) // max(1, len(query_ids))))

        def add_step(ids, x):
            xx = np.einsum("ij,ij->i", x, x)
            rough = xx[:, None] - 2.0 * (x @ q.T) + qq[None, :]
            # Margin over the rounding of the expanded form: no true neighbour is cut off.
            margin = 1e-10 * (1.0 + xx.max() + qq.max())
            for j in np.flatnonzero(rough.min(axis=0) <= bars + margin):
                column = rough[:, j]
                bar = bars[j]
                if len(column) > k:
                    bar = min(bar, np.partition(column, k - 1)[k - 1])
                near = np.flatnonzero(column <= bar + margin)
                gap = x[near] - q[j]
                d = np.concatenate([best[j][1], np.sqrt(np.einsum("ij,ij->i", gap, gap))])
                i = np.concatenate([best[j][0], ids[near]])
                keep = np.lexsort((i, d))[:k]
                best[j] = (i[keep], d[keep])
                if len(keep) == k:
                    bars[j] = d[keep[-1]] ** 2

        def add(ids, x):
            if len(ids) and x.shape[1] != q.shape[1]:
                raise ValueError(f"vector width {x.shape[1]} differs from query width {q.shape[1]}")
            for at in range(0, len(ids), step):
                add_step(ids[at : at + step], x[at : at + step])

        def finish():
            sizes = [len(i) for i, _ in best]
            return (
                np.repeat(np.asarray(query_ids, np.int64), sizes),
                np.concatenate([i for i, _ in best]) if best else np.empty(0, np.int64),
                np.concatenate([d for _, d in best]) if best else np.empty(0),
            )

        return add, finish

    return start


def _scan_with(block, k: int):
    """mapInArrow function: all vectors of the task against one broadcast query block."""
    start = _keeper(k)

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        add, finish = start(*block.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = np.diff(batch.column(1).offsets.to_numpy())
            if (widths != widths[0]).any():
                raise ValueError("stored vectors differ in width")
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            add(batch.column(0).to_numpy(), flat.reshape(batch.num_rows, -1))
        query, vector, distance = finish()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query), pa.array(vector), pa.array(distance)],
            ["query_id", "vector_id", "distance"],
        )

    return scan


def _cell(k: int):
    """Cogroup function: one cell of vectors against one block of queries."""
    start = _keeper(k)

    def scan(vectors, queries):
        import numpy as np
        import pandas as pd

        if not len(vectors) or not len(queries):
            return pd.DataFrame({
                "query_id": np.empty(0, np.int64), "vector_id": np.empty(0, np.int64), "distance": np.empty(0),
            })
        add, finish = start(queries["query_id"].to_numpy(), np.stack(queries["query_vec"].to_list()))
        add(vectors["vector_id"].to_numpy(), np.stack(vectors["vector"].to_list()).astype(np.float64))
        query, vector, distance = finish()
        return pd.DataFrame({"query_id": query, "vector_id": vector, "distance": distance})

    return scan


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = SEARCH_K,
    vector_id: str = "parameter_id",
    vector: str = "vector_embed",
    block_bytes: int = BLOCK_BYTES,
    cell_bytes: int = CELL_BYTES,
) -> DataFrame:
    """The k nearest stored vectors of each query (query_id, query_vec), ties by id.

    A column ``k`` of the queries takes the place of the argument. Returns query_id, ``vector_id``, distance.
    """
    own_k = "k" in queries.columns
    if own_k:
        lowest, k = queries.agg(F.min("k"), F.max("k")).first()
        lowest, k = lowest or 0, k or 0
    if k < 0 or own_k and lowest < 0:
        raise ValueError("k must not be negative")
    stored = vectors.filter(F.col(vector).isNotNull()).select(
        F.col(vector_id).cast("long").alias("vector_id"), F.col(vector).alias("vector")
    )
    asked = queries.select(F.col("query_id").cast("long"), "query_vec")
    if k == 0:
        return stored.sparkSession.createDataFrame([], BEST)
    query_bytes = _bytes(asked, "query_vec")
    if query_bytes <= block_bytes:
        spark = stored.sparkSession
        # Within block_bytes, as just measured.
        rows = asked.collect()
        block = spark.sparkContext.broadcast(([r[0] for r in rows], [list(r[1]) for r in rows]))
        local = stored.mapInArrow(_scan_with(block, k), BEST) if rows else spark.createDataFrame([], BEST)
        if len(rows) == 1 and not own_k:
            return local.orderBy("distance", "vector_id").limit(k)
    else:
        # Grid: query blocks times vector cells, each pair one bounded task.
        blocks = -(-query_bytes // block_bytes)
        cells = max(1, -(-_bytes(stored, "vector") // cell_bytes))
        v = stored.withColumn("_cell", F.pmod(F.xxhash64("vector_id"), F.lit(cells))).withColumn(
            "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        )
        q = asked.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn(
            "_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long")))
        )
        on = ["_cell", "_block"]
        local = v.groupBy(*on).cogroup(q.groupBy(*on)).applyInPandas(_cell(k), BEST)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vector_id"))
    placed = local.withColumn("_place", place).filter(F.col("_place") <= k)
    if own_k:
        limits = queries.select(F.col("query_id").cast("long"), F.col("k").alias("_k"))
        placed = placed.join(limits, "query_id").filter(F.col("_place") <= F.col("_k")).drop("_k")
    return placed.drop("_place")


def _bytes(df: DataFrame, vec: str) -> int:
    return df.agg(F.sum(F.size(vec).cast("long") * 8 + 16)).first()[0] or 0


def search_parameters(parameters: DataFrame, queries: DataFrame, k: int = SEARCH_K) -> DataFrame:
    """query_id, parameter_id, parameter_key, original_extract, score, over all contracts and versions."""
    best = nearest(parameters, queries, k).withColumnRenamed("vector_id", "parameter_id")
    asked, most = queries.agg(F.count(F.lit(1)), F.max("k") if "k" in queries.columns else F.lit(k)).first()
    if asked * (most or 0) <= BROADCAST_ROWS:
        best = F.broadcast(best)  # three numbers a row; the parameter table stays where it is
    # Key and text are fetched for the winners only; they never pass through Python.
    return best.join(parameters.select("parameter_id", "parameter_key", "original_extract"), "parameter_id").select(
        "query_id", "parameter_id", "parameter_key", "original_extract",
        search_score(F.col("distance")).alias("score"),
    )


def search_texts(
    parameters: DataFrame, texts: DataFrame, embedder: Callable[[DataFrame], DataFrame], k: int = SEARCH_K
) -> DataFrame:
    """Search by text (query_id, text and, where they differ, k); ``embedder`` adds ``query_vec`` as for stored rows."""
    return search_parameters(parameters, embedder(texts).drop("text"), k)
