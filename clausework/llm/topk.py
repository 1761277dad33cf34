"""Exact top-k by inner product with norm-bucketed retrieval.

Vectors are sorted by length into buckets of neighbours. Queries, in blocks, first meet the bucket
of the longest vectors, which gives each query a floor for its k-th score. Against every further
bucket that floor becomes a local cosine threshold: floor / (query length * longest vector). Above
one, the pair of query and bucket is dropped before anything is shuffled. Otherwise each query chooses
by its threshold: with a low one, vectors too short to reach the floor are skipped; with a high one,
vectors outside the feasible interval of the query's largest coordinate too. Queries of like thresholds
go through a bucket together, and what any of them still needs is verified by exact products.

A pair of query block and bucket is one task group of bounded size. The scores that leave it are
the k best per query, and only those that reach the floor.

Components become floor(scale * x). Products are computed in double precision where every sum is
below 2^53, hence exact, and in whole numbers of any size otherwise.

Defined results
  null vectors, null or non-finite components    take no part, as queries or candidates
  null vec_id           never a query; a candidate, sorted after every number
  repeated ids          every row counts; a query leaves out its own row only
  unequal lengths       missing components count as zero
  ties                  smaller vec_id first
  fewer than k rows     all of them
  empty table           no rows
  other columns         ignored
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausework.llm.util import bounded, checkpointed

K, SCALE = 20, 64
# Vectors per bucket, queries per block, and queries that go through a bucket together.
BUCKET, BLOCK, TOGETHER = 4096, 1024, 128
# Room for rounding in bounds that decide what is skipped.
SLACK = 1e-9
# From this cosine threshold on, coordinate pruning pays.
STEEP = 0.5


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null unless all are finite."""
    x = F.transform(vector, lambda v: v.cast("double") * float(scale))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) >= float(1 << 62)))
    return F.when(~F.coalesce(bad, F.lit(True)), F.transform(x, lambda v: F.floor(v).cast("long")))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of whole numbers, padded with zeros."""
    column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    wide = int(lengths.max()) if len(lengths) else 0
    out = np.zeros((len(lengths), wide), np.int64)
    out[np.arange(wide) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of q with all rows of p."""
    wide = max(q.shape[1], p.shape[1])
    q, p = (np.pad(m, ((0, 0), (0, wide - m.shape[1]))) for m in (q, p))
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * max(wide, 1)
    if bound < 1 << 53:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    whole = q.astype(object) @ p.astype(object).T
    if wide and whole.size and max(abs(whole.max()), abs(whole.min())) >= 1 << 63:
        raise OverflowError("an inner product does not fit into 64 bits")
    return whole.astype(np.int64)


def _thresholds(q_norm: np.ndarray, floor: np.ndarray, longest: float) -> np.ndarray:
    """Local cosine threshold of each query; -1 where any vector may do."""
    bounded_ = np.isfinite(floor) & (floor > 0)
    return np.where(bounded_, floor / np.maximum(q_norm * longest, 1e-300), -1.0)


def _survivors(q: np.ndarray, t: np.ndarray, p: np.ndarray, p_norm: np.ndarray) -> np.ndarray:
    """Which vectors some query still needs, by the thresholds ``t``; p_norm descends."""
    longest = max(float(p_norm[0]), 1e-300)
    keep = np.zeros(len(p), bool)
    # Length: a product is at most the product of the lengths, so a query needs no shorter ones.
    flat = t < STEEP
    if flat.any():
        keep = p_norm >= t[flat].min() * longest * (1 - SLACK)
        if keep.all():
            return keep
    steep = ~flat & (t <= 1 + SLACK)
    if not steep.any():
        return keep
    # Coordinates: with a cosine of at least t, component f of p/|p| stays within
    # q_f t -/+ sqrt((1 - t^2)(1 - q_f^2)), f being the query's largest component.
    q, t = q[steep], np.minimum(t[steep], 1.0)
    unit_q = q / np.maximum(np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), 1e-300)[:, None]
    unit_p = p / np.maximum(p_norm, 1e-300)[:, None]
    f = np.abs(unit_q[:, :min(q.shape[1], p.shape[1])]).argmax(axis=1)
    peak = unit_q[np.arange(len(q)), f]
    reach = np.sqrt(np.maximum(0.0, (1 - t * t) * (1 - peak * peak))) + SLACK
    # Over all cosines from t to 1; a peak of at least t is itself within reach of its sign's end.
    low = np.where(-peak >= t, -1 - SLACK, peak * t - reach)
    high = np.where(peak >= t, 1 + SLACK, peak * t + reach)
    for i in range(len(q)):
        x = unit_p[:, f[i]]
        keep |= (x >= low[i]) & (x <= high[i]) & (p_norm >= t[i] * longest * (1 - SLACK))
    return keep


def _best(queries: pa.Table, bucket: pa.Table, k: int) -> pa.Table:
    """The k best of one bucket for every query of one block, of those that reach its floor."""
    if not queries.num_rows or not bucket.num_rows:
        return pa.table({
            "query_row": pa.array([], pa.int64()), "query_id": pa.array([], queries.schema.field("vec_id").type),
            "vec_id": pa.array([], bucket.schema.field("vec_id").type), "row": pa.array([], pa.int64()),
            "score": pa.array([], pa.int64()),
        })
    q, p = _matrix(queries.column("vector")), _matrix(bucket.column("vector"))
    q_row, p_row = queries.column("row").to_numpy(), bucket.column("row").to_numpy()
    floor = queries.column("floor").to_pandas().fillna(-np.inf).to_numpy(np.float64)
    p_norm = bucket.column("norm").to_numpy()
    by_length = np.argsort(-p_norm, kind="stable")
    thresholds = _thresholds(queries.column("norm").to_numpy(), floor, float(p_norm.max()))
    # By id, so that the first of equal scores is the one that wins.
    ids = bucket.column("vec_id").to_pandas()
    by_id = np.lexsort((p_row, ids.fillna(0).to_numpy(), ids.isna().to_numpy()))
    out_q, out_p, out_score = [], [], []
    alike = np.argsort(thresholds, kind="stable")
    for at in range(0, len(q), TOGETHER):
        some = alike[at:at + TOGETHER]
        needed = np.zeros(len(p), bool)
        needed[by_length] = _survivors(q[some], thresholds[some], p[by_length], p_norm[by_length])
        rows = by_id[needed[by_id]]
        scores = _products(q[some], p[rows])
        hit = (scores >= floor[some, None]) & (q_row[some, None] != p_row[None, rows])
        who, what = np.nonzero(hit)
        score = scores[who, what]
        order = np.lexsort((what, -score, who))
        who, what, score = who[order], what[order], score[order]
        first = np.searchsorted(who, who)
        top = np.arange(len(who)) - first < k
        out_q.append(some[who[top]])
        out_p.append(rows[what[top]])
        out_score.append(score[top])
    out_q = np.concatenate(out_q) if out_q else np.zeros(0, np.int64)
    found = np.concatenate(out_p) if out_p else np.zeros(0, np.int64)
    chosen = bucket.column("vec_id").take(pa.array(found))
    return pa.table({
        "query_row": pa.array(q_row[out_q]), "query_id": queries.column("vec_id").take(pa.array(out_q)),
        "vec_id": chosen, "row": pa.array(p_row[found]),
        "score": pa.array(np.concatenate(out_score) if out_score else np.zeros(0, np.int64)),
    })


def _meet(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """k best per (query, bucket) of queries (block, bucket, floor) and vectors (block, bucket)."""
    schema = f"query_row long, query_id {dict(queries.dtypes)['vec_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, row long, score long"
    keys = ["block", "bucket"]
    # Both come from one table; fresh column identities keep the sides apart.
    queries = queries.toDF(*queries.columns)
    return queries.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(lambda a, b: _best(a, b, k), schema)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
                 scale: int = SCALE, bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of every row that ``is_query`` (of ``vec_id``) selects."""
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].alias("vec_id"), scaled(vectors[vector_col], scale).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = rows.filter("vector is not null").withColumn("norm", F.sqrt(square)).withColumn("row", F.monotonically_increasing_id())
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.desc("norm"), "vec_id", "row").sortWithinPartitions(F.desc("norm"), "vec_id", "row")
    # Place within the sorted partition; partitions descend by length, so bucket numbers do too.
    place = F.monotonically_increasing_id()
    ordered = checkpointed(ordered.withColumns({
        "part": F.shiftright(place, 33), "inner": F.floor(place.bitwiseAND((1 << 33) - 1) / bucket),
    }))
    deepest, n_queries = ordered.agg(F.max("inner"), F.count_if(is_query)).first()
    per_part = (deepest or 0) + 1
    blocks = max(1, -(-n_queries // block))
    ordered = ordered.withColumn("bucket", F.col("part") * per_part + F.col("inner")).drop("part", "inner")
    # Dealt by hash of the row number: blocks of about equal size.
    queries = ordered.filter(is_query).drop("bucket").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    each_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    longest = ordered.agg(F.min("bucket")).first()[0] or 0
    seed = _meet(
        queries.withColumns({"bucket": F.lit(longest).cast("long"), "floor": F.lit(None).cast("double")}),
        ordered.filter(F.col("bucket") == longest).select("*", each_block), k,
    )
    seed = checkpointed(_ranked(seed, k).drop("rank"))
    floors = seed.groupBy(F.col("query_row").alias("row")).agg(
        F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("floor")
    ).filter(F.col("n") >= k).drop("n")
    # One number per bucket; a query meets those whose longest vector could still reach its floor.
    longest_of = checkpointed(ordered.groupBy("bucket").agg(F.max("norm").alias("longest")))
    every_bucket = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts * per_part - 1).cast("long"))).alias("bucket")
    reaches = F.col("floor").isNull() | (F.col("floor") <= F.col("norm") * F.col("longest") * (1 + SLACK))
    pairs = (
        queries.join(floors, "row", "left").select("*", every_bucket).filter(F.col("bucket") != longest)
        .join(bounded(longest_of), "bucket").filter(reaches).drop("longest")
    )
    # Vectors go to the blocks that still want their bucket.
    wanted = pairs.select("bucket", "block").distinct()
    rest = _meet(pairs, ordered.join(wanted, "bucket"), k)
    found = seed.unionByName(rest)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
