"""SimHash groups and exact top-k against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausework.llm import simhash, topk

SCHEMA = "doc_id long, text string, fp string, key string, root string"


def slow_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(rows):
    """component_id per row by trying all pairs."""
    fps = [slow_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                up[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids, default=None)))
    return out


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(2, 6)))
    rows = [(1, None), (2, ""), (3, " \n "), (4, "Only three words"), (5, "only THREE\twords"), (None, "only three words"), (None, "alone")]
    rows += [(6, "nbsp\xa0stays one"), (7, "long " * 20_000), (8, "LONG " * 20_000)]
    for g in range(12):
        base = [word() for _ in range(300)]
        for _ in range(rng.randrange(1, 9)):
            new = list(base)
            for _ in range(rng.randrange(0, 4)):
                new[rng.randrange(300)] = word()
            rows.append((100 + len(rows) * 37 % 500, " ".join(new)))
            base = new if g % 2 else base  # chains as well as stars
    rows += [(900, rows[-1][1])] * 3
    return rows


def test_near_duplicates(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "c", "c", "c") for r in rows], SCHEMA)
    got = simhash.near_duplicates(docs)
    assert Counter(map(tuple, got.collect())) == Counter(groups(rows))
    left = simhash.one_per_component(docs)
    assert left.columns == docs.columns
    names = {c for _, _, c in groups(rows) if c is not None}
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(names)
    assert left.filter("doc_id is null").count() == 1  # "alone"


@pytest.mark.parametrize("limit", [8, 4096])
def test_every_link_of_a_dense_cloud_is_found(spark, limit):
    rng = random.Random(9)
    fps, centre = set(), rng.getrandbits(64)
    for _ in range(400):
        x = centre
        for _ in range(rng.randrange(0, 12)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(200)}
    fps = sorted(fps)
    frame = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    cells = simhash.split_cells(simhash.grid(frame, len(fps)), limit)
    if limit == 8:
        assert cells.groupBy("cell").count().agg(F.max("count")).first()[0] < 8 * 4
    roots = {r.node: r.root for r in simhash.components(simhash.links(cells)).collect()}
    near = lambda a, b: (a ^ b).bit_count() <= 4
    seen, want = set(), {}
    for x in fps:
        if x in seen:
            continue
        todo, part = [x], {x}
        while todo:
            y = todo.pop()
            new = {z for z in fps if z not in part and near(y, z)}
            part |= new
            todo += new
        seen |= part
        for y in part if len(part) > 1 else ():
            want[simhash._signed(y)] = frozenset(map(simhash._signed, part))
    assert roots.keys() == want.keys()
    by_root = {}
    for node, root in roots.items():
        by_root.setdefault(root, set()).add(node)
    assert {frozenset(v) for v in by_root.values()} == set(want.values())


@pytest.mark.parametrize("distance", [1, 2, 4, 6])
def test_any_two_close_embeddings_share_a_cell(distance):
    rng = random.Random(distance)
    for blocks in (distance + 2, distance + 3, distance + 4):
        masks = simhash.block_masks(blocks, distance)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for _ in range(rng.randrange(distance + 1)):
                b ^= 1 << rng.randrange(64)
            even = simhash._EVEN_BITS
            pack = lambda x: (x ^ x >> 1) & even | (x & x >> 1 & even) << 1
            assert any(pack(a) & m == pack(b) & m for m in masks)


def test_manhattan_bound_never_exceeds_hamming():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    assert simhash._near(a, b, 4).all()


def brute_top(rows, is_query, k, scale=64):
    ints = []
    for vec_id, v in rows:
        if v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        ints.append((vec_id, [int(np.floor(scale * float(x))) for x in v]))
    out = []
    for n, (q_id, q) in enumerate(ints):
        if not is_query(q_id):
            continue
        scores = [(-sum(a * b for a, b in zip(q, c)), i is None, i or 0) for m, (i, c) in enumerate(ints) if m != n]
        for rank, (s, none, i) in enumerate(sorted(scores)[:k], 1):
            out.append((q_id, rank, None if none else i, -s))
    return Counter(out)


@pytest.mark.parametrize("bucket,block", [(4096, 1024), (7, 3), (64, 16)])
def test_top_products(spark, bucket, block):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.standard_normal(6) * 2.0 ** (i % 5)).astype(np.float32).tolist()) for i in range(240)]
    rows += [(300 + i, rows[3][1]) for i in range(60)]  # one common vector
    rows += [(400, None), (401, [1.0, None, 2.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (405, [1.0, 2.0]),
             (None, [3.0] * 6), (None, [3.0] * 6), (420, [1e7] * 6), (440, [0.0] * 6), (20, rows[5][1]), (20, rows[5][1])]
    frame = spark.createDataFrame([(i, v, 1, 0.0) for i, v in rows], "vec_id long, embedding array<float>, norm int, row double")
    got = topk.top_products(frame, F.pmod("vec_id", F.lit(20)) == 0, k=10, bucket=bucket, block=block)
    assert Counter(map(tuple, got.collect())) == brute_top(rows, lambda i: i is not None and i % 20 == 0, 10)


def test_few_and_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    is_query = F.pmod("vec_id", F.lit(20)) == 0
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [3.0])], schema)
    assert Counter(map(tuple, topk.top_products(few, is_query).collect())) == Counter([(0, 1, 2, 64 * 192), (0, 2, 1, 64 * 128)])
    assert topk.top_products(spark.createDataFrame([], schema), is_query).count() == 0
    assert topk.top_products(spark.createDataFrame([(1, [1.0])], schema), is_query).count() == 0


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).count() == 0
    assert simhash.one_per_component(none).count() == 0


def test_pruning_saves_products_and_no_pairs(spark, monkeypatch):
    """Lengths fall off, and queries lie near axes: most buckets and most vectors are never multiplied."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    axes = np.eye(6)[rng.integers(6, size=1500)] * np.geomspace(4000, 400, 1500)[:, None] + rng.normal(size=(1500, 6)) * 5
    vectors = axes.astype(np.int64)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    table = pa.table({
        "row": np.arange(1500), "vec_id": np.arange(1500), "vector": pa.array(vectors.tolist(), pa.list_(pa.int64())), "norm": norms,
    })
    scores = vectors @ vectors.T
    floor = np.sort(np.where(np.eye(1500, dtype=bool), -(1 << 60), scores), axis=1)[:, -5].astype(float)
    queries = table.append_column("floor", pa.array(floor)).slice(0, 300)
    done = []
    inner = topk._products
    monkeypatch.setattr(topk, "_products", lambda q, p: done.append(len(q) * len(p)) or inner(q, p))
    found = topk._best(queries, table, 5)
    assert sum(done) < 0.6 * 300 * 1500
    got = {}
    for q, v, x in zip(found["query_row"].to_pylist(), found["row"].to_pylist(), found["score"].to_pylist(), strict=True):
        got.setdefault(q, []).append((-x, v))
    for q in range(300):
        want = sorted((-int(scores[q, v]), v) for v in range(1500) if v != q)[:5]
        assert sorted(got[q]) == want, q
    # A bucket none of whose vectors is long enough is not met at all.
    assert (topk._thresholds(norms[:300], floor[:300], 10.0) > 1).all()
