"""Registered queries of the corpus operators: each over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import (
    exact_dedup, mixing, packing, periodic, quality, rank_bpe, secrets, simhash, spelling, token_files, topk, toxicity, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies"
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.find_secrets(_table(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(_table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(_table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(spelling.vocabulary(_table(spark, sf_dir, "documents"), slip=spelling.SLIP))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.periodic_runs(periodic.planted(_table(spark, sf_dir, "documents"))))


def op13_rank_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_bpe.token_digest(rank_bpe.decode(rank_bpe.encode(_table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_secrets": op2_secrets,
    "op3_packing": op3_packing,
    "op4_quality": op4_quality,
    "op5_token_files": op5_token_files,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_topk": op8_topk,
    "op9_toxicity": op9_toxicity,
    "op10_url_filter": op10_url_filter,
    "op11_spelling": op11_spelling,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_rank_bpe": op13_rank_bpe,
}

# Letters in either case, spelled out: the flag for it would fold letters beyond ASCII.
_KEYS = "|".join(
    "".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in word)
    for word in ("password", "passwd", "secret", "token", "api_key")
)
_ASSIGN_SQL = rf"""({_KEYS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS_SQL = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
    k(kind, name, p) AS (VALUES (0, 'assign', '{_ASSIGN_SQL}'), (1, 'access', 'AKIA[A-Z0-9]{{14,}}'),
        (2, 'hex', '[0-9a-f]{{16,}}'), (3, 'owned', '[A-Za-z0-9+/_-]{{20,}}')),
    h AS (SELECT r, doc_id, source, kind, name, string_split_regex(text, p) AS gaps, regexp_extract_all(text, p) AS hits FROM d, k),
    o AS (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM h),
    s AS (SELECT r, doc_id, source, kind, name, hits[i] AS hit,
        CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
            + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a FROM o),
    v AS (SELECT *, a + length(hit) AS z, CASE kind WHEN 0 THEN regexp_extract(hit, '{_ASSIGN_SQL}', 2) ELSE hit END AS value FROM s),
    f AS (SELECT * FROM v WHERE kind IN (1, 2) OR kind = 0 AND length(value) >= 12
        OR kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')),
    c AS (SELECT * FROM f WHERE kind < 3 OR NOT EXISTS (
        SELECT 1 FROM f b WHERE b.r = f.r AND b.kind < 3 AND b.a < f.z AND f.a < b.z)),
    w AS (SELECT value, count(DISTINCT source) + max(CAST(source IS NULL AS INT)) AS owners,
        count(DISTINCT (source, doc_id)) AS repositories FROM c GROUP BY 1),
    j AS (SELECT c.*, owners = 1 AND repositories < 10 AS live, owners >= 3 OR repositories >= 10 AS example, name || ':' || a || ':' || z AS span FROM c JOIN w USING (value)),
    g AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
        string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3) AS base,
        string_agg(span, ',' ORDER BY a, kind) FILTER (kind < 3 OR live) AS spans,
        count(DISTINCT value) FILTER (live) AS n_live, count(DISTINCT value) FILTER (example) AS n_examples FROM j GROUP BY 1)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
        sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live,
        coalesce(n_examples, 0) AS n_examples
    FROM d LEFT JOIN g USING (r)"""

# CRC-32 from its polynomial: its table t, and the hash of a text in UTF-8, given in hex.
_CRC_TABLE_SQL = """t AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8),
        lambda c, k: xor(c // 2, (c % 2) * 3988292384), CAST(i AS BIGINT))) AS crc)"""
_CRC_SQL = """xor(4294967295, list_reduce(list_transform(range(1, length(x) + 1, 2),
        lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)), lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1]), 4294967295))"""
# Near words by deleting or masking one letter.
_SPELLING_SQL = rf"""
    WITH RECURSIVE {_CRC_TABLE_SQL},
    r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
    d AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x
        FROM r WHERE length(run) >= 6 GROUP BY ALL),
    h AS (SELECT run, n, {_CRC_SQL} AS h FROM d, t),
    w AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, h % length(run) + 2)
        ELSE run END AS word, n FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
    i AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v),
    e AS (SELECT word, n, left(word, i - 1) || substr(word, i + 1) AS less, left(word, i - 1) || '*' || substr(word, i + 1) AS mask FROM i),
    u AS (SELECT DISTINCT e.word AS long, v.word AS short FROM e JOIN v ON e.less = v.word),
    p AS (SELECT long AS word, short AS near FROM u UNION ALL SELECT short, long FROM u
        UNION ALL SELECT a.word, b.word FROM e a JOIN e b USING (mask) WHERE a.word <> b.word),
    b AS (SELECT word, v.n, count(*) AS n_near, arg_min({{'w': near, 'n': o.n}}, {{'less': -o.n, 'w': near}}) AS best
        FROM p JOIN v USING (word) JOIN (SELECT word AS near, n FROM v) o USING (near) GROUP BY ALL),
    f AS (SELECT word, best.w AS form, best.n AS form_n FROM b WHERE best.n >= 5 * n),
    c AS (SELECT word, form AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON c.root = f.word),
    z AS (SELECT word, root FROM c WHERE root NOT IN (SELECT word FROM f))
    SELECT word, form, coalesce(root, word) AS root, v.n, coalesce(n_near, 0) AS n_near, form_n
    FROM v LEFT JOIN b USING (word) LEFT JOIN f USING (word) LEFT JOIN z USING (word)"""

# A run repeats five words or more at its period: islands of equal five-grams, that no shorter period covers.
_PERIODIC_SQL = rf"""
    WITH {_CRC_TABLE_SQL},
    d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(CAST(doc_id AS VARCHAR))) AS x,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    h AS (SELECT r, doc_id, ws, len(ws) AS n, {_CRC_SQL} AS h FROM d, t),
    g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
    w AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[CASE WHEN i < a THEN i
        ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1]) END AS ws FROM g),
    k AS (SELECT r, i, array_to_string(ws[i + 1:i + 5], ' ') AS gram FROM (SELECT r, ws, unnest(range(n - 4)) AS i FROM w)),
    m AS (SELECT a.r, b.i - a.i AS q, a.i, a.i - row_number() OVER (PARTITION BY a.r, b.i - a.i ORDER BY a.i) AS island
        FROM k a JOIN k b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i),
    c AS (SELECT r, q, min(i) AS s, count(*) + 4 + q AS l FROM m GROUP BY r, q, island),
    u AS (SELECT * FROM c WHERE l >= 6 AND l >= 4 * q),
    v AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM u o WHERE o.r = u.r AND o.q < u.q AND o.s <= u.s AND o.s + o.l >= u.s + u.l)),
    e AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS line,
        arg_min({{'s': s, 'l': l, 'q': q}}, {{'less': -l / q, 's': s, 'q': q}}) AS best FROM v GROUP BY r),
    z AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM v),
    y AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept
        FROM (SELECT r, unnest(range(n)) AS i, unnest(ws) AS word FROM w) ANTI JOIN z USING (r, i) GROUP BY r)
    SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.q AS period,
        1000 * best.l // best.q AS exponent_milli, sha256(coalesce(line, '')) AS runs_sha256,
        sha256(coalesce(kept, '')) AS collapsed_sha256, n AS n_words
    FROM w LEFT JOIN e USING (r) LEFT JOIN y USING (r)"""

ORACLES: dict[str, str] = {
    "op11_spelling": _SPELLING_SQL,
    "op12_periodic_runs": _PERIODIC_SQL,
    "op2_secrets": _SECRETS_SQL,
    "op6_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256)""",
    "op8_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20""",
}
