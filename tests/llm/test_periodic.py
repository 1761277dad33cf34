"""Periodic runs against all lags of every text."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from clausework.llm import periodic

SCHEMA = "doc_id long, text string, h string, words string, runs string"


def brute(words, least=6):
    """All runs (start, length, period) by trying every lag at every place."""
    out = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length, part = j + q - i, words[i:j + q]
            if j > i and length >= max(least, 4 * q):
                if all(part[d:] != part[:length - d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def texts():
    rng = random.Random(6)
    for _ in range(300):
        words = rng.choices([str(i) for i in range(rng.choice([1, 2, 3, 30]))], k=rng.randrange(90))
        if words and rng.random() < 0.7:
            at = rng.randrange(len(words))
            period = words[at:at + 1 + (len(words) - at) // rng.randrange(3, 11)]
            if rng.random() < 0.5:
                period = (period[:max(1, len(period) // 5)] * 3 + period)[:len(period)]
            words = words[:at] + [period[i % len(period)] for i in range(len(words) - at)]
        yield rng.choice([" ", "\n", " \t\x0b"]).join(words)


ODD = [None, "", " \n", "a", "a " * 5, "a " * 6, " a b" * 4, "a b c " * 2, "x\xa0y " * 9, "é É " * 5, "same " * 30_000, "a a a a a b b b b b b"]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("least", [6, 9])
def test_runs_equal_brute_force(least):
    rows = [(t or "").split() for t in texts()]
    starts = np.cumsum([0, *map(len, rows)])
    codes = np.unique([w for r in rows for w in r], return_inverse=True)[1]
    got = [tuple(r) for r in periodic.runs_of(codes, starts, least).tolist()]
    assert got == [(int(s) + a, b, q) for s, r in zip(starts, rows, strict=False) for a, b, q in brute(r, least)]


def test_time_stays_near_linear_where_seeds_are_everywhere():
    for words in ([1] * 300_000, [1, 2, 3] * 100_000, list(range(50_000)) * 6):
        found = periodic.runs_of(np.array(words), np.array([0, len(words)]))
        assert found[:, 1].tolist() == [len(words)]


def test_documents_equal_brute_force(spark):
    rows = [(i if i % 11 else None, t) for i, t in enumerate([*ODD, *texts()])] + [(5, "a b " * 8)] * 3
    found = periodic.periodic_runs(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    for (doc, text), r in zip(rows, found, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert (r.doc_id, r.n_words, [tuple(x) for x in r.runs]) == (doc, len(words), runs)
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        assert r.collapsed == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_digest_equals_brute_force(spark):
    rows = [(i if i % 40 else None, t) for i, t in enumerate([*ODD, *texts()], 1000)]
    digest = periodic.run_digest(periodic.periodic_runs(periodic.planted(frame(spark, rows)))).collect()
    changed = 0
    for (doc, text), r in zip(rows, digest, strict=True):
        words = [w.decode() for w in (text or "").encode().split()]
        n, h = len(words), zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = brute(words) if n < 1000 else [(0, n, 1)]
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        want = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (r.doc_id, r.n_runs, (r.start, r.length, r.period, r.exponent_milli)) == (doc, len(runs), want)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()
    assert changed > 10


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert periodic.run_digest(periodic.periodic_runs(periodic.planted(none))).count() == 0
