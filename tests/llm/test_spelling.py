"""Spelling variants against all one-edit strings of every word."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from clausework.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string, key string"
LETTERS = spelling._LOWER + "".join(map(chr, range(0xC0, 0x100)))


def edits(word, letters=LETTERS):
    """All strings one edit away."""
    out = {word[:i] + word[i + 1:] for i in range(len(word))}
    out |= {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}
    out |= {word[:i] + c + word[i + 1:] for i in range(len(word)) for c in letters}
    return out - {word}


def brute(counts, ratio=spelling.RATIO):
    near = {w: [x for x in edits(w) if x in counts] for w in counts}
    form = {}
    for word, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[word] = best if best and counts[best] >= ratio * counts[word] else None
    out = set()
    for word in counts:
        root = word
        while form[root]:
            root = form[root]
        out.add((word, form[word], root, counts[word], len(near[word]), counts.get(form[word])))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], SCHEMA)


def result(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def counted(rows, slip):
    lowered = str.maketrans(spelling._UPPER, spelling._LOWER)
    out = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lowered)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if slip and h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += len(run) >= 6
    return {w: n for w, n in out.items() if n >= 5}


@pytest.mark.parametrize("slip", [0, 7])
def test_groups_equal_brute_force(spark, slip):
    rng = random.Random(4)
    base = ["".join(rng.choices("abcéÉÿ×Z", k=rng.randrange(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "ab" * 40]
    words = base + [rng.choice(sorted(edits(w, "abé"))) for w in base for _ in range(3)]
    rows = [(i if i % 9 else None, " ".join(rng.choices(words, k=rng.randrange(120)))) for i in range(60)]
    rows += [(1, None), (2, ""), (3, " \n1 2-3"), (4, "Hello_Hello Straße STRASSE " * 40)] + [(70, "repeat repeats " * 3)] * 5
    vocab = spelling.vocabulary(frame(spark, rows), slip=slip)
    want = counted(rows, slip)
    assert {(r.word, r.n) for r in vocab.collect()} == set(want.items())
    assert result(spelling.spelling_groups(vocab)) == brute(want)


def test_any_number_of_symbols_and_either_join(spark, monkeypatch):
    rng = random.Random(9)
    counts = {"".join(rng.choices("abcd", k=rng.randrange(6, 8))): rng.choice([5, 25, 125, 625]) for _ in range(300)}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    want = brute(counts)
    for symbols in (1, 3, 9):
        assert result(spelling.spelling_groups(vocab, symbols=symbols)) == want
    monkeypatch.setattr(spelling, "bounded", lambda df: df)
    monkeypatch.setattr(spelling, "HELD", 50)
    assert result(spelling.spelling_groups(vocab)) == want


def test_forms_lead_to_roots_and_ties_go_to_the_first(spark):
    counts = {"abcdef": 625, "abcdeg": 625, "abcdefg": 125, "abcdefgh": 25, "abcdefghi": 5, "zzzzzz": 9}
    got = {r[0]: r for r in result(spelling.spelling_groups(spark.createDataFrame(list(counts.items()), "word string, n long")))}
    assert got["abcdefghi"][:3] == ("abcdefghi", "abcdefgh", "abcdef")
    assert got["abcdefg"][1] == "abcdef" and got["abcdeg"][1] is None and got["zzzzzz"][1:3] == (None, "zzzzzz")


def test_neighbourhood_holds_every_edit_once():
    rows = np.random.default_rng(0).integers(1, 4, (30, 7)).astype(np.uint64)

    def key(symbols):
        out = 0
        for c in symbols:
            out = (out * int(spelling._BASE) + int(c)) % 2**64
        return out

    found = [[] for _ in rows]
    for number, hashes in spelling.neighbours(rows, 3):
        for i, h in zip(number.tolist(), hashes.tolist(), strict=True):
            found[i].append(h)
    for row, hashes in zip(rows.tolist(), found, strict=True):
        word = "".join(map(str, row))
        assert sorted(hashes) == sorted(key(w) for w in edits(word, "123") | {word})


def test_very_long_words(spark):
    word = "x" * 3000 + "y" * 3000
    rows = [(0, " ".join([word] * 25)), (1, " ".join([word[:-1]] * 5)), (2, " ".join(["z" + word[2:]] * 5))]
    got = {r[0]: r for r in result(spelling.spelling_groups(spelling.vocabulary(frame(spark, rows))))}
    assert got[word[:-1]][1] == word and got[word][4] == 1 and got["z" + word[2:]][4] == 0


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert spelling.spelling_groups(spelling.vocabulary(none, slip=199)).count() == 0
