"""Encoding, packing and token files: exact round trips."""

import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from clausework.llm import packing, token_files, tokens

SCHEMA = "doc_id long, text string, length string, start string, source string"
ODD = [
    None, "", " ", "\n", "a", "Hello, World.\nIt's 3 o'clock...", "x" * 30_000, "tab\t and  two   blanks\n\n\nend ", " lead",
    "İstanbul ΣΑΣ éé ﬁ", "<|endoftext|> <|startoftext|>", "a\x1cb \x85 c　d  e", "日本語 テキスト 한국어", "emoji \U0001f600\U0001f600 !",
    "! \x1c! .\n ,\n\t\n x", "don't DON'T we'll 'tis. can't.", "word " * 9000, "A.b,c. D, E. ÉA, ß.",
    "a <|endoftext|> b", "a  <|endoftext|>\n\n<|ENDOFTEXT|>.x<|startoftext|>, <|Endoftext|>", "a \0b", "\0", "\0\0 \0a\n\0 b", "a\0 b", " <|endoftext|>",
]


def plain(name):
    tokenizer = Tokenizer.from_file(tokens.public_path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_encoding_by_pieces_equals_encoding_whole(name):
    want, encode = plain(name), tokens.encoder(tokens.public_path(name)).encode
    rng = random.Random(3)
    alphabet = list(" \n\t.,!'\"-aAbBeEsStTéß1205日\x1c ́\U0001f600") + ["  ", "the", "'s", "'ll", " \n", ", ", ". "]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(60))) for _ in range(3000)]
    every = tokens.encoder(tokens.public_path(name)).encode_all(pa.array(texts))
    for text, together in zip(texts, every, strict=True):
        assert list(array("I", encode(text))) == want(text), repr(text)
        assert together == encode(text), repr(text)
    some = pa.array(texts).slice(3, 50)
    assert list(tokens.encoder(tokens.public_path(name)).encode_all(some)) == [encode(t) for t in texts[3:53]]


@pytest.mark.parametrize("name", [tokens.WORD_BPE, tokens.BYTE_BPE])
def test_cache_generations_change_nothing(monkeypatch, name):
    monkeypatch.setattr(tokens, "TEXTS", 7)
    path = tokens.public_path(name)
    own = tokens.Encoder(path, tokens.word_pieces, folds=True) if name == tokens.WORD_BPE else tokens.Encoder(path, tokens.byte_pieces, tokens._byte_text)
    own.limit = 40
    rng, want = random.Random(6), plain(name)
    texts = [" ".join("".join(rng.choices("aBc.,", k=rng.randrange(1, 4))) for _ in range(20)) for _ in range(300)]
    for text, ids in zip(texts, own.encode_all(pa.array(texts)), strict=True):
        assert list(array("I", ids)) == want(text)
    assert max(len(own.young), len(own.old)) <= 40 + 7 * 20 * 2


def frame(spark, texts):
    rows = [(i if i % 7 else None, t, "clash", "clash", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def ids_crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


@pytest.mark.parametrize("window", [4096, 64])
def test_packing_places_every_id_once(spark, window):
    rng = random.Random(5)
    texts = ODD + ["w " * rng.randrange(400) for _ in range(400)] + ["same"] * 50
    docs = frame(spark, texts)
    rows = packing.pack(docs, window=window, keep_ids=True, docs_per_task=120).collect()
    encode = plain(tokens.WORD_BPE)
    want = Counter()
    for r in docs.collect():
        ids = encode(r.text) + [packing.END_ID]
        for at in range(0, len(ids), window):
            want[r.doc_id, at, tuple(ids[at:at + window]), len(ids)] += 1
    assert Counter((r.doc_id, r.start, tuple(r.ids), r.doc_tokens) for r in rows) == want
    windows = defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) and r.ids_crc32 == ids_crc(r.ids)
        windows[r.sequence_id].append((r.offset, r.length))
    total = 0
    for placed in windows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= window
        total += at
    # Four tasks leave a few windows part empty each.
    assert len(windows) * window - total <= 4 * 3 * window


def test_best_fit_takes_the_tightest_window():
    rng = random.Random(1)
    windows = packing.OpenWindows(100)
    left = {}
    for length in sorted((rng.randrange(1, 101) for _ in range(2000)), reverse=True):
        number, offset = windows.take(length)
        fits = [c for c in left.values() if c >= length]
        had = left.get(number, 100)
        assert had == (min(fits) if fits else 100) and offset == 100 - had
        left[number] = had - length


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert packing.pack(none).count() == 0
    assert token_files.token_files(none).count() == 0


def test_shard_answers_from_its_file():
    rng = np.random.default_rng(2)
    for ids in (rng.integers(0, 50_257, 150_000), np.zeros(10, int), np.array([5]), rng.integers(0, 3, 200_000), np.array([], int)):
        ids = ids.astype(np.uint32)
        shard = token_files.Shard(token_files.build(ids, [len(ids)]))
        assert (shard.all() == ids).all() and shard.lengths.tolist() == [len(ids)]
        for i in rng.integers(0, max(1, len(ids)), 40 if len(ids) else 0):
            value = int(ids[i])
            assert shard.access(int(i)) == value
            assert shard.rank(value, int(i)) == (ids[:i] == value).sum()
            places = np.flatnonzero(ids == value)
            assert shard.count(value) == len(places)
            j = int(rng.integers(0, len(places)))
            assert shard.find(value, j) == places[j]
        assert shard.count(60_000) == 0
        with pytest.raises(IndexError):
            shard.find(60_000, 0)


@pytest.mark.parametrize("shard_tokens", [token_files.SHARD_TOKENS, 500])
def test_token_files_round_trip(spark, tmp_path, shard_tokens):
    texts = ODD * 3 + ["same"] * 30
    docs = frame(spark, texts)
    out = str(tmp_path / "shards")
    token_files.write_shards(docs, out, shard_tokens=shard_tokens)
    rows = token_files.read_shards(spark, out).collect()
    encode = plain(tokens.BYTE_BPE)
    want = Counter()
    for r in docs.collect():
        ids = encode(r.text) + [token_files.END_ID]
        want[r.doc_id, len(ids), ids_crc(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    rows.sort(key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
    assert order == sorted(order)
