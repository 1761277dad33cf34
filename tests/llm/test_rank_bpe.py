"""Rank-queue BPE against the public library, its queue against a sorted list."""

import hashlib
import random
import time
from array import array

import pytest
import tiktoken

from clausework.llm import rank_bpe

SCHEMA = "doc_id long, text string, ids string, bytes string"
ODD = [
    None, "", " ", "\n\n x", "a", "Hello, World.\nIt's 3 o'clock...", "tab\t and  two   blanks\n\n\nend ", "<|endoftext|> <|x|>",
    "a\x1cb \x85 c　d​e \x00", "日本語 テキスト 한국어", "emoji \U0001f600\U0001f600 !", "don't DON'T we'll 'tis.",
    "x" * 30_000, "ab" * 20_000, "日" * 9000, "!?" * 5000, "١٢٣ ½ Ⅷ", "word " * 70_000,
]


@pytest.fixture(scope="module")
def own():
    return rank_bpe.bpe(*rank_bpe.public_ranks())


@pytest.fixture(scope="module")
def library(own):
    path, pattern = rank_bpe.public_ranks()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank_bpe.read_ranks(path), special_tokens={}).encode_ordinary


def test_encoding_equals_the_library(own, library):
    rng = random.Random(2)
    alphabet = list(" \n\t\x1c\x85\xa0.,!'\"aAbBeEstTzß1205日本한\U0001f600é́") + ["  ", "the", "'s", "'ll"]
    for text in ODD + ["".join(rng.choices(alphabet, k=rng.randrange(80))) for _ in range(4000)]:
        ids = own.encode(text)
        assert list(array("I", ids)) == library(text or ""), repr(text)[:100]
        assert own.decode(ids) == (text or "").encode()


def test_every_code_point_is_cut_as_the_library_does(own, library):
    for point in range(0x110000):
        if not 0xD800 <= point < 0xE000 and (point < 0x3500 or point % 7 == 0):
            c = chr(point)
            text = f"a{c}b {c} {c}{c}1{c}"
            assert list(array("I", own.encode(text))) == library(text), hex(point)


def test_merges_follow_the_lowest_rank_even_below_the_last(tmp_path):
    """Merging ab makes abc, of a lower rank than what is still in ab's bucket."""
    import base64

    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"bx", b"ab", b"xab", b"aa"]
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    ranks = rank_bpe.read_ranks(str(path))
    own = rank_bpe.Bpe(str(path), r"\S+|\s+")
    want = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rng = random.Random(8)
    for _ in range(2000):
        text = "".join(rng.choices("abcx", k=rng.randrange(1, 30)))
        assert list(array("I", own.encode(text))) == want(text)


def test_long_pre_tokens_take_no_square_of_time(own):
    def seconds(n):
        began = time.process_time()
        own.merge(b"xyzzy" * (n // 5))
        return time.process_time() - began

    seconds(1000)
    assert not own.buckets and not any(own.words)
    assert seconds(400_000) < 40 * max(seconds(40_000), 0.02)


def test_cache_is_bounded(monkeypatch, library):
    monkeypatch.setattr(rank_bpe, "CACHE", 50)
    monkeypatch.setattr(rank_bpe, "SLICE", 16)
    monkeypatch.setattr(rank_bpe, "AT_ONCE", 100)
    own = rank_bpe.Bpe(*rank_bpe.public_ranks())
    rng = random.Random(4)
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcdefg", k=9)) for _ in range(40))
        assert list(array("I", own.encode(text))) == library(text)
        assert max(len(own.young), len(own.old)) <= 50 and own.decode(own.encode(text)) == text.encode()


def test_documents_round_trip(spark, library):
    rows = [(i if i % 5 else None, t) for i, t in enumerate(ODD * 2)]
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    got = rank_bpe.token_digest(rank_bpe.decode(rank_bpe.encode(docs))).collect()
    want = []
    for i, text in rows:
        ids = library(text or "")
        want.append((i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert [tuple(r) for r in got] == want


def test_unknown_ids_and_no_documents(spark, own):
    with pytest.raises(ValueError):
        own.decode(array("I", [60_000]).tobytes())
    assert rank_bpe.token_digest(rank_bpe.decode(rank_bpe.encode(spark.createDataFrame([], SCHEMA)))).count() == 0
