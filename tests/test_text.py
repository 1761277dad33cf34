import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clausework.functions.text import WHITESPACE, chunk_documents, chunks, normalize_text, trimmed

NORMALIZED = [
    (None, ""),
    ("", ""),
    ("  USD  500 ", "$500"),
    ("500 usd", "500 $"),
    ("usd500", "usd500"),
    ("1.5m", "1500000"),
    ("1,500k", "1500000"),
    ("1.001k", "1000"),
    ("1.2.3k", "1.2300"),
    ("5km", "5km"),
    ("net 30 b", "net 30000000000"),
    ("5 million dollars", "5000000 $"),
    ("12 thousand million", "12000 million"),
    ("GBP 2.5 Billion", "£2500000000"),
    ("$1,000,000.00", "$1000000"),
    ("1.005", "1.005"),
    ("3.000", "3.000"),
    ("€   10,000", "€10000"),
    ("eur, 5", "€5"),
    ("New York, NY", "new yorkny"),
    ("0.5 pounds and 7k", "0.5 £and 7000"),
    ("£ 1.00, $ 2.00", "£1$2"),
    # Digits of other scripts, words next to letters of other scripts, numbers past 64 bits.
    ("٣k", "3000"),
    ("éusd 5", "éusd 5"),
    ("12345678901234567890 b", str(int(float("12345678901234567890") * 10**9))),
    ("a\x1c b 　c", "a b c"),
]

CHUNKS = [
    ("aaaa\n\nbbbb\n\ncccccccccccc\n\ndd", ["aaaa\n\nbbbb", "cccccccccc", "cc", "dd"]),
    ("aaaaa\n\nbbbb\n\nc", ["aaaaa", "bbbb\n\nc"]),
    ("a" * 20, ["a" * 10, "a" * 10]),
    ("", []),
    (" \n\n \t ", []),
    ("\n\n\na\n\n\nb", ["a\n\nb"]),
    ("\U0001f600" * 12, ["\U0001f600" * 10, "\U0001f600" * 2]),
    ("a\nb" + "\n" * 9 + "c", ["a\nb\n\nc"]),
]


def test_normalize(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(NORMALIZED)], "i int, a string")
    got = {r.i: r.n for r in normalize_text(df, "a", "n").collect()}
    assert [got[i] for i in range(len(NORMALIZED))] == [b for _, b in NORMALIZED]


def test_normalize_stays_in_the_jvm(spark, plan):
    source = spark.range(5).select(F.col("id").cast("string").alias("a"))
    assert "Python" not in plan(normalize_text(source, "a", "n"))


def test_whitespace_matches_python():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_trimmed(spark):
    samples = [w + "a b" + w for w in WHITESPACE] + ["", WHITESPACE]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert all(r.t == r.s.strip() for r in df.withColumn("t", trimmed(F.col("s"))).collect())


@pytest.mark.parametrize("text,expected", CHUNKS)
def test_chunks(spark, text, expected):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(chunks(F.col("text"), 10)).first()[0] == expected


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \né", max_size=60), min_size=1, max_size=40))
def test_chunk_properties(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = chunk_documents(df, max_chars=12).collect()
    assert all(0 < len(r.chunk) <= 12 for r in rows)
    for i, text in enumerate(texts):
        parts = [r.chunk for r in sorted(rows, key=lambda r: r.chunk_no) if r.id == i]
        kept = [p.strip() for p in text.split("\n\n") if p.strip()]
        assert "".join(parts).replace("\n\n", "") == "".join(kept).replace("\n\n", "")


def test_long_text_is_cut_whole(spark):
    text = "".join(chr(97 + i % 26) for i in range(1_000_003))
    df = spark.createDataFrame([(text,)], "text string")
    parts = df.select(chunks(F.col("text"))).first()[0]
    assert "".join(parts) == text and {len(p) for p in parts[:-1]} == {3000}
