import random

import pytest
from pyspark.sql import functions as F

from clausework.functions.text import chunk_documents
from clausework.operators.chunking import chunk_pieces
from clausework.operators.layout import assemble_documents


@pytest.mark.parametrize("seed", [1, 2])
def test_long_documents_chunk_like_cells(spark, seed):
    rng = random.Random(seed)
    rows = []
    for doc, count in (("long", 400), ("longer", 600), ("short", 20), ("blank", 3)):
        for n in range(count):
            word = rng.choice(["a", "bb", "ccc", "", " ", "\n"]) if doc != "blank" else " "
            text = (word * rng.choice([1, 1, 2, 5, 30])).replace("aa", "a\n\nb") + rng.choice(["", "\n", "\n\nz"])
            rows.append((doc, n // 3, n % 3, text if doc != "blank" else "\n"))
    rng.shuffle(rows)
    pieces = spark.createDataFrame(rows, "contract_id string, page int, pos int, piece string").cache()
    want = chunk_documents(assemble_documents(pieces), max_chars=12)
    got = chunk_pieces(pieces, 12, chars_per_task=900, rows_per_task=90)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert want.filter(F.length("chunk") == 12).count() > 0


def test_chunking_takes_time_in_proportion(spark):
    """Sixteen times the paragraphs must not take much more than sixteen times as long."""
    import time

    def seconds(n):
        df = spark.range(1).select(F.array_join(F.array_repeat(F.lit("some words of text"), n), "\n\n").alias("text"))
        start = time.perf_counter()
        assert chunk_documents(df, max_chars=30).count() == n
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(160_000) < 40 * max(0.5, seconds(10_000))
