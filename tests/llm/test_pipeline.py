"""The pipeline, stage by stage, against brute force on the smallest tables."""

import os
from collections import Counter

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
from clausework.llm import mixing, packing, quality, tokens  # noqa: E402
from test_exact_and_mix import norm, words  # noqa: E402
from test_links_and_search import groups  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept.append((before, docs))
        assert name == "packing" or docs.columns == columns
    (raw, good), (_, exact), (_, near), (_, mixed), (_, packed) = kept

    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    scores = {r.doc_id: r.score for r in quality.score(raw, quality.fit(raw, labels)).collect()}
    good_rows = {r.doc_id: r.text for r in good.collect()}
    assert good_rows.keys() == {i for i, s in scores.items() if s >= 0.7} and 0 < len(good_rows) < len(scores)

    first = {}
    for i in sorted(good_rows):
        first.setdefault(norm(good_rows[i]), i)
    exact_rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(i for i, _ in exact_rows) == sorted(first.values())

    assert sorted(r.doc_id for r in near.collect()) == sorted({c for _, _, c in groups(exact_rows)})

    copies = {r.doc_id: r.copies for r in mixing.mix(near).collect()}
    mixed_rows = mixed.collect()
    assert Counter(r.doc_id for r in mixed_rows) == +Counter(copies)
    assert all(words(r.text) for r in mixed_rows)

    encode = tokens.encoder(tokens.public_path(tokens.WORD_BPE)).encode
    want = Counter()
    for r in mixed_rows:
        want[r.doc_id] += len(encode(r.text)) // 4 + 1
    have = Counter()
    for r in packed.collect():
        have[r.doc_id] += r.length
        assert r.offset + r.length <= packing.WINDOW
    assert have == want


def test_run_is_all_stages(spark):
    done = corpus_pipeline.run(spark, FOLDER)
    assert done.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert done.count() > 0


CLASHING = [f"__{n}" for n in "score source doc size copies again n i sha key".split()] + ["c0", "kept", "root"]
ODD = [(None, "no id here", "a"), (1, None, None), (2, "", "a"), (3, "same words", "b"), (3, "same words", "b"), (4, "same  words", "b"),
       (5, "long " * 30_000, None), (None, None, None)]


def test_stages_keep_columns_of_any_name_and_odd_rows(spark):
    schema = ", ".join(["doc_id long", "text string", "source string", *[f"`{n}` string" for n in CLASHING]])
    docs = spark.createDataFrame([(*r, *[f"{n}{i}" for n in CLASHING]) for i, r in enumerate(ODD)], schema)
    every = {tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        # No document has a label, so every score is one half.
        out = quality.good_documents(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int")), threshold=0.5) \
            if name == "quality" else stage(spark, docs, FOLDER)
        rows = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and rows and set(rows) <= every, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).count() >= len(ODD)


def test_stages_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, FOLDER).count() == 0
