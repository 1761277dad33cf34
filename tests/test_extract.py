import json

import pytest
from pyspark.sql import functions as F

from clausework.plans import enrich, extract
from clausework.schemas import CHUNK_CHARS, DOCUMENTS, PARAMETERS
from clausework.sources import tables
from clausework.streaming import jobs

VERSION = "contract_id string, version_number int, is_current boolean"


@pytest.fixture
def versions(spark):
    return spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True), ("c", 1, False)], VERSION)


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(
        [
            ("a", "Effective Date: May 1\n\nGoverning Law: Utah\nGoverning Law: State of Utah"),
            ("b", "nothing here"), ("c", "Governing Law: x"), ("d", "Governing Law: y"),
        ],
        DOCUMENTS,
    )


def test_rules(documents, versions):
    rows = extract.with_ids(extract.extract(documents, versions), start=5).orderBy("parameter_id").collect()
    assert [(r.parameter_id, r.contract_id, r.version_number, r.parameter_key, r.original_extract) for r in rows] == [
        (5, "a", 2, "Governing Law", "State of Utah"), (6, "a", 2, "Effective Date", "May 1"),
    ]
    assert all(r.combined_score == 1.0 and r.user_override is None and len(r.vector_embed) == 384 for r in rows)
    assert {r.contract_id for r in extract.without_version(documents, versions).collect()} == {"c", "d"}


def test_model_providers(spark, documents, versions):
    """A model is asked once per chunk and may answer anything; the embedder sees stored values."""
    calls = spark.sparkContext.accumulator(0)

    def load_model():
        def answer(prompts):
            calls.add(len(prompts))
            return [
                json.dumps({"parameters": [{"key": "size", "value": len(p.split("\n\n", 1)[1])}]}) if "Utah" in p else "sorry"
                for p in prompts
            ]
        return answer

    def load_embedder():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    rows = extract.extract(
        documents, versions,
        ask=lambda chunks: enrich.replies_from_model(chunks, load_model, ["size"]),
        embedder=lambda df: df.withColumn("vector_embed", enrich.embed_with(F.col("original_extract"), load_embedder)),
    ).collect()
    size = len("Effective Date: May 1\n\nGoverning Law: Utah\nGoverning Law: State of Utah")
    assert [(r.parameter_key, r.original_extract, list(r.vector_embed)) for r in rows] == [("size", str(size), [2.0, 1.0])]
    assert calls.value == 2


def test_keys_of_each_request(spark, documents, versions):
    asked = documents.withColumn(
        "requested_keys", F.when(F.col("contract_id") == "a", F.array(F.lit("x"), F.lit("y"))).otherwise(F.array().cast("array<string>"))
    )
    rows = extract.document_chunks(asked, versions).select(
        "contract_id", enrich.prompts(F.col("chunk"), F.col("requested_keys")).alias("p")
    ).collect()
    prompts = {r.contract_id: r.p for r in rows}
    assert "parameters: x, y." in prompts["a"] and "Extract only" not in prompts["b"]
    assert prompts["b"].endswith("\n\nnothing here")


def test_keys_across_chunks(spark, versions):
    """Nameless items of different chunks share generated names, and the longer one stays."""
    replies = spark.createDataFrame(
        [("b", 1, 0, '[{"value": "short"}]'), ("b", 1, 1, '[{"value": "much longer"}]')],
        "contract_id string, version_number int, chunk_no int, response string",
    )
    rows = extract.parameters_from_replies(replies).collect()
    assert [(r.parameter_key, r.original_extract, r.item_no) for r in rows] == [("param_1", "much longer", 0)]


def test_append_doubles_and_replace_does_not(spark, documents, versions, tmp_path):
    rows = extract.extract(documents, versions)
    none = spark.createDataFrame([], PARAMETERS)
    once = extract.append_rows(none, rows)
    path = str(tmp_path / "parameters")
    tables.write_snapshot(once, path)
    stored = tables.read_table(spark, path, "contract_parameters_extracted")
    twice = extract.append_rows(stored, rows)
    assert sorted(r.parameter_id for r in twice.collect()) == [1, 2, 3, 4]
    assert extract.replace_rows(stored, rows).count() == 2
    with pytest.raises(Exception):
        tables.write_snapshot(once, path)


def test_a_run_lands_once(spark, documents, versions, tmp_path):
    path = str(tmp_path / "runs")
    rows = extract.extract(documents, versions)
    for run in ("r1", "r2", "r1"):
        tables.append_run(rows, path, run)
    got = spark.read.parquet(path).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"r1": 2, "r2": 2}


def test_hashing_embedder(spark):
    df = spark.createDataFrame([(0, "Pay, pay now"), (1, ""), (2, None), (3, "NOW pay pay")], "i int, t string")
    got = {r.i: r.v for r in enrich.embed_hashing(df, "t", "v", 64).collect()}
    assert got[2] is None and sum(x * x for x in got[1]) == 0
    assert len(got[0]) == 64 and got[0] == got[3]
    assert sum(x * x for x in got[0]) == pytest.approx(1.0, abs=1e-6)


def test_text_folder(spark, tmp_path):
    (tmp_path / "DOC 1.txt").write_text("line\n\nline")
    (tmp_path / "DOC-2.txt").write_text("x")
    (tmp_path / "A+B.txt").write_text("plus")
    got = {r.contract_id: r.text for r in tables.read_documents(spark, str(tmp_path), "text").collect()}
    assert got == {"DOC 1": "line\n\nline", "DOC-2": "x", "A+B": "plus"}


def test_streamed_extraction_over_arriving_files(spark, documents, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    versioned = documents.withColumn("version_number", F.lit(1)).select("contract_id", "version_number", "text")
    for wanted in ("contract_id = 'a'", "contract_id <> 'a'"):
        versioned.filter(wanted).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(versioned.schema).parquet(source)
        jobs.extraction_stream(stream, out, state).awaitTermination()
    rows = spark.read.parquet(out).select("contract_id", "parameter_key").collect()
    assert sorted(map(tuple, rows)) == [("a", "Effective Date"), ("a", "Governing Law"), ("c", "Governing Law"), ("d", "Governing Law")]


def test_streamed_workflow_keeps_state_between_files(spark, tmp_path):
    from test_workflow import random_log, LOG

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows, expected = random_log(11, 120, 3, 0.2, True)
    rows = [(*r[:5], None) for r in sorted(rows)]
    from clausework.operators.workflow import command_step

    step, tag = command_step()
    now, expected = {}, {}
    for seq, _, contract, command, match, _ in rows:
        now[contract], status = step(now.get(contract), contract, command, match)
        expected[seq] = (status, *(now[contract] or (0, None, None)), now[contract] and tag(contract, now[contract]))
    for part in (rows[:50], rows[50:51], rows[51:]):
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(source)
        stream = jobs.workflow_stream(spark.readStream.schema(LOG).parquet(source))
        jobs.write_stream(stream, out, state).awaitTermination()
    got = {r.seq: (r.status, r.version_number, r.workflow_state, r.revision, r.etag) for r in spark.read.parquet(out).collect()}
    assert got == expected


def test_default_chunk_size():
    assert CHUNK_CHARS == 3000


def test_a_model_embeds_every_row_once(spark, documents):
    calls = spark.sparkContext.accumulator(0)

    def load():
        def model(texts):
            calls.add(len(texts))
            return [[1.0, 0.0] for _ in texts]

        return model

    versions = documents.select("contract_id").distinct().selectExpr("contract_id", "1 version_number", "true is_current")
    rows = extract.with_ids(extract.extract(documents, versions, embedder=lambda df: df.withColumn(
        "vector_embed", enrich.embed_with(F.col("original_extract"), load))))
    n = rows.count()
    assert n > 0 and calls.value == n


def test_jobs_before_the_first_action(spark):
    """Building a replay asks for hot keys once per source table."""
    from clausework.operators import workflow

    log = spark.createDataFrame([(i, i, f"c{i % 9}", "create", None) for i in range(50)], "seq long, ts long, contract_id string, command string, if_match string")
    status = spark.sparkContext.statusTracker()
    for run in (lambda: workflow.replay(log, with_etag=True), lambda: workflow.replay_with_etags(log)):
        spark.sparkContext.setJobGroup("plan", "plan")
        before = len(status.getJobIdsForGroup("plan"))
        run()
        assert len(status.getJobIdsForGroup("plan")) - before <= 4
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_keys_of_each_document(spark):
    from clausework.operators.reconcile import key_coverage

    chunks = spark.createDataFrame(
        [("a", "x.y: 1\nz: 2", ["x.y"]), ("b", "x.y: 1\nz: 2\nz : 3", ["z", "x.y", "none"]), ("c", "z: 1", [])],
        "contract_id string, chunk string, keys array<string>",
    )
    got = {
        r.contract_id: [(p["key"], p["value"]) for p in json.loads(r.response)["parameters"]]
        for r in enrich.replies_from_rules(chunks, F.col("keys")).collect()
    }
    assert got == {"a": [("x.y", "1")], "b": [("z", "2"), ("z", "3"), ("x.y", "1")], "c": []}
    have = spark.createDataFrame([("a", "x.y"), ("b", "z"), ("b", "z")], "contract_id string, parameter_key string")
    covered = key_coverage(chunks, have, ["contract_id"], F.col("keys")).collect()
    assert {(r.contract_id, r.parameter_key, r.missing) for r in covered} == {
        ("a", "x.y", False), ("b", "z", False), ("b", "x.y", True), ("b", "none", True),
    }


def test_keys_are_taken_literally(spark):
    keys = ["a.b", "end \\E mark", "\\Qq\\E\\E", "(x|y)"]
    text = "\n".join(f"{k}: value of {i}" for i, k in enumerate(keys)) + "\naxb: no\nx: no"
    df = spark.createDataFrame([(1, text, keys)], "id int, chunk string, keys array<string>")
    for some in (F.col("keys"), keys):
        row = enrich.replies_from_rules(df, some).first()
        assert [(x["key"], x["value"]) for x in json.loads(row.response)["parameters"]] == [(k, f"value of {i}") for i, k in enumerate(keys)]
