"""Streams that go on from stored tables: the workflow with a hot contract, and replies in any order."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from clausework.operators import scan
from clausework.operators.workflow import command_step, end_states, replay, replay_with_etags
from clausework.plans.catalog import QUERIES
from clausework.plans.extract import parameters_from_replies
from clausework.streaming import jobs
from test_workflow import LOG, outcome, random_log

REPLIES = "contract_id string, version_number int, chunk_no int, response string"


def arrive(spark, folder, part, schema):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).parquet(folder)


@pytest.mark.parametrize("tags,rows_per_task", [(False, 2_000_000), (False, 25), (True, 2_000_000), (True, 25)])
def test_a_replay_goes_on_from_stored_states(spark, tags, rows_per_task):
    rows, expected = random_log(21, 300, 3, 0.03, tags)
    rows.sort()
    run = replay_with_etags if tags else lambda *a, **b: replay(*a, with_etag=True, **b)
    states, got = None, {}
    for part in (rows[:90], rows[90:100], rows[100:]):
        done = run(spark.createDataFrame(part, LOG), initial_state="opened", rows_per_task=rows_per_task, states=states).cache()
        assert set(LOG.replace(",", "").split()[::2]) <= set(done.columns) and done.count() == len(part)
        got |= outcome(done.withColumn("revision", F.when(F.col("version_number") > 0, F.col("revision"))))
        ends = end_states(done.filter("version_number > 0"), columns=("version_number", "workflow_state", "revision"))
        if states is not None:
            ends = ends.unionByName(states.join(ends, "contract_id", "left_anti"))
        states = spark.createDataFrame(ends.collect(), ends.schema)
    assert got == expected


@pytest.mark.parametrize("tags", [False, True])
def test_no_task_sees_a_hot_contract_whole(spark, tmp_path, monkeypatch, tags):
    """Windows only ever sort slices of the contract that nearly all commands are of."""
    limit, seen = 60, []
    inner = scan._scan

    def watched(df, keys, order, carries):
        seen.append(df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0)
        return inner(df, keys, order, carries)

    monkeypatch.setattr(scan, "_scan", watched)
    rows, _ = random_log(5, 500, 2, 0.01, tags)
    rows = [(*r[:2], "hot" if i % 10 else r[2], *r[3:5], None) for i, r in enumerate(sorted(rows))]
    step, tag = command_step()
    now, expected = {}, {}
    for seq, _, contract, command, match, _ in rows:
        now[contract], status = step(now.get(contract), contract, command, match)
        expected[seq] = (status, *(now[contract] or (0, None, None)), now[contract] and tag(contract, now[contract]))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:250], rows[250:]):
        stream = arrive(spark, source, part, LOG)
        jobs.workflow_into(
            stream, out, state, if_match="if_match" if tags else None, buckets=4, rows_per_task=limit
        ).awaitTermination()
    got = spark.read.parquet(f"{out}/outcomes")
    assert outcome(got.withColumn("revision", F.when(F.col("version_number") > 0, F.col("revision")))) == expected
    assert seen and max(seen) <= 2 * limit < 225


def last_batch_again(checkpoint):
    """As if the stream had stopped after its last batch was written, before that was noted down."""
    commits = os.path.join(checkpoint, "commits")
    last = max(int(n) for n in os.listdir(commits) if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(os.path.join(commits, name))


def test_a_repeated_batch_gives_the_same_tables(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows, _ = random_log(8, 90, 4, 0.2, True)
    rows = [(*r[:5], None) for r in sorted(rows)]
    for part in (rows[:40], rows[40:]):
        query = jobs.workflow_into(arrive(spark, source, part, LOG), out, state, buckets=4)
        query.awaitTermination()
    table = jobs.workflow_states(spark, out, query.id, buckets=4)
    before = outcome(spark.read.parquet(f"{out}/outcomes")), sorted(map(tuple, table.read().collect())), table.version()
    last_batch_again(state)
    query = jobs.workflow_into(spark.readStream.schema(LOG).parquet(source), out, state, buckets=4)
    query.awaitTermination()
    assert before == (outcome(spark.read.parquet(f"{out}/outcomes")), sorted(map(tuple, table.read().collect())), table.version())


def test_a_new_checkpoint_is_a_stream_of_its_own(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    stream = arrive(spark, source, [(1, 1, "c", "create", None, None)], LOG)
    for n in range(2):
        jobs.workflow_into(stream, out, str(tmp_path / f"state{n}"), buckets=2).awaitTermination()
    assert [(r.version_number, r.status) for r in spark.read.parquet(f"{out}/outcomes").collect()] == [(1, 200)] * 2


def replies(rng, contracts=5, chunks=9):
    for c in range(contracts):
        for version in (1, 2):
            for chunk in range(chunks):
                items = [
                    {"key": rng.choice("abc"), "value": " " * rng.randrange(3) + "v" * rng.randrange(7) + " " * rng.randrange(3),
                     "spatial": rng.choice([None, {"page": chunk}])}
                    for _ in range(rng.randrange(4))
                ]
                yield f"c{c}", version, chunk, rng.choice([json.dumps(items), json.dumps(items), "{bad", None])


def result(df):
    columns = ["contract_id", "version_number", "parameter_key", "original_extract", "spatial_json", "combined_score", "item_no", "vector_embed"]
    return sorted(map(str, df.select(*columns).collect()))


def test_streamed_replies_equal_the_batch(spark, tmp_path):
    rows = list(replies(random.Random(3)))
    want = result(parameters_from_replies(spark.createDataFrame(rows, REPLIES)))
    random.Random(4).shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for part in (rows[:30], rows[20:60], rows[60:]):  # ten replies arrive twice
        query = jobs.replies_into(arrive(spark, source, part, REPLIES), out, state, buckets=4)
        query.awaitTermination()
    _, table = jobs.reply_tables(spark, out, query.id, 4)
    assert result(table.read()) == want
    version = table.version()
    last_batch_again(state)
    jobs.replies_into(spark.readStream.schema(REPLIES).parquet(source), out, state, buckets=4).awaitTermination()
    assert result(table.read()) == want and table.version() == version


def test_only_rows_with_a_new_winner_are_embedded(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def embedder(df):
        counted = F.udf(lambda x: calls.add(1) or [float(len(x))], "array<float>")
        return df.withColumn("vector_embed", counted("original_extract"))

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [
        [("c", 1, 0, '[{"key": "a", "value": "xx"}, {"key": "b", "value": "y"}]')],
        [("c", 1, 1, '[{"key": "a", "value": "x"}, {"key": "b", "value": "longer"}]')],
    ]
    counts = []
    for part in parts:
        query = jobs.replies_into(arrive(spark, source, part, REPLIES), out, state, embedder, buckets=2)
        query.awaitTermination()
        counts.append(calls.value)
    _, table = jobs.reply_tables(spark, out, query.id, 2)
    assert {(r.parameter_key, r.original_extract, r.vector_embed[0]) for r in table.read().collect()} == {("a", "xx", 2.0), ("b", "longer", 6.0)}
    assert counts[1] - counts[0] == 1 and counts[0] == 2


def test_stored_replies_are_joined_without_broadcast(spark, tmp_path, monkeypatch, plan):
    """However small the files of candidates and vectors are: in memory they are far larger."""
    plans, inner = [], jobs.checkpointed
    monkeypatch.setattr(jobs, "checkpointed", lambda df: plans.append(plan(df)) or inner(df))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = list(replies(random.Random(5)))
    for part in (rows[::2], rows[1::2]):
        query = jobs.replies_into(arrive(spark, source, part, REPLIES), out, state, buckets=2)
        query.awaitTermination()
    assert "SortMergeJoin" in plans[-1] and not any("Broadcast" in p for p in plans)
    batch = parameters_from_replies(spark.read.schema(REPLIES).parquet(source))
    assert "SortMergeJoin" in plan(batch) and "Broadcast" not in plan(batch)
    _, table = jobs.reply_tables(spark, out, query.id, 2)
    assert result(table.read()) == result(batch)


def test_a_stream_of_a_table_takes_all_its_files(spark, tmp_path):
    """Whether the table is one file or a folder of them."""
    documents = spark.range(40).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("body "), F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lit(7).alias("n_chars"),
    )
    got = []
    for files in (5, 1):
        folder = tmp_path / f"files{files}"
        documents.repartition(files).write.parquet(str(folder / "documents.parquet"))
        if files == 1:  # beside a table of another name
            (part,) = (folder / "documents.parquet").glob("part-*")
            folder = tmp_path / "plain"
            folder.mkdir()
            part.rename(folder / "documents.parquet")
            documents.limit(3).write.parquet(str(folder / "documents_old.parquet"))
        got.append(sorted(map(tuple, QUERIES["stream_extract"](spark, str(folder)).collect())))
    assert got[0] == got[1] == sorted(
        (str(i), 1, key, value) for i in range(40)
        for key, value in (("Payment Terms", "net 7"), ("Governing Law", "state of en"), ("Effective Date", f"s{i}"))
    )


def test_replies_are_parsed_once_and_filtered_after(spark, tmp_path, monkeypatch, plan):
    """A filter below the parsed columns would parse again for every place where it names them."""
    plans, inner = [], jobs.stored
    monkeypatch.setattr(jobs, "stored", lambda df, name: plans.append(plan(df)) or inner(df, name))
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = [("c", 1, 0, '[{"key": "a", "value": " x "}, {"key": "b", "value": "  "}, {"key": "d", "value": ""}]')]
    query = jobs.replies_into(arrive(spark, source, rows, REPLIES), out, state, buckets=2)
    query.awaitTermination()
    assert len(plans) == 1 and "Generate" in plans[0] and "Filter" not in plans[0]
    _, table = jobs.reply_tables(spark, out, query.id, 2)
    assert [(r.parameter_key, r.original_extract) for r in table.read().collect()] == [("a", " x ")]


@pytest.mark.parametrize("model", [False, True])
def test_vectors_are_stored_as_short_as_they_come_and_read_as_arrays(spark, tmp_path, model):
    """Hashed counts are a few places of 384, and rows are rewritten with each batch of their bucket."""
    def embedder(df):
        return df.withColumn("vector_embed", F.when(F.length("original_extract") < 3, F.array(F.lit(-0.0).cast("float"), F.lit(None))))

    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    parts = [[("c", 1, 1, '[{"key": "a", "value": "x y"}, {"key": "b", "value": "yy"}, {"key": "d", "value": "--"}]')],
             [("c", 1, 0, '[{"key": "a", "value": "y"}, {"key": "e", "value": "x"}]')]]
    for part in parts:  # the rows of a, b and d keep their vectors
        query = jobs.replies_into(arrive(spark, source, part, REPLIES), out, state, embedder if model else None, buckets=2)
        query.awaitTermination()
    _, table = jobs.reply_tables(spark, out, query.id, 2)
    assert table.read().columns == [f.split()[0] for f in jobs.ROWS.split(", ")]
    assert result(table.read()) == result(parameters_from_replies(spark.read.schema(REPLIES).parquet(source), embedder if model else None))
    held = {r.parameter_key: r for r in spark.read.schema(table.schema).parquet(*table.read().inputFiles()).collect()}
    assert {k: r.vector_sparse and r.vector_sparse.numNonzeros() for k, r in held.items()} == (
        dict.fromkeys("abde") if model else {"a": 2, "b": 1, "d": 0, "e": 1})
    assert {k for k, r in held.items() if r.vector_embed is not None} == ({"b", "d", "e"} if model else set())
    assert model or all(len(r.vector_embed) == 384 for r in table.read().collect())
