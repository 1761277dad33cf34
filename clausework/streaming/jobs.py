"""The workflow and the extraction on live feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from clausework.functions.text import chunk_documents
from clausework.operators.reconcile import by_shuffle, measured, merge_candidates, reconciled
from clausework.operators.scan import ROWS_PER_TASK
from clausework.operators.workflow import OUTCOME, STATE, command_step, end_states, replay, replay_with_etags
from clausework.plans.enrich import hash_words, plain_vector, replies_from_rules
from clausework.plans.extract import OWNER, embedded, numbered_items, parameter_rows, parameters_from_replies, stored
from clausework.schemas import CHUNK_CHARS
from clausework.session import checkpointed
from clausework.sources.buckets import BUCKETS, BucketedTable

CANDIDATES = (
    "contract_id STRING, version_number INT, parameter_key STRING, _len INT, item_no LONG, value STRING, spatial_json STRING"
)
ROWS = (
    "contract_id STRING, version_number INT, parameter_key STRING, param_group_id STRING, param_structure_type STRING, "
    "original_extract STRING, user_override STRING, spatial_json STRING, combined_score DOUBLE, item_no LONG, "
    "vector_embed ARRAY<FLOAT>, winner LONG"
)
SPARSE = "vector_sparse"
GROUP = [*OWNER, "parameter_key"]


def run_of(batch: DataFrame) -> str:
    """The id of the stream that a micro-batch is of: kept over restarts, new with a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _start(stream: DataFrame, land: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def workflow_states(spark: SparkSession, path: str, run: str, key: str = "contract_id", kind: str = "string", buckets: int = BUCKETS) -> BucketedTable:
    """End states of a workflow stream, one version of the table per micro-batch."""
    schema = f"`{key}` {kind}, version_number LONG, workflow_state STRING, revision LONG"
    return BucketedTable(spark, f"{path}/states/run={run}", schema, [key], buckets=buckets)


def workflow_into(
    commands: DataFrame,
    path: str,
    checkpoint: str,
    key: str = "contract_id",
    order: tuple[str, ...] = ("ts", "seq"),
    command: str = "command",
    if_match: str | None = "if_match",
    initial_state: str | None = None,
    buckets: int = BUCKETS,
    rows_per_task: int = ROWS_PER_TASK,
) -> StreamingQuery:
    """Carry out a stream of commands; outcomes land in ``path/outcomes``, end states in a bucketed table.

    Each micro-batch is a replay that goes on from the stored states of its contracts, so a contract
    with more commands than a task should sort is split just as in a replay of a whole log. Commands
    of a micro-batch are applied in ``order``; one that arrives later is applied then, as a service
    would on arrival. Only buckets of contracts in the batch are read and rewritten, and a repeated
    batch starts from the states before it and overwrites its own outcomes.
    """
    order = list(order)
    kind = dict(commands.dtypes)[key]

    def land(batch: DataFrame, batch_id: int) -> None:
        run = run_of(batch)
        log = checkpointed(batch)
        table = workflow_states(batch.sparkSession, path, run, key, kind, buckets)
        touched = table.touched(log)
        before = table.version(batch_id)
        states = None
        if before is not None:
            states = checkpointed(table.read(before, touched).join(log.select(key).distinct(), key, "left_semi"))
        if if_match:
            outcome = replay_with_etags(log, key, order, command, if_match, initial_state, rows_per_task, states)
        else:
            outcome = replay(log, key, order, command, initial_state, True, rows_per_task, states)
        out = f"{path}/outcomes/run={run}/batch={batch_id}"
        outcome.write.mode("overwrite").parquet(out)
        # An outcome keeps the key's type, but not always in its spelling by schema inference.
        done = batch.sparkSession.read.schema(outcome.schema).parquet(out).filter("version_number > 0")
        table.upsert(end_states(done, key, order, tuple(STATE)), batch_id)

    return _start(commands, land, checkpoint)


def reply_tables(spark: SparkSession, path: str, run: str, buckets: int = BUCKETS) -> tuple[BucketedTable, BucketedTable]:
    """Candidates and parameter rows of a stream of replies; one version of each per micro-batch.

    A stored row has its vector in one of two columns: sparse if it is the built-in embedder's, as an array if it is a
    model's. Whoever reads the rows gets arrays.
    """
    def place(name):
        return f"{path}/{name}/run={run}"

    schema = T.StructType.fromDDL(ROWS).add(SPARSE, VectorUDT())
    return (
        BucketedTable(spark, place("candidates"), CANDIDATES, ["contract_id"], [*GROUP, "_len"], buckets),
        BucketedTable(spark, place("rows"), schema, ["contract_id"], [*OWNER, "item_no"], buckets, with_plain_vectors),
    )


def with_plain_vectors(rows: DataFrame) -> DataFrame:
    return rows.withColumn("vector_embed", F.coalesce("vector_embed", plain_vector(F.col(SPARSE)))).drop(SPARSE)


def with_sparse_vectors(rows: DataFrame) -> DataFrame:
    return hash_words(rows, "original_extract", SPARSE)


def replies_into(
    replies: DataFrame,
    path: str,
    checkpoint: str,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Reconcile model replies (contract_id, version_number, chunk_no, response) as they arrive.

    A version's chunks may come in any order, in any number of micro-batches, and more than once.
    What later items can be measured against is kept: per key the first item of each length. These
    candidates merge, so after every batch the parameter rows are those of all replies so far. Only
    buckets of contracts in the batch are rewritten; rows whose winner stays keep their vectors.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept, rows = reply_tables(spark, path, run_of(batch), buckets)
        items = numbered_items(batch.select(*OWNER, "chunk_no", "response"))
        # Items are stored as they are parsed: a filter by their text would be pushed below, and parse it again for
        # every place where it is named.
        items = stored(items.select(*GROUP, "item_no", "value", F.to_json("spatial").alias("spatial_json")), "items")
        arrived = measured(items)
        touched = kept.touched(arrived)
        if not touched:
            return
        kept.update(lambda old: merge_candidates(old, arrived, GROUP), touched, batch_id)
        known = kept.read(batch_id, touched)

        def renewed(old: DataFrame) -> DataFrame:
            won = reconciled(known, GROUP).withColumnRenamed("item_no", "winner")
            had = old.select(*GROUP, "winner", "vector_embed", SPARSE, F.lit(True).alias("_known"))
            both = checkpointed(by_shuffle(won, had, [*GROUP, "winner"], "left"))
            same = parameter_rows(both.filter("_known"), "winner", "vector_embed", SPARSE)
            new = parameter_rows(both.filter("_known IS NULL"), "winner")
            return same.unionByName(embedded(new, embedder or with_sparse_vectors), allowMissingColumns=True)

        rows.update(renewed, touched, batch_id)

    return _start(replies, land, checkpoint)


def workflow_stream(
    commands: DataFrame,
    key: str = "contract_id",
    order: tuple[str, ...] = ("ts", "seq"),
    command: str = "command",
    if_match: str | None = "if_match",
    initial_state: str | None = None,
) -> DataFrame:
    """Outcome of each command of a stream; state per contract is one small tuple.

    Within a micro-batch a contract's commands are applied in ``order``; a command that arrives
    in a later micro-batch is applied then, as a service would on arrival. The trigger's file
    limit bounds what one contract can bring at once.
    """
    step, tag = command_step()
    order = list(order)
    schema = T.StructType([
        *commands.schema.fields, T.StructField("version_number", T.LongType()), *OUTCOME,
    ])
    columns = schema.fieldNames()

    def advance(contract, batches, state):
        import pandas as pd

        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        now = tuple(state.get) if state.exists else None
        outcomes = []
        none = [None] * len(pdf)
        tags, opened = pdf[if_match] if if_match else none, pdf[initial_state] if initial_state else none
        for what, match, state_given in zip(pdf[command], tags, opened):
            now, status = step(
                now, contract[0], what, match if isinstance(match, str) else None,
                state_given if isinstance(state_given, str) else None,
            )
            version, workflow_state, revision = now or (0, None, None)
            outcomes.append((version, workflow_state, status, revision, tag(contract[0], now) if now else None))
        if now:
            state.update(now)
        names = ["version_number", "workflow_state", "status", "revision", "etag"]
        done = pd.DataFrame(outcomes, columns=names, index=pdf.index).astype({"revision": "Int64"})
        yield pd.concat([pdf, done], axis=1)[columns]

    return commands.groupBy(key).applyInPandasWithState(
        advance, schema, "version_number long, workflow_state string, revision long", "append", "NoTimeout"
    )


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, taking everything that is there and stopping."""
    return (
        df.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def extraction_stream(
    documents: DataFrame,
    path: str,
    checkpoint: str,
    ask: Callable[[DataFrame], DataFrame] | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    max_chars: int = CHUNK_CHARS,
) -> StreamingQuery:
    """Extract arriving documents (contract_id, version_number, text) into parameter rows.

    Chunking and the model are stateless per row. Each micro-batch reconciles its own documents
    and lands in a folder named by the stream and its number, so a repeated batch overwrites
    itself, and a stream with a new checkpoint leaves the rows of an earlier one alone.
    """
    chunked = chunk_documents(documents, "text", max_chars)

    def land(batch: DataFrame, batch_id: int) -> None:
        replies = stored((ask or replies_from_rules)(batch), "stream-replies")
        parameters_from_replies(replies, embedder).write.mode("overwrite").parquet(f"{path}/run={run_of(batch)}/batch={batch_id}")

    return _start(chunked, land, checkpoint)
