"""The whole extraction job: documents to parameter rows, for all contracts at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.functions.replies import reply_items
from clausework.functions.text import chunk_documents
from clausework.operators.reconcile import reconcile
from clausework.operators.scan import lookup, number_rows
from clausework.plans.enrich import embed_hashing, replies_from_rules
from clausework.schemas import CHUNK_CHARS
from clausework.session import scratch_path

OWNER = ["contract_id", "version_number"]


def document_chunks(documents: DataFrame, versions: DataFrame, max_chars: int = CHUNK_CHARS) -> DataFrame:
    """Chunks of each document under its contract's current version; others have nowhere to go.

    Further columns, such as the keys a request asks for, stay with the chunks.
    """
    current = versions.filter("is_current").select(*OWNER)
    more = [c for c in documents.columns if c not in (*OWNER, "text")]
    return chunk_documents(
        lookup(documents, current, ["contract_id"]).select(*OWNER, *more, "text"), "text", max_chars
    )


def without_version(documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Documents whose contract has no current version, with status 404."""
    current = versions.filter("is_current").select("contract_id")
    return documents.join(current, "contract_id", "left_anti").withColumn("status", F.lit(404))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: model calls are made once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parameters_from_replies(
    replies: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """New parameter rows, without ids, from stored replies (owner, chunk_no, response).

    ``item_no`` orders a version's rows by the first appearance of their key.
    """
    kept = reconcile(numbered_items(replies), OWNER)
    return embedded(parameter_rows(kept.withColumn("spatial_json", F.to_json("spatial"))), embedder)


def numbered_items(replies: DataFrame) -> DataFrame:
    """Items of replies, with their place in the version as ``item_no``."""
    return reply_items(replies).withColumn(
        "item_no", F.shiftleft(F.col("chunk_no").cast("long"), 32) + F.col("pos")
    )


def parameter_rows(kept: DataFrame, *more: str) -> DataFrame:
    """Reconciled items as new parameter rows, without id and vector; columns named in ``more`` stay."""
    return kept.select(
        *OWNER,
        "parameter_key",
        F.lit(None).cast("string").alias("param_group_id"),
        F.lit("SCALAR").alias("param_structure_type"),
        F.col("value").alias("original_extract"),
        F.lit(None).cast("string").alias("user_override"),
        "spatial_json",
        F.lit(1.0).alias("combined_score"),
        F.col("first_no").alias("item_no"),
        *more,
    )


def embedded(rows: DataFrame, embedder: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    embed = embedder or (lambda df: embed_hashing(df, "original_extract", "vector_embed"))
    return embed(rows)


def extract(
    documents: DataFrame,
    versions: DataFrame,
    ask: Callable[[DataFrame], DataFrame] | None = None,
    embedder: Callable[[DataFrame], DataFrame] | None = None,
    max_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """Documents (contract_id, text) to new parameter rows on each current version.

    ``ask`` maps chunks to replies; its output is stored first because the rows read it twice.
    """
    chunks = document_chunks(documents, versions, max_chars)
    replies = stored((ask or replies_from_rules)(chunks), "replies")
    return parameters_from_replies(replies, embedder)


def with_ids(rows: DataFrame, start: int = 1) -> DataFrame:
    """Consecutive parameter ids in insertion order: contract, version, first appearance.

    The rows are stored first: numbering reads them twice, and an embedder is to be asked once.
    """
    return number_rows(stored(rows, "rows"), [*OWNER, "item_no"], "parameter_id", start).drop("item_no")


def append_rows(parameters: DataFrame, rows: DataFrame) -> DataFrame:
    """Parameter table plus the new rows, earlier ones kept: extracting twice doubles them."""
    start = (parameters.agg(F.max("parameter_id")).first()[0] or 0) + 1
    return parameters.unionByName(with_ids(rows, start).select(*parameters.columns))


def replace_rows(parameters: DataFrame, rows: DataFrame) -> DataFrame:
    """As ``append_rows`` but dropping earlier rows of the versions extracted again."""
    again = rows.select(*OWNER).distinct()
    start = (parameters.agg(F.max("parameter_id")).first()[0] or 0) + 1
    return parameters.join(again, OWNER, "left_anti").unionByName(
        with_ids(rows, start).select(*parameters.columns)
    )
