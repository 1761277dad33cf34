"""From raw documents to packed training sequences: filter, deduplicate twice, mix, pack.

Each stage takes (spark, docs, sf_dir) and all rows its predecessor kept. All but the last return
the columns of ``docs``; a document that the mix takes several times is there several times.

Defined results
  null or empty text    scored like any other; equal to one another; size 0 in the mix; the end id alone when packed
  null doc_id           never labelled, otherwise a document like any other
  repeated rows, ties   the row with the smallest doc_id stays (null last), of equal rows one
  very long texts       whole in every stage
  empty table           no rows from any stage
  other columns         kept under whatever name, up to the last stage
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausework.llm import exact_dedup, mixing, packing, quality, simhash
from clausework.llm.util import scratch_path

# Words a worker remembers the ids of: few, as its memory also holds what the other stages need.
CACHE = 100_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.good_documents(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.one_per_component(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the token windows."""
    return packing.pack(docs, cache=CACHE)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

# Trained models, fingerprints and tokenizers have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
