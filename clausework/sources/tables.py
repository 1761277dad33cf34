"""Reading and writing the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.schemas import DOCUMENTS, TABLES


# An input split of this size keeps a core busy for a while.
SPLIT_BYTES = 32 << 20


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the data model from Parquet, with its declared schema (no inference)."""
    return spark.read.schema(TABLES[name]).parquet(path)


def spread(df: DataFrame, path: str) -> DataFrame:
    """``df``, read from ``path``, over all cores when the files are too few to split that far.

    Only inputs below ``SPLIT_BYTES`` per core are shuffled; larger ones already have the tasks.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    # File lengths only: the contents are pruned away.
    files = df.sparkSession.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    return df.repartition(cores) if size < cores * SPLIT_BYTES else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    partition_column: str,
    bounds: tuple[int, int] | None = None,
    partitions: int = 32,
    properties: dict[str, str] | None = None,
) -> DataFrame:
    """A table of an existing database, read in parallel ranges of ``partition_column``.

    Without ``bounds`` the database is asked for them first.
    """
    def reader(what: str):
        return spark.read.format("jdbc").option("url", url).option("dbtable", what).options(**(properties or {}))

    if bounds is None:
        ends = f"(SELECT min({partition_column}) AS low, max({partition_column}) AS high FROM {table}) ends"
        low, high = reader(ends).load().first()
        bounds = (0, 1) if low is None else (low, high)
    return reader(table).options(
        partitionColumn=partition_column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=partitions
    ).load()


def read_documents(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Documents (contract_id, text): a Parquet table, or a folder of text files named by contract."""
    if fmt == "parquet":
        return spark.read.schema(DOCUMENTS).parquet(path)
    if fmt != "text":
        raise ValueError(f"unknown document format {fmt}")
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return spark.read.text(path, wholetext=True).select(
        # In a path a plus is a plus; decoding would make it a blank.
        F.url_decode(F.replace(F.regexp_replace(name, "\\.[^.]*$", ""), F.lit("+"), F.lit("%2B"))).alias("contract_id"), F.col("value").alias("text")
    )


def read_commands(spark: SparkSession, path: str, streaming: bool = False, files_per_batch: int = 64) -> DataFrame:
    """The command feed, as a table or as a stream of arriving files.

    ``files_per_batch`` bounds a micro-batch, and with it what one contract can bring at once,
    however long the backlog.
    """
    if not streaming:
        return read_table(spark, path, "commands")
    reader = spark.readStream.schema(TABLES["commands"]).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def append_run(rows: DataFrame, path: str, run_id: str) -> None:
    """Append one extraction run; repeating a run id replaces that run only."""
    (
        rows.withColumn("run_id", F.lit(run_id))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id")
        .parquet(path)
    )


def write_snapshot(df: DataFrame, path: str) -> None:
    """Write a changed table to a new path; the input it was derived from stays readable."""
    df.write.mode("errorifexists").parquet(path)
