"""Overrides and accepts on a stored parameter table, rewriting only the buckets they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.operators.review import VERSION_KEY, accept, acceptable, apply_overrides
from clausework.schemas import PARAMETERS
from clausework.session import checkpointed
from clausework.sources.buckets import BUCKETS, BucketedTable


def parameter_table(spark: SparkSession, path: str, schema: str = PARAMETERS, buckets: int = BUCKETS) -> BucketedTable:
    """Parameters bucketed by contract, in the order of a version's listing."""
    return BucketedTable(spark, path, schema, ["contract_id"], [*VERSION_KEY, "parameter_id"], buckets)


def override_parameters(table: BucketedTable, scored: DataFrame) -> int:
    """The next version of ``table`` after scored overrides (parameter_id, user_override, combined_score, status).

    An override names its parameter, not its contract: two columns of the table tell which buckets they are in.
    """
    scored = checkpointed(scored)
    names = scored.filter("status = 200").select("parameter_id")
    owners = table.read().select("parameter_id", "contract_id").join(names, "parameter_id", "left_semi")
    return table.update(lambda stored: apply_overrides(stored, scored), owners)


def accept_versions(table: BucketedTable, granted: DataFrame) -> int:
    """The next version of ``table`` after a batch accept of the ``granted`` versions (contract_id, version_number)."""
    granted = checkpointed(granted.select(*VERSION_KEY).distinct())

    def accepted(stored: DataFrame) -> DataFrame:
        marked = stored.join(granted.withColumn("_granted", F.lit(True)), VERSION_KEY, "left")
        hit = F.col("_granted").isNotNull() & acceptable(F.col("user_override"), F.col("combined_score"))
        return accept(marked, hit).select(*stored.columns)

    return table.update(accepted, granted)
