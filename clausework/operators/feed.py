"""The command feed: payloads parsed once, commands handed to the operators that carry them out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.operators.ledger import name_contracts
from clausework.schemas import DEFAULT_KEYS, DRAFT

# What a payload may hold, by the names that requests use.
PAYLOAD = (
    "contract_id STRING, contract_type STRING, metadata STRING, workflow_state STRING, contract_text STRING, "
    "parameters ARRAY<STRING>, version_number INT, parameter_id LONG, user_override STRING"
)


def parsed(feed: DataFrame, payload: str = "payload") -> DataFrame:
    """The feed with a struct ``_p`` of payload fields; missing fields are null, and all are where the JSON is bad.

    A payload that breaks off gives nothing, also of the fields before the break.
    """
    whole = F.try_parse_json(F.col(payload)).isNotNull()
    return feed.withColumn("_p", F.when(whole, F.from_json(F.col(payload), PAYLOAD))).drop(payload)


def creates(commands: DataFrame, feed: str = "") -> DataFrame:
    """Create requests: seq, ts, contract_id (made up from ``feed`` and seq if missing), contract_type, metadata, workflow_state."""
    named = commands.filter("command = 'create'").select(
        "seq", "ts", F.coalesce(F.nullif("contract_id", F.lit("")), "_p.contract_id").alias("contract_id"),
        "_p.contract_type", "_p.metadata", F.coalesce("_p.workflow_state", F.lit(DRAFT)).alias("workflow_state"),
    )
    return name_contracts(named, "seq", feed=feed)


def moves(commands: DataFrame) -> DataFrame:
    """Submits and approves: seq, contract_id, command, if_match."""
    return commands.filter("command IN ('submit', 'approve')").select("seq", "contract_id", "command", "if_match")


def extractions(commands: DataFrame) -> DataFrame:
    """Documents to extract: seq, contract_id, text, and the keys asked for (the default ones if none are named)."""
    keys = F.coalesce("_p.parameters", F.array(*map(F.lit, DEFAULT_KEYS)))
    return commands.filter("command = 'extract'").select("seq", "contract_id", F.col("_p.contract_text").alias("text"), keys.alias("keys"))


def overrides(commands: DataFrame) -> DataFrame:
    """Overrides: seq, parameter_id, user_override (null takes an override back)."""
    return commands.filter("command = 'override'").select("seq", "_p.parameter_id", "_p.user_override")


def accepts(commands: DataFrame) -> DataFrame:
    """Batch accepts: seq, contract_id, version_number, if_match."""
    return commands.filter("command = 'accept'").select("seq", "contract_id", "_p.version_number", "if_match")


def workflow_log(commands: DataFrame, feed: str = "") -> DataFrame:
    """What a replay reads: seq, ts, contract_id, command, if_match and the initial state of creates."""
    named = name_contracts(
        commands.withColumn("contract_id", F.when(
            F.col("command") == "create", F.coalesce(F.nullif("contract_id", F.lit("")), "_p.contract_id")
        ).otherwise(F.col("contract_id"))), "seq", feed=feed,
    )
    return named.select("seq", "ts", "contract_id", "command", "if_match", F.col("_p.workflow_state").alias("initial_state"))
