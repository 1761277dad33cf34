"""Registered queries over the test tables, each with its DuckDB statement where SQL can say it.

The test tables stand in for the data model: orders and customers for versions and contracts,
lineitem for parameters, events for the command log, conversations and documents for text,
embeddings for stored vectors. Every query reads its tables whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausework.functions import scores, text, vectors
from clausework.functions.replies import reply_items, spatial_struct
from clausework.operators import audit, cells, chunking, feed, layout, ledger, reconcile, review, search, workflow
from clausework.operators.scan import lookup, number_rows
from clausework.plans import enrich, extract, upsert
from clausework.schemas import DEFAULT_KEYS
from clausework.session import scratch_path, tune
from clausework.sources import tables
from clausework.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Parquet tables of one folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = tune(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table for costly row-local work, narrowed before it is spread over the cores."""
        return tables.spread(getattr(self, name).select(*columns), f"{self.folder}/{name}.parquet")


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = lambda spark, folder: build(Tables(spark, folder))
        if sql:
            ORACLES[build.__name__] = sql
        return build

    return register


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def big(name: str, alias: str | None = None):
    return F.col(name).cast("bigint").alias(alias or name)


def six(column, alias: str):
    return F.round(column, 6).alias(alias)


# ---- contracts and versions ----------------------------------------------------------------

@query("""
WITH sent AS (
  SELECT CASE WHEN o_orderkey % 10 < 2 THEN substr(sha256('create-' || o_orderkey), 1, 32) ELSE o_custkey::VARCHAR END AS id,
    o_orderpriority, o_orderkey FROM orders),
unknown AS (SELECT * FROM sent WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey::VARCHAR = id))
SELECT s_suppkey::VARCHAR AS contract_id, s_name AS contract_type FROM supplier
UNION ALL
SELECT id, o_orderpriority FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY o_orderkey) AS rn FROM unknown)
WHERE rn = 1
""")
def contract_insert_if_absent(t):
    """Orders as create requests; every fifth has no id, or an empty one."""
    contracts = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("contract_id"), F.col("s_name").alias("contract_type")
    )
    last = F.col("o_orderkey") % 10
    incoming = t.orders.select(
        F.when(last == 1, F.lit("")).when(last != 0, F.col("o_custkey").cast("string")).alias("contract_id"),
        F.col("o_orderpriority").alias("contract_type"), F.col("o_orderkey").alias("seq"),
    )
    return ledger.insert_if_absent(contracts, incoming, "seq")


@query("""
WITH sent AS (
  SELECT 1 AS feed, o_orderkey AS seq, o_orderpriority AS contract_type,
    CASE WHEN o_orderkey % 10 < 2 THEN substr(sha256('create-orders-' || o_orderkey), 1, 32) ELSE o_custkey::VARCHAR END AS id FROM orders
  UNION ALL SELECT 2, c_custkey, c_mktsegment,
    CASE WHEN c_custkey % 3 = 0 THEN substr(sha256('create-customers-' || c_custkey), 1, 32) ELSE c_custkey::VARCHAR END FROM customer)
SELECT s_suppkey::VARCHAR AS contract_id, s_name AS contract_type FROM supplier
UNION ALL
SELECT id, contract_type FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY feed, seq) AS rn FROM sent
  WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey::VARCHAR = id))
WHERE rn = 1
""")
def contract_insert_two_feeds(t):
    """Orders, then customers as create requests of two feeds that count from the same number, some without ids."""
    contracts = t.supplier.select(
        F.col("s_suppkey").cast("string").alias("contract_id"), F.col("s_name").alias("contract_type")
    )
    last = F.col("o_orderkey") % 10
    orders = t.orders.select(
        F.when(last >= 2, F.col("o_custkey").cast("string")).alias("contract_id"),
        F.col("o_orderpriority").alias("contract_type"), F.col("o_orderkey").alias("seq"),
    )
    customers = t.customer.select(
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey").cast("string")).otherwise("").alias("contract_id"),
        F.col("c_mktsegment").alias("contract_type"), F.col("c_custkey").alias("seq"),
    )
    both = ledger.insert_if_absent(contracts, orders, "seq", feed="orders")
    return ledger.insert_if_absent(both, customers, "seq", feed="customers")


@query("""
SELECT o_orderkey AS contract_id, CAST(coalesce(max(l_linenumber), 0) + 1 AS BIGINT) AS next_version
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey
""")
def next_version(t):
    versions = t.lineitem.select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("version_number")
    )
    requests = t.orders.select(F.col("o_orderkey").alias("contract_id"))
    return ledger.next_version(requests, versions).select("contract_id", big("next_version"))


def order_versions(t) -> DataFrame:
    """Orders as versions of customers, numbered by date."""
    feed = t.orders.select(
        F.col("o_custkey").alias("contract_id"), "o_orderdate", "o_orderkey",
        F.col("o_orderstatus").alias("workflow_state"),
    )
    return ledger.version_ledger(feed, "contract_id", ["o_orderdate", "o_orderkey"])


LEDGER_SQL = """
SELECT o_custkey AS contract_id, o_orderkey, o_orderstatus AS workflow_state,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version_number,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current
FROM orders
"""


@query(LEDGER_SQL)
def version_ledger(t):
    return order_versions(t).select("contract_id", "o_orderkey", "workflow_state", "version_number", "is_current")


@query(f"""
SELECT contract_id, version_number, workflow_state, is_current,
  substr(sha256(contract_id::VARCHAR), 1, 32) || '-' || version_number || '-0' AS etag FROM ({LEDGER_SQL})
""")
def version_view(t):
    tagged = order_versions(t).withColumn("etag", ledger.etag(F.col("contract_id"), F.col("version_number"), F.lit(0)))
    return ledger.version_view(tagged)


@query("""
SELECT l_partkey AS parameter_id, l_returnflag AS parameter_key, l_linestatus AS original_extract,
  NULLIF(l_returnflag, 'N') AS user_override, 1 - l_discount AS combined_score FROM lineitem
""")
def short_parameters(t):
    return ledger.short_parameters(t.lineitem.select(
        "l_orderkey", F.col("l_partkey").alias("parameter_id"), F.col("l_returnflag").alias("parameter_key"),
        F.col("l_linestatus").alias("original_extract"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("user_override"),
        (1 - F.col("l_discount")).alias("combined_score"),
    ))


@query(f"SELECT contract_id, o_orderkey, workflow_state FROM ({LEDGER_SQL}) WHERE is_current")
def current_version(t):
    versions = t.orders.select(
        F.col("o_custkey").alias("contract_id"), "o_orderdate", "o_orderkey",
        F.col("o_orderstatus").alias("workflow_state"),
    )
    return ledger.current_version(
        versions, "contract_id", ["o_orderdate", "o_orderkey"], ["o_orderkey", "workflow_state"]
    )


@query(f"""
SELECT event_id, user_id AS contract_id, event_id % 20 + 1 AS version_number, workflow_state,
  CAST(CASE WHEN workflow_state IS NULL THEN 404 ELSE 200 END AS BIGINT) AS status
FROM events LEFT JOIN ({LEDGER_SQL}) v
  ON v.contract_id = user_id AND v.version_number = event_id % 20 + 1
""")
def version_lookup_status(t):
    requests = t.events.select(
        "event_id", F.col("user_id").alias("contract_id"), (F.col("event_id") % 20 + 1).alias("version_number")
    )
    versions = order_versions(t).select("contract_id", "version_number", "workflow_state")
    return ledger.lookup_versions(requests, versions).select(
        "event_id", "contract_id", "version_number", "workflow_state", big("status")
    )


@query(f"""
WITH first AS (SELECT *, o_custkey::VARCHAR AS c FROM orders),
numbered AS ({LEDGER_SQL}),
requests AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth,
    count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'signup'),
base AS (SELECT contract_id, max(version_number) AS top FROM numbered GROUP BY 1)
SELECT contract_id::VARCHAR AS contract_id, version_number::BIGINT AS version_number, workflow_state,
  is_current AND contract_id NOT IN (SELECT user_id FROM requests) AS is_current
FROM numbered
UNION ALL
SELECT user_id::VARCHAR, (coalesce(top, 0) + nth)::BIGINT, 'STAGED_DRAFT', nth = n
FROM requests LEFT JOIN base ON contract_id = user_id
""")
def version_creation(t):
    """Sign-ups as create requests on top of the order ledger."""
    versions = order_versions(t).select(
        F.col("contract_id").cast("string"), F.col("version_number").cast("int"), "workflow_state", "is_current",
        ledger.etag(F.col("contract_id"), F.col("version_number"), F.lit(0)).alias("etag"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"),
    )
    requests = t.events.filter("event_type = 'signup'").select(
        F.col("user_id").cast("string").alias("contract_id"), F.lit("STAGED_DRAFT").alias("workflow_state"),
        "ts", "event_id",
    )
    after = ledger.create_versions(requests, versions, ["ts", "event_id"])
    return after.select("contract_id", big("version_number"), "workflow_state", "is_current")


@query("""
SELECT l_orderkey AS contract_id, CAST(l_linenumber AS BIGINT) AS version_number, l_partkey AS parameter_id,
  l_returnflag AS parameter_key, l_linestatus AS original_extract, 1 - l_discount AS combined_score
FROM lineitem JOIN orders ON o_orderkey = l_orderkey AND l_linenumber = 1 + o_custkey % 7
ORDER BY l_partkey
""")
def parameter_listing(t):
    parameters = t.lineitem.select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").cast("bigint").alias("version_number"),
        F.col("l_partkey").alias("parameter_id"), F.col("l_returnflag").alias("parameter_key"),
        F.col("l_linestatus").alias("original_extract"), (1 - F.col("l_discount")).alias("combined_score"),
    )
    requested = t.orders.select(
        F.col("o_orderkey").alias("contract_id"), (F.col("o_custkey") % 7 + 1).alias("version_number")
    )
    return ledger.parameter_listing(
        parameters, requested, view=["parameter_id", "parameter_key", "original_extract", "combined_score"]
    )


@query(f"""
SELECT event_id, CAST(CASE WHEN o_orderkey IS NULL THEN 404
  WHEN event_id % 4 < 2 OR event_id % 4 = 2 THEN 200 ELSE 409 END AS BIGINT) AS status
FROM events LEFT JOIN ({LEDGER_SQL}) v ON v.contract_id = user_id AND is_current
""")
def etag_check(t):
    """If-Match missing, empty, right or stale by turns, against the user's current version."""
    current = order_versions(t).filter("is_current").select(
        "contract_id", ledger.etag(F.col("contract_id"), F.col("version_number"), F.lit(0)).alias("etag"),
    )
    sent = (
        F.when(F.col("event_id") % 4 == 1, F.lit(""))
        .when(F.col("event_id") % 4 == 2, F.col("etag"))
        .when(F.col("event_id") % 4 == 3, F.lit("stale"))
    )
    requests = t.events.select("event_id", F.col("user_id").alias("contract_id"))
    joined = lookup(requests, current, ["contract_id"], "left")
    status = F.when(F.col("etag").isNull(), F.lit(404)).otherwise(ledger.etag_status(sent, F.col("etag")))
    return joined.select("event_id", status.cast("bigint").alias("status"))


# ---- workflow ------------------------------------------------------------------------------

COMMAND_OF = {"signup": "create", "purchase": "submit", "error": "approve", "click": "extract", "view": "accept"}


def command_log(events: DataFrame) -> DataFrame:
    command = F.create_map(*[F.lit(x) for pair in COMMAND_OF.items() for x in pair])
    return events.select(
        F.col("user_id").cast("string").alias("contract_id"), "ts", F.col("event_id").alias("seq"),
        command[F.col("event_type")].alias("command"),
    )


def replay_sql(if_match: str, columns: str, opened: str = "'STAGED_DRAFT'") -> str:
    """A step-by-step replay: one recursion level per command of a contract."""
    case = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMAND_OF.items())
    return f"""
WITH RECURSIVE log AS (
  SELECT user_id::VARCHAR AS contract_id, ts, event_id AS seq, CASE event_type {case} END AS command,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
sent AS (SELECT *, {if_match} AS if_match FROM log),
steps AS (
  SELECT contract_id, NULL::BIGINT AS seq, 0::BIGINT AS n, 0::BIGINT AS ver, NULL::VARCHAR AS state, 0::BIGINT AS rev, 0::BIGINT AS status
  FROM (SELECT DISTINCT contract_id FROM log)
  UNION ALL
  SELECT contract_id, seq, n,
    CASE WHEN command = 'create' THEN ver + 1 ELSE ver END,
    CASE WHEN new_status <> 200 THEN state WHEN command = 'create' THEN {opened}
      WHEN command = 'submit' THEN 'PENDING_APPROVAL' WHEN command = 'approve' THEN 'PRODUCTION_ACTIVE' ELSE state END,
    CASE WHEN command = 'create' THEN 0 WHEN new_status = 200 AND command IN ('submit', 'approve') THEN rev + 1 ELSE rev END,
    new_status
  FROM (
    SELECT l.*, s.ver, s.state, s.rev, CAST(CASE
      WHEN l.command = 'create' THEN 200 WHEN s.ver = 0 THEN 404
      WHEN l.command NOT IN ('submit', 'approve', 'accept') THEN 200
      WHEN coalesce(l.if_match, '') <> '' AND l.if_match <>
        substr(sha256(l.contract_id), 1, 32) || '-' || s.ver || '-' || s.rev THEN 409
      WHEN l.command = 'approve' AND s.state <> 'PENDING_APPROVAL' THEN 400 ELSE 200 END AS BIGINT) AS new_status
    FROM steps s JOIN sent l ON l.contract_id = s.contract_id AND l.n = s.n + 1)
)
SELECT {columns} FROM steps WHERE n > 0
"""


REPLAY_COLUMNS = """contract_id, seq, ver AS version_number, state AS workflow_state, status,
  CASE WHEN ver > 0 THEN substr(sha256(contract_id), 1, 32) || '-' || ver || '-' || rev END AS etag"""


@query(replay_sql("NULL::VARCHAR", REPLAY_COLUMNS))
def workflow_replay(t):
    return workflow.replay(command_log(t.events), with_etag=True).select(
        "contract_id", "seq", big("version_number"), "workflow_state", big("status"), "etag"
    )


@query(f"""
WITH replayed AS ({replay_sql("NULL::VARCHAR", "contract_id, n, state")})
SELECT state AS workflow_state, count(*) AS contracts FROM (
  SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY n DESC) AS rn FROM replayed)
WHERE rn = 1 GROUP BY 1
""")
def workflow_funnel(t):
    return workflow.funnel(workflow.end_states(workflow.replay(command_log(t.events))))


@query(replay_sql(
    """CASE seq % 4 WHEN 1 THEN '' WHEN 2 THEN 'stale' WHEN 3 THEN
    substr(sha256(contract_id), 1, 32) || '-' || (1 + n // 6) || '-' || (seq // 4) % 2 END""",
    REPLAY_COLUMNS,
))
def workflow_replay_etag(t):
    """Every fourth command sends a guessed tag, every fourth a stale one."""
    return workflow.replay_with_etags(guessed_tags(command_log(t.events))).select(
        "contract_id", "seq", big("version_number"), "workflow_state", big("status"), "etag"
    )


def guessed_tags(log: DataFrame) -> DataFrame:
    nth = workflow.running(log, ["contract_id"], ["ts", "seq"], {"_n": workflow.Carry("sum", F.lit(1))})
    guess = ledger.etag(
        F.col("contract_id"), F.floor(F.col("_n") / 6) + 1, F.floor(F.col("seq") / 4) % 2
    )
    return nth.withColumn(
        "if_match",
        F.when(F.col("seq") % 4 == 1, F.lit(""))
        .when(F.col("seq") % 4 == 2, F.lit("stale"))
        .when(F.col("seq") % 4 == 3, guess),
    ).drop("_n")


def file_stream(t, name: str, files_per_batch: int = 64) -> DataFrame:
    """A table as a stream of its files: one file, or a folder of them.

    The path is a pattern, as a streaming source takes a plain path for a folder.
    """
    reader = t.spark.readStream.schema(getattr(t, name).schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{t.folder}/{{{name}}}.parquet")


@query(replay_sql("NULL::VARCHAR", REPLAY_COLUMNS, "CASE WHEN seq % 3 = 0 THEN 'PENDING_APPROVAL' ELSE 'STAGED_DRAFT' END"))
def stream_workflow(t):
    """Commands arriving in three parts, by time; every third create asks for an initial state of its own."""
    log = command_log(t.events).withColumn("opened", F.when(F.col("seq") % 3 == 0, F.lit("PENDING_APPROVAL")))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = log.select(at.alias("at")).approxQuantile("at", [1 / 3, 2 / 3], 0.01) or (0, 0)
    feed_, out, checkpoint = (scratch_path(t.spark, f"stream-{n}") for n in ("commands", "workflow", "checkpoint"))
    # A part is carried out before the next arrives.
    for part in (at < low, (at >= low) & (at < high), at >= high):
        log.filter(part).write.mode("append").parquet(feed_)
        arriving = t.spark.readStream.schema(log.schema).parquet(feed_)
        jobs.workflow_into(arriving, out, checkpoint, if_match=None, initial_state="opened", buckets=16).awaitTermination()
    return t.spark.read.parquet(f"{out}/outcomes").select(
        "contract_id", "seq", "version_number", "workflow_state", big("status"), "etag"
    )


def payload_feed(events: DataFrame) -> DataFrame:
    """Events as commands with JSON payloads, every eleventh of them broken."""
    seq, kind = F.col("event_id"), F.col("event_type")
    text = seq.cast("string")
    override = F.when(seq % 3 != 0, F.concat(F.lit('"v'), text, F.lit('"'))).otherwise(F.lit("null"))
    payload = (
        F.when(seq % 11 == 0, F.lit('{"version_number": 1, '))
        .when(kind == "signup", F.concat(
            F.lit('{"contract_type": "t'), text, F.lit('", "metadata": {"n":'), text, F.lit('}'),
            F.when(seq % 2 == 0, F.lit(', "workflow_state": "PENDING_APPROVAL"')).otherwise(F.lit("")), F.lit("}")))
        .when(kind == "click", F.concat(F.lit('{"contract_text": "line '), text, F.lit('", "parameters": ["a", "b"]}')))
        .when(kind == "view", F.concat(F.lit('{"version_number": '), text, F.lit("}")))
        .when(kind == "purchase", F.concat(F.lit('{"parameter_id": '), text, F.lit(', "user_override": '), override, F.lit("}")))
    )
    command = F.create_map(*[F.lit(x) for pair in PAYLOAD_COMMANDS.items() for x in pair])
    named = F.when((kind == "error") & (seq % 2 == 0), F.lit("submit")).otherwise(command[kind])
    return events.select(
        seq.alias("seq"), "ts", F.when((kind != "signup") | (seq % 4 != 0), F.col("user_id").cast("string")).alias("contract_id"),
        named.alias("command"), F.when(seq % 5 == 0, F.lit("tag")).alias("if_match"), payload.alias("payload"),
    )


PAYLOAD_COMMANDS = {"signup": "create", "purchase": "override", "error": "approve", "click": "extract", "view": "accept"}


@query("""
SELECT event_id AS seq, event_type AS kind,
  CASE WHEN event_type = 'signup' AND event_id % 4 = 0 THEN substr(sha256('create-' || event_id), 1, 32)
    WHEN event_type <> 'purchase' THEN user_id::VARCHAR END AS contract_id,
  CASE event_type
    WHEN 'signup' THEN CASE WHEN event_id % 11 = 0 THEN '||STAGED_DRAFT' ELSE 't' || event_id || '|{"n":' || event_id || '}|'
      || CASE WHEN event_id % 2 = 0 THEN 'PENDING_APPROVAL' ELSE 'STAGED_DRAFT' END END
    WHEN 'click' THEN CASE WHEN event_id % 11 = 0 THEN '|5' ELSE 'line ' || event_id || '|2' END
    WHEN 'view' THEN CASE WHEN event_id % 11 = 0 THEN '' ELSE event_id::VARCHAR END || CASE WHEN event_id % 5 = 0 THEN '|tag' ELSE '|' END
    WHEN 'purchase' THEN CASE WHEN event_id % 11 = 0 THEN '|' ELSE event_id || '|' || CASE WHEN event_id % 3 = 0 THEN '' ELSE 'v' || event_id END END
    WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'submit' ELSE 'approve' END || CASE WHEN event_id % 5 = 0 THEN '|tag' ELSE '|' END
  END AS detail
FROM events
""")
def command_feed(t):
    """Every routed command with what its operator is given."""
    commands = feed.parsed(payload_feed(t.events))

    def rows(df, kind, *columns):
        shown = F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
        owner = F.col("contract_id") if "contract_id" in df.columns else F.lit(None).cast("string")
        return df.select("seq", F.lit(kind).alias("kind"), owner.alias("contract_id"), shown.alias("detail"))

    c = F.col
    return (
        rows(feed.creates(commands), "signup", c("contract_type"), c("metadata"), c("workflow_state"))
        .unionByName(rows(feed.extractions(commands), "click", c("text"), F.size("keys")))
        .unionByName(rows(feed.accepts(commands), "view", c("version_number"), c("if_match")))
        .unionByName(rows(feed.overrides(commands), "purchase", c("parameter_id"), c("user_override")))
        .unionByName(rows(feed.moves(commands), "error", c("command"), c("if_match")))
    )


# ---- review --------------------------------------------------------------------------------

def line_parameters(t) -> DataFrame:
    """Line items as parameters: no override where not returned, an empty one where accepted."""
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_linestatus").alias("original_extract"),
        F.when(F.col("l_returnflag") == "A", F.lit("")).when(F.col("l_returnflag") == "R", F.lit("R")).alias("user_override"),
        (1 - F.col("l_discount")).alias("combined_score"),
    )


LINES_SQL = """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  l_linestatus AS original_extract,
  CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN 'R' END AS user_override, 1 - l_discount AS combined_score
FROM lineitem"""
ACCEPTED = "user_override IS NULL AND combined_score >= 0.99"


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, original_extract,
  CASE WHEN {ACCEPTED} THEN original_extract ELSE user_override END AS user_override,
  round(CASE WHEN {ACCEPTED} THEN 1.0 ELSE combined_score END, 6) AS combined_score
FROM ({LINES_SQL})
""")
def batch_accept(t):
    return review.batch_accept(line_parameters(t)).withColumns({
        "l_linenumber": big("l_linenumber"), "combined_score": F.round("combined_score", 6),
    })


@query(f"SELECT l_orderkey, l_linenumber, count(*) AS updated FROM ({LINES_SQL}) WHERE {ACCEPTED} GROUP BY 1, 2")
def batch_accept_count(t):
    return review.accept_counts(line_parameters(t), ["l_orderkey", "l_linenumber"]).withColumn(
        "l_linenumber", big("l_linenumber")
    )


UPSERT_SQL = """
WITH p AS (SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus, l_returnflag, l_discount) AS parameter_id,
    l_orderkey::VARCHAR AS contract_id, l_linenumber::BIGINT AS version_number, l_linestatus AS original_extract,
    CASE l_returnflag WHEN 'A' THEN '' WHEN 'R' THEN 'R' END AS user_override, 1 - l_discount AS combined_score FROM lineitem),
o AS (SELECT * REPLACE (CASE WHEN parameter_id % 997 = 0 THEN 'v' || parameter_id ELSE user_override END AS user_override,
    CASE WHEN parameter_id % 997 = 0 THEN 0.25 ELSE combined_score END AS combined_score) FROM p),
a AS (SELECT *, user_override IS NULL AND combined_score >= 0.99 AND contract_id::BIGINT % 101 = 0 AND version_number = 2 AS hit FROM o)
SELECT parameter_id, contract_id, version_number, original_extract,
  CASE WHEN hit THEN original_extract ELSE user_override END AS user_override,
  round(CASE WHEN hit THEN 1.0 ELSE combined_score END, 6) AS combined_score FROM a
"""


@query(UPSERT_SQL)
def parameters_upsert(t):
    """A stored parameter table after overrides and an accept, each of which rewrites the buckets it touches."""
    lines = t.lineitem.select(
        *LINE, "l_returnflag", "l_discount", F.col("l_linestatus").alias("original_extract"),
        F.when(F.col("l_returnflag") == "A", F.lit("")).when(F.col("l_returnflag") == "R", F.lit("R")).alias("user_override"),
        (1 - F.col("l_discount")).alias("combined_score"),
    )
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "original_extract", "l_returnflag", "l_discount"]
    stored = number_rows(lines, order, "parameter_id").select(
        "parameter_id", F.col("l_orderkey").cast("string").alias("contract_id"), F.col("l_linenumber").cast("int").alias("version_number"),
        "original_extract", "user_override", "combined_score",
    )
    schema = ", ".join(f"{name} {kind}" for name, kind in stored.dtypes)
    table = upsert.parameter_table(t.spark, scratch_path(t.spark, "parameters"), schema, 32)
    table.write(stored)
    overridden = table.read().filter("parameter_id % 997 = 0").select(
        "parameter_id", F.concat(F.lit("v"), F.col("parameter_id").cast("string")).alias("user_override"),
        F.lit(0.25).alias("combined_score"), F.lit(200).alias("status"),
    )
    upsert.override_parameters(table, overridden)
    granted = t.orders.filter("o_orderkey % 101 = 0").select(F.col("o_orderkey").cast("string").alias("contract_id"), F.lit(2).alias("version_number"))
    upsert.accept_versions(table, granted)
    return table.read().withColumns({"version_number": big("version_number"), "combined_score": F.round("combined_score", 6)})


@query(f"""
WITH p AS ({LINES_SQL}),
r AS (SELECT o_orderkey, 1 + o_custkey % 9 AS version, CASE o_orderstatus WHEN 'F' THEN NULL WHEN 'O' THEN
    substr(sha256(o_orderkey::VARCHAR), 1, 32) || '-' || (1 + o_custkey % 9) || '-0' ELSE 'stale' END AS if_match FROM orders),
v AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(*) FILTER (l_suppkey % 2 = 0) AS again
  FROM p WHERE {ACCEPTED} GROUP BY 1, 2),
j AS (SELECT r.*, CASE WHEN v.l_orderkey IS NULL THEN 404 WHEN if_match = 'stale' THEN 409 ELSE 200 END AS status, n, again
  FROM r LEFT JOIN v ON v.l_orderkey = o_orderkey AND v.l_linenumber = version
  LEFT JOIN c ON c.l_orderkey = o_orderkey AND c.l_linenumber = version)
SELECT o_orderkey AS contract_id, version::BIGINT AS version_number, i AS attempt, status::BIGINT AS status,
  CASE WHEN status = 200 THEN coalesce(CASE i WHEN 0 THEN n ELSE again END, 0) END AS updated
FROM j, LATERAL (SELECT unnest(generate_series(0, o_orderkey % 3)) AS i)
""")
def batch_accept_requests(t):
    """Up to three accept requests per order, with version and tag checked first; every other supplier's line has no original."""
    requests = t.orders.select(
        F.col("o_orderkey").alias("contract_id"), (1 + F.col("o_custkey") % 9).alias("version_number"),
        F.when(F.col("o_orderstatus") == "O", ledger.etag(F.col("o_orderkey"), 1 + F.col("o_custkey") % 9, F.lit(0)))
        .when(F.col("o_orderstatus") == "P", F.lit("stale")).alias("if_match"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 3)).alias("attempt"),
    ).withColumn("seq", F.col("contract_id") * 3 + F.col("attempt"))
    parameters = line_parameters(t).withColumnsRenamed({"l_orderkey": "contract_id", "l_linenumber": "version_number"})
    parameters = parameters.withColumns({
        "version_number": big("version_number"),
        "original_extract": F.when(F.col("l_suppkey") % 2 != 0, F.col("original_extract")),
    })
    versions = parameters.select("contract_id", "version_number").distinct().withColumn(
        "etag", ledger.etag(F.col("contract_id"), F.col("version_number"), F.lit(0))
    )
    replies, _ = review.accept_requests(requests, versions, parameters)
    return replies.select("contract_id", "version_number", "attempt", big("status"), "updated")


@query(f"""
SELECT *, user_override IS NULL AND combined_score >= 0.99 AS server_accepts FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, user_override, combined_score FROM ({LINES_SQL})
  WHERE coalesce(user_override, '') = '' AND NOT (user_override IS NULL AND combined_score >= 0.99))
""")
def accept_preview_divergence(t):
    return review.accept_divergence(line_parameters(t)).select(
        "l_orderkey", big("l_linenumber"), "l_partkey", "l_suppkey", "user_override", "combined_score", "server_accepts"
    )


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
  CASE WHEN 1 - l_discount >= 0.99 THEN 'high' ELSE '' END AS review_status,
  CASE WHEN l_returnflag = 'N' THEN '--' ELSE printf('%.2f', 1 - l_discount) END AS score_label
FROM lineitem
""")
def review_status(t):
    score = 1 - F.col("l_discount")
    shown = F.when(F.col("l_returnflag") != "N", score)
    return t.lineitem.select(
        "l_orderkey", big("l_linenumber"), "l_partkey", "l_suppkey",
        scores.review_status(score).alias("review_status"), scores.score_label(shown).alias("score_label"),
    )


@query("""
SELECT a.vec_id AS parameter_id, CAST(CASE WHEN b.vec_id IS NULL THEN 404 ELSE 200 END AS BIGINT) AS status,
  CASE WHEN b.vec_id IS NOT NULL THEN round(
    0.6 * CASE a.vec_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.0 WHEN 2 THEN 14.0 / 17 ELSE 0.0 END
    + CASE WHEN a.vec_id % 4 = 3 THEN 0.0 ELSE 0.4 * list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END, 6)
  END AS combined_score
FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id - 1
""")
def override_rescore(t):
    """Each vector overrides the one before it; texts are equal, disjoint, reordered money or empty."""
    def form(*texts):
        return F.get(F.array(*[F.lit(x) for x in texts]), (F.col("vec_id") % 4).cast("int"))

    parameters = t.embeddings.select(
        (F.col("vec_id") + 1).alias("parameter_id"),
        F.get(F.array(*[F.lit(x) for x in ("$1,000.00", "aaaa", "5 million dollars", "gone")]),
              ((F.col("vec_id") + 1) % 4).cast("int")).alias("original_extract"),
        F.col("embedding").alias("vector_embed"),
    )
    # An earlier override of every row must lose to the later one.
    late = t.embeddings.select(
        F.col("vec_id").alias("parameter_id"), F.lit(2).alias("seq"),
        form("USD 1000", "bbbb", "USD 5,000,000", "").alias("user_override"), F.col("embedding").alias("override_embed"),
    )
    early = late.withColumns({"seq": F.lit(1), "user_override": F.lit("superseded")})
    return review.score_overrides(late.unionByName(early), parameters).select(
        "parameter_id", big("status"), six(F.col("combined_score"), "combined_score")
    )


# ---- documents and replies -----------------------------------------------------------------

def turn_pages(t) -> DataFrame:
    """Each turn of a conversation as a page of one piece."""
    return t.conversations.select(
        F.col("conv_id").alias("contract_id"), F.col("turn").alias("page"), F.lit(0).alias("pos"), F.col("text").alias("piece")
    )


@query("""
SELECT conv_id AS contract_id, string_agg(page_text || chr(10) || chr(10), '' ORDER BY page) AS text FROM (
  SELECT conv_id, turn // 2 AS page, string_agg(text, ' ' ORDER BY turn) AS page_text FROM conversations GROUP BY 1, 2)
GROUP BY 1
""")
def document_assembly(t):
    """Two turns to a page."""
    return layout.assemble_documents(t.conversations.select(
        F.col("conv_id").alias("contract_id"), F.floor(F.col("turn") / 2).alias("page"),
        (F.col("turn") % 2).alias("pos"), F.col("text").alias("piece"),
    ))


def chunk_sql(limit: int) -> str:
    """Greedy packing, one recursion level per paragraph (here: turn) of a document."""
    return f"""
WITH RECURSIVE p AS (
  SELECT conv_id, text AS para, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n
  FROM conversations WHERE length(trim(text)) > 0),
packed AS (
  SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS grp, 0::BIGINT AS used, false AS big FROM (SELECT DISTINCT conv_id FROM p)
  UNION ALL
  SELECT p.conv_id, p.n,
    CASE WHEN k.used > 0 AND NOT k.big AND p.size <= {limit} AND k.used + 2 + p.size <= {limit} THEN k.grp ELSE k.grp + 1 END,
    CASE WHEN k.used > 0 AND NOT k.big AND p.size <= {limit} AND k.used + 2 + p.size <= {limit} THEN k.used + 2 + p.size ELSE p.size END,
    p.size > {limit}
  FROM packed k JOIN p ON p.conv_id = k.conv_id AND p.n = k.n + 1),
groups AS (
  SELECT p.conv_id, grp, string_agg(para, chr(10) || chr(10) ORDER BY p.n) AS body
  FROM packed k JOIN p ON p.conv_id = k.conv_id AND p.n = k.n GROUP BY 1, 2),
cut AS (
  SELECT conv_id, grp, i, substr(body, i * {limit} + 1, {limit}) AS chunk
  FROM groups, LATERAL (SELECT unnest(generate_series(0, (length(body) - 1) // {limit})) AS i))
SELECT conv_id AS contract_id, row_number() OVER (PARTITION BY conv_id ORDER BY grp, i) - 1 AS chunk_no, chunk FROM cut
"""


@query(chunk_sql(300))
def document_chunks(t):
    return chunking.chunk_pieces(turn_pages(t), 300).withColumn("chunk_no", big("chunk_no"))


@query(chunk_sql(3000))
def document_chunks_default(t):
    return chunking.chunk_pieces(turn_pages(t)).withColumn("chunk_no", big("chunk_no"))


@query("""
WITH d AS (SELECT doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS body FROM documents)
SELECT doc_id, i AS chunk_no, substr(body, i * 3000 + 1, 3000) AS chunk
FROM d, LATERAL (SELECT unnest(generate_series(0, (length(body) - 1) // 3000)) AS i)
WHERE length(body) > 0
""")
def long_paragraph_slices(t):
    """Documents without blank lines: one paragraph each, cut into fixed pieces."""
    return text.chunk_documents(t.spread("documents", "doc_id", "text")).withColumn("chunk_no", big("chunk_no"))


def line_replies(t) -> DataFrame:
    """One stored reply per line item: well-formed in several shapes, or not."""
    key, name, number = F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_linenumber").cast("string")
    forms = (
        F.concat(F.lit('{"parameters": [{"key": "'), key, F.lit('", "value": '), number,
                 F.lit(', "spatial": {"page": '), number, F.lit(', "x_min": 1.5}}, 5, {"name": "'), name, F.lit('", "value": "'), number, F.lit('"}]}')),
        F.concat(F.lit('[{"value": "'), name, F.lit('"}, null, {"key": 0, "name": "", "value": [1, "'), key, F.lit('"]}]')),
        F.concat(F.lit('{"parameters": [{"key": "'), key, F.lit('", "value": 0}')),
        F.concat(F.lit('{"parameters": {"'), key, F.lit('": {}}}')),
        F.concat(F.lit('{"parameters": [{"key": "'), key, F.lit('", "value": false}, {"key": "t", "value": true}, '
                 '{"value": 1e-7}, {"value": 1e20}, {"value": 0.00001}, {"value": 1.5e2}, {"value": 12345678.25}, {"value": 0.0001}, {"value": -2.50}]}')),
    )
    # Of the five forms only a line's own is put together.
    shape = F.coalesce(*[F.when(F.col("l_partkey") % 5 == i, form) for i, form in enumerate(forms)])
    lines = t.spread("lineitem", *LINE, "l_returnflag", "l_linestatus")
    return lines.select("l_orderkey", big("l_linenumber"), "l_partkey", "l_suppkey", shape.alias("response"))


@query("""
WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, l_returnflag AS k, l_linestatus AS s, l_partkey % 5 AS shape FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0::BIGINT AS pos, k AS parameter_key, l_linenumber::VARCHAR AS value, l_linenumber AS page, 1.5::DOUBLE AS x_min FROM l WHERE shape = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, s, l_linenumber::VARCHAR, NULL, NULL FROM l WHERE shape = 0
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0, 'param_1', s, NULL, NULL FROM l WHERE shape = 1
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 2, 'param_3', '[1,"' || k || '"]', NULL, NULL FROM l WHERE shape = 1
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 0, k, '', NULL, NULL FROM l WHERE shape = 4
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 1, 't', 'True', NULL, NULL FROM l WHERE shape = 4
UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, i, 'param_' || (i + 1), number, NULL, NULL
  FROM l, (VALUES (2, '1e-07'), (3, '1e+20'), (4, '1e-05'), (5, '150.0'), (6, '12345678.25'), (7, '0.0001'), (8, '-2.5')) v(i, number) WHERE shape = 4
""")
def reply_items_parsed(t):
    box = spatial_struct(F.col("spatial"))
    return reply_items(line_replies(t)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", big("pos"), "parameter_key", "value",
        box["page"].cast("bigint").alias("page"), box["x_min"].alias("x_min"),
    )


@query("""
SELECT conv_id, role, text AS value, turn, first_turn FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn) AS rn,
    min(turn) OVER (PARTITION BY conv_id, role) AS first_turn
  FROM conversations WHERE length(trim(text)) > 0) WHERE rn = 1
""")
def reconciled_items(t):
    """The longest text per role of a conversation, earliest on ties (texts have no outer blanks)."""
    items = t.conversations.select("conv_id", "turn", "role", F.col("text").alias("value"))
    return reconcile.reconcile(items, ["conv_id"], "role", "value", "turn").select(
        "conv_id", "role", "value", "turn", F.col("first_no").alias("first_turn")
    )


STREAMED_REPLIES_SQL = """
WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_returnflag AS k, l_linestatus AS s, l_partkey % 5 AS shape,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
      CASE l_partkey % 5 WHEN 1 THEN l_linestatus || l_returnflag ELSE l_returnflag || l_linestatus END) AS chunk FROM lineitem),
items AS (
  SELECT o, chunk, 0 AS pos, k AS key, n::VARCHAR AS value FROM l WHERE shape = 0
  UNION ALL SELECT o, chunk, 2, s, n::VARCHAR FROM l WHERE shape = 0
  UNION ALL SELECT o, chunk, 0, 'param_1', s FROM l WHERE shape = 1
  UNION ALL SELECT o, chunk, 2, 'param_3', '[1,"' || k || '"]' FROM l WHERE shape = 1
  UNION ALL SELECT o, chunk, 1, 't', 'True' FROM l WHERE shape = 4
  UNION ALL SELECT o, chunk, i, 'param_' || (i + 1), number
    FROM l, (VALUES (2, '1e-07'), (3, '1e+20'), (4, '1e-05'), (5, '150.0'), (6, '12345678.25'), (7, '0.0001'), (8, '-2.5')) v(i, number)
    WHERE shape = 4)
SELECT o::VARCHAR AS contract_id, 1::BIGINT AS version_number, key AS parameter_key, value AS original_extract,
  first_no AS item_no, 1.0::DOUBLE AS combined_score FROM (
  SELECT *, row_number() OVER (PARTITION BY o, key ORDER BY length(value) DESC, chunk, pos) AS rn,
    min(chunk * 4294967296 + pos) OVER (PARTITION BY o, key) AS first_no FROM items)
WHERE rn = 1
"""


@query(STREAMED_REPLIES_SQL)
def stream_replies(t):
    """Replies to the chunks of one version per order, arriving in three parts that each hold some of its chunks."""
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "response")
    replies = line_replies(t).select(
        F.col("l_orderkey").cast("string").alias("contract_id"), F.lit(1).alias("version_number"),
        F.row_number().over(place).alias("chunk_no"), "response",
    )
    replies = extract.stored(replies, "replies")
    feed_, out, checkpoint = (scratch_path(t.spark, f"replies-{n}") for n in ("feed", "rows", "checkpoint"))
    for part in (2, 0, 1):
        replies.filter(F.col("chunk_no") % 3 == part).write.mode("append").parquet(feed_)
        arriving = t.spark.readStream.schema(replies.schema).parquet(feed_)
        stream = jobs.replies_into(arriving, out, checkpoint, buckets=16)
        stream.awaitTermination()
    _, rows = jobs.reply_tables(t.spark, out, stream.id, 16)
    return rows.read().select("contract_id", big("version_number"), "parameter_key", "original_extract", "item_no", "combined_score")


@query("""
SELECT c.conv_id, k.role, NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.role = k.role) AS missing
FROM (SELECT DISTINCT conv_id FROM conversations) c, (VALUES ('system'), ('user'), ('assistant')) k(role)
""")
def key_coverage(t):
    owners = t.conversations.select("conv_id").distinct()
    return reconcile.key_coverage(owners, t.conversations, ["conv_id"], ["system", "user", "assistant"], "role")


# ---- normalisation -------------------------------------------------------------------------

@query("""
WITH l AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS q,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, CAST(round(l_discount * 100) AS BIGINT) AS d, lower(l_returnflag) AS f, l_linenumber % 7 AS form FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE form
  WHEN 1 THEN '$' || (cents // 100) || CASE WHEN cents % 100 = 0 THEN '' ELSE '.' || lpad((cents % 100)::VARCHAR, 2, '0') END
  WHEN 2 THEN (q * 1000) || ' $'
  WHEN 3 THEN (q * 1000)::VARCHAR
  WHEN 4 THEN '£' || (d * 1000000 + 500000)
  WHEN 5 THEN (q * 1000000) || ' €'
  WHEN 6 THEN 'net ' || (q * 1000000000) || l_partkey
  ELSE f || ' £' END AS canonical
FROM l
""")
def normalize_money(t):
    q, part = F.col("l_quantity").cast("bigint").cast("string"), F.col("l_partkey").cast("string")
    d = F.round(F.col("l_discount") * 100).cast("bigint").cast("string")
    form = F.col("l_linenumber") % 7
    raw = (
        F.when(form == 1, F.concat(F.lit(" USD  "), F.format_number("l_extendedprice", 2)))
        .when(form == 2, F.concat(q, F.lit(" thousand Dollars")))
        .when(form == 3, F.concat(q, F.lit("k")))
        .when(form == 4, F.concat(F.lit("GBP "), d, F.lit(".5 Million")))
        .when(form == 5, F.concat(q, F.lit("\t m euros")))
        .when(form == 6, F.concat(F.lit("Net "), q, F.lit(" B,  "), part))
        .otherwise(F.concat(F.col("l_returnflag"), F.lit("  pounds ")))
    )
    lines = t.spread("lineitem", *LINE, "l_returnflag", "l_quantity", "l_extendedprice", "l_discount").select(
        "l_orderkey", big("l_linenumber"), "l_partkey", "l_suppkey", raw.alias("raw")
    )
    return text.normalize_text(lines, "raw", "canonical").drop("raw")


def whole_words_sql(text_sql: str, words: str, symbol: str) -> str:
    """Replace whole words, letters of any script counting as letters; twice, as neighbours share a gap."""
    gap = r"[^\p{L}\p{N}_]"
    for _ in range(2):
        text_sql = rf"regexp_replace({text_sql}, '(^|{gap})({words})($|{gap})', '\1{symbol}\3', 'g')"
    return text_sql


BLANKS_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
CANONICAL_SQL = rf"regexp_replace(lower(trim(text, {BLANKS_SQL})), '[\s\v]+', ' ', 'g')"
for _words, _symbol in (("usd|dollars?", "$"), ("eur|euros?", "€"), ("gbp|pounds?", "£")):
    CANONICAL_SQL = whole_words_sql(CANONICAL_SQL, _words, _symbol)


@query(rf"""
SELECT doc_id, trim(regexp_replace(replace(regexp_replace({CANONICAL_SQL},
  '([$,€£])\s+', '\1', 'g'), ',', ''), '\.00\b', '', 'g')) AS canonical
FROM documents
""")
def normalize_documents(t):
    return text.normalize_text(t.spread("documents", "doc_id", "text"), "text", "canonical").drop("text")


# ---- vectors -------------------------------------------------------------------------------

@query("""
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
""")
def cosine_pairs(t):
    """Each vector with its successor."""
    after = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return t.embeddings.join(after, "vec_id").select(
        "vec_id", six(vectors.cosine_similarity(F.col("embedding"), F.col("other")), "cosine")
    )


def vector_parameters(t) -> DataFrame:
    return t.embeddings.select(
        F.col("vec_id").alias("parameter_id"), F.col("label").cast("string").alias("parameter_key"),
        F.concat(F.lit("value "), F.col("vec_id").cast("string")).alias("original_extract"),
        F.col("embedding").alias("vector_embed"),
    )


def topk_sql(queries: str, k: str = "5") -> str:
    return f"""
WITH q AS ({queries}),
d AS (SELECT query_id, vec_id, label, list_distance(embedding::DOUBLE[], query_vec) AS distance FROM embeddings, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM d)
SELECT query_id, vec_id AS parameter_id, label::VARCHAR AS parameter_key, 'value ' || vec_id AS original_extract,
  round(1 / (1 + distance), 6) AS score FROM r WHERE place <= {k}
"""


@query(topk_sql("SELECT 0::BIGINT AS query_id, arg_min(embedding, vec_id)::DOUBLE[] AS query_vec FROM embeddings"))
def vector_topk(t):
    """The five stored vectors nearest to the first one."""
    first = t.embeddings.agg(F.min_by("embedding", "vec_id").alias("query_vec")).select(
        F.lit(0).cast("bigint").alias("query_id"), "query_vec"
    )
    return search.search_parameters(vector_parameters(t), first).withColumn("score", F.round("score", 6))


@query(topk_sql("""SELECT label::BIGINT AS query_id, list(mean ORDER BY i) AS query_vec FROM (
  SELECT label, i, avg(embedding[i]::DOUBLE) AS mean
  FROM embeddings, LATERAL (SELECT unnest(generate_series(1, len(embedding))) AS i) GROUP BY 1, 2) GROUP BY 1""", "query_id % 4 + 2"))
def vector_topk_batch(t):
    """The two to five stored vectors nearest to the mean of each label, all labels at once."""
    means = t.embeddings.groupBy(big("label", "query_id")).agg(
        Summarizer.mean(array_to_vector(F.col("embedding"))).alias("_mean")
    ).select("query_id", vector_to_array("_mean").alias("query_vec"), (F.col("query_id") % 4 + 2).alias("k"))
    return search.search_parameters(vector_parameters(t), means).withColumn("score", F.round("score", 6))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@query("""
SELECT count(*) AS queries, (SELECT count(*) FROM embeddings WHERE embedding IS NOT NULL) AS vectors, count(*) * 5 AS neighbours, true AS reached
FROM embeddings WHERE vec_id % 50 = 0 AND embedding IS NOT NULL
""")
def vector_cells_recall(t):
    """Approximate neighbours of every fiftieth vector among all, against the exact ones: whether nine in ten are found."""
    stored = t.embeddings.select(F.col("vec_id").alias("parameter_id"), F.col("embedding").alias("vector_embed"))
    queries = stored.filter("parameter_id % 50 = 0 AND vector_embed IS NOT NULL").select(
        F.col("parameter_id").alias("query_id"), F.col("vector_embed").alias("query_vec")
    )
    index = cells.build_cells(stored, scratch_path(t.spark, "cells"))
    found = cells.nearest_in_cells(index, queries, cells.probes_for(index, queries))
    measured = cells.recall_of(found, search.nearest(stored, queries))
    counts = queries.agg(F.count(F.lit(1)).alias("queries")), index.lists(t.spark).agg(F.count(F.lit(1)).alias("vectors"))
    for one in counts:
        measured = measured.unionByName(one, allowMissingColumns=True)
    return measured.agg(*[F.max(c).alias(c) for c in ("queries", "vectors", "neighbours")], (F.max("recall") >= 0.9).alias("reached"))


def letter_profile(df: DataFrame, source: str, target: str) -> DataFrame:
    """A small embedder that SQL can repeat: how often each letter occurs, relative to the length."""
    low = F.lower(F.col(source))
    shares = [
        (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double") / F.greatest(F.length(low), F.lit(1))
        for c in LETTERS
    ]
    return df.withColumn(target, F.array(*shares))


PROFILE_SQL = f"""list_transform(string_split('{",".join(LETTERS)}', ','),
  lambda c: (length(lower(text)) - length(replace(lower(text), c, '')))::DOUBLE / greatest(length(lower(text)), 1))"""


@query(f"""
WITH q AS (SELECT item_id, {PROFILE_SQL} AS v FROM benchmark),
d AS (SELECT doc_id, lang, {PROFILE_SQL} AS v FROM documents),
r AS (SELECT item_id, doc_id, lang, list_distance(q.v, d.v) AS distance FROM q, d)
SELECT item_id AS query_id, doc_id AS parameter_id, lang AS parameter_key, 'value ' || doc_id AS original_extract,
  round(1 / (1 + distance), 6) AS score
FROM r QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY distance, doc_id) <= 5
""")
def search_by_text(t):
    """The five documents nearest to each benchmark text, which is embedded like the documents."""
    parameters = letter_profile(t.spread("documents", "doc_id", "lang", "text"), "text", "vector_embed").select(
        F.col("doc_id").alias("parameter_id"), F.col("lang").alias("parameter_key"),
        F.concat(F.lit("value "), F.col("doc_id").cast("string")).alias("original_extract"), "vector_embed",
    )
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), "text")
    found = search.search_texts(parameters, asked, lambda df: letter_profile(df, "text", "query_vec"))
    return found.withColumn("score", F.round("score", 6))


@query("SELECT doc_id, 384::BIGINT AS width, true AS unit FROM documents")
def embed_hashing(t):
    embedded = enrich.embed_hashing(t.spread("documents", "doc_id", "text"), "text", "vector_embed")
    return embedded.select(
        "doc_id", F.size("vector_embed").cast("bigint").alias("width"),
        (F.abs(vectors.norm(F.col("vector_embed")) - 1) < 1e-3).alias("unit"),
    )


# ---- extraction ----------------------------------------------------------------------------

def planted_documents(documents: DataFrame) -> DataFrame:
    """Documents with "key: value" lines around their text, some keys twice."""
    return documents.select(
        F.col("doc_id").cast("string").alias("contract_id"),
        F.concat(
            F.lit("Payment Terms: net "), F.col("n_chars").cast("string"), F.lit("\n\n"), F.col("text"),
            F.lit("\n\ngoverning law: "), F.col("lang"), F.lit("\nGoverning Law : state of "), F.col("lang"),
            F.lit("\n\nPayment Terms: 0\n\nEffective Date:   \n\nEffective Date: "), F.col("source"), F.lit(" "),
        ).alias("text"),
    )


EXTRACT_SQL = """
SELECT doc_id::VARCHAR AS contract_id, key AS parameter_key, value AS original_extract, place FROM (
  SELECT doc_id, 'Payment Terms' AS key, 'net ' || n_chars AS value, 1 AS place FROM documents
  UNION ALL SELECT doc_id, 'Governing Law', 'state of ' || lang, 2 FROM documents
  UNION ALL SELECT doc_id, 'Effective Date', source, 3 FROM documents)
"""


@query(f"""
SELECT dense_rank() OVER (ORDER BY contract_id) AS contract_rank, contract_id, 1::BIGINT AS version_number, parameter_key,
  original_extract, NULL::VARCHAR AS user_override, 1.0::DOUBLE AS combined_score, 384::BIGINT AS width
FROM ({EXTRACT_SQL})
""")
def extract_rules(t):
    """The whole extraction job on documents with planted lines; three rows, so three ids, a contract."""
    documents = planted_documents(t.spread("documents", *DOCUMENT))
    versions = documents.select("contract_id", F.lit(1).alias("version_number"), F.lit(True).alias("is_current"))
    rows = extract.extract(documents, versions)
    return extract.with_ids(rows).select(
        F.floor((F.col("parameter_id") + 2) / 3).alias("contract_rank"), "contract_id", big("version_number"), "parameter_key", "original_extract", "user_override",
        "combined_score", F.size("vector_embed").cast("bigint").alias("width"),
    )


@query(f"SELECT contract_id, 1::BIGINT AS version_number, parameter_key, original_extract FROM ({EXTRACT_SQL})")
def stream_extract(t):
    """The same job on a stream of arriving documents."""
    documents = planted_documents(tables.spread(
        file_stream(t, "documents").select(*DOCUMENT), f"{t.folder}/documents.parquet"
    )).select(
        "contract_id", F.lit(1).alias("version_number"), "text"
    )
    out = scratch_path(t.spark, "stream-extract")
    jobs.extraction_stream(documents, out, scratch_path(t.spark, "stream-checkpoint")).awaitTermination()
    return t.spark.read.parquet(out).select("contract_id", big("version_number"), "parameter_key", "original_extract")


# ---- layout --------------------------------------------------------------------------------

PAGES_SQL = """SELECT l_orderkey AS contract_id, l_linenumber AS page, max(l_quantity) AS width, sum(l_quantity) AS height
FROM lineitem GROUP BY 1, 2"""


def line_pages(t) -> DataFrame:
    return t.lineitem.groupBy(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("page")).agg(
        F.max("l_quantity").alias("width"), F.sum("l_quantity").alias("height")
    )


@query(f"""
WITH p AS (SELECT *, coalesce(sum((height + 16)::DECIMAL(28, 9)) OVER (PARTITION BY contract_id ORDER BY page
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS page_offset FROM (SELECT * REPLACE (height * 1.1 AS height) FROM ({PAGES_SQL}))),
b AS (SELECT l_orderkey, l_partkey, l_suppkey, greatest(l_linenumber - 1, 1) AS page, l_tax * 100 AS x0, l_tax * 100 + l_discount * 200 AS x1,
  l_discount * 100 AS y0, l_discount * 100 + l_tax * 50 AS y1, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'R' THEN l_quantity END AS pw,
  CASE WHEN l_returnflag = 'R' THEN l_quantity * 2 END AS ph FROM lineitem WHERE l_suppkey % 7 <> 0),
s AS (SELECT b.*, page_offset, CASE WHEN coalesce(pw, 0) = 0 THEN 1 ELSE width / pw END AS sx, CASE WHEN coalesce(ph, 0) = 0 THEN 1 ELSE height / ph END AS sy
  FROM b JOIN p ON p.contract_id = l_orderkey AND p.page = b.page)
SELECT l_orderkey AS contract_id, l_partkey, l_suppkey, CAST(page AS BIGINT) AS page, round(x0 * sx, 6) AS "left", round(page_offset + y0 * sy, 6) AS top,
  round(greatest((x1 - x0) * sx, 6), 6) AS width, round(greatest((y1 - y0) * sy, 6), 6) AS height FROM s
""")
def box_geometry(t):
    """A box per line item, on the pages its order's lines make up; line 1 lands on page 0, some have no box."""
    own = F.col("l_returnflag")
    boxes = t.lineitem.select(
        F.col("l_orderkey").alias("contract_id"), "l_partkey", "l_suppkey", (F.col("l_linenumber") - 1).alias("page"),
        (F.col("l_tax") * 100).alias("x_min"), (F.col("l_tax") * 100 + F.col("l_discount") * 200).alias("x_max"),
        (F.col("l_discount") * 100).alias("y_min"), (F.col("l_discount") * 100 + F.col("l_tax") * 50).alias("y_max"),
        F.when(own == "A", F.lit(0.0)).when(own == "R", F.col("l_quantity")).alias("page_width"),
        F.when(own == "R", F.col("l_quantity") * 2).alias("page_height"),
    )
    boxes = boxes.withColumns({
        c: F.when(F.col("l_suppkey") % 7 != 0, F.col(c)) for c in ("page", "x_min", "x_max", "y_min", "y_max")
    })
    placed = layout.box_geometry(boxes, layout.page_offsets(line_pages(t).withColumn("height", F.col("height") * 1.1)))
    return placed.select(
        "contract_id", "l_partkey", "l_suppkey", big("page"),
        *[six(F.col(c), c) for c in ("left", "top", "width", "height")],
    )


@query(f"SELECT contract_id, sum(height) + 16 * (count(*) - 1) AS document_height FROM ({PAGES_SQL}) GROUP BY 1")
def document_heights(t):
    return layout.document_heights(line_pages(t))


# ---- audits --------------------------------------------------------------------------------

@query("""SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS copies FROM lineitem
GROUP BY 1, 2 HAVING count(*) > 1""")
def audit_duplicate_keys(t):
    return audit.duplicate_keys(t.lineitem.select("l_orderkey", big("l_linenumber")), ["l_orderkey", "l_linenumber"])


@query(f"""
SELECT l_partkey AS contract_id, NULL::BIGINT AS version_number, count(*) AS rows FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = l_partkey) GROUP BY 1
UNION ALL
SELECT user_id, event_id % 20 + 1, count(*) FROM events
WHERE NOT EXISTS (SELECT 1 FROM ({LEDGER_SQL}) v WHERE contract_id = user_id AND version_number = event_id % 20 + 1)
GROUP BY 1, 2
""")
def audit_orphans(t):
    """Contracts named by line items but unknown, and versions named by events but unknown."""
    lines = audit.orphans(
        t.lineitem.select(F.col("l_partkey").alias("contract_id")),
        t.customer.select(F.col("c_custkey").alias("contract_id")), ["contract_id"],
    )
    events = audit.orphans(
        t.events.select(F.col("user_id").alias("contract_id"), (F.col("event_id") % 20 + 1).alias("version_number")),
        order_versions(t), ["contract_id", "version_number"],
    )
    return events.unionByName(lines.withColumn("version_number", F.lit(None).cast("bigint")))


@query("""
SELECT 'text' AS column_name, 'not_null' AS rule, count(*) FILTER (text IS NULL) AS violations FROM documents
UNION ALL SELECT 'text', 'max_length', count(*) FILTER (length(text) > 200) FROM documents
UNION ALL SELECT 'lang', 'max_length', count(*) FILTER (length(lang) > 20) FROM documents
""")
def audit_rules(t):
    return audit.rule_violations(t.documents, ["text"], {"text": 200, "lang": 20})


@query("""SELECT c_custkey AS contract_id, count(*) FILTER (o_orderstatus = 'P') AS current_versions
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') <> 1""")
def audit_current_versions(t):
    """Customers as contracts, some without any version."""
    versions = t.orders.select(F.col("o_custkey").alias("contract_id"), (F.col("o_orderstatus") == "P").alias("is_current"))
    return audit.current_violations(versions, t.customer.select(F.col("c_custkey").alias("contract_id")))


@query("""WITH v AS (SELECT vec_id, CASE vec_id % 10 WHEN 0 THEN list_transform(embedding, lambda x: x * 2) WHEN 1 THEN embedding[:63]
  ELSE embedding END::DOUBLE[] AS e FROM embeddings WHERE vec_id % 10 <> 2)
SELECT vec_id, len(e)::BIGINT AS width, round(sqrt(list_dot_product(e, e)), 6) AS norm
FROM v WHERE len(e) <> 64 OR abs(sqrt(list_dot_product(e, e)) - 1) > 1e-3""")
def audit_vectors(t):
    """Vectors of width 64: of every ten, one is too long, one too narrow and one missing."""
    e, turn = F.col("embedding"), F.col("vec_id") % 10
    changed = F.when(turn == 0, F.transform(e, lambda x: x * 2)).when(turn == 1, F.slice(e, 1, 63)).when(turn != 2, e)
    rows = t.embeddings.withColumn("embedding", changed)
    return audit.vector_violations(rows, "embedding", 64).select("vec_id", big("width"), six(F.col("norm"), "norm"))
