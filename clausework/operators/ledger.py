"""Contracts and versions: insertion, numbering, lookup and preconditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausework.operators.scan import ROWS_PER_TASK, UNKNOWN, Carry, hot_keys, lookup, running
from clausework.schemas import DRAFT, FULL_PARAMETER_VIEW, SHORT_PARAMETER_VIEW, VERSION_VIEW

# Longest etag: 32 + 1 + 10 + 1 + 19 = 63 characters, within the declared 64.
ETAG_PREFIX = 32


def etag(contract: Column, version: Column, revision: Column) -> Column:
    """Reproducible tag of one revision of one version: contract digest, version, revision."""
    digest = F.substring(F.sha2(contract.cast("string"), 256), 1, ETAG_PREFIX)
    return F.concat_ws("-", digest, version.cast("string"), revision.cast("string"))


def version_view(versions: DataFrame) -> DataFrame:
    return versions.select(*VERSION_VIEW)


def short_parameters(parameters: DataFrame) -> DataFrame:
    return parameters.select(*SHORT_PARAMETER_VIEW)


def parameter_listing(
    parameters: DataFrame,
    requested: DataFrame,
    keys=("contract_id", "version_number"),
    view=None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Parameters of the requested versions, ordered by id."""
    wanted = requested.select(*keys).distinct()
    columns = list(dict.fromkeys([*keys, *(view or FULL_PARAMETER_VIEW)]))
    found = lookup(parameters.select(*columns), wanted, list(keys), rows_per_task=rows_per_task)
    return found.orderBy("parameter_id")


def first_arrivals(incoming: DataFrame, key: str, order: str) -> DataFrame:
    """The first row per key by ``order``, combined map-side."""
    return incoming.groupBy(key).agg(
        F.min_by(F.struct(*[c for c in incoming.columns if c != key]), order).alias("_first")
    ).select(key, "_first.*")


def name_contracts(incoming: DataFrame, order: str, key: str = "contract_id", feed: str = "") -> DataFrame:
    """Create requests without an id (null or '') get one of their own, reproducibly from ``feed`` and the unique ``order``.

    Feeds that count from the same number need different names, or their requests would share ids.
    """
    lead = f"create-{feed}-" if feed else "create-"
    own = F.substring(F.sha2(F.concat(F.lit(lead), F.col(order).cast("string")), 256), 1, 32)
    return incoming.withColumn(key, F.coalesce(F.nullif(F.col(key), F.lit("")), own))


def insert_if_absent(
    contracts: DataFrame, incoming: DataFrame, order: str, key: str = "contract_id", feed: str = ""
) -> DataFrame:
    """Contracts plus the first arrival of every unknown id; known rows stay as they are.

    Text ids may be missing: such a request always makes a contract (see ``name_contracts``).
    """
    if dict(incoming.dtypes)[key] == "string":
        incoming = name_contracts(incoming, order, key, feed)
    # Reduced map-side to one row per id first, so an id posted over and over cannot skew the join.
    arrivals = first_arrivals(incoming, key, order)
    fresh = arrivals.join(contracts.select(key), key, "left_anti").select(*contracts.columns)
    return contracts.unionByName(fresh)


def next_version(
    requests: DataFrame,
    versions: DataFrame,
    key: str = "contract_id",
    version: str = "version_number",
    rows_per_task: int = ROWS_PER_TASK,
    hot=UNKNOWN,
) -> DataFrame:
    """Each request with ``next_version``: highest existing number plus one."""
    highest = versions.groupBy(key).agg(F.max(version).alias("_highest"))
    return lookup(requests, highest, [key], "left", rows_per_task, hot).select(
        *requests.columns,
        (F.coalesce(F.col("_highest"), F.lit(0)) + 1).alias("next_version"),
    )


def version_ledger(feed: DataFrame, key: str, order: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Number the rows of each key in ``order``; only the last one is current."""
    one = F.lit(1)
    numbered = running(
        feed, [key], order,
        {"version_number": Carry("sum", one), "_versions": Carry("total", one)},
        rows_per_task,
    )
    return numbered.withColumn("is_current", F.col("version_number") == F.col("_versions")).drop("_versions")


def create_versions(
    requests: DataFrame,
    versions: DataFrame,
    order: list[str],
    created_at: Column | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The version table after all create requests (contract_id, workflow_state, ``order``).

    New versions start empty: nothing is copied from earlier ones.
    """
    one = F.lit(1)
    hot = hot_keys(requests, ["contract_id"], rows_per_task)
    numbered = running(
        requests, ["contract_id"], order,
        {"_nth": Carry("sum", one), "_all": Carry("total", one)}, rows_per_task, hot,
    )
    number = (F.col("next_version") + F.col("_nth") - 1).cast("int")
    fresh = next_version(numbered, versions, rows_per_task=rows_per_task, hot=hot).select(
        "contract_id",
        number.alias("version_number"),
        F.coalesce(F.col("workflow_state"), F.lit(DRAFT)).alias("workflow_state"),
        (F.col("_nth") == F.col("_all")).alias("is_current"),
        etag(F.col("contract_id"), number, F.lit(0)).alias("etag"),
        (F.current_timestamp().cast("timestamp_ntz") if created_at is None else created_at).alias("created_at"),
    )
    touched = requests.select("contract_id").distinct().withColumn("_touched", F.lit(True))
    older = lookup(versions, touched, ["contract_id"], "left", rows_per_task).select(
        *[
            (F.col("is_current") & F.col("_touched").isNull()).alias(c) if c == "is_current" else F.col(c)
            for c in versions.columns
        ]
    )
    return older.unionByName(fresh)


def current_version(versions: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The latest row per key by ``order``; partial aggregation, no window."""
    return versions.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(*order)).alias("_current")
    ).select(key, "_current.*")


def lookup_versions(
    requests: DataFrame,
    versions: DataFrame,
    keys=("contract_id", "version_number"),
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Requests with the version's columns and ``status``: 200, 404, or 500 where a key has several rows.

    Several rows are an error, not several answers; their columns stay null. The grouping shuffles
    by the keys of the join, so it costs no exchange of its own.
    """
    others = [c for c in versions.columns if c not in keys]
    found = versions.groupBy(*keys).agg(
        F.first(F.struct(F.lit(1).alias("_one"), *others)).alias("_v"), F.count(F.lit(1)).alias("_rows")
    )
    joined = lookup(requests, found, list(keys), "left", rows_per_task)
    status = F.when(F.col("_rows").isNull(), F.lit(404)).when(F.col("_rows") > 1, F.lit(500)).otherwise(F.lit(200))
    return joined.select(
        *requests.columns, *[F.when(F.col("_rows") == 1, F.col(f"_v.{c}")).alias(c) for c in others], status.alias("status")
    )


def listing_status(requested: DataFrame, versions: DataFrame, keys=("contract_id", "version_number")) -> DataFrame:
    """What a listing of each requested version answers: 200 (also without parameters), 404 or 500."""
    return lookup_versions(requested.select(*keys).distinct(), versions.select(*keys), keys)


def etag_status(if_match: Column, current: Column) -> Column:
    """409 when a non-empty If-Match differs from the current tag, else 200."""
    return F.when((F.coalesce(if_match, F.lit("")) != "") & ~if_match.eqNullSafe(current), F.lit(409)).otherwise(
        F.lit(200)
    )
