"""Approval workflow replayed from command logs, all contracts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausework.operators.ledger import ETAG_PREFIX, etag, etag_status
from clausework.operators.scan import ROWS_PER_TASK, UNKNOWN, Carry, hot_keys, reachable, running, split_hot
from clausework.schemas import ACTIVE, DRAFT, PENDING
from clausework.session import checkpointed

CREATE, SUBMIT, APPROVE, ACCEPT = "create", "submit", "approve", "accept"
# The command that stands for a contract's stored end state in front of its log.
STORED = "stored"
STATE = ["version_number", "workflow_state", "revision"]

OUTCOME = [
    T.StructField("workflow_state", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("revision", T.LongType()),
    T.StructField("etag", T.StringType()),
]


def _continued(commands: DataFrame, states: DataFrame | None, key: str, command: str) -> DataFrame:
    """The log, led by one row per stored end state; its order columns are null, which sort first."""
    if states is None:
        none = {"_v0": F.lit(None).cast("long"), "_s0": F.lit(None).cast("string"), "_r0": F.lit(None).cast("long")}
        return commands.withColumns(none)
    lead = states.filter("version_number > 0").select(
        key, F.lit(STORED).alias(command), F.col("version_number").cast("long").alias("_v0"),
        F.col("workflow_state").alias("_s0"), F.col("revision").cast("long").alias("_r0"),
    )
    return commands.unionByName(lead, allowMissingColumns=True)


def _opened(initial_state: str | None) -> Column:
    asked = F.lit(DRAFT) if initial_state is None else F.coalesce(F.col(initial_state), F.lit(DRAFT))
    return F.when(F.col("_v0").isNotNull(), F.col("_s0")).otherwise(asked)


def _versions(command: Column) -> Column:
    """What a row adds to the number of versions."""
    return F.coalesce(F.col("_v0"), F.when(command == CREATE, 1).otherwise(0).cast("long"))


def _first_revision(command: Column) -> Carry:
    """The revision that the version of a row starts from: other than 0 for the version a stored state is of."""
    return Carry("last", F.when(F.col("_v0").isNotNull(), F.col("_r0")).when(command == CREATE, 0))


def replay(
    commands: DataFrame,
    key: str = "contract_id",
    order: list[str] | None = None,
    command: str = "command",
    initial_state: str | None = None,
    with_etag: bool = False,
    rows_per_task: int = ROWS_PER_TASK,
    states: DataFrame | None = None,
) -> DataFrame:
    """Version, state and status after each command, for logs without If-Match.

    Create and submit set the state whatever it was; approve succeeds only right after a setter
    that left the contract pending. So three running values decide everything: the number of
    creates, the state the last setter left, and the kind of the previous workflow command.
    With ``states`` (``key``, version_number, workflow_state, revision), a log goes on from there.
    """
    order = order or ["ts", "seq"]
    kind = F.col(command)
    rows = _continued(commands, states, key, command)
    opened = _opened(initial_state)
    setter = F.when((kind == CREATE) | F.col("_v0").isNotNull(), opened).when(kind == SUBMIT, F.lit(PENDING))
    flow = F.when(kind.isin(CREATE, SUBMIT, APPROVE), kind)
    hot = hot_keys(commands, [key], rows_per_task)
    scanned = running(
        rows, [key], order,
        {
            "version_number": Carry("sum", _versions(kind)),
            "_set": Carry("last", setter),
            "_last": Carry("last", flow),
            "_before": Carry("last", flow, include_row=False),
            "_base": _first_revision(kind),
        },
        rows_per_task, hot,
    )
    exists = F.col("version_number") > 0
    approved = (F.col("_last") == APPROVE) & (F.col("_set") == PENDING)
    out = scanned.withColumns({
        "status": F.when(~exists, 404)
        .when((kind == APPROVE) & ((F.col("_set") != PENDING) | (F.col("_before") == APPROVE)), 400)
        .otherwise(200),
        "workflow_state": F.when(exists, F.when(approved, F.lit(ACTIVE)).otherwise(F.col("_set"))),
    })
    names = [*commands.columns, "version_number", "status", "workflow_state"]
    if not with_etag:
        return out.filter("_v0 IS NULL").select(*names)
    rotated = F.when(kind.isin(SUBMIT, APPROVE) & (F.col("status") == 200), 1).otherwise(0)
    # Without a hot contract there is no hot version.
    revised = running(
        out, [key, "version_number"], order, {"_moves": Carry("sum", rotated)}, rows_per_task,
        None if hot is None else UNKNOWN,
    ).filter("_v0 IS NULL").withColumn("revision", F.col("_moves") + F.coalesce("_base", F.lit(0)))
    return revised.select(*names, "revision").withColumn(
        "etag", F.when(exists, etag(F.col(key), F.col("version_number"), F.col("revision")))
    )


def end_states(
    replayed: DataFrame, key: str = "contract_id", order: list[str] | None = None, columns: tuple[str, ...] = tuple(STATE[:2])
) -> DataFrame:
    """Current version and state per contract after a replay; map-side combined."""
    return replayed.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.struct(*(order or ["ts", "seq"]))).alias("_end")
    ).select(key, "_end.*")


def funnel(states: DataFrame) -> DataFrame:
    """Number of contracts per workflow state."""
    return states.groupBy("workflow_state").agg(F.count(F.lit(1)).alias("contracts"))


def command_step():
    """One command against one version, as a closure so workers need no copy of this package.

    A state is (version_number, workflow_state, revision) or None when no version exists.
    """
    import hashlib

    create, submit, approve, accept = CREATE, SUBMIT, APPROVE, ACCEPT
    draft, pending, active = DRAFT, PENDING, ACTIVE
    width = ETAG_PREFIX

    def tag(contract, state):
        digest = hashlib.sha256(str(contract).encode()).hexdigest()[:width]
        return f"{digest}-{state[0]}-{state[2]}"

    def step(state, contract, command, if_match, opened=None):
        if command == create:
            return (1 if state is None else state[0] + 1, opened or draft, 0), 200
        if state is None:
            return None, 404
        if command not in (submit, approve, accept):
            return state, 200
        if if_match and if_match != tag(contract, state):
            return state, 409
        if command == accept:
            return state, 200
        if command == submit:
            return (state[0], pending, state[2] + 1), 200
        if state[1] != pending:
            return state, 400
        return (state[0], active, state[2] + 1), 200

    return step, tag


def replay_with_etags(
    commands: DataFrame,
    key: str = "contract_id",
    order: list[str] | None = None,
    command: str = "command",
    if_match: str = "if_match",
    initial_state: str | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    states: DataFrame | None = None,
) -> DataFrame:
    """Replay of logs whose submits, approves and accepts may carry If-Match.

    A create opens a new version whatever came before, so each (contract, version) is replayed on
    its own. A version none of whose submits and approves carries a tag has the closed form of
    ``replay``, and the tags of its accepts are compared as a column. Of the others, those of
    ordinary size stream through one sorted pass per task; one with more commands than
    ``rows_per_task`` is resolved by joins instead (see ``_fired``). ``states`` as in ``replay``.
    """
    order = order or ["ts", "seq"]
    kind = F.col(command)
    hot_contracts = hot_keys(commands, [key], rows_per_task)
    rows = running(
        _continued(commands, states, key, command), [key], order,
        {"version_number": Carry("sum", _versions(kind)), "_base": _first_revision(kind)},
        rows_per_task, hot_contracts,
    ).withColumn("_opened", _opened(initial_state))
    out = [*commands.columns, "version_number", "workflow_state", "status", "revision", "etag"]
    before_any = F.col("version_number") == 0
    segment = [key, "version_number"]
    tagged = kind.isin(SUBMIT, APPROVE) & (F.coalesce(F.col(if_match), F.lit("")) != "")
    hot = None if hot_contracts is None else UNKNOWN
    # Both branches below read the same exchange of the commands by contract.
    rows = running(
        rows, segment, order, {"_tagged": Carry("total", F.when(tagged, 1).otherwise(0))}, rows_per_task, hot
    )
    # The versions that need their tags settled command by command, and all the rest.
    open_rows = rows.filter("_tagged > 0 AND version_number > 0")
    done = _closed_replay(rows.filter(before_any | (F.col("_tagged") == 0)), segment, order, command, if_match, rows_per_task, hot).select(*out, "_v0")
    cold, hot, _ = split_hot(open_rows, segment, rows_per_task, hot=hot)
    done = done.unionByName(_sorted_replay(cold, segment, order, command, if_match).select(*out, "_v0"))
    if hot is not None:
        done = done.unionByName(_joined_replay(hot, segment, order, command, if_match, rows_per_task).select(*out, "_v0"))
    return done.filter("_v0 IS NULL").drop("_v0")


def _closed_replay(rows, segment, order, command, if_match, rows_per_task, hot):
    """Versions without tags on what moves them, and commands before any version."""
    kind = F.when(F.col(command) == STORED, CREATE).otherwise(F.col(command))
    flow = F.when(kind.isin(CREATE, SUBMIT, APPROVE), kind)
    setter = F.when(kind == CREATE, F.col("_opened")).when(kind == SUBMIT, F.lit(PENDING))
    stated = running(
        rows, segment, order,
        {
            "_set": Carry("last", setter),
            "_last": Carry("last", flow),
            "_before": Carry("last", flow, include_row=False),
        },
        rows_per_task, hot,
    )
    works = (kind == SUBMIT) | ((kind == APPROVE) & (F.col("_set") == PENDING) & (F.col("_before") != APPROVE))
    revised = running(
        stated.withColumn("_works", F.coalesce(works, F.lit(False))), segment, order,
        {"_moves": Carry("sum", F.when(F.col("_works"), 1).otherwise(0))}, rows_per_task, hot,
    )
    exists = F.col("version_number") > 0
    now = etag(*[F.col(c) for c in segment], F.col("revision"))
    state = F.when((F.col("_last") == APPROVE) & (F.col("_set") == PENDING), F.lit(ACTIVE)).otherwise(F.col("_set"))
    return revised.withColumn("revision", F.when(exists, F.col("_moves") + F.col("_base"))).withColumns({
        "workflow_state": F.when(exists, state),
        "status": F.when(~exists, 404)
        .when(kind == ACCEPT, etag_status(F.col(if_match), now))
        .when(kind.isin(SUBMIT, APPROVE) & ~F.col("_works"), 400)
        .otherwise(200),
        "etag": F.when(exists, now),
    })


def _sorted_replay(rows, segment, order, command, if_match):
    """Rows of a version arrive in order; the pass holds one state, never a group."""
    step, tag = command_step()
    key, stored = segment[0], STORED

    def fold(batches):
        at = state = None
        for pdf in batches:
            states, statuses, revisions, tags = [], [], [], []
            for contract, version, what, match, opened, revision in zip(
                pdf[key], pdf["version_number"], pdf[command], pdf[if_match], pdf["_opened"], pdf["_base"]
            ):
                if at != (contract, version):
                    at, state = (contract, version), (version - 1, None, 0)
                if what == stored:
                    state, status = (version, opened, int(revision)), 200
                else:
                    state, status = step(
                        state, contract, what, match if isinstance(match, str) else None, opened
                    )
                states.append(state[1])
                statuses.append(status)
                revisions.append(state[2])
                tags.append(tag(contract, state))
            yield pdf.assign(workflow_state=states, status=statuses, revision=revisions, etag=tags)

    schema = T.StructType([*rows.schema.fields, *OUTCOME])
    return rows.repartition(*segment).sortWithinPartitions(*segment, *order).mapInPandas(fold, schema)


def _joined_replay(rows, segment, order, command, if_match, rows_per_task):
    """Replay of versions too long for one task.

    Once it is known which commands with If-Match take effect, the others fall out of the log and
    the closed form of ``replay`` holds for what is left. Revisions are counted from ``_base``, where
    the version starts.
    """
    kind = F.when(F.col(command) == STORED, CREATE).otherwise(F.col(command))
    moves = kind.isin(SUBMIT, APPROVE)
    conditional = moves & (F.coalesce(F.col(if_match), F.lit("")) != "")
    # The revision a tag asks for; null for tags that are no tag of this version.
    number = F.element_at(F.split(F.col(if_match), "-"), -1).try_cast("long")
    asked = F.when(conditional & (etag(*[F.col(c) for c in segment], number) == F.col(if_match)), number - F.col("_base"))
    free = F.when(moves & ~conditional, kind)
    lined = running(
        rows.withColumn("_asked", asked), segment, order,
        {
            "_pos": Carry("sum", F.lit(1)),
            "_run": Carry("sum", F.when(free.isNotNull(), 1).otherwise(0)),
            "_free": Carry("last", free),
            "_free_before": Carry("last", free, include_row=False),
        },
        rows_per_task,
    )
    # What free commands alone would do: a submit always works, an approve right after a submit.
    works = (free == SUBMIT) | ((free == APPROVE) & (F.col("_free_before") == SUBMIT))
    lined = checkpointed(running(
        lined, segment, order, {"_worked": Carry("sum", F.when(works, 1).otherwise(0))}, rows_per_task
    ))
    fired = _fired(lined, segment, kind, free, rows_per_task).withColumn("_fired", F.lit(True))
    known = lined.join(fired, [*segment, "_pos"], "left")
    acts = (kind == CREATE) | free.isNotNull() | F.col("_fired").isNotNull()
    flow = F.when(acts & kind.isin(CREATE, SUBMIT, APPROVE), kind)
    setter = F.when(acts & (kind == CREATE), F.col("_opened")).when(acts & (kind == SUBMIT), F.lit(PENDING))
    stated = running(
        known.withColumn("_acts", acts), segment, order,
        {
            "_set": Carry("last", setter),
            "_last": Carry("last", flow),
            "_before": Carry("last", flow, include_row=False),
        },
        rows_per_task,
    )
    pending = (F.col("_set") == PENDING) & (F.col("_before") != APPROVE)
    moved = F.col("_acts") & ((kind == SUBMIT) | ((kind == APPROVE) & pending))
    revised = running(
        stated.withColumn("_moved", F.coalesce(moved, F.lit(False))), segment, order,
        {"_moves": Carry("sum", F.when(F.col("_moved"), 1).otherwise(0))}, rows_per_task,
    ).withColumn("revision", F.col("_moves") + F.col("_base"))
    return revised.withColumns({
        "workflow_state": F.when((F.col("_last") == APPROVE) & (F.col("_set") == PENDING), F.lit(ACTIVE)).otherwise(
            F.col("_set")
        ),
        # An accept changes neither state nor revision, but its tag is checked.
        "status": F.when(kind == ACCEPT, etag_status(F.col(if_match), etag(*[F.col(c) for c in segment], F.col("revision"))))
        .when(~moves | F.col("_moved"), 200)
        .when(F.col("_acts") | F.col("_asked").eqNullSafe(F.col("_moves")), 400)
        .otherwise(409),
        "etag": etag(*[F.col(c) for c in segment], F.col("revision")),
    })


def _fired(lined, segment, kind, free, rows_per_task):
    """Positions of the commands with If-Match that take effect.

    After such a command (or the create) the revision and state are known, and between it and the
    next one only free commands act, whose effect differs from ``_worked`` by a constant settled at
    the first of them. So each has one successor, found by an equality key and the next position;
    the chain from the create is then walked in doubling steps.
    """
    is_root = kind == CREATE
    nodes = lined.filter(is_root | F.col("_asked").isNotNull()).select(
        *segment, "_pos", "_run", "_worked", "_free", "_asked", kind.alias("_kind"),
        F.when(is_root, 0).otherwise(F.col("_asked") + 1).alias("_after"),
        F.when(is_root, F.col("_opened") == PENDING).otherwise(kind == SUBMIT).alias("_pending"),
    )
    first_free = lined.filter(free.isNotNull()).select(
        *segment, (F.col("_run") - 1).alias("_run"), F.col("_pos").alias("_free_pos"), free.alias("_free_kind")
    )
    nodes = checkpointed(nodes.join(first_free, [*segment, "_run"], "left"))
    submit_before = F.coalesce(F.col("_free") == SUBMIT, F.lit(False))
    shift = F.when(
        F.col("_free_kind") == APPROVE, F.col("_pending").cast("int") - submit_before.cast("int")
    ).otherwise(0)
    none = F.lit(None).cast("long")

    def side(rows, near, run, key, at, pos, submit):
        return rows.select(
            *segment, F.lit(near).alias("_near"), run.alias("_at_run"), key.alias("_key"),
            (-at).alias("_back"), pos.alias("_offer"), submit.alias("_submit"), F.col("_pos"), F.col("_pending"),
        )

    offers = nodes.filter("_asked IS NOT NULL")
    is_submit = F.col("_kind") == SUBMIT
    no_run = F.lit(-1).cast("long")
    lines = (
        # Before the next free command: same run, the very next revision.
        side(offers, True, F.col("_run"), F.col("_asked"), F.col("_pos"), F.col("_pos"), is_submit)
        .unionByName(side(nodes, True, F.col("_run"), F.col("_after"), F.col("_pos"), none, F.lit(False)))
        # Behind it: the revision relative to the free commands' own count.
        .unionByName(side(
            offers.filter(is_submit | submit_before), False, no_run,
            F.col("_asked") - F.col("_worked"), F.col("_pos"), F.col("_pos"), is_submit,
        ))
        .unionByName(side(
            nodes.filter("_free_pos IS NOT NULL"), False, no_run,
            F.col("_after") - F.col("_worked") + shift, F.col("_free_pos"), none, F.lit(False),
        ))
    )
    found = running(
        lines, [*segment, "_near", "_at_run", "_key"], ["_back"],
        {
            "_any": Carry("last", F.col("_offer"), include_row=False),
            "_by_submit": Carry("last", F.when(F.col("_submit"), F.col("_offer")), include_row=False),
        },
        rows_per_task,
    ).filter("_offer IS NULL")
    follower = F.when(~F.col("_near") | F.col("_pending"), F.col("_any")).otherwise(F.col("_by_submit"))
    jump = checkpointed(
        found.withColumn("_next", follower).filter("_next IS NOT NULL").groupBy(*segment, "_pos").agg(
            F.max_by("_next", "_near").alias("_next")
        )
    )
    return reachable(nodes.filter("_asked IS NULL").select(*segment, "_pos"), jump, segment)
