import random

import pytest
from pyspark.sql import functions as F

from clausework.operators.workflow import command_step, end_states, funnel, replay, replay_with_etags

LOG = "seq long, ts long, contract_id string, command string, if_match string, opened string"
GOLDEN = [
    (["submit"], [404], (0, None)),
    (["create", "approve"], [200, 400], (1, "STAGED_DRAFT")),
    (["create", "submit", "approve", "approve"], [200, 200, 200, 400], (1, "PRODUCTION_ACTIVE")),
    (["create", "submit", "approve", "submit"], [200] * 4, (1, "PENDING_APPROVAL")),
    (["create", "submit", "create", "approve"], [200, 200, 200, 400], (2, "STAGED_DRAFT")),
]


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("run", [replay, replay_with_etags])
def test_golden(spark, run):
    rows = [
        (i, i, f"c{case}", command, None, None)
        for case, (commands, _, _) in enumerate(GOLDEN)
        for i, command in enumerate(commands)
    ]
    done = run(log(spark, rows)).cache()
    got = {(r.contract_id, r.seq): r.status for r in done.collect()}
    ends = {r.contract_id: (r.version_number, r.workflow_state) for r in end_states(done).collect()}
    for case, (_, statuses, end) in enumerate(GOLDEN):
        assert [got[f"c{case}", i] for i in range(len(statuses))] == statuses
        assert ends[f"c{case}"] == end
    states = {r.workflow_state: r.contracts for r in funnel(end_states(done)).collect()}
    assert states == {None: 1, "STAGED_DRAFT": 2, "PRODUCTION_ACTIVE": 1, "PENDING_APPROVAL": 1}


def random_log(seed, size, contracts, creates, with_tags):
    """A log whose tags are often right, taken from a step-by-step run, plus that run's outcome."""
    rng = random.Random(seed)
    step, tag = command_step()
    states, rows, expected = {}, [], {}
    for seq in range(size):
        # The first contract holds most of the commands.
        contract = "c0" if rng.random() < 0.7 else f"c{rng.randrange(contracts)}"
        command = rng.choices(
            ["create", "submit", "approve", "extract", "accept"], [creates, 1, 1, 0.3, 0.5]
        )[0]
        state = states.get(contract)
        opened = rng.choice([None, "PENDING_APPROVAL", "OTHER"]) if command == "create" else None
        match = None
        if with_tags and rng.random() < 0.7:
            guess = state and (state[0], state[1], max(0, state[2] + rng.choice([0, 0, 0, 1, -1, 2])))
            match = tag(contract, guess) if guess else "x-1-0"
            match = rng.choice([match, match, match, "", "other"])
        rows.append((seq, seq // 3, contract, command, match, opened))
        state, status = step(state, contract, command, match, opened)
        states[contract] = state
        expected[seq] = (status, *(state or (0, None, None)), state and tag(contract, state))
    rng.shuffle(rows)
    return rows, expected


def outcome(df):
    return {
        r.seq: (r.status, r.version_number, r.workflow_state, r.revision, r.etag) for r in df.collect()
    }


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40])
def test_replay_equals_steps(spark, rows_per_task):
    rows, expected = random_log(1, 400, 6, 0.1, False)
    done = replay(log(spark, rows), initial_state="opened", with_etag=True, rows_per_task=rows_per_task)
    done = done.withColumn("revision", F.when(F.col("version_number") > 0, F.col("revision")))
    assert outcome(done) == expected


@pytest.mark.parametrize("seed,creates,rows_per_task", [(2, 0.1, 2_000_000), (3, 0.005, 60), (4, 0.03, 60)])
def test_replay_with_etags_equals_steps(spark, seed, creates, rows_per_task):
    rows, expected = random_log(seed, 400, 4, creates, True)
    assert {v[0] for v in expected.values()} >= {200, 400, 409}
    done = replay_with_etags(log(spark, rows), initial_state="opened", rows_per_task=rows_per_task)
    assert outcome(done) == expected
