"""Replay by collapse against a row-by-row replay in id order."""

from __future__ import annotations

import random

import pytest
from helpers import as_set

from rowtide.operators.replay import (
    apply_policy,
    policies,
    replay,
    replay_many,
    unreadable_keys,
)
from rowtide.plans.spec import SyncJob, TableSpec

LOG = "id bigint, dbname string, tablename string, pks string, op string, op_time timestamp_ntz"


def spec(source="t", **policy) -> TableSpec:
    return TableSpec.from_dict(
        {
            "source": source,
            "target": source + "_copy",
            "fields": [
                {"source": "id", "target": "k", "pk": True, "jdbc_type": "BIGINT"},
                {"source": "v", "target": "w"},
            ],
            **policy,
        }
    )


def naive(source: dict, target: dict, log: list, insert_only: bool, deletable: bool) -> dict:
    state = dict(target)
    for key, op in log:
        if op == "D":
            if deletable:
                state.pop(key, None)
        elif op == "U" and insert_only:
            continue
        elif key in source and not (insert_only and key in state):
            state[key] = source[key]
    return state


def world(seed: int, keys: int = 300):
    pick = random.Random(seed)
    source, target, log = {}, {}, []
    for key in range(keys):
        ops = [pick.choice("IUD") for _ in range(pick.randint(0, 4))]
        log += [(key, op) for op in ops]
        # a key whose last op was a delete is gone from the source, unless a later
        # insert has not reached the log yet
        if pick.random() < (0.1 if ops and ops[-1] == "D" else 0.8):
            source[key] = f"s{key}"
        if pick.random() < 0.5:
            target[key] = f"t{key}"
    pick.shuffle(log)
    return source, target, log


def frames(spark, source, target, log, table="T"):
    a = spark.createDataFrame(list(source.items()) or [(None, None)], "id bigint, v string")
    b = spark.createDataFrame(list(target.items()) or [(None, None)], "k bigint, w string")
    rows = [(n, "db", table, f"ID;NUMBER;{k};", op, None) for n, (k, op) in enumerate(log, 1)]
    return a.na.drop(), b.na.drop(), spark.createDataFrame(rows, LOG)


@pytest.mark.parametrize("insert_only", [False, True])
@pytest.mark.parametrize("deletable", [False, True])
def test_replay_equals_naive(spark, insert_only, deletable):
    source, target, log = world(seed=insert_only * 2 + deletable)
    want = naive(source, target, log, insert_only, deletable)
    # a put of a vanished row, after a delete, removes what the target holds: the
    # loop above does the same, because the delete came first
    a, b, frame = frames(spark, source, target, log)
    got = replay(a, b, frame, spec(insert_only=insert_only, target_deletable=deletable))
    assert as_set(got) == sorted(want.items(), key=repr)


def test_named_cases(spark):
    one = spec(insert_only=True, target_deletable=True)
    cases = {
        "insert then update": ([(1, "I"), (1, "U")], {1: "s"}, {}, {1: "s"}),
        "delete then insert": ([(1, "D"), (1, "I")], {1: "s"}, {1: "t"}, {1: "s"}),
        "insert of a present key": ([(1, "I")], {1: "s"}, {1: "t"}, {1: "t"}),
        "row gone after its insert": ([(1, "I")], {}, {1: "t"}, {1: "t"}),
        "row gone, deleted before": ([(1, "D"), (1, "I")], {}, {1: "t"}, {}),
    }
    for name, (log, source, target, want) in cases.items():
        a, b, frame = frames(spark, source, target, log)
        assert as_set(replay(a, b, frame, one)) == sorted(want.items()), name


def test_empty_log_changes_nothing(spark):
    a, b, _ = frames(spark, {1: "s"}, {2: "t"}, [(1, "I")])
    assert as_set(replay(a, b, spark.createDataFrame([], LOG), spec())) == [(2, "t")]


def test_guard_keeps_late_rows_from_undoing_newer_ones(spark):
    a, b, log = frames(spark, {1: "s"}, {1: "s"}, [(1, "D")])
    one = spec(target_deletable=True)
    applied = spark.createDataFrame([(1, 5)], "k bigint, last_id bigint")
    assert as_set(replay(a, b, log, one, applied=applied)) == [(1, "s")]
    assert as_set(replay(a, b, log, one)) == []


def test_unreadable_keys_are_reported_not_applied(spark):
    a, b, log = frames(spark, {1: "s"}, {}, [(1, "I")])
    odd = spark.createDataFrame([(9, "db", "t", "id;NUMBER;oops;", "I", None)], LOG)
    both = log.union(odd)
    assert as_set(replay(a, b, both, spec())) == [(1, "s")]
    assert [r["id"] for r in unreadable_keys(both, spec()).collect()] == [9]


def test_many_tables_and_foreign_rows(spark):
    job = SyncJob("j", "db_cf", tables=(spec("p", seqnumber=1, target_deletable=True), spec("c", seqnumber=2)))
    a, b, log_p = frames(spark, {1: "s"}, {1: "t", 2: "t"}, [(1, "U"), (2, "D")], "P")
    _, _, log_c = frames(spark, {}, {}, [(1, "U"), (2, "D")], "C")
    _, _, other = frames(spark, {}, {}, [(2, "I")], "ELSEWHERE")
    log = log_p.union(log_c.selectExpr("id + 10 AS id", "dbname", "tablename", "pks", "op", "op_time"))
    got = replay_many({"p": a, "c": a}, {"p_copy": b, "c_copy": b}, log.union(other), job)
    assert list(got) == ["p_copy", "c_copy"]
    assert as_set(got["p_copy"]) == [(1, "s")]
    assert as_set(got["c_copy"]) == [(1, "s"), (2, "t")]
    kept = apply_policy(log.union(other), policies(spark, job.tables))
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 11]
