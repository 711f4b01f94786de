"""Pending echoes in the state store: restarts, expiry, typed keys, spread keys."""

from __future__ import annotations

import time

import pytest
from helpers import as_set

from rowtide.functions.keys import comparable_pks
from rowtide.plans.spec import FieldSpec
from rowtide.streaming import echo_state
from rowtide.streaming.echo_state import pending_echoes, stream_echo_state

SCHEMA = "side string, origin string, tablename string, pks string, op string, id bigint, row_hash bigint"


def arrive(spark, inbox, rows):
    """One file of (side, key text, id) rows."""
    made = [(s, "p", "T", k, "U", n, None) for s, k, n in rows]
    spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(inbox))


def run_once(spark, tmp_path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = stream_echo_state(
        stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True, **options
    )
    query.awaitTermination()
    return as_set(spark.read.parquet(str(tmp_path / "out")), "kind", "pks", "id")


def test_pending_rows_outlive_restarts_and_cancel_in_order(spark, tmp_path):
    steps = [
        [("applied", "a", 1), ("applied", "a", 2), ("captured", "b", 3)],
        [("captured", "a", 4)],
        [("captured", "a", 5), ("captured", "a", 6), ("applied", "b", 7)],
    ]
    wanted = [[("b", 3)], [("b", 3)], [("a", 6), ("b", 3)]]
    waiting = [[("a", 1), ("a", 2)], [("a", 2)], [("b", 7)]]
    for rows, sent, held in zip(steps, wanted, waiting, strict=True):
        arrive(spark, tmp_path / "in", rows)
        # every call is a new query on the same checkpoint
        got = run_once(spark, tmp_path)
        assert [(k, n) for kind, k, n in got] == sent and {kind for kind, _, _ in got} == {"forward"}
        assert as_set(pending_echoes(spark, str(tmp_path / "cp")), "pks", "id") == held


def test_echo_that_never_comes_is_reported_and_forgotten(spark, tmp_path):
    arrive(spark, tmp_path / "in", [("applied", "a", 1), ("applied", "a", 2), ("captured", "a", 3)])
    assert run_once(spark, tmp_path, ttl_seconds=1) == []
    assert as_set(pending_echoes(spark, str(tmp_path / "cp")), "id") == [(2,)]
    time.sleep(1.5)
    arrive(spark, tmp_path / "in", [("captured", "b", 4)])
    assert run_once(spark, tmp_path, ttl_seconds=1) == [("forward", "b", 4), ("missing", "a", 2)]
    assert pending_echoes(spark, str(tmp_path / "cp")).count() == 0
    # what comes after that is a change like any other
    arrive(spark, tmp_path / "in", [("captured", "a", 5)])
    assert ("forward", "a", 5) in run_once(spark, tmp_path, ttl_seconds=1)


def test_keys_are_compared_by_value_and_spread_by_span(spark, tmp_path):
    field = FieldSpec("k", "k", True, "BIGINT", "NUMBER")
    rows = [("applied", "k;NUMBER;01;", 1), ("captured", "K;BIGINT;1;", 2), ("captured", "k;BIGINT;1;", 300)]
    arrive(spark, tmp_path / "in", [*rows, ("applied", "k;NUMBER;1;", 301)])
    got = run_once(spark, tmp_path, fields=[field], span_bits=6)
    assert got == []
    assert pending_echoes(spark, str(tmp_path / "cp")).count() == 0


def test_keys_are_taken_together_by_slots(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(echo_state, "SLOTS", 3, raising=False)
    keys = [f"k{n}" for n in range(60)]
    echoed = [("captured", k, n) for n, k in enumerate(keys) if n % 2]
    arrive(spark, tmp_path / "in", [*[("applied", k, n) for n, k in enumerate(keys)], *echoed])
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    query = stream_echo_state(stream, str(tmp_path / "out"), str(tmp_path / "cp"), once=True, ttl_seconds=1)
    query.awaitTermination()
    # one call of Python and one timer for a slot, not for each of the 30 keys that still wait
    timers = [p.stateOperators[0].customMetrics["numRegisteredTimers"] for p in query.recentProgress]
    assert 1 <= max(timers) <= 3
    assert as_set(pending_echoes(spark, str(tmp_path / "cp")), "pks", "id") == sorted(
        [(k, n) for n, k in enumerate(keys) if n % 2 == 0], key=repr
    )
    # some keys get their echo, one gets an applied row more; each of the others is given up
    time.sleep(1.5)
    arrive(spark, tmp_path / "in", [("captured", "k0", 100), ("captured", "k0", 101), ("applied", "k2", 102)])
    missing = [("missing", k, n) for n, k in enumerate(keys) if n % 2 == 0 and n]
    assert run_once(spark, tmp_path, ttl_seconds=1) == sorted([("forward", "k0", 101), *missing], key=repr)
    assert as_set(pending_echoes(spark, str(tmp_path / "cp")), "pks", "id") == [("k2", 102)]


def test_keys_of_a_slot_are_told_apart(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(echo_state, "SLOTS", 1, raising=False)
    odd = [
        ("T", "a", "U", 1, None),
        (None, "a", "U", 2, None),
        ("T", None, "U", 3, None),
        ("T", "a", None, 4, None),
        ("T", "a", "U", None, None),
        ("T", "a", "U", 5, 7),
        ("T", 'a","op":"U', "U", 6, None),
        (None, None, None, None, None),
        ("T", "", "U", 300, None),
        ("T", "\u00e4\u4e00", "U", 301, -1),
    ]
    for side, rows in [("applied", odd[::2]), ("captured", odd), ("applied", odd[1::2])]:
        made = [(side, None, *row) for row in rows]
        spark.createDataFrame(made, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run_once(spark, tmp_path, hashed=True, span_bits=0)
    columns = ["tablename", "pks", "op", "id", "row_hash"]
    assert as_set(spark.read.parquet(str(tmp_path / "out")), *columns) == sorted(odd[1::2], key=repr)
    assert as_set(pending_echoes(spark, str(tmp_path / "cp")), *columns) == sorted(odd[1::2], key=repr)


@pytest.mark.parametrize(
    "one, other, typed, alike",
    [
        ("k;NUMBER;1;", "K;BIGINT;1;", False, True),
        ("k;NUMBER;1;", "k;NUMBER;01;", False, False),
        ("k;NUMBER;1;", "k;NUMBER;01;", True, True),
        ("k,m;A,B;1,x;", "K,m;B,A;1,x;", False, True),
        ("k,m;A,B;1,x;", "m,k;B,A;1,x;", False, False),
        ("k,m;A,B;01,x;", "m,k;B,A;x,1;", True, True),
        ("k;NUMBER;none;", "k;NUMBER;none;", True, True),
        ("k;NUMBER;none;", "k;NUMBER;nine;", True, False),
        ("", "k;NUMBER;1;", True, False),
    ],
)
def test_comparable_keys(spark, one, other, typed, alike):
    fields = [FieldSpec("k", "k", True, "BIGINT", "NUMBER")] if typed else None
    if typed and "m" in one:
        fields.append(FieldSpec("m", "m", True))
    rows = spark.createDataFrame([(one, other)], "a string, b string")
    got = rows.select(comparable_pks(rows["a"], fields) == comparable_pks(rows["b"], fields)).first()[0]
    assert got is alike
