from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from helpers import as_set
from pyspark.sql import functions as F

from rowtide.operators.changelog import collapse, run_batches
from rowtide.operators.compare import classify, dedupe, dedupe_rare, inserts, updates
from rowtide.operators.numbering import number_rows, paginate
from rowtide.operators.sequences import sequence_plan, sequence_reconciled
from rowtide.operators.twoway import suppress_echo
from rowtide.operators.writeback import (
    append,
    conflicts,
    delete_by_key,
    flip_flag,
    merge,
    move,
    update_by_key,
    upsert,
)

T = "k int, j string, v string"


@pytest.fixture
def pair(spark):
    target = spark.createDataFrame([(1, "a", "old"), (1, "b", "keep"), (2, "a", "old")], T)
    rows = spark.createDataFrame([(1, "a", None), (3, "a", "new")], T)
    return target, rows


PK = ["k", "j"]


def test_null_overwrites_and_composite_key(pair):
    target, rows = pair
    want = [(1, "a", None), (1, "b", "keep"), (2, "a", "old"), (3, "a", "new")]
    for operator in (upsert, merge):
        got = operator(target, rows, PK)
        assert as_set(got) == sorted(want, key=repr)
        assert as_set(operator(got, rows, PK)) == sorted(want, key=repr)
    assert as_set(update_by_key(target, rows, PK)) == sorted(want[:3], key=repr)
    assert as_set(append(target, rows, PK)) == as_set(target.union(rows.where("k = 3")))
    assert as_set(conflicts(target, rows, PK)) == [(1, "a", None)]
    assert as_set(delete_by_key(target, rows, PK)) == sorted(want[1:3], key=repr)


def test_unmapped_columns_survive(spark, pair):
    target, rows = pair
    wide = target.withColumn("own", F.concat("k", "j"))
    want = [(1, "a", None, "1a"), (1, "b", "keep", "1b"), (2, "a", "old", "2a"), (3, "a", "new", None)]
    for operator in (upsert, merge):
        assert as_set(operator(wide, rows, PK)) == sorted(want, key=repr)
    assert as_set(append(wide, rows, PK).where("k = 3")) == [(3, "a", "new", None)]


def test_empty_sides(spark, pair):
    target, rows = pair
    none = target.limit(0)
    assert as_set(upsert(none, rows, PK)) == as_set(rows)
    assert as_set(merge(none, rows, PK)) == as_set(rows)
    assert as_set(upsert(target, none, PK)) == as_set(target)
    assert as_set(merge(target, none, PK)) == as_set(target)
    assert {r["op"] for r in classify(rows, none, PK).collect()} == {"I"}
    assert classify(none, target, PK).count() == 0


def test_classify_splits_source_exactly(spark):
    source = spark.range(500).selectExpr("id AS k", "id % 7 AS v")
    target = spark.range(200, 900).selectExpr("id AS k", "id % 3 AS v")
    ops = classify(source, target, ["k"])
    assert ops.where("op = 'I'").count() == inserts(source, target, ["k"]).count() == 200
    assert ops.where("op = 'U'").count() == updates(source, target, ["k"]).count() == 300
    # both sides of one table, and a table compared with its own classification
    again = classify(ops.drop("op"), ops, ["k"])
    assert {r["op"] for r in again.select("op").distinct().collect()} == {"U"}
    three = classify(source, target, ["k"], only_changed=True).groupBy("op").count().collect()
    same = sum(1 for i in range(200, 500) if i % 7 == i % 3)
    assert {r["op"]: r["count"] for r in three} == {"I": 200, "U": 300 - same, "=": same}


def test_move_and_flip(spark):
    source = spark.createDataFrame([(1, "x", 0), (2, "y", 0), (3, "z", 5)], "k int, v string, f short")
    target = spark.createDataFrame([(2, "old", 9)], "k int, v string, f short")
    new, left = move(source, target, source.where("k < 3"), ["k"])
    assert as_set(new) == [(1, "x", 0), (2, "y", 0)] and as_set(left) == [(3, "z", 5)]
    flipped = flip_flag(source, source.where("k = 1"), ["k"], "f", 1)
    assert as_set(flipped) == [(1, "x", 1), (2, "y", 0), (3, "z", 5)]
    assert flipped.schema["f"].dataType.simpleString() == "smallint"


def test_dedupe_keeps_one_and_accounts_for_the_rest(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "c"), (None, "n"), (None, "n"), (3, None), (3, "z")]
    df = spark.createDataFrame(rows, "k int, v string")
    kept, rejected = dedupe(df, ["k"], ["v"])
    assert as_set(kept) == sorted([(1, "a"), (2, "c"), (3, None)], key=repr)
    want = [(1, "a", 1), (1, "b", 1), (3, "z", 1), (None, "n", 2)]
    assert as_set(rejected) == sorted(want, key=repr)
    latest = dedupe(df, ["k"], ["v"], latest=True)[0]
    assert as_set(latest) == sorted([(1, "b"), (2, "c"), (3, "z")], key=repr)
    for last in (False, True):
        one, two = dedupe(df, ["k"], ["v"], latest=last), dedupe_rare(df, ["k"], ["v"], latest=last)
        assert as_set(one[0]) == as_set(two[0]) and as_set(one[1]) == as_set(two[1])
    only_keys = dedupe(df.select("k"), ["k"], [])
    assert as_set(only_keys[0]) == [(1,), (2,), (3,)]
    assert as_set(only_keys[1]) == sorted([(1, 2), (3, 1), (None, 2)], key=repr)


def test_dedupe_hot_key_with_different_rows(spark):
    hot = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS k", "id AS v")
    kept, rejected = dedupe(hot, ["k"], ["v"])
    total = kept.count() + rejected.agg(F.sum("copies")).first()[0]
    assert total == 30_000 and kept.where("k = 7").collect() == [(7, 0)]


@pytest.mark.parametrize("bits", [0, 2, 20])
def test_numbering_by_buckets(spark, bits):
    ids = random.Random(1).sample(range(-300, 3000), 400)
    df = spark.createDataFrame([(i,) for i in ids], "k bigint")
    got = as_set(number_rows(df, ["k"], bits=bits))
    assert sorted(got) == [(k, n) for n, k in enumerate(sorted(ids), 1)]


def test_numbering_by_range(spark):
    names = [f"{i % 37:02d}" for i in range(500)]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "s string, i int").repartition(5)
    got = {(r["s"], r["i"]): (r["row_no"], r["page_no"]) for r in paginate(df, ["s", "i"], 7).collect()}
    want = sorted((n, i) for i, n in enumerate(names))
    assert got == {key: (n, (n - 1) // 7 + 1) for n, key in enumerate(want, 1)}
    # equal keys: any order among them, but each number once
    hot = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END AS s")
    numbers = [r["row_no"] for r in number_rows(hot, ["s"]).collect()]
    assert sorted(numbers) == list(range(1, 3001))


def _random_log(seed: int, n: int = 600):
    pick = random.Random(seed)
    ids = pick.sample(range(1, 5 * n), n)
    hot = lambda: "T0" if pick.random() < 0.5 else pick.choice(["T1", "T2", "T3"])
    return sorted((i, hot(), f"k;N;{pick.choice([1, 1, 2, 3, 4])};", pick.choice("IUD")) for i in ids)


LOG = "id bigint, tablename string, pks string, op string"


@pytest.mark.parametrize("mixed", [False, True])
@pytest.mark.parametrize("bits", [3, 6, 20])
def test_runs_match_a_plain_loop(spark, mixed, bits):
    rows = _random_log(bits)
    df = spark.createDataFrame(rows, LOG)
    if mixed:
        got = run_batches(df, by=("op", "tablename"), partition=(), bits=bits)
    else:
        got = run_batches(df, bits=bits)
    last, number, want = {}, Counter(), {}
    for i, table, _, op in rows:
        group, value = ("all", (op, table)) if mixed else (table, op)
        if last.get(group) != value:
            number[group] += 1
        last[group] = value
        want[i] = number[group]
    assert {r["id"]: r["run_no"] for r in got.collect()} == want


def test_collapse_matches_a_plain_loop_and_composes(spark):
    rows = _random_log(3)
    df = spark.createDataFrame(rows, LOG)
    want = {}
    for i, table, pks, op in rows:
        deleted = want.get((table, pks), (None, None, False))[2]
        want[table, pks] = (op, i, deleted or op == "D")
    once = collapse(df, ["tablename", "pks"])
    assert {(r[0], r[1]): tuple(r[2:]) for r in once.collect()} == want
    twice = collapse(once, ["tablename"])
    assert as_set(twice) == as_set(collapse(df, ["tablename"]))


@pytest.mark.parametrize("bits", [2, 5, 20])
def test_echo_matches_a_plain_loop(spark, bits):
    captured, applied = _random_log(11), _random_log(12, 250)
    budget = Counter(row[1:] for row in applied)
    want = []
    for row in captured:
        if budget[row[1:]]:
            budget[row[1:]] -= 1
        else:
            want.append(row)
    one, two = spark.createDataFrame(captured, LOG), spark.createDataFrame(applied, LOG)
    assert as_set(suppress_echo(one, two, bits=bits)) == sorted(want, key=repr)
    left = suppress_echo(two, one, bits=bits)
    assert Counter(tuple(r[1:]) for r in left.collect()) == +budget


def test_echo_needs_matching_hash(spark):
    schema = LOG + ", row_hash bigint"
    captured = [(1, "T", "a", "U", 10), (2, "T", "b", "U", 10), (3, "T", "c", "D", None)]
    applied = [(9, "t", "a", "U", 10), (9, "t", "b", "U", 99), (9, "t", "c", "D", None)]
    one, two = spark.createDataFrame(captured, schema), spark.createDataFrame(applied, schema)
    assert as_set(suppress_echo(one, two, hashed=True)) == [(2, "T", "b", "U", 10)]
    assert suppress_echo(one, two).count() == 0


def test_sequences(spark):
    schema = "name string, last_number int, increment_by int, cache_size int, currval int"
    src = [("EQ", 5, 1, 1, 0), ("BEHIND", 10, 1, 1, 0), ("AHEAD", 10, 1, 1, 0), ("CUR", 10, 1, 20, 7)]
    tgt = [("eq", 5, 1, 1, 3), ("behind", 47, 1, 1, 0), ("ahead", 9, 1, 1, 0), ("cur", 90, 1, 20, 3)]
    a, b = spark.createDataFrame(src, schema), spark.createDataFrame(tgt, schema)
    plan = {r["name"]: tuple(r)[1:] for r in sequence_plan(a, b).collect()}
    assert plan["EQ"] == ("last_number", 5, 5, None, 0, "none", None)
    assert plan["BEHIND"] == ("last_number", 10, 47, "source", 37, "temporary", 1)
    assert plan["AHEAD"] == ("last_number", 10, 9, "target", 1, "single", None)
    assert plan["CUR"] == ("currval", 7, 3, "target", 4, "temporary", 1)
    done = {r["name"]: (r["src_value"], r["tgt_value"]) for r in sequence_reconciled(a, b).collect()}
    assert done == {"EQ": (5, 5), "BEHIND": (47, 47), "AHEAD": (10, 10), "CUR": (7, 7)}


def test_counts_per_group_of_random_log_add_up(spark):
    rows = _random_log(5)
    got = defaultdict(int)
    for r in run_batches(spark.createDataFrame(rows, LOG), bits=4).collect():
        got[r["tablename"]] = max(got[r["tablename"]], r["run_no"])
    assert sum(got.values()) >= 4
