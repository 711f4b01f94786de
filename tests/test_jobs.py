"""Stores, drivers and streams, end to end on small tables."""

from __future__ import annotations

import datetime as dt
import glob
import os
import random
import time

import pytest
from helpers import as_set, plan_of
from pyspark.sql import functions as F

from rowtide.operators.changelog import capture_changes
from rowtide.operators.slices import next_position, time_slices
from rowtide.operators.writeback import merge, upsert
from rowtide.plans import jobs
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.sources.jdbc import Connection, read_options
from rowtide.sources.log import LOG_SCHEMA, read_log_stream
from rowtide.sources.snapshots import (
    Bucketing,
    CommitConflict,
    Parts,
    SnapshotStore,
    load_checkpoint,
    save_checkpoint,
)
from rowtide.streaming import streams


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


@pytest.fixture
def stores(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "a")), SnapshotStore(spark, str(tmp_path / "b"))


def frame(spark, rows, schema="id bigint, v string"):
    return spark.createDataFrame(rows, schema)


# -- stores ---------------------------------------------------------------------------


def test_store_publishes_all_tables_at_once(spark, stores):
    store, _ = stores
    assert store.version == 0 and not store.has("x")
    assert store.read("x", schema="id bigint").count() == 0
    with pytest.raises(LookupError):
        store.read("x")
    store.commit({"x": frame(spark, [(1, "a")]), "y": frame(spark, [(2, "b")])}, job="j", batch_id=4)
    assert (store.version, as_set(store.read("x"))) == (1, [(1, "a")])
    before = store.read("x")
    # a new state may be built from the one it replaces
    store.commit({"x": store.read("x").union(frame(spark, [(3, "c")]))})
    assert as_set(store.read("x")) == [(1, "a"), (3, "c")]
    assert as_set(before) == [(1, "a")] and as_set(store.read("x", version=1)) == [(1, "a")]
    assert as_set(store.read("y")) == [(2, "b")]
    # batches published before change nothing, whatever they bring
    assert not store.commit({"x": frame(spark, [])}, job="j", batch_id=4)
    assert not store.commit({"x": frame(spark, [])}, job="j", batch_id=3)
    assert store.commit({"y": frame(spark, [])}, job="other", batch_id=3)
    assert as_set(store.read("x")) == [(1, "a"), (3, "c")]


def test_store_appends(spark, stores):
    store, _ = stores
    for n in range(3):
        store.commit(appends={"log": frame(spark, [(n, "x")])})
    assert as_set(store.read("log")) == [(0, "x"), (1, "x"), (2, "x")]
    files = glob.glob(store.path + "/log/*/*.parquet")
    assert all(os.path.getsize(f) for f in files) and len(store.manifest()["tables"]["log"]["folders"]) == 3


def test_failed_write_leaves_the_old_state(spark, stores):
    store, _ = stores
    store.commit({"x": frame(spark, [(1, "a")])})
    bad = frame(spark, [(1, "a")]).withColumn("v", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit({"x": bad, "y": frame(spark, [(1, "a")])})
    assert store.version == 1 and not store.has("y")


def test_half_written_publication_is_ignored(spark, stores):
    store, _ = stores
    store.commit({"x": frame(spark, [(1, "a")])})
    open(store.path + "/_published/2", "w").close()
    assert store.version == 1
    store.commit({"x": frame(spark, [(2, "b")])})
    assert store.version == 3 and as_set(store.read("x")) == [(2, "b")]


def test_second_writer_of_a_table_is_refused(spark, stores):
    store, _ = stores
    store.commit({"x": frame(spark, [(1, "a")])})
    mine = SnapshotStore(spark, store.path)
    write = mine._write

    def slow(table, df):
        entry = write(table, df)
        store.commit({"x": frame(spark, [(9, "z")])})
        return entry

    mine._write = slow
    with pytest.raises(CommitConflict):
        mine.commit({"x": frame(spark, [(2, "b")])})
    assert as_set(store.read("x")) == [(9, "z")]


def test_commit_knows_what_it_was_made_from(spark, stores):
    store, _ = stores
    store.commit({"x": frame(spark, [(1, "a")])})
    base = store.version
    mine = store.read("x").where("id > 1").union(frame(spark, [(2, "b")]))
    # appended rows are kept ...
    store.commit(appends={"x": frame(spark, [(3, "c")])})
    store.commit({"x": mine}, base=base)
    assert as_set(store.read("x")) == [(2, "b"), (3, "c")]
    # ... but a table that was rewritten is not overwritten
    base = store.version
    store.commit({"x": frame(spark, [(9, "z")])})
    with pytest.raises(CommitConflict):
        store.commit({"x": mine}, base=base)
    assert as_set(store.read("x")) == [(9, "z")]


def test_job_plans_again_when_its_source_was_rewritten(spark, stores, monkeypatch):
    a, b = stores
    schema = "id bigint, v string, done int"
    a.commit({"t": frame(spark, [(1, "x", 0)], schema)})
    one = spec(flag={"name": "done", "before": 0, "after": 1})
    commit, raced = a.commit, []

    def slow(*args, **kwargs):
        if not raced:
            raced.append(True)
            commit({"t": frame(spark, [(1, "x", 0), (2, "y", 0)], schema)})
        return commit(*args, **kwargs)

    monkeypatch.setattr(a, "commit", slow)
    jobs.run(SyncJob("j", "db_bj", tables=(one,)), a, b)
    assert as_set(a.read("t")) == [(1, "x", 1), (2, "y", 1)]
    assert as_set(b.read("t_copy")) == [(1, "x"), (2, "y")]


def test_bucketed_target_is_not_shuffled(spark, stores):
    _, plain = stores
    store = SnapshotStore(spark, plain.path, {"x": Bucketing(("k",), 4)})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.commit({"x": spark.range(1000).selectExpr("id AS k", "id AS v")})
        rows = spark.range(900, 1100).selectExpr("id AS k", "-id AS v")
        for operator in (upsert, merge):
            new = operator(store.read("x"), rows, ["k"])
            assert new.where("v < 0").count() == 200 and new.count() == 1100
            plan = plan_of(operator(store.read("x"), rows, ["k"]))
            scans = plan.split("Scan parquet ")
            assert "Bucketed: true" in plan or "SelectedBucketsCount: 4 out of 4" in plan
            # only the incoming rows are exchanged
            assert plan.count("hashpartitioning(k") <= (2 if operator is upsert else 1), plan
            assert len(scans) > 1
        store.commit({"x": upsert(store.read("x"), rows, ["k"])})
        assert store.read("x").count() == 1100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_checkpoints(stores):
    store, _ = stores
    assert load_checkpoint(store, "j", "t") is None
    for n in (1, 2):
        save_checkpoint(store, "j", {"t": dt.datetime(2024, 1, n), "u": dt.datetime(2023, 1, n)}, n)
    assert load_checkpoint(store, "j", "t") == dt.datetime(2024, 1, 2)
    assert load_checkpoint(store, "j", "u") == dt.datetime(2023, 1, 2)
    assert load_checkpoint(store, "other", "t") is None


def test_jdbc_options():
    conn = Connection("jdbc:vendor://host/db", {"user": "u"})
    plain = read_options(conn, "t", key="id", bounds=(1, 9), partitions=1)
    assert "partitionColumn" not in plain and plain["user"] == "u"
    split = read_options(conn, "t", key="id", bounds=(1, 9), partitions=4)
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"]) == ("id", "1", "9")
    assert split["numPartitions"] == "4" and split["fetchsize"] == "10000"
    # an empty table has no bounds to split by
    assert "partitionColumn" not in read_options(conn, "t", key="id", bounds=(None, None), partitions=4)


# -- drivers --------------------------------------------------------------------------


def flux_of(store):
    rows = store.read(jobs.FLUX_TABLE).collect()
    return {r["source_table_name"]: (r["cycle"], r["count_i"], r["count_u"], r["count_d"]) for r in rows}


def test_full_job(spark, stores):
    a, b = stores
    a.commit(
        {
            "p": frame(spark, [(1, "x"), (2, "y"), (2, "z"), (None, "n")]),
            "c": frame(spark, [(5, "q"), (6, "r")]),
        }
    )
    b.commit({"p_copy": frame(spark, [(1, "old")], "k bigint, w string")})
    job = SyncJob(
        "j", "db_qb", tables=(spec("p", seqnumber=1), spec("c", seqnumber=2, delete_source=True))
    )
    jobs.run(job, a, b)
    assert as_set(b.read("p_copy")) == [(1, "x"), (2, "y")]
    assert as_set(b.read("c_copy")) == [(5, "q"), (6, "r")]
    assert a.read("c").count() == 0 and a.read("p").count() == 4
    assert flux_of(b) == {"p": (1, 1, 1, 0), "c": (1, 2, 0, 0)}
    errors = b.read(jobs.ERROR_TABLE).select("pk_value", "audit_error")
    assert as_set(errors) == [
        ("", "key is missing"),
        ("id;BIGINT;2;", "duplicate key, copies: 1"),
    ]
    jobs.run(job, a, b)
    assert as_set(b.read("p_copy")) == [(1, "x"), (2, "y")]
    assert flux_of(b) == {"p": (2, 0, 2, 0), "c": (2, 0, 0, 0)}


def test_insert_only_job_appends(spark, stores):
    a, b = stores
    a.commit({"t": frame(spark, [(1, "new"), (2, "new")])})
    b.commit({"t_copy": frame(spark, [(1, "old")], "k bigint, w string")})
    jobs.run(SyncJob("j", "db_qb", tables=(spec(insert_only=True, delete_source=True),)), a, b)
    assert as_set(b.read("t_copy")) == [(1, "old"), (2, "new")]
    assert len(b.manifest()["tables"]["t_copy"]["folders"]) == 2
    # what the target refused stays at the source
    assert as_set(a.read("t")) == [(1, "new")]


def test_unreadable_values_are_rejected_not_blanked(spark, stores):
    a, b = stores
    a.commit({"t": frame(spark, [("1", "x"), ("oops", "y")], "id string, v string")})
    jobs.run(SyncJob("j", "db_qb", tables=(spec(),)), a, b)
    assert as_set(b.read("t_copy")) == [(1, "x")]
    assert as_set(b.read(jobs.ERROR_TABLE).select("audit_error")) == [("unreadable value: id",)]


def test_marker_job(spark, stores):
    a, b = stores
    rows = [(1, "x", 0), (2, "y", 1), (3, "z", 0), (3, "zz", 0)]
    a.commit({"t": frame(spark, rows, "id bigint, v string, done int")})
    one = spec(flag={"name": "done", "before": 0, "after": 1})
    jobs.run(SyncJob("j", "db_bj", tables=(one,)), a, b)
    assert as_set(b.read("t_copy")) == [(1, "x"), (3, "z")]
    # a key with a rejected duplicate is not marked as done
    assert as_set(a.read("t")) == [(1, "x", 1), (2, "y", 1), (3, "z", 0), (3, "zz", 0)]


DATED = TableSpec.from_dict(
    {
        "source": "t",
        "target": "t_copy",
        "marker": "at",
        "fields": [
            {"source": "id", "pk": True, "jdbc_type": "BIGINT"},
            {"source": "at", "jdbc_type": "TIMESTAMP"},
        ],
    }
)


def at(second: float) -> dt.datetime:
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=second)


def dated(spark, *rows):
    return frame(spark, [(i, at(s)) for i, s in rows], "id bigint, at timestamp_ntz")


def test_date_marker_job(spark, stores):
    a, b = stores
    job = SyncJob("j", "db_sjbj", tables=(DATED,))
    a.commit({"t": dated(spark, (1, 0), (2, 59), (3, 60), (4, 130))})
    jobs.run(job, a, b)
    # slices 0 and 1 are over, the one holding second 130 is still open
    assert as_set(b.read("t_copy"), "id") == [(1,), (2,), (3,)]
    assert load_checkpoint(b, "j", "t") == at(120)
    jobs.run(job, a, b)
    assert b.read("t_copy").count() == 3 and load_checkpoint(b, "j", "t") == at(120)
    a.commit({"t": a.read("t").union(dated(spark, (5, 179), (6, 500)))})
    jobs.run(job, a, b)
    assert as_set(b.read("t_copy"), "id") == [(1,), (2,), (3,), (4,), (5,)]
    assert load_checkpoint(b, "j", "t") == at(480)


def test_slices_do_not_depend_on_the_time_zone(spark):
    night = dt.datetime(2024, 3, 10, 1, 0)  # clocks change in New York an hour later
    rows = [(n, night + dt.timedelta(minutes=n)) for n in range(0, 180, 7)]
    answers = []
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        df = frame(spark, rows, "id bigint, at timestamp_ntz")
        answers.append((as_set(time_slices(df, "at")), next_position(df, "at").first()[0]))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert answers[0] == answers[1]
    assert [r[2] for r in sorted(answers[0][0], key=lambda r: r[0])] == list(range(0, 175, 7))


def log_rows(spark, rows, table="T"):
    rows = [(n, "db", table, f"id;NUMBER;{k};", op, at(n)) for n, k, op in rows]
    return spark.createDataFrame(rows, LOG_SCHEMA)


def test_cdc_job_acknowledges_exactly_what_it_took(spark, stores):
    a, b = stores
    a.commit(
        {
            "t": frame(spark, [(1, "x"), (2, "y")]),
            "log": log_rows(spark, [(1, 1, "I"), (2, 2, "I"), (3, 9, "D")]).union(
                log_rows(spark, [(2, 5, "I")], "OTHER")
            ),
        }
    )
    b.commit({"t_copy": frame(spark, [(9, "gone")], "k bigint, w string")})
    job = SyncJob("j", "db_cf", source_log="log", tables=(spec(target_deletable=True),))
    jobs.run(job, a, b, limit=2)
    assert as_set(b.read("t_copy")) == [(1, "x"), (2, "y"), (9, "gone")]
    assert as_set(a.read("log"), "id", "tablename") == [(2, "OTHER"), (3, "T")]
    jobs.run(job, a, b)
    assert as_set(b.read("t_copy")) == [(1, "x"), (2, "y")]
    assert as_set(a.read("log"), "id", "tablename") == [(2, "OTHER")]
    assert flux_of(b) == {"t": (2, 0, 0, 1)}


def test_what_the_policy_forbids_is_skipped_and_acknowledged(spark, stores):
    a, b = stores
    bad = log_rows(spark, [(3, 0, "I")]).withColumn("pks", F.lit("id;NUMBER;what;"))
    a.commit(
        {
            "t": frame(spark, [(1, "new")]),
            "log": log_rows(spark, [(1, 1, "U"), (2, 1, "D")]).union(bad),
        }
    )
    b.commit({"t_copy": frame(spark, [(1, "old")], "k bigint, w string")})
    job = SyncJob("j", "db_cf", source_log="log", tables=(spec(insert_only=True),))
    jobs.run(job, a, b)
    assert as_set(b.read("t_copy")) == [(1, "old")] and a.read("log").count() == 0
    errors = b.read(jobs.ERROR_TABLE).select("pk_value", "audit_error")
    assert as_set(errors) == [("id;NUMBER;what;", "unreadable key in the change log")]


def test_cdc_repeats_after_a_crash_before_the_acknowledgement(spark, stores, monkeypatch):
    a, b = stores
    a.commit({"t": frame(spark, [(1, "x")]), "log": log_rows(spark, [(1, 1, "I")])})
    job = SyncJob("j", "db_cf", source_log="log", tables=(spec(),))

    def crash(*_):
        raise RuntimeError("crash")

    with monkeypatch.context() as m:
        m.setattr(jobs, "_ack", crash)
        with pytest.raises(RuntimeError):
            jobs.run(job, a, b, cycle=1)
    # more rows arrive before the cycle is repeated under its old number
    a.commit({"t": frame(spark, [(1, "x"), (2, "y")])}, appends={"log": log_rows(spark, [(2, 2, "I")])})
    jobs.run(job, a, b, cycle=1)
    assert as_set(b.read("t_copy")) == [(1, "x"), (2, "y")] and a.read("log").count() == 0


PAIR = SyncJob(
    "pair",
    "db_sx",
    source_log="log",
    target_log="log",
    tables=(spec(target_deletable=True),),
)


def capture(spark, store, table, old, new, one, reverse, first_id, when):
    """Commit a new state of one side together with its captured log."""
    log = capture_changes(
        old, new, one, reverse=reverse, first_id=first_id, op_time=when, with_hash=True
    )
    store.commit({table: new}, appends={"log": log})


def test_two_way_settles_without_echo(spark, stores):
    a, b = stores
    one = PAIR.tables[0]
    start_a = frame(spark, [(n, f"v{n}") for n in range(20)])
    start_b = start_a.toDF("k", "w")
    a.commit({"t": start_a})
    b.commit({"t_copy": start_b})
    new_a = frame(spark, [(n, "A" if n % 5 == 0 else f"v{n}") for n in range(1, 22)])
    new_b = frame(spark, [(n, "B" if n % 7 == 0 else f"v{n}") for n in range(20) if n != 3], "k bigint, w string")
    capture(spark, a, "t", start_a, new_a, one, False, 1, at(10))
    capture(spark, b, "t_copy", start_b, new_b, one, True, 1, at(20))
    jobs.run(PAIR, a, b)
    assert as_set(a.read("t")) == as_set(b.read("t_copy"))
    state = {r["id"]: r["v"] for r in a.read("t").collect()}
    assert 3 not in state and state[5] == "A" and state[7] == "B" and state[21] == "v21"
    # key 0 was deleted on side a and changed on side b, later: b wins
    assert state[0] == "B"
    assert a.read("log").count() == 0 and b.read("log").count() == 0

    # now both captures see what was written on behalf of the other side
    settled_a, settled_b = a.read("t"), b.read("t_copy")
    capture(spark, a, "t", new_a, settled_a, one, False, 100, at(30))
    capture(spark, b, "t_copy", new_b, settled_b, one, True, 100, at(30))
    assert a.read("log").count() > 0 and b.read("log").count() > 0
    jobs.run(PAIR, a, b)
    # ... and nothing is sent back
    assert as_set(a.read("t")) == as_set(settled_a) and as_set(b.read("t_copy")) == as_set(settled_b)
    assert flux_of(b)["t"][1:] == (0, 0, 0)
    assert a.read("t__applied").count() == 0 and b.read("t_copy__applied").count() == 0


def test_two_way_repeats_after_a_crash_between_the_sides(spark, stores, monkeypatch):
    a, b = stores
    one = PAIR.tables[0]
    start_a = frame(spark, [(n, f"v{n}") for n in range(10)])
    start_b = start_a.toDF("k", "w")
    a.commit({"t": start_a})
    b.commit({"t_copy": start_b})
    new_a = frame(spark, [(n, "A" if n < 3 else f"v{n}") for n in range(10) if n != 9])
    new_b = frame(spark, [(n, "B" if n in (2, 5) else f"v{n}") for n in range(10)], "k bigint, w string")
    capture(spark, a, "t", start_a, new_a, one, False, 1, at(10))
    capture(spark, b, "t_copy", start_b, new_b, one, True, 1, at(20))
    with monkeypatch.context() as m:
        m.setattr(a, "commit", lambda *_, **__: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            jobs.run(PAIR, a, b, cycle=1)
    # side b has been written, side a has not
    assert as_set(a.read("t")) == as_set(new_a) and b.read("t_copy").count() == 9
    jobs.run(PAIR, a, b, cycle=1)
    want = [(0, "A"), (1, "A"), (2, "B"), (3, "v3"), (4, "v4"), (5, "B"), (6, "v6"), (7, "v7"), (8, "v8")]
    assert as_set(a.read("t")) == want and as_set(b.read("t_copy")) == want
    assert a.read("log").count() == 0 and b.read("log").count() == 0


def test_sequences_job(spark):
    schema = "name string, last_number int, increment_by int, cache_size int"
    src = spark.createDataFrame([("S1", 10, 1, 1), ("S9", 1, 1, 1)], schema)
    tgt = spark.createDataFrame([("t1", 4, 1, 1), ("S9", 9, 1, 1)], schema)
    job = SyncJob.from_dict(
        {"name": "j", "apptype": "db_xl", "sequences": [{"source": "s1", "target": "t1"}]}
    )
    rows = jobs.run(job, src, tgt).collect()
    assert [(r["name"], r["side"], r["delta"], r["step"]) for r in rows] == [("S1", "target", 6, "temporary")]


# -- streams ----------------------------------------------------------------------------


def drop_files(spark, folder, frames):
    for df in frames:
        df.coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_cdc_stop_and_restart(spark, stores, tmp_path):
    pick = random.Random(4)
    rows = [(n, pick.randint(0, 9), pick.choice("IUD")) for n in range(1, 61)]
    source = frame(spark, [(k, f"s{k}") for k in range(0, 10, 2)])
    start = frame(spark, [(k, "old") for k in range(10)], "k bigint, w string")
    job = SyncJob("j", "db_cf", tables=(spec(target_deletable=True),))
    results = []
    for name, cuts in (("once", [60]), ("pieces", [15, 40, 60])):
        a = SnapshotStore(spark, str(tmp_path / name / "a"))
        b = SnapshotStore(spark, str(tmp_path / name / "b"))
        a.commit({"t": source})
        b.commit({"t_copy": start})
        inbox, done = tmp_path / name / "log", 0
        for upto in cuts:
            drop_files(spark, inbox, [log_rows(spark, rows[done:upto])])
            done = upto
            log = read_log_stream(spark, str(inbox), max_files=1)
            streams.stream_cdc(log, a, b, job, str(tmp_path / name / "cp"), once=True).awaitTermination()
        results.append(as_set(b.read("t_copy")))
        newest = {}
        for n, k, _ in rows:
            newest[k] = n
        applied = b.read("t_copy__applied").groupBy("k").agg(F.max("last_id"))
        assert as_set(applied) == sorted(newest.items())
    assert results[0] == results[1]


def test_stream_cdc_old_file_arriving_late(spark, stores, tmp_path):
    a, b = stores
    a.commit({"t": frame(spark, [(1, "s")])})
    job = SyncJob("j", "db_cf", tables=(spec(target_deletable=True),))
    inbox = tmp_path / "log"
    for rows in ([(5, 1, "I")], [(2, 1, "D")]):
        drop_files(spark, inbox, [log_rows(spark, rows)])
        log = read_log_stream(spark, str(inbox))
        streams.stream_cdc(log, a, b, job, str(tmp_path / "cp"), once=True).awaitTermination()
    assert as_set(b.read("t_copy")) == [(1, "s")]


def test_published_batch_is_not_applied_again(spark, stores):
    a, b = stores
    a.commit({"t": frame(spark, [(1, "s")])})
    job = SyncJob("j", "db_cf", tables=(spec(),))
    for n in range(2):
        jobs.apply_log(job, log_rows(spark, [(1, 1, "I")]), a, b, cycle=7, batch_id=7, stream="s")
        if n == 0:
            version = b.version
    assert b.version == version


def test_new_stream_does_not_skip_batches_of_an_old_one(spark, stores, tmp_path):
    _, b = stores
    job = SyncJob("j", "db_qb", tables=(spec(only_once=True),))
    for n in (1, 2):
        inbox = tmp_path / f"in{n}"
        drop_files(spark, inbox, [frame(spark, [(n, "x")])])
        stream = spark.readStream.schema("id bigint, v string").parquet(str(inbox))
        streams.stream_full(stream, b, job, job.tables[0], str(tmp_path / f"cp{n}")).awaitTermination()
    assert as_set(b.read("t_copy")) == [(1, "x"), (2, "x")]


def test_stream_keeps_polling_until_stopped(spark, stores, tmp_path):
    _, b = stores
    job = SyncJob("j", "db_qb", tables=(spec(),), interval=1)
    inbox = tmp_path / "in"
    drop_files(spark, inbox, [frame(spark, [(1, "x")])])
    stream = spark.readStream.schema("id bigint, v string").parquet(str(inbox))
    run = streams.stream_full(stream, b, job, job.tables[0], str(tmp_path / "cp"))
    try:
        run.processAllAvailable()
        drop_files(spark, inbox, [frame(spark, [(1, "y"), (2, "z")])])
        run.processAllAvailable()
    finally:
        run.stop()
    assert as_set(b.read("t_copy")) == [(1, "y"), (2, "z")]


def test_polling_runs_the_job_again_and_again(spark, stores, tmp_path):
    a, b = stores
    one = spec(flag={"name": "done", "before": 0, "after": 1})
    job = SyncJob("j", "db_bj", tables=(one,), interval=1)
    schema = "id bigint, v string, done int"
    a.commit({"t": frame(spark, [(1, "x", 0)], schema)})
    run = streams.poll(job, a, b, str(tmp_path / "cp"))

    def until(rows):
        for _ in range(60):
            if b.has("t_copy") and as_set(b.read("t_copy")) == rows and run.isActive:
                return
            time.sleep(0.5)
        raise AssertionError(run.exception())

    try:
        until([(1, "x")])
        # an application adds a row while the job keeps rewriting the flags
        a.commit(appends={"t": frame(spark, [(2, "y", 0)], schema)})
        until([(1, "x"), (2, "y")])
    finally:
        run.stop()


def test_stream_date_marker_waits_and_diverts_late_rows(spark, stores, tmp_path):
    _, b = stores
    job = SyncJob("j", "db_sjbj", tables=(DATED,))
    inbox = tmp_path / "in"
    steps = [
        ([(1, 0), (2, 30)], [], []),
        ([(3, 59), (4, 130)], [1, 2, 3], []),
        ([(5, 110), (6, 131), (7, 200)], [1, 2, 3, 4, 6], ["id;BIGINT;5;"]),
    ]
    for rows, copied, late in steps:
        drop_files(spark, inbox, [dated(spark, *rows)])
        stream = spark.readStream.schema("id bigint, at timestamp_ntz").parquet(str(inbox))
        streams.stream_date_marker(stream, b, job, DATED, str(tmp_path / "cp"), once=True).awaitTermination()
        target = b.read("t_copy", schema="id bigint, at timestamp_ntz")
        assert as_set(target, "id") == [(i,) for i in copied]
        errors = b.read(jobs.ERROR_TABLE, schema=jobs.FLUX_SCHEMA + ", pk_value string")
        assert [r["pk_value"] for r in errors.collect()] == late


def test_stream_echo_carries_pending_rows(spark, stores, tmp_path):
    store, _ = stores
    schema = "side string, origin string, tablename string, pks string, op string, id bigint, row_hash bigint"

    def batch(*rows):
        return spark.createDataFrame([(s, "p", "T", k, "U", n, None) for s, k, n in rows], schema)

    inbox = tmp_path / "in"
    steps = [
        batch(("applied", "a", 1), ("applied", "a", 2), ("captured", "b", 3)),
        batch(("captured", "a", 4)),
        batch(("captured", "a", 5), ("captured", "a", 6), ("applied", "b", 7)),
    ]
    for df in steps:
        drop_files(spark, inbox, [df])
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        streams.stream_echo(stream, store, "e", str(tmp_path / "cp"), once=True).awaitTermination()
    assert as_set(store.read(streams.FORWARDED), "pks", "id") == [("a", 6), ("b", 3)]
    assert as_set(store.read(streams.PENDING_ECHO), "pks", "id") == [("b", 7)]


# -- tables kept in parts -----------------------------------------------------------------


def folders(store, table):
    return store.manifest()["tables"][table]["parts"]


def test_only_touched_parts_are_rewritten(spark, stores):
    a, plain = stores
    b = SnapshotStore(spark, plain.path, {"t_copy": Parts(("k",), span_bits=4)})
    a.commit({"t": frame(spark, [(n, f"s{n}") for n in range(100)])})
    b.commit({"t_copy": frame(spark, [(n, "old") for n in range(90)], "k int, w string")})
    before = folders(b, "t_copy")
    assert sorted(map(int, before)) == list(range(6))
    changes = [(1, 3, "U"), (2, 17, "D"), (3, 99, "I")]
    a.commit({"log": log_rows(spark, changes)})
    job = SyncJob("j", "db_cf", source_log="log", tables=(spec(target_deletable=True),))
    a.commit({"t": a.read("t").where("id <> 17")})
    jobs.run(job, a, b)
    want = {n: "old" for n in range(90) if n != 17} | {3: "s3", 99: "s99"}
    assert as_set(b.read("t_copy")) == sorted(want.items(), key=repr)
    after = folders(b, "t_copy")
    assert {p for p in after if after[p] != before.get(p)} == {"0", "1", "6"}
    # a part that loses its last row disappears
    a.commit({"log": log_rows(spark, [(9, 99, "D")])})
    jobs.run(job, a, b)
    assert "6" not in folders(b, "t_copy") and b.read("t_copy").count() == 89


@pytest.mark.parametrize("layout", [dict(count=7), dict(span_bits=3)])
def test_modes_agree_on_tables_in_parts(spark, tmp_path, layout):
    rows = [(n, f"v{n}", n % 2) for n in range(40)]
    states = []
    for name, kind in (("plain", {}), ("parts", {"t_copy": Parts(("k",), **layout)})):
        a = SnapshotStore(spark, str(tmp_path / name / "a"))
        b = SnapshotStore(spark, str(tmp_path / name / "b"), kind)
        a.commit({"t": frame(spark, rows, "id bigint, v string, done int")})
        b.commit({"t_copy": frame(spark, [(n, "old") for n in range(10, 60)], "k bigint, w string")})
        jobs.run(SyncJob("j", "db_bj", tables=(spec(flag={"name": "done", "before": 0, "after": 1}),)), a, b)
        jobs.run(SyncJob("i", "db_qb", tables=(spec(insert_only=True),)), a, b)
        states.append((as_set(b.read("t_copy")), as_set(a.read("t")), flux_of(b)))
    assert states[0] == states[1]
    assert len(states[0][0]) == 60


def test_prune_keeps_what_recent_versions_need(spark, stores):
    store, _ = stores
    store.commit({"x": frame(spark, [(0, "a")]), "y": frame(spark, [(0, "a")])})
    for n in range(1, 5):
        store.commit({"x": frame(spark, [(n, "a")])})
    store.prune(keep=2)
    assert as_set(store.read("x")) == [(4, "a")] and as_set(store.read("x", version=4)) == [(3, "a")]
    assert as_set(store.read("y")) == [(0, "a")]
    assert len(glob.glob(store.path + "/x/*")) == 2 and sorted(store._published()) == [4, 5]
