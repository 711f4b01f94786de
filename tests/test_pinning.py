"""Rows that others append between a cycle's look at the version, its reads and its commit."""

from __future__ import annotations

import datetime as dt
import json
import threading

import pytest
from helpers import as_set
from pyspark.sql import functions as F
from test_jobs import frame, spec

from rowtide.operators.sequences import sequence_plan
from rowtide.plans import jobs
from rowtide.plans.spec import SequenceSpec, SyncJob, TableSpec
from rowtide.sources.log import LOG_SCHEMA
from rowtide.sources.snapshots import NO_PART, Bucketing, Parts, SnapshotStore


class Busy(SnapshotStore):
    """A store to which somebody appends just before the first read of a table."""

    appended = None

    def read(self, table, **options):
        if self.appended and self.appended[0] == table:
            name, rows = self.appended
            self.appended = None
            SnapshotStore(self.spark, self.path, self.layout).commit(appends={name: rows})
        return super().read(table, **options)


@pytest.fixture
def stores(spark, tmp_path):
    return Busy(spark, str(tmp_path / "a")), Busy(spark, str(tmp_path / "b"))


def log_rows(spark, rows, table="T"):
    at = dt.datetime(2024, 1, 1)
    full = [(i, "DB", table, f"id;NUMBER;{k};", op, at) for i, k, op in rows]
    return spark.createDataFrame(full, LOG_SCHEMA)


def test_full_with_move_keeps_rows_appended_meanwhile(spark, stores):
    source, target = stores
    source.commit({"t": frame(spark, [(1, "a"), (2, "b")])})
    source.appended = ("t", frame(spark, [(3, "c")]))
    job = SyncJob(name="j", apptype="db_qb", tables=(spec(delete_source=True),))
    jobs.run(job, source, target)
    assert as_set(target.read("t_copy")) == [(1, "a"), (2, "b")]
    assert as_set(source.read("t")) == [(3, "c")]


@pytest.mark.parametrize("layout", [{}, {"t": Parts(("id",), count=5)}])
def test_marker_does_not_double_rows_appended_meanwhile(spark, stores, layout):
    source, target = stores
    source.layout = layout
    flag = {"name": "f", "before": 0, "after": 1}
    schema = "id bigint, v string, f int"
    source.commit({"t": frame(spark, [(1, "a", 0), (2, "b", 1)], schema)})
    source.appended = ("t", frame(spark, [(3, "c", 0), (4, "d", 0)], schema))
    job = SyncJob(name="j", apptype="db_bj", tables=(spec(flag=flag),))
    jobs.run(job, source, target)
    assert as_set(source.read("t")) == [(1, "a", 1), (2, "b", 1), (3, "c", 0), (4, "d", 0)]
    jobs.run(job, source, target)
    assert as_set(target.read("t_copy")) == [(1, "a"), (3, "c"), (4, "d")]


def test_date_marker_loses_nothing_appended_meanwhile(spark, stores):
    source, target = stores
    table = TableSpec.from_dict(
        {
            "source": "t",
            "marker": "at",
            "fields": [{"source": "id", "pk": True, "jdbc_type": "BIGINT"}, {"source": "at", "jdbc_type": "TIMESTAMP"}],
        }
    )
    start = dt.datetime(2024, 1, 1)

    def rows(a, b):
        return frame(spark, [(i, start + dt.timedelta(seconds=20 * i)) for i in range(a, b)], "id bigint, at timestamp_ntz")

    source.commit({"t": rows(0, 10)})
    source.appended = ("t", rows(10, 20))
    job = SyncJob(name="j", apptype="db_sjbj", tables=(table,))
    jobs.run(job, source, target)
    source.commit(appends={"t": rows(20, 30)})
    jobs.run(job, source, target)
    # the last slice waits
    assert sorted(r[0] for r in as_set(target.read("t"))) == list(range(27))


def test_cdc_leaves_log_rows_appended_meanwhile(spark, stores):
    source, target = stores
    source.commit({"t": frame(spark, [(1, "a"), (2, "b")]), "log": log_rows(spark, [(1, 1, "I")])})
    source.appended = ("log", log_rows(spark, [(2, 2, "I")]))
    job = SyncJob(name="j", apptype="db_cf", source_log="log", tables=(spec(),))
    jobs.run(job, source, target)
    kept = [r["id"] for r in source.read("log").collect()]
    copied = [r[0] for r in as_set(target.read("t_copy"))]
    assert sorted(kept + copied) == [1, 2]
    jobs.run(job, source, target)
    assert as_set(target.read("t_copy")) == [(1, "a"), (2, "b")]
    assert source.read("log").count() == 0


def test_max_records_of_the_job_bounds_a_cycle(spark, stores):
    source, target = stores
    source.commit({"t": frame(spark, [(i, "v") for i in range(5)]), "log": log_rows(spark, [(i + 1, i, "I") for i in range(5)])})
    job = SyncJob.from_dict({"name": "j", "apptype": "db_cf", "source_log": "log", "max_records": 2, "tables": []})
    job = SyncJob(**{**job.__dict__, "tables": (spec(),)})
    jobs.run(job, source, target)
    assert as_set(target.read("t_copy")) == [(0, "v"), (1, "v")]
    assert sorted(r["id"] for r in source.read("log").collect()) == [3, 4, 5]


def test_inactive_job_does_nothing(spark, stores):
    source, target = stores
    jobs.run(SyncJob(name="j", apptype="db_qb", active=False, tables=(spec(),)), source, target)
    assert target.version == 0


def errors(store):
    return sorted((r["pk_value"], r["audit_error"]) for r in store.read(jobs.ERROR_TABLE).collect())


def test_a_bad_cell_does_not_block_replay(spark, stores):
    source, target = stores
    typed = TableSpec.from_dict(
        {
            "source": "t", "target": "t_copy",
            "fields": [{"source": "id", "pk": True, "jdbc_type": "BIGINT"}, {"source": "v", "jdbc_type": "INTEGER"}],
        }
    )
    source.commit(
        {
            "t": frame(spark, [(1, "10"), (2, "n/a"), (3, "30"), (3, "31")]),
            "log": log_rows(spark, [(1, 1, "I"), (2, 2, "D"), (3, 2, "I"), (4, 3, "U"), (5, 4, "X")]),
        }
    )
    job = SyncJob(name="j", apptype="db_cf", source_log="log", tables=(typed,))
    jobs.run(job, source, target)
    assert as_set(target.read("t_copy")) == [(1, 10), (3, 30)]
    assert source.read("log").count() == 0
    assert [e for _, e in errors(target)] == [
        "unreadable value: v", "duplicate key, copies: 1", "unknown operation in the change log",
    ]


def test_two_way_reports_bad_keys_and_conflicts(spark, stores):
    a, b = stores
    a.commit({"t": frame(spark, [(1, "a")]), "log_a": log_rows(spark, [(1, 1, "U"), (2, "none", "U")])})
    b.commit(
        {
            "t_copy": frame(spark, [(1, "b")], "k bigint, w string"),
            "log_b": log_rows(spark, [(9, 1, "U")], "T_COPY").withColumn("pks", F.lit("k;NUMBER;1;")),
        }
    )
    b.appended = ("log_b", log_rows(spark, [(10, 5, "U")], "OTHER"))
    job = SyncJob(name="j", apptype="db_sx", source_log="log_a", target_log="log_b", tables=(spec(),))
    jobs.run(job, a, b)
    assert as_set(a.read("t")) == [(1, "b")] == as_set(b.read("t_copy"))
    assert [e for _, e in errors(b)] == [
        "changed on both sides, target wins over operation U", "unreadable key in the change log",
    ]
    assert a.read(jobs.FLUX_TABLE).count() == 1
    assert b.read("log_b").count() == 1


def test_target_keeps_its_types(spark, stores):
    source, target = stores
    source.commit({"t": frame(spark, [(1, "1.50"), (2, "2")])})
    table = TableSpec.from_dict(
        {
            "source": "t", "target": "t_copy",
            "fields": [{"source": "id", "pk": True, "jdbc_type": "BIGINT"}, {"source": "v", "jdbc_type": "DOUBLE"}],
        }
    )
    target.commit({"t_copy": frame(spark, [], "id bigint, v decimal(12,2)")})
    jobs.run(SyncJob(name="j", apptype="db_qb", tables=(table,)), source, target)
    assert target.read("t_copy").schema["v"].dataType.simpleString() == "decimal(12,2)"


def test_rows_without_a_span_key_have_a_part(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), {"t": Parts(("id",), span_bits=3)})
    store.commit({"t": frame(spark, [(None, "x"), (9, "y")])})
    assert sorted(store.manifest()["tables"]["t"]["parts"], key=int) == [str(NO_PART), "1"]
    assert as_set(store.read("t", parts=[NO_PART])) == [(None, "x")]


def test_bucketed_table_stays_bucketed_after_appends(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), {"t": Bucketing(("id",), 4)})
    store.commit({"t": frame(spark, [(i, "a") for i in range(20)])})
    store.commit(appends={"t": frame(spark, [(i, "b") for i in range(20, 30)])})
    table = store.read("t")
    assert table.columns == ["id", "v"] and table.count() == 30
    plan = table.groupBy("id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    for i in range(4):
        store.commit({"t": frame(spark, [(i, "c")])})
    names = {t.name for t in spark.catalog.listTables() if t.name.startswith("rowtide_")}
    store.prune(1)
    assert len({t.name for t in spark.catalog.listTables() if t.name.startswith("rowtide_")}) < len(names)


def test_one_publication_wins_a_version(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    won = []

    def publish(i):
        won.append(store._publish(1, {"tables": {}, "batches": {"j": i}}))

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(won) == [False] * 5 + [True]
    assert json.loads((tmp_path / "s/_published/1").read_text())["batches"]["j"] in range(6)


def test_sequences_from_stores_report_missing_pairs(spark, stores):
    a, b = stores
    schema = "name string, last_number bigint, increment_by bigint, cache_size bigint"
    a.commit({jobs.SEQUENCE_TABLE: frame(spark, [("S1", 9, 1, 1), ("S2", 5, 1, 1)], schema)})
    b.commit({jobs.SEQUENCE_TABLE: frame(spark, [("S1", 4, 1, 1)], schema)})
    job = SyncJob(name="q", apptype="db_xl", sequences=tuple(SequenceSpec(s, s) for s in ("S1", "S2", "S3")))
    plan = {r["name"]: (r["side"], r["step"]) for r in jobs.run(job, a, b).collect()}
    assert plan == {"S1": ("target", "temporary"), "S2": ("target", "missing"), "S3": ("both", "missing")}
    assert sequence_plan(a.read("sequences"), b.read("sequences")).count() == 1


def test_compaction_keeps_rows(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"), {"p": Parts(("id",), count=2)})
    for i in range(4):
        store.commit(appends={t: frame(spark, [(i, "a")]) for t in ("t", "p")})
    store.commit({"small": frame(spark, [(1, "a")])})
    before = store.manifest()["tables"]["small"]
    store.compact(folders=2)
    after = store.manifest()["tables"]
    assert len(after["t"]["folders"]) == 1 and after["small"] == before
    assert as_set(store.read("t")) == as_set(store.read("p")) == [(i, "a") for i in range(4)]


def test_guard_keeps_one_row_per_key(spark, stores):
    source, target = stores
    source.commit({"t": frame(spark, [(1, "a"), (2, "b")])})
    job = SyncJob(name="j", apptype="db_cf", source_log="log", tables=(spec(),))
    for batch, ids in enumerate(([1, 2], [3], [2])):
        log = log_rows(spark, [(i, 1 + i % 2, "U") for i in ids])
        jobs.apply_log(job, log, source, target, cycle=batch, batch_id=batch, guard=True)
    assert as_set(target.read("t_copy__applied")) == [(1, 2), (2, 3)]
    assert as_set(target.read("t_copy")) == [(1, "a"), (2, "b")]
