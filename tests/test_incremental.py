"""Digest trees, page index, streaming collapse and progress, counts from the writing pass."""

from __future__ import annotations

import random
import re

import pytest
from helpers import as_set, plan_of
from pyspark.sql import functions as F

from rowtide.operators.changelog import capture_changes, collapse
from rowtide.operators.digests import DigestTree, capture_by_digest, differing_ranges, digest_tree, rows_in
from rowtide.operators.numbering import paginate
from rowtide.operators.paging import page_index, read_page
from rowtide.plans import jobs
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.session import scratch_scope, settle
from rowtide.sources.log import read_log_stream
from rowtide.sources.snapshots import Bucketing, Parts, SnapshotStore
from rowtide.streaming import streams
from rowtide.streaming.progress import ProgressLog

SPEC = TableSpec.from_dict(
    {
        "source": "t",
        "target": "t_copy",
        "fields": [
            {"source": "id", "target": "k", "pk": True, "jdbc_type": "BIGINT"},
            {"source": "v", "target": "w"},
            {"source": "n", "target": "m", "jdbc_type": "INTEGER"},
        ],
    }
)
SCHEMA = "id bigint, v string, n int"


def snapshot(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


# -- digests ----------------------------------------------------------------------------


def changed(rows, pick):
    """Rows with some changed, some gone, some new; a value that moves from one column to the other."""
    new = [r for r in rows if pick.random() > 0.02]
    new = [(i, v + "x", n) if pick.random() < 0.03 else (i, v, n) for i, v, n in new]
    return new + [(100_000 + i, "new", i) for i in range(5)]


@pytest.mark.parametrize("span_bits", [3, 10])
def test_capture_by_digest_finds_every_change(spark, span_bits):
    pick = random.Random(span_bits)
    rows = [(i * 3, f"v{i % 7}", None if i % 11 == 0 else i) for i in range(3000)]
    before, after = snapshot(spark, rows), snapshot(spark, changed(rows, pick))
    at = __import__("datetime").datetime(2024, 1, 1)
    want = as_set(capture_changes(before, after, SPEC, op_time=at))
    assert len(want) > 100
    got = as_set(capture_by_digest(before, after, SPEC, span_bits=span_bits, op_time=at))
    assert got == want
    assert capture_by_digest(before, before, SPEC, span_bits=span_bits).count() == 0


def test_digests_of_other_keys_and_nulls(spark):
    schema = "name string, v string, w string"
    before = spark.createDataFrame([("a", "x", None), ("b", None, "x"), ("c", "z", "z")], schema)
    after = spark.createDataFrame([("a", None, "x"), ("b", None, "x"), ("d", "z", "z")], schema)
    spec = TableSpec.from_dict(
        {"source": "t", "fields": [{"source": "name", "pk": True}, {"source": "v"}, {"source": "w"}]}
    )
    got = as_set(capture_by_digest(before, after, spec), "pks", "op")
    assert [(p.split(";")[2], op) for p, op in got] == [("a", "U"), ("c", "D"), ("d", "I")]


def test_only_differing_ranges_are_read_on(spark):
    """1 % of the key range changed: about 1 % of the rows go into the join."""
    rows = [(i, "v", i) for i in range(100_000)]
    before = snapshot(spark, rows)
    after = before.withColumn("v", F.when(F.col("id").between(50_000, 50_999), "w").otherwise(F.col("v")))
    columns = before.columns
    trees = [digest_tree(df, ["id"], columns, span_bits=8) for df in (before, after)]
    assert [t.count() for t in trees[0].levels] == [391, 2, 1]
    ranges = differing_ranges(*trees)
    touched = rows_in(before, ["id"], ranges, 8)
    assert 1000 <= touched.count() <= 2 * 256 + 1000
    plan = plan_of(touched)
    assert "BroadcastHashJoin LeftSemi" in plan and "SortMergeJoin" not in plan
    # nothing but the broadcast list is exchanged before rows are filtered
    assert not re.search(r"Exchange hashpartitioning", plan)


def test_digests_are_kept_with_their_snapshot(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    rows = [(i, "v", i) for i in range(500)]
    before, after = snapshot(spark, rows), snapshot(spark, rows[:-3] + [(499, "other", 1)])
    tree = digest_tree(before, ["id"], before.columns, span_bits=4)
    store.commit({"t": before, **tree.tables("t")})
    tables = {t: store.read(t) for t in store.manifest()["tables"]}
    kept = DigestTree.kept(tables, "t", ["id"], before.columns, span_bits=4)
    got = capture_by_digest(store.read("t"), after, SPEC, trees=(kept, None), span_bits=4)
    assert as_set(got, "pks", "op") == [
        ("id;BIGINT;497;", "D"), ("id;BIGINT;498;", "D"), ("id;BIGINT;499;", "U")
    ]
    with pytest.raises(ValueError):
        differing_ranges(kept, digest_tree(before, ["id"], ["id"], span_bits=4))


# -- pages ------------------------------------------------------------------------------


@pytest.mark.parametrize("keys", [["id"], ["v", "id"]])
def test_read_page_equals_numbering(spark, keys):
    rows = [(i * 7 % 1009, f"v{i % 5}" if i % 6 else None, i) for i in range(1000)]
    df = snapshot(spark, rows)
    index = page_index(df, keys, ranges=16)
    assert index.rows == 1000 and index.pages(30) == 34 and len(index.bounds) == 15
    pages = {}
    for r in paginate(df, keys, 30).collect():
        pages.setdefault(r["page_no"], set()).add(tuple(r))
    for page in (1, 2, 17, 33, 34):
        assert set(map(tuple, read_page(df, index, page, 30).collect())) == pages[page]
    assert read_page(df, index, 35, 30).collect() == [] and read_page(df, index, 0, 30).collect() == []
    assert set(map(tuple, read_page(df, index, 1, 5000).collect())) >= pages[1]


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    path = str(tmp_path / "t")
    snapshot(spark, [(i, "v", i) for i in range(4000)]).write.parquet(path)
    df = spark.read.parquet(path)
    index = page_index(df, ["id"], ranges=64)
    plan = plan_of(read_page(df, index, 20, 50))
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan).group(1)
    assert "GreaterThanOrEqual(id," in pushed and "LessThanOrEqual(id," in pushed
    empty = page_index(df.limit(0), ["id"])
    assert empty.rows == 0 and read_page(df.limit(0), empty, 1, 10).collect() == []


# -- streams ----------------------------------------------------------------------------

LOG = "id bigint, tablename string, pks string, op string, op_time timestamp_ntz"


@pytest.mark.parametrize("cuts", [[300], [40, 41, 200, 300]])
def test_streaming_collapse_equals_batch(spark, tmp_path, cuts):
    """Any split into batches, in any order, with a new query for every batch."""
    pick = random.Random(6)
    at = __import__("datetime").datetime(2024, 1, 1)
    rows = [(n, "T", f"k{pick.randint(0, 30)}", pick.choice("IUD"), at) for n in range(1, 301)]
    pick.shuffle(rows)
    store, done = SnapshotStore(spark, str(tmp_path / "s")), 0
    for upto in cuts:
        spark.createDataFrame(rows[done:upto], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        done = upto
        log = read_log_stream(spark, str(tmp_path / "in"), LOG)
        streams.stream_collapse(log, store, "last", "c", str(tmp_path / "cp"), once=True).awaitTermination()
    assert as_set(store.read("last")) == as_set(collapse(spark.createDataFrame(rows, LOG), ["tablename", "pks"]))


def test_progress_of_batches_is_noted(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    job = SyncJob("j", "db_qb", tables=(TableSpec.from_dict({
        "source": "t", "target": "t_copy", "fields": [{"source": "id", "pk": True, "jdbc_type": "BIGINT"}]}),))
    noted = ProgressLog().watch(spark)
    try:
        for n in (3, 5):
            spark.range(n).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in"))
            query = streams.stream_full(stream, store, job, job.tables[0], str(tmp_path / "cp"), once=True)
            query.awaitTermination()
            noted.wait(query)
    finally:
        noted.unwatch(spark)
    # the batch is looked at several times, and counted once
    assert as_set(noted.rows(spark), "batch_id", "n_rows") == [(0, 3), (1, 5)]
    assert noted.publish(store) == 2 and noted.publish(store) == 0
    assert as_set(store.read("stream_progress"), "batch_id", "n_rows") == [(0, 3), (1, 5)]


# -- counts -----------------------------------------------------------------------------


def flux(store):
    return as_set(store.read(jobs.FLUX_TABLE), "source_table_name", "count_i", "count_d", "count_u")


@pytest.mark.parametrize("layout", [{}, {"t_copy": Parts(("k",), count=3)}, {"t_copy": Bucketing(("k",), 3)}])
@pytest.mark.parametrize("policy", [{}, {"insert_only": True}])
def test_changes_are_counted_by_the_write(spark, tmp_path, layout, policy):
    one = TableSpec(SPEC.source, SPEC.target, SPEC.fields, **policy)
    a = SnapshotStore(spark, str(tmp_path / "a"))
    b = SnapshotStore(spark, str(tmp_path / "b"), layout)
    a.commit({"t": snapshot(spark, [(i, "new", i) for i in range(30)])})
    b.commit({"t_copy": snapshot(spark, [(i, "old", i) for i in range(20, 45)]).toDF("k", "w", "m")})
    job = SyncJob("j", "db_qb", tables=(one,))
    jobs.run(job, a, b)
    assert flux(b) == [("t", 20, 0, 0 if policy else 10)]
    assert b.read("t_copy").columns == ["k", "w", "m"] and b.read("t_copy").count() == 45
    # nothing to copy, and a target that does not exist yet
    a.commit({"t": snapshot(spark, []), "u": snapshot(spark, [])})
    jobs.run(job, a, b)
    assert flux(b) == [("t", 0, 0, 0)]
    other = TableSpec("u", "u_copy", SPEC.fields, **policy)
    jobs.run(SyncJob("k", "db_qb", tables=(other,)), a, b)
    assert ("u", 0, 0, 0) in flux(b)


def test_written_state_joins_both_sides_once(spark):
    source = snapshot(spark, [(i, "new", i) for i in range(30)])
    target = source.toDF("k", "w", "m")
    result = jobs.full_table(source, target, SPEC, counted=True)
    plan = plan_of(result.target)
    assert len(re.findall(r"^\S.*Join", plan.split("===")[0], re.M)) <= 1
    assert plan.count("FullOuter") >= 1


def test_broken_table_leaves_the_others_alone(spark, tmp_path):
    a, b = SnapshotStore(spark, str(tmp_path / "a")), SnapshotStore(spark, str(tmp_path / "b"))
    specs = tuple(
        TableSpec.from_dict({"source": s, "target": s + "_copy", "fields": [{"source": "id", "pk": True, "jdbc_type": "BIGINT"}]})
        for s in ("t1", "t2", "t3")
    )
    job = SyncJob("j", "db_qb", tables=specs)
    a.commit({"t1": spark.range(3), "t3": spark.range(4)})
    with pytest.raises(LookupError, match="t2"):
        jobs.run(job, a, b)
    assert flux(b) == [("t1", 3, 0, 0), ("t3", 4, 0, 0)]
    errors = as_set(b.read(jobs.ERROR_TABLE), "source_table_name", "audit_error")
    assert len(errors) == 1 and errors[0][0] == "t2" and "table failed" in errors[0][1]
    assert b.read("t1_copy").count() == 3 and not b.has("t2_copy")
    # the cycle is not over: what is missing is done, what is published is left alone
    version = b.manifest()["tables"]["t1_copy"]
    a.commit({"t2": spark.range(5)})
    jobs.run(job, a, b)
    assert b.manifest()["tables"]["t1_copy"] == version
    assert flux(b) == [("t1", 3, 0, 0), ("t2", 5, 0, 0), ("t3", 4, 0, 0)]


# -- a table that grows -------------------------------------------------------------------


def test_appends_come_once_and_restart_at_their_version(spark, tmp_path):
    from rowtide.streaming.appends import stream_appends

    store, got = SnapshotStore(spark, str(tmp_path / "s")), []

    def run(**options):
        stream_appends(
            store, "t", lambda rows, n: got.append(as_set(rows, "id")), str(tmp_path / "cp"), once=True, **options
        ).awaitTermination()

    store.commit({"other": spark.range(1)})
    run()
    assert got == []
    store.commit(appends={"t": spark.range(2)})
    store.commit(appends={"t": spark.range(2, 3)})
    run()
    assert got == [[(0,), (1,), (2,)]]
    store.commit(appends={"t": spark.range(3, 4), "other": spark.range(1)})
    store.commit({"other": spark.range(2)})
    # written, never published
    spark.range(50, 60).write.parquet(store.path + "/t/v-lost")
    run(max_versions=1)
    assert got[1:] == [[(3,)], []]
    store.commit({"t": spark.range(9)})
    with pytest.raises(Exception, match="written anew"):
        run()


def test_scratch_goes_with_its_scope(spark):
    with scratch_scope(spark):
        with scratch_scope(spark):
            gone, stays = settle(spark.range(3)), settle(spark.range(4), outlive=True)
        assert stays.count() == 4
        with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
            gone.collect()
    with pytest.raises(Exception, match="FILE_NOT_EXIST|PATH_NOT_FOUND|does not exist"):
        stays.collect()
