"""Two-way cycles that are interrupted between the sides: every change goes over once."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

import pytest
from helpers import as_set

from rowtide.plans import jobs
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.sources.log import LOG_SCHEMA
from rowtide.sources.snapshots import CommitConflict, SnapshotStore

SPEC = TableSpec.from_dict(
    {
        "source": "t",
        "target": "t_copy",
        "target_deletable": True,
        "fields": [
            {"source": "id", "target": "k", "pk": True, "jdbc_type": "BIGINT", "db_type": "NUMBER"},
            {"source": "v", "target": "w"},
        ],
    }
)
JOB = SyncJob("pair", "db_sx", source_log="log", target_log="log", tables=(SPEC,))


class Failing(SnapshotStore):
    """A store of which the next commits fail, with a given error each."""

    def commit(self, *args, **options):
        if self.errors:
            raise self.errors.pop()
        return super().commit(*args, **options)


@pytest.fixture
def sides(spark, tmp_path):
    a, b = Failing(spark, str(tmp_path / "a")), SnapshotStore(spark, str(tmp_path / "b"))
    a.errors = []
    rows = [(n, "old") for n in range(1, 4)]
    empty = spark.createDataFrame([], LOG_SCHEMA)
    a.commit({"t": spark.createDataFrame(rows, "id bigint, v string"), "log": empty})
    b.commit({"t_copy": spark.createDataFrame(rows, "k bigint, w string"), "log": empty})
    return a, b


def change(store, n, key, value, type_name="NUMBER"):
    """An application changes a row; a trigger writes the log."""
    spark, table, columns = store.spark, "t", "id bigint, v string"
    name = "id"
    if store.has("t_copy"):
        table, columns, name = "t_copy", "k bigint, w string", "k"
    left = store.read(table).where(f"{name} <> {key}")
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=n)
    log = [(n, "DB", table.upper(), f"{name};{type_name};{key};", "U", at)]
    store.commit(
        {table: left.union(spark.createDataFrame([(key, value)], columns))},
        appends={"log": spark.createDataFrame(log, LOG_SCHEMA)},
    )


def value_of(store, key):
    table, name = ("t_copy", "k") if store.has("t_copy") else ("t", "id")
    return store.read(table).where(f"{name} = {key}").first()[1]


@pytest.mark.parametrize("error", [CommitConflict("another writer"), ZeroDivisionError("crash")])
def test_an_interrupted_cycle_records_its_effect_once(sides, error):
    a, b = sides
    change(a, 1, 1, "from a")
    a.errors = [error]
    if isinstance(error, CommitConflict):
        jobs.run(JOB, a, b)
    else:
        with pytest.raises(ZeroDivisionError):
            jobs.run(JOB, a, b)
        jobs.run(JOB, a, b)
    assert value_of(b, 1) == "from a" and a.read("log").count() == 0
    assert as_set(b.read("t_copy__applied"), "tablename", "op", "id") == [("T_COPY", "U", 1)]
    flux = as_set(b.read(jobs.FLUX_TABLE), "source_table_name", "count_i", "count_d", "count_u")
    assert flux == [("t", 0, 0, 1)]
    # the echo, whose log names the type otherwise, is not sent back
    change(b, 10, 1, "from a", type_name="BIGINT")
    jobs.run(JOB, a, b)
    assert b.read("t_copy__applied").count() == 0 and a.read("t__applied").count() == 0
    # the next change of that key is a real one
    change(b, 11, 1, "genuine")
    jobs.run(JOB, a, b)
    assert value_of(a, 1) == "genuine" and b.read("log").count() == 0


def test_a_change_between_the_sides_is_not_overwritten(sides):
    a, b = sides
    change(b, 1, 2, "from b")
    a.errors = [ZeroDivisionError("crash")]
    with pytest.raises(ZeroDivisionError):
        jobs.run(JOB, a, b)
    change(a, 5, 2, "newer on a")
    jobs.run(JOB, a, b)
    assert value_of(a, 2) == "newer on a" and a.read("log").count() == 1
    errors = as_set(a.read(jobs.ERROR_TABLE), "level", "audit_error")
    assert errors == [("WARN", "changed on both sides meanwhile, operation left out: U")]
    jobs.run(JOB, a, b)
    assert value_of(b, 2) == "newer on a" and a.read("log").count() == 0


def test_changes_of_a_key_are_taken_together_whatever_the_limit(sides):
    """The rival of a change lies beyond the rows of the cycle: still a conflict, the later one wins."""
    a, b = sides
    change(a, 1, 1, "from a")
    for n, key in ((1, 3), (2, 2), (9, 1)):
        change(b, n, key, f"from b {n}")
    jobs.run(replace(JOB, max_records=1), a, b)
    # key 1 of both sides and key 3 were taken, key 2 waits
    assert value_of(a, 1) == value_of(b, 1) == "from b 9" and value_of(a, 3) == "from b 1"
    assert as_set(b.read("log"), "id") == [(2,)] and a.read("log").count() == 0
    assert value_of(a, 2) == "old"
    errors = as_set(b.read(jobs.ERROR_TABLE), "level", "pk_value", "audit_error")
    assert errors == [("WARN", "id;NUMBER;1;", "changed on both sides, target wins over operation U")]
    jobs.run(replace(JOB, max_records=1), a, b)
    assert value_of(a, 2) == "from b 2" and b.read("log").count() == 0
