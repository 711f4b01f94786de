"""Queries that run whole jobs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowtide.plans import jobs
from rowtide.plans.spec import SyncJob, TableSpec
from rowtide.registry import changes as ch
from rowtide.registry import fixtures as fx
from rowtide.registry.base import query, rows, table, with_tables
from rowtide.session import scratch_path
from rowtide.sources.log import read_log_stream
from rowtide.sources.snapshots import CommitConflict, Parts, SnapshotStore
from rowtide.streaming import streams
from rowtide.streaming.appends import stream_cdc_table
from rowtide.streaming.echo_state import FORWARD, stream_echo_state
from rowtide.streaming.progress import ProgressLog

PLAIN = "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders"
UPSERTED = """SELECT k, price, status FROM src UNION ALL
              SELECT k, price, status FROM tgt WHERE k NOT IN (SELECT k FROM src)"""
FULL = with_tables(UPSERTED, src=PLAIN, tgt=fx.TARGET)


@query("job_full", FULL)
def job_full(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: copy the orders onto a target that lacks some and has others changed."""
    orders = table(spark, sf, "orders")
    return jobs.full_table(orders, rows(spark, sf, fx.TARGET), fx.orders_spec()).target


# Lines that the target already holds; keys of the source occur more than once.
LINE_TARGET = """
SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey,
       max(l_quantity) AS l_quantity
FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY l_orderkey, l_linenumber
"""
LINE_KEPT = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                  ORDER BY l_partkey, l_suppkey, l_quantity) AS n,
                count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS size
               FROM ({fx.DUPLICATES}) q) r WHERE n = 1
"""
LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity"


def _lines(spark, sf, **policy) -> jobs.TableResult:
    spec = TableSpec(ch.LINES.source, "lines_copy", ch.LINES.fields, **policy)
    return jobs.full_table(table(spark, sf, "lineitem"), rows(spark, sf, LINE_TARGET), spec)


@query(
    "job_full_lines",
    with_tables(
        f"""SELECT {LINE_COLUMNS} FROM kept UNION ALL
            SELECT {LINE_COLUMNS} FROM tgt t WHERE NOT EXISTS (SELECT 1 FROM kept k
              WHERE k.l_orderkey = t.l_orderkey AND k.l_linenumber = t.l_linenumber)""",
        kept=LINE_KEPT,
        tgt=LINE_TARGET,
    ),
)
def _(spark, sf):
    return _lines(spark, sf).target


@query(
    "job_full_insert_only",
    with_tables(
        f"""SELECT {LINE_COLUMNS} FROM tgt UNION ALL
            SELECT {LINE_COLUMNS} FROM kept WHERE l_orderkey % 3 <> 0""",
        kept=LINE_KEPT,
        tgt=LINE_TARGET,
    ),
)
def _(spark, sf):
    return _lines(spark, sf, insert_only=True).target


@query(
    "job_full_move_source",
    with_tables(
        f"""SELECT {LINE_COLUMNS} FROM lineitem l WHERE EXISTS (SELECT 1 FROM kept k
              WHERE k.size > 1 AND k.l_orderkey = l.l_orderkey
                AND k.l_linenumber = l.l_linenumber)""",
        kept=LINE_KEPT,
    ),
)
def _(spark, sf):
    left = _lines(spark, sf, delete_source=True).source
    return left.select(*[c.strip() for c in LINE_COLUMNS.split(",")])


FLAG = {"name": "sync_flag", "before": 0, "after": 1}


def _marked(spark, sf) -> jobs.TableResult:
    spec = fx.orders_spec(flag=FLAG)
    return jobs.marked_table(rows(spark, sf, fx.FLAGGED), rows(spark, sf, fx.TARGET), spec)


@query(
    "job_marker_target",
    with_tables(UPSERTED, src=PLAIN + " WHERE o_orderstatus = 'O'", tgt=fx.TARGET),
)
def _(spark, sf):
    return _marked(spark, sf).target


@query("job_marker_source", "SELECT o_orderkey, o_totalprice, 1 AS sync_flag FROM orders")
def _(spark, sf):
    return _marked(spark, sf).source.select("o_orderkey", "o_totalprice", "sync_flag")


EVENTS = TableSpec.from_dict(
    {
        "source": "events",
        "target": "events_copy",
        "marker": "ts",
        "fields": [
            {"source": "event_id", "pk": True, "jdbc_type": "BIGINT"},
            {"source": "ts", "target": "seen_at", "jdbc_type": "TIMESTAMP"},
            {"source": "user_id", "jdbc_type": "BIGINT"},
            {"source": "event_type", "jdbc_type": "VARCHAR"},
        ],
    }
)
EVENT_TARGET = """
SELECT event_id, ts AS seen_at, -user_id AS user_id, event_type FROM events WHERE event_id % 4 = 0
"""
DATED = with_tables(
    """SELECT event_id, seen_at, user_id, event_type FROM done UNION ALL
       SELECT event_id, seen_at, user_id, event_type FROM tgt
       WHERE event_id NOT IN (SELECT event_id FROM done)""",
    done=f"""SELECT e.event_id, e.ts AS seen_at, e.user_id, e.event_type FROM events e
             JOIN ({ch.SLICES}) s ON s.event_id = e.event_id WHERE s.slice_end < s.hi""",
    tgt=EVENT_TARGET,
)


@query("job_date_marker", DATED)
def _(spark, sf):
    events = table(spark, sf, "events")
    return jobs.dated_table(events, rows(spark, sf, EVENT_TARGET), EVENTS).target


def _store(spark: SparkSession, name: str) -> SnapshotStore:
    return SnapshotStore(spark, scratch_path(spark, name))


def _user_stores(spark, sf, *, with_log: bool) -> tuple[SnapshotStore, SnapshotStore]:
    source, target = _store(spark, "source"), _store(spark, "target")
    tables = ch.split_by_table(rows(spark, sf, fx.STATE))
    if with_log:
        tables["change_log"] = rows(spark, sf, fx.LOG)
    source.commit(tables)
    target.commit(ch.split_by_table(rows(spark, sf, fx.STALE), "_copy"))
    return source, target


def _copies(target: SnapshotStore) -> DataFrame:
    return ch.labelled({f"t{m}_copy": target.read(f"t{m}_copy") for m in range(3)})


@query("job_cdc", ch.many_sql())
def _(spark, sf):
    source, target = _user_stores(spark, sf, with_log=True)
    jobs.run_cdc(fx.users_job(), source, target)
    return _copies(target)


SIDES = f"""SELECT 'a' AS side, user_id, n_events, last_event FROM ({ch.SQL_A}) x
            UNION ALL SELECT 'b', uid, cnt, last_ev FROM ({ch.SQL_B}) y"""


def _pair_stores(spark, sf) -> tuple[SnapshotStore, SnapshotStore]:
    a, b = _store(spark, "a"), _store(spark, "b")
    empty_hash = F.lit(None).cast("long").alias("row_hash")
    a.commit(
        {
            "users": rows(spark, sf, fx.SIDE_A),
            "log_a": rows(spark, sf, fx.LOG_A),
            "users__applied": rows(spark, sf, fx.APPLIED_A).select("*", empty_hash),
        }
    )
    b.commit(
        {
            "people": rows(spark, sf, fx.SIDE_B),
            "log_b": rows(spark, sf, fx.LOG_B),
            "people__applied": rows(spark, sf, fx.APPLIED_B).select("*", empty_hash),
        }
    )
    return a, b


def _pair_job() -> SyncJob:
    return SyncJob(
        name="pair", apptype="db_sx", source_log="log_a", target_log="log_b", tables=(fx.pair_spec(),)
    )


def _sides(a: SnapshotStore, b: SnapshotStore) -> DataFrame:
    names = {"uid": "user_id", "cnt": "n_events", "last_ev": "last_event"}
    side_b = b.read("people").withColumnsRenamed(names)
    return (
        a.read("users")
        .withColumn("side", F.lit("a"))
        .unionByName(side_b.withColumn("side", F.lit("b")))
    )


@query("job_two_way", SIDES)
def _(spark, sf):
    a, b = _pair_stores(spark, sf)
    jobs.run(_pair_job(), a, b)
    return _sides(a, b)


# -- what is turned away, and what happens between reading and publishing ---------------

ERRORS = "pk_value, audit_error, source_table_name"


def _errors(store: SnapshotStore) -> DataFrame:
    names = [c.strip() for c in ERRORS.split(",")]
    return store.read(jobs.ERROR_TABLE).select(*names)


@query(
    "job_full_flux",
    with_tables(
        """SELECT 'orders' AS source_table_name, 'orders_copy' AS target_table_name,
                  count(CASE WHEN k NOT IN (SELECT k FROM tgt) THEN 1 END) AS count_i,
                  CAST(0 AS BIGINT) AS count_d,
                  count(CASE WHEN k IN (SELECT k FROM tgt) THEN 1 END) AS count_u FROM src""",
        src=PLAIN,
        tgt=fx.TARGET,
    ),
)
def _(spark, sf):
    """The changes of a job, counted by the pass that writes them."""
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit({"orders": table(spark, sf, "orders")})
    target.commit({"orders_copy": rows(spark, sf, fx.TARGET)})
    jobs.run(SyncJob(name="orders", apptype="db_qb", tables=(fx.orders_spec(),)), source, target)
    names = ["source_table_name", "target_table_name", "count_i", "count_d", "count_u"]
    return target.read(jobs.FLUX_TABLE).select(*names)


class _FailingOnce(SnapshotStore):
    """A store whose next commit fails after the other side was published."""

    failed = False

    def commit(self, *args, **options) -> bool:
        if not self.failed:
            self.failed = True
            raise CommitConflict("another writer was here")
        return super().commit(*args, **options)


@query("job_two_way_retry", SIDES)
def _(spark, sf):
    """A conflict between the sides: what side b was given is neither decided nor recorded again."""
    a, b = _pair_stores(spark, sf)
    failing = _FailingOnce(spark, a.path)
    jobs.run(_pair_job(), failing, b)
    return _sides(a, b)


# Events without a marker belong to no slice.
UNDATED = """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN NULL ELSE ts END AS ts, user_id, event_type
             FROM events"""


def _dated_job() -> SyncJob:
    return SyncJob(name="events", apptype="db_sjbj", tables=(EVENTS,))


@query(
    "date_marker_errors",
    f"""SELECT concat('event_id;BIGINT;', CAST(event_id AS STRING), ';') AS pk_value,
               'marker is missing' AS audit_error, 'events' AS source_table_name
        FROM ({UNDATED}) q WHERE ts IS NULL""",
)
def _(spark, sf):
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit({"events": rows(spark, sf, UNDATED)})
    jobs.run(_dated_job(), source, target)
    return _errors(target)


@query(
    "error_log_once",
    f"""SELECT concat('event_id;BIGINT;', CAST(event_id AS STRING), ';') AS pk_value,
               'marker is missing' AS audit_error, 'events' AS source_table_name
        FROM ({UNDATED}) q WHERE ts IS NULL""",
)
def _(spark, sf):
    """Three cycles over rows that stay bad: each is reported in the first."""
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit({"events": rows(spark, sf, UNDATED)})
    for _ in range(3):
        jobs.run(_dated_job(), source, target)
    return _errors(target)


# Rows that come when their slices have been copied.
LATE = """SELECT event_id + 1000000000 AS event_id, ts, user_id, event_type FROM events
          WHERE event_id % 40 = 1 AND ts < (SELECT max(ts) FROM events) - INTERVAL 1 DAY"""


@query(
    "date_marker_late",
    f"""SELECT concat('event_id;BIGINT;', CAST(event_id AS STRING), ';') AS pk_value,
               'row is older than the saved position' AS audit_error, 'events' AS source_table_name
        FROM ({LATE}) q""",
)
def _(spark, sf):
    """Late rows are reported in the cycle that first sees them, and not again."""
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit({"events": table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")})
    jobs.run(_dated_job(), source, target)
    source.commit(appends={"events": rows(spark, sf, LATE)})
    for _ in range(2):
        jobs.run(_dated_job(), source, target)
    return _errors(target)


@query(
    "job_date_marker_cycles",
    """SELECT event_id, ts AS seen_at, user_id, event_type FROM events e,
              (SELECT min(ts) AS lo, max(ts) AS hi FROM events) b
       WHERE ts < lo + to_seconds(60 * CAST(floor((epoch_us(hi) - epoch_us(lo) - 1) / 60000000) AS BIGINT))""",
)
def _(spark, sf):
    """Two cycles; between them the source gets its later rows."""
    events = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit({"events": events.where(F.col("event_id") <= half)})
    jobs.run(_dated_job(), source, target)
    source.commit(appends={"events": events.where(F.col("event_id") > half)})
    jobs.run(_dated_job(), source, target)
    return target.read("events_copy")


# The log with keys that are no numbers and operations that are none.
BAD_LOG = f"""
SELECT id, dbname, tablename,
       CASE WHEN id % 50 = 7 THEN 'user_id;NUMBER;none;' ELSE pks END AS pks,
       CASE WHEN id % 50 = 8 THEN 'X' ELSE op END AS op, op_time
FROM ({fx.LOG}) l"""
BAD_OPS = f"""SELECT pks AS pk_value, 'unknown operation in the change log' AS audit_error,
                     concat('t', right(tablename, 1)) AS source_table_name
              FROM ({BAD_LOG}) q WHERE op = 'X'"""
BAD_KEYS = f"""SELECT DISTINCT pks AS pk_value, 'unreadable key in the change log' AS audit_error,
                      concat('t', right(tablename, 1)) AS source_table_name
               FROM ({BAD_LOG}) q WHERE pks LIKE '%none%' AND op IN ('I', 'U')"""


@query("job_cdc_errors", f"{BAD_OPS} UNION ALL {BAD_KEYS}")
def _(spark, sf):
    source, target = _store(spark, "source"), _store(spark, "target")
    source.commit(
        ch.split_by_table(rows(spark, sf, fx.STATE)) | {"change_log": rows(spark, sf, BAD_LOG)}
    )
    target.commit(ch.split_by_table(rows(spark, sf, fx.STALE), "_copy"))
    jobs.run_cdc(fx.users_job(), source, target)
    return _errors(target)


@query("job_cdc_parts", ch.many_sql())
def _(spark, sf):
    """Log in spans of ids, targets in parts by key: only touched parts are written anew."""
    layout = {f"t{m}_copy": Parts(("user_id",), count=16) for m in range(3)}
    source = SnapshotStore(
        spark, scratch_path(spark, "source"), {"change_log": Parts(("id",), span_bits=10)}
    )
    target = SnapshotStore(spark, scratch_path(spark, "target"), layout)
    source.commit(
        ch.split_by_table(rows(spark, sf, fx.STATE)) | {"change_log": rows(spark, sf, fx.LOG)}
    )
    target.commit(ch.split_by_table(rows(spark, sf, fx.STALE), "_copy"))
    jobs.run_cdc(fx.users_job(), source, target)
    return _copies(target)


@query("job_marker_parts", "SELECT o_orderkey, o_totalprice, 1 AS sync_flag FROM orders")
def _(spark, sf):
    """Source in parts by key: only parts with flagged rows are written anew."""
    source = SnapshotStore(
        spark, scratch_path(spark, "source"), {"orders": Parts(("o_orderkey",), count=16)}
    )
    target = _store(spark, "target")
    source.commit({"orders": rows(spark, sf, fx.FLAGGED)})
    target.commit({"orders_copy": rows(spark, sf, fx.TARGET)})
    job = SyncJob(name="marked", apptype="db_bj", tables=(fx.orders_spec(flag=FLAG),))
    jobs.run(job, source, target)
    return source.read("orders").select("o_orderkey", "o_totalprice", "sync_flag")


# -- streams ------------------------------------------------------------------------------


def _file_stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One of the given tables as a stream."""
    schema = table(spark, sf, name).schema
    return read_log_stream(spark, sf, schema, glob=f"{name}.parquet")


@query("stream_full_once", FULL)
def _(spark, sf):
    target = _store(spark, "target")
    target.commit({"orders_copy": rows(spark, sf, fx.TARGET)})
    job = SyncJob(name="orders", apptype="db_qb", tables=(fx.orders_spec(only_once=True),))
    run = streams.stream_full(
        _file_stream(spark, sf, "orders"), target, job, job.tables[0], scratch_path(spark, "offsets")
    )
    run.awaitTermination()
    return target.read("orders_copy")


def _log_stream(spark: SparkSession, sf: str) -> DataFrame:
    return _file_stream(spark, sf, "events").selectExpr(
        "event_id + 1 AS id",
        "'DB' AS dbname",
        "concat('T', CAST(user_id % 3 AS STRING)) AS tablename",
        "concat('user_id;NUMBER;', CAST(user_id AS STRING), ';') AS pks",
        "CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op",
        "ts AS op_time",
    )


@query("stream_cdc", ch.many_sql())
def _(spark, sf):
    source, target = _user_stores(spark, sf, with_log=False)
    run = streams.stream_cdc(
        _log_stream(spark, sf),
        source,
        target,
        fx.users_job(),
        scratch_path(spark, "offsets"),
        once=True,
    )
    run.awaitTermination()
    return _copies(target)


@query(
    "stream_time_slices",
    """SELECT date_trunc('minute', ts) AS slice_start,
              date_trunc('minute', ts) + INTERVAL 1 MINUTE AS slice_end, count(*) AS n_rows
       FROM events GROUP BY date_trunc('minute', ts)
       HAVING date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) FROM events)""",
)
def _(spark, sf):
    path = scratch_path(spark, "slices")
    counts = streams.slice_counts(_file_stream(spark, sf, "events"), "ts")
    run = (
        counts.writeStream.format("parquet")
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True)
        .start(path)
    )
    run.awaitTermination()
    return spark.read.parquet(path)


@query("stream_date_marker", DATED)
def _(spark, sf):
    target = _store(spark, "target")
    target.commit({"events_copy": rows(spark, sf, EVENT_TARGET)})
    job = SyncJob(name="events", apptype="db_sjbj", tables=(EVENTS,))
    run = streams.stream_date_marker(
        _file_stream(spark, sf, "events"), target, job, EVENTS, scratch_path(spark, "offsets"), once=True
    )
    run.awaitTermination()
    return target.read("events_copy")


def _echo_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The log as captured rows, and the even ids as rows applied for the peer."""
    return (
        _log_stream(spark, sf)
        .withColumn("origin", F.lit("peer"))
        .withColumn("row_hash", F.lit(None).cast("long"))
        .withColumn(
            "side",
            F.explode(
                F.when(F.col("id") % 2 == 0, F.array(F.lit("captured"), F.lit("applied"))).otherwise(
                    F.array(F.lit("captured"))
                )
            ),
        )
    )


@query(
    "stream_echo",
    ch.ECHO_FREE.format(columns="id, tablename, pks, op", captured=fx.LOG, applied=fx.PEER),
)
def _(spark, sf):
    tagged = _echo_stream(spark, sf)
    store = _store(spark, "echo")
    run = streams.stream_echo(tagged, store, "echo", scratch_path(spark, "offsets"), once=True)
    run.awaitTermination()
    return store.read(streams.FORWARDED).select("id", "tablename", "pks", "op")


SPAN_BITS = 8
SPANNED = f"""SELECT *, id // {1 << SPAN_BITS} AS span FROM ({{log}}) q"""


@query(
    "stream_echo_state",
    ch.ECHO_FREE.replace("PARTITION BY tablename", "PARTITION BY span, tablename")
    .replace("a.n = c.n", "a.n = c.n AND a.span = c.span")
    .format(
        columns="id, tablename, pks, op",
        captured=SPANNED.format(log=fx.LOG),
        applied=SPANNED.format(log=fx.PEER),
    ),
)
def _(spark, sf):
    """Pending echoes in the state store, keys spread over spans of ids."""
    path = scratch_path(spark, "echo")
    run = stream_echo_state(
        _echo_stream(spark, sf), path, scratch_path(spark, "offsets"), once=True, span_bits=SPAN_BITS
    )
    run.awaitTermination()
    sent = spark.read.parquet(path).where(F.col("kind") == FORWARD)
    return sent.select("id", "tablename", "pks", "op")


@query("stream_progress", "SELECT CAST(0 AS BIGINT) AS batch_id, count(*) AS n_rows FROM orders")
def _(spark, sf):
    """Rows per micro-batch, as the listener notes them."""
    target, noted = _store(spark, "target"), ProgressLog().watch(spark)
    try:
        job = SyncJob(name="orders", apptype="db_qb", tables=(fx.orders_spec(only_once=True),))
        orders = _file_stream(spark, sf, "orders")
        run = streams.stream_full(orders, target, job, job.tables[0], scratch_path(spark, "offsets"))
        run.awaitTermination()
        noted.wait(run)
    finally:
        noted.unwatch(spark)
    noted.publish(target)
    mine = target.read("stream_progress").where(F.col("query_id") == str(run.id))
    return mine.select("batch_id", "n_rows")


@query(
    "stream_collapse",
    f"""SELECT tablename, pks, arg_max(op, id) AS last_op, max(id) AS last_id,
               bool_or(op = 'D') AS has_delete, arg_max(op_time, id) AS last_time
        FROM ({fx.LOG}) q GROUP BY tablename, pks""",
)
def _(spark, sf):
    """The last op per key as a streaming aggregation."""
    store = _store(spark, "collapsed")
    run = streams.stream_collapse(
        _log_stream(spark, sf), store, "last_ops", "collapse", scratch_path(spark, "offsets"), once=True
    )
    run.awaitTermination()
    return store.read("last_ops")


@query("stream_cdc_table", ch.many_sql())
def _(spark, sf):
    """The change log as a table of the source store that captures append to."""
    source, target = _user_stores(spark, sf, with_log=False)
    log = rows(spark, sf, fx.LOG)
    for part in range(2):
        source.commit(appends={"change_log": log.where(F.col("id") % 2 == part)})
    run = stream_cdc_table(source, target, fx.users_job(), scratch_path(spark, "offsets"), once=True)
    run.awaitTermination()
    return _copies(target)
