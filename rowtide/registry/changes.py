"""Queries on the change log, replay, two-way synchronisation, sequences and audit."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.functions.keys import encode_pks, key_columns
from rowtide.operators import audit, changelog, digests, replay, sequences, slices, twoway
from rowtide.operators.compare import dedupe
from rowtide.plans.spec import FieldSpec, SyncJob, TableSpec
from rowtide.registry import fixtures as fx
from rowtide.registry.base import query, rows, table, with_tables
from rowtide.sources.log import ack_log, read_log
from rowtide.sources.scan import read_sequences
from rowtide.sources.snapshots import latest_checkpoint

USER = "CAST(split_part(pks, ';', 3) AS BIGINT)"


def replay_sql(log: str, source: str, target: str, *, insert_only=False, deletable=False) -> str:
    """End state of replaying ``log(id, op, user_id)`` onto ``target``, in plain SQL."""
    allowed = "op = 'I'"
    if not insert_only:
        allowed += " OR op = 'U'"
    if deletable:
        allowed += " OR op = 'D'"
    put = "CASE WHEN c.has_delete THEN 'P' ELSE 'A' END" if insert_only else "'P'"
    decided = f"""
      SELECT c.user_id, s.n_events, s.last_event,
             CASE WHEN c.last_op = 'D' OR (s.user_id IS NULL AND c.has_delete) THEN 'D'
                  WHEN s.user_id IS NOT NULL THEN {put} END AS action
      FROM (SELECT user_id, arg_max(op, id) AS last_op, bool_or(op = 'D') AS has_delete
            FROM {log} WHERE {allowed} GROUP BY user_id) c
      LEFT JOIN {source} s ON s.user_id = c.user_id"""
    return f"""
      SELECT user_id, n_events, last_event FROM {target}
      WHERE user_id NOT IN (SELECT user_id FROM ({decided}) d WHERE action IN ('P', 'D'))
      UNION ALL
      SELECT user_id, n_events, last_event FROM ({decided}) d
      WHERE action = 'P' OR (action = 'A' AND user_id NOT IN (SELECT user_id FROM {target}))"""


LOG_PARTS = {
    "log": f"SELECT id, tablename, op, {USER} AS user_id FROM ({fx.LOG}) q",
    "src": fx.STATE,
    "tgt": fx.STALE,
}


# -- the log itself ---------------------------------------------------------------


@query(
    "log_head_table",
    f"""SELECT id, tablename, pks, op, op_time FROM ({fx.LOG}) q
        WHERE id > 0 AND tablename = 'T1' ORDER BY id LIMIT 500""",
)
def _(spark, sf):
    head = read_log(rows(spark, sf, fx.LOG), table="t1", limit=500)
    return head.select("id", "tablename", "pks", "op", "op_time")


@query("log_head_mixed", f"SELECT id, tablename, op FROM ({fx.LOG}) q WHERE id > 0 ORDER BY id LIMIT 800")
def _(spark, sf):
    return read_log(rows(spark, sf, fx.LOG), limit=800).select("id", "tablename", "op")


@query(
    "ack_log",
    f"SELECT id, tablename FROM ({fx.LOG}) q WHERE NOT (tablename = 'T1' AND op <> 'U')",
)
def _(spark, sf):
    log = rows(spark, sf, fx.LOG)
    done = log.where("tablename = 'T1' AND op <> 'U'").select(F.lower("tablename").alias("tablename"), "id")
    return ack_log(log, done).select("id", "tablename")


@query("parse_pks", f"SELECT id, {USER} AS user_id FROM ({fx.LOG}) q")
def _(spark, sf):
    log = rows(spark, sf, fx.LOG)
    return key_columns(log, fx.users_spec("T1").fields).select("id", "user_id")


NAMED = """
SELECT c_custkey, concat(c_mktsegment, ',', c_name, ';50%') AS label,
       CAST(c_acctbal AS DECIMAL(12, 2)) AS balance FROM customer
"""

NAMED_FIELDS = [
    FieldSpec("c_custkey", "c_custkey", True, "BIGINT", "NUMBER"),
    FieldSpec("label", "label", True, "VARCHAR", "VARCHAR2"),
    FieldSpec("balance", "balance", True, "NUMERIC", "NUMBER", "12,2"),
]


@query(
    "encode_pks",
    f"""SELECT c_custkey, concat('c_custkey,label,balance;NUMBER,VARCHAR2,NUMBER;',
               CAST(c_custkey AS STRING), ',',
               replace(replace(replace(label, '%', '%25'), ',', '%2C'), ';', '%3B'), ',',
               CAST(balance AS STRING), ';') AS pks
        FROM ({NAMED}) q""",
)
def _(spark, sf):
    return rows(spark, sf, NAMED).select("c_custkey", encode_pks(NAMED_FIELDS).alias("pks"))


@query("encode_parse_pks", NAMED)
def _(spark, sf):
    text = rows(spark, sf, NAMED).select(encode_pks(NAMED_FIELDS).alias("pks"))
    return key_columns(text, NAMED_FIELDS)


RUNS = """SELECT id, tablename, op, sum(fresh) OVER (PARTITION BY {part} ORDER BY id) AS run_no
          FROM (SELECT id, tablename, op,
                       CASE WHEN {same} THEN 0 ELSE 1 END AS fresh
                FROM (SELECT id, tablename, op,
                             lag(op) OVER (PARTITION BY {part} ORDER BY id) AS last_op,
                             lag(tablename) OVER (PARTITION BY {part} ORDER BY id) AS last_table
                      FROM ({log}) q) r) s"""
RUNS_TABLE = RUNS.format(part="tablename", same="last_op = op", log=fx.LOG)
RUNS_MIXED = RUNS.format(part="1", same="last_op = op AND last_table = tablename", log=fx.LOG)


@query("run_batches", f"SELECT id, tablename, op, CAST(run_no AS BIGINT) AS run_no FROM ({RUNS_TABLE}) t")
def _(spark, sf):
    log = rows(spark, sf, fx.LOG).select("id", "tablename", "op")
    return changelog.run_batches(log)


@query(
    "run_batches_mixed",
    f"SELECT id, tablename, op, CAST(run_no AS BIGINT) AS run_no FROM ({RUNS_MIXED}) t",
)
def _(spark, sf):
    log = rows(spark, sf, fx.LOG).select("id", "tablename", "op")
    return changelog.run_batches(log, by=("op", "tablename"), partition=())


# The log with ids so far apart that every row has a bucket of its own.
SPARSE_LOG = f"""SELECT id * 70000000000 AS id, dbname, tablename, pks, op, op_time FROM ({fx.LOG}) l"""
SPARSE_PEER = f"""SELECT id * 70000000000 AS id, tablename, pks, op FROM ({fx.PEER}) p"""
SPARSE_RUNS = RUNS.format(
    part="1", same="last_op = op AND last_table = tablename", log=SPARSE_LOG
)


@query(
    "run_batches_sparse",
    f"SELECT id, tablename, op, CAST(run_no AS BIGINT) AS run_no FROM ({SPARSE_RUNS}) t",
)
def _(spark, sf):
    log = rows(spark, sf, SPARSE_LOG).select("id", "tablename", "op")
    return changelog.run_batches(log, by=("op", "tablename"), partition=())


@query(
    "run_sizes",
    f"""SELECT tablename, CAST(run_no AS BIGINT) AS run_no, op, count(*) AS n_rows,
               min(id) AS first_id, max(id) AS last_id
        FROM ({RUNS_TABLE}) t GROUP BY tablename, run_no, op""",
)
def _(spark, sf):
    log = rows(spark, sf, fx.LOG).select("id", "tablename", "op")
    runs = changelog.run_batches(log)
    return changelog.run_sizes(runs, ["op"], ["tablename"])


@query(
    "collapse",
    f"""SELECT tablename, pks, arg_max(op, id) AS last_op, max(id) AS last_id,
               bool_or(op = 'D') AS has_delete, arg_max(op_time, id) AS last_time
        FROM ({fx.LOG}) q GROUP BY tablename, pks""",
)
def _(spark, sf):
    return changelog.collapse(rows(spark, sf, fx.LOG), ["tablename", "pks"])


POLICIES = {"T0": (False, True), "T1": (True, True), "T2": (False, False)}


@query(
    "apply_policy",
    f"""SELECT id, tablename, op FROM ({fx.LOG}) q
        WHERE op = 'I' OR (op = 'U' AND tablename <> 'T1') OR (op = 'D' AND tablename <> 'T2')""",
)
def _(spark, sf):
    specs = replay.policies(spark, fx.users_job().tables)
    return replay.apply_policy(rows(spark, sf, fx.LOG), specs).select("id", "tablename", "op")


@query(
    "checkpoint_latest",
    """SELECT job, tablename, max(version) AS version, arg_max(value, version) AS value
       FROM (SELECT event_type AS job, concat('T', CAST(user_id % 3 AS STRING)) AS tablename,
                    event_id AS version, ts AS value FROM events) q
       GROUP BY job, tablename""",
)
def _(spark, sf):
    saved = table(spark, sf, "events").selectExpr(
        "event_type AS job",
        "concat('T', CAST(user_id % 3 AS STRING)) AS tablename",
        "event_id AS version",
        "ts AS value",
    )
    return latest_checkpoint(saved)


SLICES = """
SELECT event_id, ts, slice_no, lo + to_seconds(slice_no * 60) AS slice_start,
       lo + to_seconds(slice_no * 60 + 60) AS slice_end, hi
FROM (SELECT event_id, ts, lo, hi,
             CAST(floor((epoch_us(ts) - epoch_us(lo)) / 60000000) AS BIGINT) AS slice_no
      FROM events, (SELECT min(ts) AS lo, max(ts) AS hi FROM events) b) q
"""


@query(
    "time_slices",
    f"SELECT event_id, ts, slice_no, slice_start, slice_end FROM ({SLICES}) q WHERE slice_end < hi",
)
def _(spark, sf):
    cut = slices.time_slices(table(spark, sf, "events"), "ts")
    return cut.select("event_id", "ts", "slice_no", "slice_start", "slice_end")


@query(
    "next_position",
    """SELECT min(ts) + to_seconds(60 * CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts)) - 1)
                                                 / 60000000) AS BIGINT)) AS value FROM events""",
)
def _(spark, sf):
    return slices.next_position(table(spark, sf, "events"), "ts")


# -- capture ------------------------------------------------------------------------

CAPTURED_AT = datetime(2024, 1, 1)
DIFF = f"""
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS okey,
       coalesce(a.o_orderpriority, b.o_orderpriority) AS prio,
       CASE WHEN b.o_orderkey IS NULL THEN 'I' WHEN a.o_orderkey IS NULL THEN 'D'
            WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'U' END AS op
FROM ({fx.BEFORE}) b FULL JOIN ({fx.AFTER}) a
  ON a.o_orderkey = b.o_orderkey AND a.o_orderpriority = b.o_orderpriority
"""


def _captured_sql(names: str, tablename: str, ops: str) -> str:
    return f"""SELECT row_number() OVER (ORDER BY okey, prio) AS id, '{tablename}' AS tablename,
                      concat('{names};NUMBER,VARCHAR2;', CAST(okey AS STRING), ',', prio, ';') AS pks,
                      op, TIMESTAMP '2024-01-01 00:00:00' AS op_time
               FROM ({DIFF}) d WHERE op IN ({ops})"""


LOG_PART = ["id", "tablename", "pks", "op", "op_time"]


@query("capture_changes", _captured_sql("o_orderkey,o_orderpriority", "ORDERS", "'I', 'U', 'D'"))
def _(spark, sf):
    before, after = rows(spark, sf, fx.BEFORE), rows(spark, sf, fx.AFTER)
    log = changelog.capture_changes(before, after, fx.priced_spec(), op_time=CAPTURED_AT)
    return log.select(*LOG_PART)


@query("capture_by_digest", _captured_sql("o_orderkey,o_orderpriority", "ORDERS", "'I', 'U', 'D'"))
def _(spark, sf):
    before, after = rows(spark, sf, fx.BEFORE), rows(spark, sf, fx.AFTER)
    log = digests.capture_by_digest(before, after, fx.priced_spec(), span_bits=6, op_time=CAPTURED_AT)
    return log.select(*LOG_PART)


@query("capture_subset", _captured_sql("o_orderkey,o_orderpriority", "ORDERS", "'I', 'D'"))
def _(spark, sf):
    before, after = rows(spark, sf, fx.BEFORE), rows(spark, sf, fx.AFTER)
    log = changelog.capture_changes(
        before, after, fx.priced_spec(), ops=["I", "D"], op_time=CAPTURED_AT
    )
    return log.select(*LOG_PART)


@query("capture_reverse", _captured_sql("okey,prio", "ORDERS_COPY", "'I', 'U', 'D'"))
def _(spark, sf):
    names = {"o_orderkey": "okey", "o_orderpriority": "prio", "o_totalprice": "price"}
    names |= {"o_orderstatus": "status"}
    before = rows(spark, sf, fx.BEFORE).withColumnsRenamed(names)
    after = rows(spark, sf, fx.AFTER).withColumnsRenamed(names)
    log = changelog.capture_changes(
        before, after, fx.priced_spec(), reverse=True, op_time=CAPTURED_AT
    )
    return log.select(*LOG_PART)


@query(
    "capture_single_key",
    f"""SELECT row_number() OVER (ORDER BY okey) AS id,
               concat('o_orderkey;BIGINT;', CAST(okey AS STRING), ';') AS pks, op
        FROM ({DIFF}) d WHERE op IS NOT NULL""",
)
def _(spark, sf):
    before, after = rows(spark, sf, fx.BEFORE), rows(spark, sf, fx.AFTER)
    return changelog.capture_changes(before, after, fx.orders_spec()).select("id", "pks", "op")


# -- replay ---------------------------------------------------------------------------


def _replayed(name: str, mod: int, **policy) -> str:
    log = f"(SELECT * FROM log WHERE tablename = 'T{mod}') l"
    return with_tables(replay_sql(log, "src", "tgt", **policy), **LOG_PARTS)


@query("replay", _replayed("replay", 0, deletable=True))
def _(spark, sf):
    source, target = rows(spark, sf, fx.STATE), rows(spark, sf, fx.STALE)
    spec = fx.users_spec("t0", target_deletable=True)
    return replay.replay(source, target, rows(spark, sf, fx.LOG), spec)


@query("replay_insert_only", _replayed("replay_insert_only", 1, insert_only=True, deletable=True))
def _(spark, sf):
    source, target = rows(spark, sf, fx.STATE), rows(spark, sf, fx.STALE)
    spec = fx.users_spec("t1", insert_only=True, target_deletable=True)
    return replay.replay(source, target, rows(spark, sf, fx.LOG), spec)


@query(
    "replay_guarded",
    with_tables(
        replay_sql(
            """(SELECT l.* FROM log l LEFT JOIN (SELECT user_id, max(id) AS seen FROM log
                   WHERE id % 2 = 0 GROUP BY user_id) a ON a.user_id = l.user_id
                 WHERE l.tablename = 'T0' AND (a.seen IS NULL OR a.seen <
                   (SELECT max(m.id) FROM log m WHERE m.user_id = l.user_id))) l""",
            "src",
            "tgt",
            deletable=True,
        ),
        **LOG_PARTS,
    ),
)
def _(spark, sf):
    source, target = rows(spark, sf, fx.STATE), rows(spark, sf, fx.STALE)
    log = rows(spark, sf, fx.LOG)
    spec = fx.users_spec("t0", target_deletable=True)
    applied = (
        key_columns(log.where("id % 2 = 0"), spec.fields)
        .groupBy("user_id")
        .agg(F.max("id").alias("last_id"))
    )
    return replay.replay(source, target, log, spec, applied=applied)


def many_sql() -> str:
    parts = []
    for mod, (insert_only, deletable) in enumerate(POLICIES.values()):
        log = f"(SELECT * FROM log WHERE tablename = 'T{mod}') l"
        source = f"(SELECT * FROM src WHERE user_id % 3 = {mod})"
        target = f"(SELECT * FROM tgt WHERE user_id % 3 = {mod})"
        one = replay_sql(log, source, target, insert_only=insert_only, deletable=deletable)
        parts.append(f"SELECT 't{mod}_copy' AS tablename, * FROM ({one}) r{mod}")
    return with_tables(" UNION ALL ".join(parts), **LOG_PARTS)


def split_by_table(df: DataFrame, suffix: str = "") -> dict[str, DataFrame]:
    return {f"t{m}{suffix}": df.where(F.col("user_id") % 3 == m) for m in range(3)}


def labelled(states: dict[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("tablename", F.lit(name)) for name, df in states.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("replay_many", many_sql())
def _(spark, sf):
    sources = split_by_table(rows(spark, sf, fx.STATE))
    targets = split_by_table(rows(spark, sf, fx.STALE), "_copy")
    states = replay.replay_many(sources, targets, rows(spark, sf, fx.LOG), fx.users_job())
    return labelled(states)


# -- two-way --------------------------------------------------------------------------

ECHO_FREE = """SELECT {columns} FROM (SELECT *, row_number() OVER
                 (PARTITION BY tablename, pks, op ORDER BY id) AS n FROM ({captured}) q) c
               WHERE NOT EXISTS (SELECT 1 FROM (SELECT *, row_number() OVER
                 (PARTITION BY tablename, pks, op ORDER BY id) AS n FROM ({applied}) q) a
                 WHERE a.tablename = c.tablename AND a.pks = c.pks AND a.op = c.op AND a.n = c.n)"""


@query(
    "suppress_echo",
    ECHO_FREE.format(columns="id, tablename, pks, op", captured=fx.LOG, applied=fx.PEER),
)
def _(spark, sf):
    log, peer = rows(spark, sf, fx.LOG), rows(spark, sf, fx.PEER)
    return twoway.suppress_echo(log, peer).select("id", "tablename", "pks", "op")


@query(
    "suppress_echo_sparse",
    ECHO_FREE.format(columns="id, tablename, pks, op", captured=SPARSE_LOG, applied=SPARSE_PEER),
)
def _(spark, sf):
    log, peer = rows(spark, sf, SPARSE_LOG), rows(spark, sf, SPARSE_PEER)
    return twoway.suppress_echo(log, peer).select("id", "tablename", "pks", "op")


def _pending(log: str, applied: str) -> str:
    fresh = ECHO_FREE.format(columns="*", captured=log, applied=applied)
    return f"""SELECT {USER} AS user_id, arg_max(op, id) AS last_op, max(id) AS last_id,
                      bool_or(op = 'D') AS has_delete, arg_max(op_time, id) AS last_time
               FROM ({fresh}) f GROUP BY 1"""


MET = """
SELECT p.user_id AS uid, p.last_op AS a_op, p.last_id AS a_id, p.last_time AS a_time,
       q.last_op AS b_op, q.last_id AS b_id, q.last_time AS b_time,
       CASE WHEN q.last_time > p.last_time OR (q.last_time = p.last_time AND q.last_id > p.last_id)
            THEN 'target' ELSE 'source' END AS winner
FROM pa p JOIN pb q ON q.user_id = p.user_id
"""
DECIDED = """
SELECT c.user_id, s.n, s.l, CASE WHEN c.last_op = 'D' OR (s.user_id IS NULL AND c.has_delete) THEN 'D'
       WHEN s.user_id IS NOT NULL THEN 'P' END AS action
FROM {pending} c LEFT JOIN {source} s ON s.user_id = c.user_id
WHERE c.user_id NOT IN (SELECT uid FROM met WHERE winner = '{lost}')
"""
TWO_WAY = {
    "sa": f"SELECT user_id, n_events AS n, last_event AS l FROM ({fx.SIDE_A}) q",
    "sb": f"SELECT uid AS user_id, cnt AS n, last_ev AS l FROM ({fx.SIDE_B}) q",
    "pa": _pending(fx.LOG_A, fx.APPLIED_A),
    "pb": _pending(fx.LOG_B, fx.APPLIED_B),
    "met": MET,
    "to_b": DECIDED.format(pending="pa", source="sa", lost="target"),
    "to_a": DECIDED.format(pending="pb", source="sb", lost="source"),
}


def two_way_sql(side: str, names: str) -> str:
    return with_tables(
        f"""SELECT {names} FROM (
              SELECT user_id, n, l FROM s{side}
              WHERE user_id NOT IN (SELECT user_id FROM to_{side} WHERE action IS NOT NULL)
              UNION ALL SELECT user_id, n, l FROM to_{side} WHERE action = 'P') r""",
        **TWO_WAY,
    )


SQL_A = two_way_sql("a", "user_id, n AS n_events, l AS last_event")
SQL_B = two_way_sql("b", "user_id AS uid, n AS cnt, l AS last_ev")


def _two_way(spark, sf) -> twoway.TwoWay:
    return twoway.two_way(
        rows(spark, sf, fx.SIDE_A),
        rows(spark, sf, fx.SIDE_B),
        rows(spark, sf, fx.LOG_A),
        rows(spark, sf, fx.LOG_B),
        fx.pair_spec(),
        applied_a=rows(spark, sf, fx.APPLIED_A),
        applied_b=rows(spark, sf, fx.APPLIED_B),
    )


@query("two_way_a", SQL_A)
def _(spark, sf):
    return _two_way(spark, sf).a


@query("two_way_b", SQL_B)
def _(spark, sf):
    return _two_way(spark, sf).b


@query("two_way_conflicts", with_tables("SELECT * FROM met", **TWO_WAY))
def _(spark, sf):
    return _two_way(spark, sf).conflicts


@query(
    "twoway_apply",
    with_tables(
        """SELECT 'users' AS origin, 'PEOPLE' AS tablename,
                  concat('uid;NUMBER;', CAST(d.user_id AS STRING), ';') AS pks,
                  CASE WHEN d.action = 'D' THEN 'D' WHEN b.user_id IS NULL THEN 'I' ELSE 'U' END AS op
           FROM to_b d LEFT JOIN sb b ON b.user_id = d.user_id
           WHERE d.action = 'P' OR (d.action = 'D' AND b.user_id IS NOT NULL)""",
        **TWO_WAY,
    ),
)
def _(spark, sf):
    return _two_way(spark, sf).applied_b.select("origin", "tablename", "pks", "op")


# -- sequences --------------------------------------------------------------------------


@query(
    "sequence_catalog",
    f"""SELECT sequence_name, last_number, increment_by, cache_size FROM ({fx.SEQ_SOURCE}) q
        WHERE sequence_name IN ('SEQ_7', 'SEQ_11', 'SEQ_40', 'SEQ_41')""",
)
def _(spark, sf):
    names = ["seq_7", "seq_11", "seq_40", "seq_41"]
    return read_sequences(rows(spark, sf, fx.SEQ_SOURCE), names).drop("sequence_owner")


SEQ_PAIRS = f"""
SELECT s.sequence_name AS name,
       CASE WHEN same THEN 'last_number' ELSE 'currval' END AS mode,
       CASE WHEN same THEN s.last_number ELSE s.currval END AS src_value,
       CASE WHEN same THEN t.last_number ELSE t.currval END AS tgt_value,
       s.increment_by AS src_inc, t.increment_by AS tgt_inc
FROM (SELECT *, increment_by = cache_size AS square FROM ({fx.SEQ_SOURCE}) q) s
JOIN ({fx.SEQ_TARGET}) t ON upper(t.sequence_name) = s.sequence_name,
LATERAL (SELECT s.increment_by = t.increment_by AND s.cache_size = t.cache_size AND s.square AS same) m
"""


def _catalogs(spark, sf):
    return [
        rows(spark, sf, sql).withColumnRenamed("sequence_name", "name")
        for sql in (fx.SEQ_SOURCE, fx.SEQ_TARGET)
    ]


@query(
    "sequence_plan",
    f"""SELECT name, mode, src_value, tgt_value, side, delta,
               CASE WHEN side IS NULL THEN 'none' WHEN delta = inc THEN 'single'
                    ELSE 'temporary' END AS step,
               CASE WHEN side IS NOT NULL AND delta <> inc THEN inc END AS restore_increment
        FROM (SELECT *, abs(src_value - tgt_value) AS delta,
                     CASE WHEN src_value > tgt_value THEN 'target'
                          WHEN src_value < tgt_value THEN 'source' END AS side,
                     CASE WHEN src_value > tgt_value THEN tgt_inc ELSE src_inc END AS inc
              FROM ({SEQ_PAIRS}) p) q""",
)
def _(spark, sf):
    return sequences.sequence_plan(*_catalogs(spark, sf))


@query(
    "sequence_reconciled",
    f"""SELECT name, greatest(src_value, tgt_value) AS src_value,
               greatest(src_value, tgt_value) AS tgt_value, src_inc, tgt_inc
        FROM ({SEQ_PAIRS}) p""",
)
def _(spark, sf):
    return sequences.sequence_reconciled(*_catalogs(spark, sf))


# -- audit --------------------------------------------------------------------------------

AUDIT_JOB = SyncJob(name="orders", apptype="db_qb", source_db="left", target_db="right")


@query(
    "flux",
    f"""SELECT tablename, CAST(op_time AS DATE) AS cycle,
               count(*) FILTER (op = 'I') AS count_i, count(*) FILTER (op = 'D') AS count_d,
               count(*) FILTER (op = 'U') AS count_u
        FROM ({fx.LOG}) q GROUP BY tablename, CAST(op_time AS DATE)""",
)
def _(spark, sf):
    log = rows(spark, sf, fx.LOG).withColumn("cycle", F.col("op_time").cast("date"))
    return audit.flux(log, ["tablename", "cycle"])


@query(
    "upsert_flux",
    f"""SELECT 'orders' AS business_name, 'left' AS source_jdbc_name, 'orders' AS source_table_name,
               'right' AS target_jdbc_name, 'orders_copy' AS target_table_name, 2 AS cycle,
               count(*) FILTER (op = 'I') AS count_i, count(*) FILTER (op = 'D') AS count_d,
               count(*) FILTER (op = 'U') AS count_u, 0 AS flag
        FROM ({fx.LOG}) q WHERE tablename = 'T0'
        UNION ALL
        SELECT 'users', 'left', 'orders', 'right', 'orders_copy', 1,
               count(*) FILTER (op = 'I'), count(*) FILTER (op = 'D'),
               count(*) FILTER (op = 'U'), 0
        FROM ({fx.LOG}) q WHERE tablename = 'T2'""",
)
def _(spark, sf):
    log = rows(spark, sf, fx.LOG)
    spec = fx.orders_spec()
    other = SyncJob(name="users", apptype="db_cf", source_db="left", target_db="right")
    before = audit.job_flux(log.where("tablename = 'T1'"), AUDIT_JOB, spec, 1).unionByName(
        audit.job_flux(log.where("tablename = 'T2'"), other, spec, 1)
    )
    return audit.upsert_flux(before, audit.job_flux(log.where("tablename = 'T0'"), AUDIT_JOB, spec, 2))


LINES = TableSpec.from_dict(
    {
        "source": "lineitem",
        "fields": [
            {"source": "l_orderkey", "pk": True, "jdbc_type": "BIGINT", "db_type": "NUMBER"},
            {"source": "l_linenumber", "pk": True, "jdbc_type": "INTEGER", "db_type": "NUMBER"},
            {"source": "l_partkey", "jdbc_type": "BIGINT"},
            {"source": "l_suppkey", "jdbc_type": "BIGINT"},
            {"source": "l_quantity", "jdbc_type": "DOUBLE"},
        ],
    }
)

REJECTED = f"""
SELECT l_orderkey, l_linenumber, count(*) AS copies FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_partkey, l_suppkey, l_quantity) AS n FROM ({fx.DUPLICATES}) q) r
WHERE n > 1 GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity
"""


@query(
    "error_log",
    f"""SELECT 'ERROR' AS level, 'orders' AS business_name, 'left' AS source_jdbc_name,
               'lineitem' AS source_table_name, 'right' AS target_jdbc_name,
               'lineitem' AS target_table_name,
               concat('l_orderkey,l_linenumber;NUMBER,NUMBER;', CAST(l_orderkey AS STRING), ',',
                      CAST(l_linenumber AS STRING), ';') AS pk_value,
               concat('duplicate key, copies: ', CAST(copies AS STRING)) AS audit_error,
               'rowtide' AS operator, 0 AS flag
        FROM ({REJECTED}) q""",
)
def _(spark, sf):
    rejected = dedupe(rows(spark, sf, fx.DUPLICATES), LINES.pk, ["l_partkey"])[1]
    reason = F.concat(F.lit("duplicate key, copies: "), F.col("copies").cast("string"))
    return audit.error_log(rejected, AUDIT_JOB, LINES, reason).drop("log_time")
