"""Inputs derived from the base tables, in SQL that Spark and DuckDB both accept."""

from __future__ import annotations

from rowtide.plans.spec import SyncJob, TableSpec

# Target lacking a fifth of the orders, with a seventh of the rest changed, and
# some rows the source does not have.
TARGET = """
SELECT o_orderkey AS k,
       CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 10 ELSE o_totalprice END AS price,
       o_orderstatus AS status
FROM orders WHERE o_orderkey % 5 <> 0
UNION ALL
SELECT -o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 50 = 1
"""

# Orders under target names, with NULLs that must overwrite.
SOURCE = """
SELECT o_orderkey AS k,
       CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS price,
       o_orderstatus AS status
FROM orders
"""

FLAGGED = "SELECT *, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE 1 END AS sync_flag FROM orders"

LOG = """
SELECT event_id + 1 AS id, 'DB' AS dbname,
       concat('T', CAST(user_id % 3 AS STRING)) AS tablename,
       concat('user_id;NUMBER;', CAST(user_id AS STRING), ';') AS pks,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       ts AS op_time
FROM events
"""

# Current source rows for the log; some keys are gone.
STATE = """
SELECT user_id, count(*) AS n_events, max(event_id) AS last_event
FROM events WHERE user_id % 4 <> 0 GROUP BY user_id
"""

# What the target of the log holds so far.
STALE = """
SELECT user_id, count(*) AS n_events, max(event_id) AS last_event
FROM events WHERE user_id % 5 <> 0 AND event_type <> 'view' GROUP BY user_id
"""

# Changes of the log that came from the other side.
PEER = f"SELECT id, tablename, pks, op FROM ({LOG}) q WHERE id % 2 = 0"

DUPLICATES = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem"

# Two snapshots of the orders: keys come, go and change.
BEFORE = """
SELECT o_orderkey, o_orderpriority, o_totalprice, o_orderstatus FROM orders WHERE o_orderkey % 9 <> 0
"""
AFTER = """
SELECT o_orderkey, o_orderpriority,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderstatus
FROM orders WHERE o_orderkey % 8 <> 0
"""

# One sequence per customer on either side.
SEQ_SOURCE = """
SELECT 'DB' AS sequence_owner, concat('SEQ_', CAST(o_custkey AS STRING)) AS sequence_name,
       max(o_orderkey) AS last_number, 1 + o_custkey % 2 AS increment_by,
       1 + o_custkey % 3 AS cache_size, max(o_orderkey) + o_custkey % 4 AS currval
FROM orders GROUP BY o_custkey
"""
SEQ_TARGET = """
SELECT 'DB' AS sequence_owner, concat('seq_', CAST(o_custkey AS STRING)) AS sequence_name,
       max(o_orderkey) + o_custkey % 5 - 2 AS last_number, CAST(1 AS BIGINT) AS increment_by,
       1 + o_custkey % 3 AS cache_size, max(o_orderkey) + 1 AS currval
FROM orders WHERE o_custkey % 11 <> 0 GROUP BY o_custkey
"""

# Both sides of a two-way pair and their logs.
SIDE_A = STATE
SIDE_B = """
SELECT user_id AS uid, count(*) + 1 AS cnt, min(event_id) AS last_ev
FROM events WHERE user_id % 5 <> 0 GROUP BY user_id
"""
LOG_A = """
SELECT event_id + 1 AS id, 'A' AS dbname, 'USERS' AS tablename,
       concat('user_id;NUMBER;', CAST(user_id AS STRING), ';') AS pks,
       CASE event_type WHEN 'signup' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       ts AS op_time
FROM events WHERE event_id % 2 = 0 AND user_id % 7 <> 3
"""
LOG_B = """
SELECT event_id + 1 AS id, 'B' AS dbname, 'PEOPLE' AS tablename,
       concat('uid;NUMBER;', CAST(user_id AS STRING), ';') AS pks,
       CASE event_type WHEN 'click' THEN 'I' WHEN 'error' THEN 'D' ELSE 'U' END AS op,
       ts AS op_time
FROM events WHERE event_id % 2 = 1 AND user_id % 3 = 0
"""
# Changes in either log that the other side caused.
APPLIED_A = f"SELECT 'B' AS origin, tablename, pks, op, id FROM ({LOG_A}) q WHERE id % 9 = 0"
APPLIED_B = f"SELECT 'A' AS origin, tablename, pks, op, id FROM ({LOG_B}) q WHERE id % 8 = 2"


def orders_spec(**policy) -> TableSpec:
    return TableSpec.from_dict(
        {
            "source": "orders",
            "target": "orders_copy",
            "fields": [
                {"source": "o_orderkey", "target": "k", "pk": True, "jdbc_type": "BIGINT"},
                {"source": "o_totalprice", "target": "price", "jdbc_type": "DOUBLE"},
                {"source": "o_orderstatus", "target": "status", "jdbc_type": "CHAR"},
            ],
            **policy,
        }
    )


def priced_spec() -> TableSpec:
    """Orders keyed by number and priority text, under the names of the snapshots."""
    return TableSpec.from_dict(
        {
            "source": "orders",
            "target": "orders_copy",
            "fields": [
                {
                    "source": "o_orderkey",
                    "target": "okey",
                    "pk": True,
                    "jdbc_type": "BIGINT",
                    "db_type": "NUMBER",
                },
                {
                    "source": "o_orderpriority",
                    "target": "prio",
                    "pk": True,
                    "db_type": "VARCHAR2",
                },
                {"source": "o_totalprice", "target": "price", "jdbc_type": "DOUBLE"},
                {"source": "o_orderstatus", "target": "status", "jdbc_type": "CHAR"},
            ],
        }
    )


def users_spec(source: str, **policy) -> TableSpec:
    return TableSpec.from_dict(
        {
            "source": source,
            "target": source.lower() + "_copy",
            "fields": [
                {"source": "user_id", "pk": True, "jdbc_type": "BIGINT", "db_type": "NUMBER"},
                {"source": "n_events", "jdbc_type": "BIGINT"},
                {"source": "last_event", "jdbc_type": "BIGINT"},
            ],
            **policy,
        }
    )


def pair_spec() -> TableSpec:
    return TableSpec.from_dict(
        {
            "source": "users",
            "target": "people",
            "target_deletable": True,
            "fields": [
                {
                    "source": "user_id",
                    "target": "uid",
                    "pk": True,
                    "jdbc_type": "BIGINT",
                    "db_type": "NUMBER",
                },
                {"source": "n_events", "target": "cnt", "jdbc_type": "BIGINT"},
                {"source": "last_event", "target": "last_ev", "jdbc_type": "BIGINT"},
            ],
        }
    )


def users_job() -> SyncJob:
    """Three tables with three policies, in stage order."""
    return SyncJob(
        name="users",
        apptype="db_cf",
        source_log="change_log",
        tables=(
            users_spec("t0", target_deletable=True, seqnumber=1),
            users_spec("t1", insert_only=True, target_deletable=True, seqnumber=2),
            users_spec("t2", seqnumber=3),
        ),
    )
