"""Queries on scans, write-back, mapping, comparison and counting."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowtide.functions.coerce import coerce
from rowtide.functions.geometry import geometry_from_text, geometry_to_text
from rowtide.functions.types import type_catalog
from rowtide.operators import compare, writeback
from rowtide.operators.numbering import page_count, paginate
from rowtide.operators.paging import page_index, read_page
from rowtide.operators.stages import table_stages
from rowtide.plans.spec import FieldSpec
from rowtide.registry import fixtures as fx
from rowtide.registry.base import query, rows, table, with_tables
from rowtide.sources import scan



@query("scan_mapped", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders")
def _(spark, sf):
    return scan.scan(table(spark, sf, "orders"), fx.orders_spec())


@query(
    "paginate",
    """SELECT o_orderkey, row_no, CAST(floor((row_no - 1) / 1000) AS BIGINT) + 1 AS page_no
       FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS row_no FROM orders) q""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return paginate(orders, ["o_orderkey"], 1000)


# Ids so far apart that every row has a bucket of its own; some rows have none.
SPARSE = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderkey * 70000000000 END AS k,
                   o_custkey FROM orders"""


@query(
    "paginate_sparse",
    f"""SELECT k, row_no, CAST(floor((row_no - 1) / 1000) AS BIGINT) + 1 AS page_no
        FROM (SELECT k, row_number() OVER (ORDER BY k NULLS FIRST) AS row_no FROM ({SPARSE}) s) q""",
)
def _(spark, sf):
    return paginate(rows(spark, sf, SPARSE), ["k"], 1000).select("k", "row_no", "page_no")


@query(
    "paginate_by_text",
    """SELECT p_brand, p_partkey, p_size, row_no,
              CAST(floor((row_no - 1) / 250) AS BIGINT) + 1 AS page_no
       FROM (SELECT p_brand, p_partkey, p_size,
                    row_number() OVER (ORDER BY p_brand, p_partkey) AS row_no FROM part) q""",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return paginate(part, ["p_brand", "p_partkey"], 250)


PAGE = """SELECT {columns}, row_no, CAST({page} AS BIGINT) AS page_no
          FROM (SELECT {columns}, row_number() OVER (ORDER BY {keys}) AS row_no FROM {table}) q
          WHERE row_no > {size} * ({page} - 1) AND row_no <= {size} * {page}"""


@query(
    "read_page",
    PAGE.format(columns="o_orderkey, o_totalprice", keys="o_orderkey", table="orders", page=7, size=100),
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return read_page(orders, page_index(orders, ["o_orderkey"], ranges=64), 7, 100)


@query(
    "read_page_by_text",
    PAGE.format(columns="p_brand, p_partkey, p_size", keys="p_brand, p_partkey", table="part", page=3, size=40),
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_size")
    return read_page(part, page_index(part, ["p_brand", "p_partkey"], ranges=16), 3, 40)


@query("source_count_footers", "SELECT count(*) AS n FROM lineitem")
def _(spark, sf):
    return scan.source_count(scan.footer_table(spark, f"{sf.rstrip('/')}/lineitem.parquet"))


@query("marker_bounds_footers", "SELECT min(event_id) AS lo, max(event_id) AS hi FROM events")
def _(spark, sf):
    return scan.marker_bounds(scan.footer_table(spark, f"{sf.rstrip('/')}/events.parquet"), "event_id")


@query("scan_flagged", f"SELECT o_orderkey, sync_flag FROM ({fx.FLAGGED}) q WHERE sync_flag = 0")
def _(spark, sf):
    flagged = rows(spark, sf, fx.FLAGGED)
    return scan.scan_flagged(flagged, "sync_flag", 0).select("o_orderkey", "sync_flag")


@query(
    "scan_time_range",
    """SELECT event_id, ts, user_id FROM events
       WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-19 12:00:00'""",
)
def _(spark, sf):
    events = table(spark, sf, "events")
    chosen = scan.scan_time_range(events, "ts", "2024-01-05 00:00:00", "2024-01-19 12:00:00")
    return chosen.select("event_id", "ts", "user_id")


@query(
    "fetch_by_keys",
    f"SELECT * FROM ({fx.STATE}) s WHERE user_id IN (SELECT user_id FROM events WHERE user_id % 3 = 1)",
)
def _(spark, sf):
    keys = table(spark, sf, "events").where("user_id % 3 = 1").select("user_id")
    return scan.fetch_by_keys(rows(spark, sf, fx.STATE), keys, ["user_id"])


@query(
    "fetch_by_composite_keys",
    """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem l
       WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R'
                     AND r.l_orderkey = l.l_orderkey AND r.l_linenumber = l.l_linenumber)""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = lines.where("l_returnflag = 'R'")
    found = scan.fetch_by_keys(lines, keys, ["l_orderkey", "l_linenumber"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey")


# -- write-back --------------------------------------------------------------------

PAIR = {"src": fx.SOURCE, "tgt": fx.TARGET}


def _pair(spark, sf):
    return rows(spark, sf, fx.SOURCE), rows(spark, sf, fx.TARGET)


@query(
    "insert_only",
    with_tables(
        """SELECT k, price, status FROM tgt UNION ALL
           SELECT k, price, status FROM src WHERE k NOT IN (SELECT k FROM tgt)""",
        **PAIR,
    ),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.append(target, source, ["k"])


@query(
    "insert_conflicts",
    with_tables("SELECT k, price, status FROM src WHERE k IN (SELECT k FROM tgt)", **PAIR),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.conflicts(target, source, ["k"])


@query(
    "update_by_key",
    with_tables(
        """SELECT t.k, CASE WHEN s.k IS NULL THEN t.price ELSE s.price END AS price,
                  CASE WHEN s.k IS NULL THEN t.status ELSE s.status END AS status
           FROM tgt t LEFT JOIN src s ON s.k = t.k""",
        **PAIR,
    ),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.update_by_key(target, source, ["k"])


@query(
    "delete_by_key",
    with_tables("SELECT * FROM tgt WHERE k NOT IN (SELECT k FROM src WHERE status = 'F')", **PAIR),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.delete_by_key(target, source.where("status = 'F'"), ["k"])


UPSERTED = """SELECT k, price, status FROM src UNION ALL
              SELECT k, price, status FROM tgt WHERE k NOT IN (SELECT k FROM src)"""


@query("upsert", with_tables(UPSERTED, **PAIR))
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.upsert(target, source, ["k"])


@query("merge", with_tables(UPSERTED, **PAIR))
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.merge(target, source, ["k"])


@query(
    "move_target",
    with_tables(
        """SELECT k, price, status FROM src WHERE status <> 'P' UNION ALL
           SELECT k, price, status FROM tgt
           WHERE k NOT IN (SELECT k FROM src WHERE status <> 'P')""",
        **PAIR,
    ),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.move(source, target, source.where("status <> 'P'"), ["k"])[0]


@query("move_remaining", with_tables("SELECT * FROM src WHERE status = 'P'", src=fx.SOURCE))
def _(spark, sf):
    source, target = _pair(spark, sf)
    return writeback.move(source, target, source.where("status <> 'P'"), ["k"])[1]


@query(
    "flip_flag",
    f"""SELECT o_orderkey, CASE WHEN sync_flag = 0 AND o_orderkey % 4 <> 0 THEN 7 ELSE sync_flag
        END AS sync_flag FROM ({fx.FLAGGED}) q""",
)
def _(spark, sf):
    flagged = rows(spark, sf, fx.FLAGGED).select("o_orderkey", "sync_flag")
    copied = flagged.where("sync_flag = 0 AND o_orderkey % 4 <> 0")
    return writeback.flip_flag(flagged, copied, ["o_orderkey"], "sync_flag", 7)


# -- mapping and types --------------------------------------------------------------


@query(
    "project_forward",
    "SELECT o_orderkey AS k, o_totalprice AS price, o_orderstatus AS status FROM orders",
)
def _(spark, sf):
    return scan.project(table(spark, sf, "orders"), fx.orders_spec().fields)


@query(
    "project_reverse",
    f"""SELECT k AS o_orderkey, price AS o_totalprice, status AS o_orderstatus
        FROM ({fx.TARGET}) q""",
)
def _(spark, sf):
    return scan.project(rows(spark, sf, fx.TARGET), fx.orders_spec().fields, reverse=True)


COLUMN_CATALOG = """
SELECT p_partkey,
       CASE p_partkey % 5 WHEN 0 THEN 'ORACLE' WHEN 1 THEN 'MSSQL' WHEN 2 THEN 'MySQL'
                          WHEN 3 THEN 'DB2' ELSE 'Sybase' END AS vendor,
       CASE CAST(floor(p_partkey / 5) AS BIGINT) % 8
            WHEN 0 THEN concat(' VARCHAR2(', CAST(p_size AS STRING), ')')
            WHEN 1 THEN concat('decimal(', CAST(p_size AS STRING), ', 2)')
            WHEN 2 THEN 'TIMESTAMP(6)'
            WHEN 3 THEN concat('NUMBER(', CAST(p_size AS STRING), ')')
            WHEN 4 THEN 'TinyInt'
            WHEN 5 THEN 'int identity'
            WHEN 6 THEN 'CLOB'
            ELSE p_type END AS type
FROM part
"""


@query(
    "type_catalog",
    with_tables(
        """SELECT p_partkey, vendor, type,
             CASE kind WHEN 0 THEN 'VARCHAR'
                  WHEN 1 THEN CASE WHEN v = 'oracle' THEN 'VARCHAR' ELSE 'DECIMAL' END
                  WHEN 2 THEN CASE v WHEN 'mssql' THEN 'BINARY' WHEN 'sybase' THEN 'VARCHAR'
                              ELSE 'TIMESTAMP' END
                  WHEN 3 THEN CASE WHEN v IN ('oracle', 'db2') THEN 'NUMERIC' ELSE 'VARCHAR' END
                  WHEN 4 THEN CASE WHEN v IN ('mssql', 'mysql', 'sybase') THEN 'TINYINT'
                              ELSE 'VARCHAR' END
                  WHEN 5 THEN CASE WHEN v IN ('mssql', 'sybase') THEN 'INTEGER' ELSE 'VARCHAR' END
                  WHEN 6 THEN CASE WHEN v IN ('oracle', 'db2') THEN 'CLOB' ELSE 'VARCHAR' END
                  ELSE 'VARCHAR' END AS jdbc_type,
             CASE kind WHEN 1 THEN CASE WHEN v = 'oracle' THEN 12 ELSE 3 END
                  WHEN 2 THEN CASE v WHEN 'mssql' THEN -2 WHEN 'sybase' THEN 12 ELSE 93 END
                  WHEN 3 THEN CASE WHEN v IN ('oracle', 'db2') THEN 2 ELSE 12 END
                  WHEN 4 THEN CASE WHEN v IN ('mssql', 'mysql', 'sybase') THEN -6 ELSE 12 END
                  WHEN 5 THEN CASE WHEN v IN ('mssql', 'sybase') THEN 4 ELSE 12 END
                  WHEN 6 THEN CASE WHEN v IN ('oracle', 'db2') THEN 2005 ELSE 12 END
                  ELSE 12 END AS jdbc_code,
             CASE kind
                  WHEN 1 THEN CASE WHEN v = 'oracle' THEN 'string'
                       WHEN p_size BETWEEN 2 AND 38
                       THEN concat('decimal(', CAST(p_size AS STRING), ',2)')
                       ELSE 'decimal(38,10)' END
                  WHEN 2 THEN CASE v WHEN 'mssql' THEN 'binary' WHEN 'sybase' THEN 'string'
                              ELSE 'timestamp_ntz' END
                  WHEN 3 THEN CASE WHEN v NOT IN ('oracle', 'db2') THEN 'string'
                       WHEN p_size BETWEEN 1 AND 38
                       THEN concat('decimal(', CAST(p_size AS STRING), ',0)')
                       ELSE 'decimal(38,10)' END
                  WHEN 4 THEN CASE WHEN v IN ('mssql', 'sybase') THEN 'smallint'
                              WHEN v = 'mysql' THEN 'tinyint' ELSE 'string' END
                  WHEN 5 THEN CASE WHEN v IN ('mssql', 'sybase') THEN 'int' ELSE 'string' END
                  ELSE 'string' END AS spark_type
           FROM (SELECT c.*, lower(vendor) AS v, p_size,
                        CAST(floor(c.p_partkey / 5) AS BIGINT) % 8 AS kind
                 FROM cols c JOIN part p ON p.p_partkey = c.p_partkey) q""",
        cols=COLUMN_CATALOG,
    ),
)
def _(spark, sf):
    return type_catalog(rows(spark, sf, COLUMN_CATALOG))


RAW_TEXT = """
SELECT CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE CAST(o_orderkey AS STRING) END AS c_big,
       CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_totalprice AS STRING) END AS c_num,
       CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0' ELSE NULL END AS c_bit,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CAST(o_orderdate AS STRING) END AS c_date,
       CAST(o_totalprice AS STRING) AS c_dbl,
       o_orderpriority AS c_raw,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderpriority END AS c_clob,
       o_orderkey
FROM orders
"""

RAW_FIELDS = [
    FieldSpec("o_orderkey", "o_orderkey", jdbc_type="BIGINT"),
    FieldSpec("c_big", "c_big", jdbc_type="BIGINT"),
    FieldSpec("c_num", "c_num", jdbc_type="NUMERIC", size="12,2"),
    FieldSpec("c_bit", "c_bit", jdbc_type="BIT"),
    FieldSpec("c_date", "c_date", jdbc_type="DATE"),
    FieldSpec("c_dbl", "c_dbl", jdbc_type="DOUBLE"),
    FieldSpec("c_raw", "c_raw", jdbc_type="BLOB"),
    FieldSpec("c_clob", "c_clob", jdbc_type="CLOB"),
]


@query(
    "coerce_types",
    f"""SELECT o_orderkey, TRY_CAST(c_big AS BIGINT) AS c_big,
               TRY_CAST(c_num AS DECIMAL(12, 2)) AS c_num, TRY_CAST(c_bit AS BOOLEAN) AS c_bit,
               TRY_CAST(c_date AS TIMESTAMP) AS c_date, TRY_CAST(c_dbl AS DOUBLE) AS c_dbl,
               length(c_raw) AS c_raw, c_clob
        FROM ({RAW_TEXT}) q""",
)
def _(spark, sf):
    typed = coerce(rows(spark, sf, RAW_TEXT), RAW_FIELDS)
    return typed.withColumn("c_raw", F.octet_length("c_raw").cast("long"))


@query(
    "coerce_clob",
    f"""SELECT o_orderkey, coalesce(TRY_CAST(c_big AS BIGINT), 0) AS c_big,
               coalesce(TRY_CAST(c_bit AS BOOLEAN), false) AS c_bit,
               coalesce(c_clob, '') AS c_clob
        FROM ({RAW_TEXT}) q""",
)
def _(spark, sf):
    typed = coerce(
        rows(spark, sf, RAW_TEXT), RAW_FIELDS, legacy_nulls=True, clob_null_to_empty=True
    )
    return typed.select("o_orderkey", "c_big", "c_bit", "c_clob")


SHAPES = """
SELECT o_orderkey, 2001 + CAST(o_orderkey % 3 AS INT) AS g, 8307 AS s, o_totalprice AS x,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey AS DOUBLE) END AS y,
       CAST(o_orderkey % 100 AS INT) AS e2, o_orderkey % 10 = 0 AS bare
FROM orders
"""

SHAPE_TEXT = """
SELECT o_orderkey, concat('{g:', CAST(g AS STRING), ',s:8307,x:''', CAST(x AS STRING), ''',y:''',
         coalesce(CAST(y AS STRING), 'NaN'), ''',z:''NaN'',e:''',
         CASE WHEN bare THEN 'null' ELSE concat('1|', CAST(e2 AS STRING), '|1') END, ''',o:''',
         CASE WHEN bare THEN 'null' ELSE concat(CAST(x AS STRING), '|2.5') END, '''}') AS geom
FROM shapes
"""


@query("geometry_encode", with_tables(SHAPE_TEXT, shapes=SHAPES))
def _(spark, sf):
    shape = F.struct(
        F.col("g"),
        F.col("s"),
        F.col("x"),
        F.col("y"),
        F.lit(None).cast("double").alias("z"),
        F.when(~F.col("bare"), F.array(F.lit(1), F.col("e2"), F.lit(1))).alias("e"),
        F.when(~F.col("bare"), F.array(F.col("x"), F.lit(2.5))).alias("o"),
    )
    return rows(spark, sf, SHAPES).select("o_orderkey", geometry_to_text(shape).alias("geom"))


@query(
    "geometry_decode",
    with_tables(
        """SELECT o_orderkey, g, s, x, y, CASE WHEN bare THEN NULL ELSE 2 + e2 END AS e_sum,
                  CASE WHEN bare THEN NULL ELSE 3 END AS e_len,
                  CASE WHEN bare THEN NULL ELSE x END AS o_first
           FROM shapes""",
        shapes=SHAPES,
    ),
)
def _(spark, sf):
    text = rows(spark, sf, with_tables(SHAPE_TEXT, shapes=SHAPES))
    shape = text.select("o_orderkey", geometry_from_text(F.col("geom")).alias("p"))
    return shape.select(
        "o_orderkey",
        "p.g",
        "p.s",
        "p.x",
        F.when(~F.isnan("p.y"), F.col("p.y")).alias("y"),
        F.aggregate("p.e", F.lit(0), lambda a, b: a + b).alias("e_sum"),
        F.when(F.col("p.e").isNotNull(), F.size("p.e")).alias("e_len"),
        F.get("p.o", F.lit(0)).alias("o_first"),
    )


# -- comparison -----------------------------------------------------------------------


@query(
    "classify",
    with_tables(
        """SELECT k, price, status, CASE WHEN k IN (SELECT k FROM tgt) THEN 'U' ELSE 'I' END AS op
           FROM src""",
        **PAIR,
    ),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return compare.classify(source, target, ["k"])


@query(
    "classify_changed",
    with_tables(
        """SELECT s.k, CASE WHEN t.k IS NULL THEN 'I'
                            WHEN s.price IS NOT DISTINCT FROM t.price
                             AND s.status IS NOT DISTINCT FROM t.status THEN '='
                            ELSE 'U' END AS op
           FROM src s LEFT JOIN tgt t ON t.k = s.k""",
        **PAIR,
    ),
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return compare.classify(source, target, ["k"], only_changed=True).select("k", "op")


@query(
    "rows_to_insert", with_tables("SELECT * FROM src WHERE k NOT IN (SELECT k FROM tgt)", **PAIR)
)
def _(spark, sf):
    source, target = _pair(spark, sf)
    return compare.inserts(source, target, ["k"])


@query("rows_to_update", with_tables("SELECT * FROM src WHERE k IN (SELECT k FROM tgt)", **PAIR))
def _(spark, sf):
    source, target = _pair(spark, sf)
    return compare.updates(source, target, ["k"])


LINE_KEY = ["l_orderkey", "l_linenumber"]


@query(
    "dedupe_kept",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                    ORDER BY l_partkey, l_suppkey, l_quantity) AS n
          FROM ({fx.DUPLICATES}) q) r WHERE n = 1""",
)
def _(spark, sf):
    return compare.dedupe(rows(spark, sf, fx.DUPLICATES), LINE_KEY, ["l_partkey"])[0]


@query(
    "dedupe_rejected",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, count(*) AS copies FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                    ORDER BY l_partkey, l_suppkey, l_quantity) AS n
          FROM ({fx.DUPLICATES}) q) r WHERE n > 1
        GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity""",
)
def _(spark, sf):
    return compare.dedupe(rows(spark, sf, fx.DUPLICATES), LINE_KEY, ["l_partkey"])[1]


@query(
    "dedupe_rare",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
          SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                    ORDER BY l_partkey, l_suppkey, l_quantity) AS n
          FROM ({fx.DUPLICATES}) q) r WHERE n = 1""",
)
def _(spark, sf):
    return compare.dedupe_rare(rows(spark, sf, fx.DUPLICATES), LINE_KEY, ["l_partkey"])[0]


# -- counting ---------------------------------------------------------------------------


@query("source_count", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
def _(spark, sf):
    return scan.source_count(table(spark, sf, "orders"), F.col("o_orderstatus") == "O")


@query("marker_bounds", "SELECT min(ts) AS lo, max(ts) AS hi FROM events")
def _(spark, sf):
    return scan.marker_bounds(table(spark, sf, "events"), "ts")


@query(
    "page_count",
    """SELECT o_orderstatus, CAST(ceil(count(*) / 700.0) AS BIGINT) AS pages
       FROM orders GROUP BY o_orderstatus""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.groupBy("o_orderstatus").agg(page_count(F.count(F.lit(1)), 700).alias("pages"))


JOB_TABLES = """
SELECT p_brand AS job, p_partkey AS table_id,
       CASE WHEN p_brand = (SELECT min(p_brand) FROM part) THEN 5 ELSE p_size % 7 * 3 END AS seqnumber
FROM part
"""


@query(
    "table_stages",
    f"""SELECT job, table_id, seqnumber,
               dense_rank() OVER (PARTITION BY job ORDER BY seqnumber) AS stage,
               max(seqnumber) OVER (PARTITION BY job) > min(seqnumber) OVER (PARTITION BY job)
                 AS dependent
        FROM ({JOB_TABLES}) q""",
)
def _(spark, sf):
    return table_stages(rows(spark, sf, JOB_TABLES))
