"""Run registered queries against DuckDB: ``python tests/check.py [sf] [name ...]``."""

from __future__ import annotations

import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main() -> None:
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2:] or list(entry.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="rowtide-check-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, sql, bad = connect(sf), entry.oracle_sql(), 0
    for name in names:
        begin = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            problem = compare(df, con, sql[name]) if name in sql else None
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - begin:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    spark.stop()


if __name__ == "__main__":
    main()
