"""What the plans of the operators look like, and how hot keys are spread."""

from __future__ import annotations

import re

import pytest
from helpers import plan_of
from pyspark.sql import functions as F

from rowtide.functions.types import type_catalog
from rowtide.operators.changelog import collapse, run_batches
from rowtide.operators.compare import classify, dedupe
from rowtide.operators.numbering import number_rows
from rowtide.operators.replay import apply_policy, collapse_routed, pending_of, policies
from rowtide.operators.twoway import suppress_echo
from rowtide.operators.writeback import merge, upsert
from rowtide.registry import fixtures as fx
from rowtide.registry.base import rows, table
from rowtide.sources.log import route_log, routed_to
from rowtide.sources.scan import (
    footer_table,
    marker_bounds,
    scan,
    scan_flagged,
    scan_time_range,
    source_count,
)

SF = "/root/testdata/sf0.01"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_scan_reads_only_mapped_columns(spark):
    plan = plan_of(scan(table(spark, SF, "orders"), fx.orders_spec()))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan


def test_filters_reach_the_files(spark):
    orders = table(spark, SF, "orders")
    plan = plan_of(scan_flagged(orders, "o_orderstatus", "O").select("o_orderkey"))
    assert "EqualTo(o_orderstatus,O)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string>" in plan
    plan = plan_of(scan_time_range(table(spark, SF, "events"), "ts", "2024-01-05", "2024-01-06"))
    assert "GreaterThanOrEqual(ts,2024-01-05T00:00)" in plan and "LessThan(ts,2024-01-06T00:00)" in plan


def test_numbering_gathers_only_bucket_counts(spark, no_broadcast):
    orders = table(spark, SF, "orders").select("o_orderkey", "o_orderpriority")
    numbered = number_rows(orders, ["o_orderkey"], bits=10)
    text = numbered._jdf.queryExecution().executedPlan().toString()
    # the one place that sees all buckets comes after the rows were counted
    place = text.index("Exchange SinglePartition")
    after = text[place : text.index("FileScan", place)]
    assert "HashAggregate(keys=[_parent" in after
    assert text.count("SinglePartition") == 1
    # and the rows themselves are exchanged once
    wide = [line for line in text.splitlines() if "FileScan" in line and "o_orderpriority" in line]
    assert len(wide) == 1


def test_sparse_ids_are_spread(spark, no_broadcast):
    """Ids so far apart that each row has a bucket of its own: no task sees all of them."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        log = spark.range(64_000).selectExpr(
            "id * 70000000000 AS id", "'T' AS tablename", "'k;N;1;' AS pks", "'U' AS op"
        )
        assert most_rows_in_one_task(number_rows(log, ["id"])) < 16_000
        assert most_rows_in_one_task(run_batches(log)) < 16_000
        assert most_rows_in_one_task(suppress_echo(log, log.where("id > 0"))) < 16_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_replay_aggregates_hash_and_combine_before_the_shuffle(spark):
    plan = plan_of(collapse(rows(spark, SF, fx.LOG), ["tablename", "pks"]))
    assert "SortAggregate" not in plan and plan.count("HashAggregate") >= 2
    assert "partial_max_by" in plan


def test_fixed_lists_are_broadcast_whatever_the_threshold(spark, no_broadcast):
    columns = table(spark, SF, "part").selectExpr("'oracle' AS vendor", "p_type AS type")
    assert "BroadcastHashJoin" in plan_of(type_catalog(columns))
    log = rows(spark, SF, fx.LOG)
    assert "BroadcastHashJoin" in plan_of(apply_policy(log, policies(spark, fx.users_job().tables)))


def test_large_joins_are_not_broadcast(spark, no_broadcast):
    source, target = rows(spark, SF, fx.SOURCE), rows(spark, SF, fx.TARGET)
    for plan in (
        plan_of(merge(target, source, ["k"])),
        plan_of(upsert(target, source, ["k"])),
        plan_of(classify(source, target, ["k"])),
        plan_of(suppress_echo(rows(spark, SF, fx.LOG), rows(spark, SF, fx.PEER))),
    ):
        assert "Broadcast" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_small_batch_is_broadcast_to_the_target(spark):
    target = rows(spark, SF, fx.TARGET)
    few = rows(spark, SF, fx.SOURCE).where("k < 20")
    plan = plan_of(upsert(target, few, ["k"]))
    assert "BroadcastHashJoin LeftAnti BuildRight" in plan
    assert "hashpartitioning" not in plan


def most_rows_in_one_task(df) -> int:
    counts = df.groupBy(F.spark_partition_id()).count()
    return counts.agg(F.max("count")).first()[0]


def test_hot_table_is_spread(spark, no_broadcast):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        log = spark.range(64_000).selectExpr(
            "id", "'T' AS tablename", "'k;N;1;' AS pks", "CASE WHEN id % 3 = 0 THEN 'I' ELSE 'U' END AS op"
        )
        # one table, one key: still no task sees more than a few buckets
        assert most_rows_in_one_task(run_batches(log, bits=10)) < 16_000
        echo = suppress_echo(log, log.where("id < 10"), bits=10)
        assert echo.count() == 63_990 and most_rows_in_one_task(echo) < 16_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_rejects_of_a_hot_key_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        hot = spark.range(32_000).selectExpr("1 AS k", "id AS v")
        _, rejected = dedupe(hot, ["k"], ["v"])
        assert rejected.count() == 31_999 and most_rows_in_one_task(rejected) < 8_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_keys_of_deduped_rows_do_not_drag_the_rows_along(spark):
    kept, _ = dedupe(table(spark, SF, "orders"), ["o_orderkey"], [])
    plan = plan_of(kept.select("o_orderkey"))
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_routed_log_reads_one_folder_per_table(spark):
    log = spark.range(1, 400).selectExpr(
        "id", "'d' dbname", "concat('T', id % 3) tablename", "concat('user_id;N;', id % 50, ';') pks",
        "'U' op", "timestamp_ntz'2024-01-01 00:00:00' op_time",
    )
    job = fx.users_job()
    mine = pending_of(collapse_routed(log, job), job.tables[0])
    plan = plan_of(mine)
    assert re.search(r"PartitionFilters: \[.*tablename.*= T0", plan)
    part = routed_to(route_log(log), "t1")
    assert part.count() == 133 and re.search(r"PartitionFilters: \[.*_route.*= T1", plan_of(part))


def test_counts_and_bounds_come_from_footers(spark):
    lines = footer_table(spark, f"{SF}/lineitem.parquet")
    assert "PushedAggregation: [COUNT(*)]" in plan_of(source_count(lines))
    events = footer_table(spark, f"{SF}/events.parquet")
    plan = plan_of(marker_bounds(events, "event_id"))
    assert "PushedAggregation: [MIN(event_id), MAX(event_id)]" in plan
    # other tables are read as before
    assert "PushedAggregation" not in plan_of(source_count(table(spark, SF, "orders")))
