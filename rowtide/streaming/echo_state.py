"""Echo suppression as a keyed stateful stream: pending echoes live in the state store.

One key of the state is a table, a typed key, an op (and a row hash) and a span of ids.
It holds the applied rows whose echo is still to come, each with the moment it is given up.
Nothing is rewritten per batch: a batch reads and writes the state of the keys it brings.
An echo that never comes leaves the state by a timer and is reported.

Keys are dealt into a fixed number of slots by their hash. Python is called once for a slot and
takes all of its keys together, as a call costs far more than a key. A slot's state is a map by key,
of which only the keys that a batch brings are looked up; a second map says by moment which keys
may have something to give up then, so that a timer looks at these only.

Where applied rows carry the id that their echo is captured under, as triggers that write
both in one transaction do, ``span_bits`` cuts the ids into spans: a key that fills a third
of the log is spread over many tasks, and a state holds at most a span. Without spans
all changes of one key go through one task, in Arrow batches; logs captured by comparing
snapshots are spread by their row hash.

Defined results: an applied row cancels the earliest captured row of its key that comes in the
same batch or later; captured rows without a table, key or op have keys of their own, of
nulls; an applied row that arrives after its echo is given up and reported in its time; a row
of neither side fails the query. What is given up is reported with the first batch that brings
rows after its time: the clock of the timers is the arrival of rows, so that no row is ever late.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from rowtide.functions.keys import comparable_pks
from rowtide.plans.spec import FieldSpec

# the processor is shipped with the query, so that executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Seconds until an echo is given up, and by how much the clock may be set back between batches.
TTL_SECONDS = 24 * 3600
CLOCK_SECONDS = 60

# What an output row is.
FORWARD, MISSING = "forward", "missing"
_CARRIED = ["origin", "tablename", "pks", "op", "id", "row_hash"]
_PENDING = ["until", *_CARRIED]
_NUMBERS = ["until", "id", "row_hash"]
# Keys are dealt into so many slots. States are found by them, so it is the same for as long as a checkpoint is.
SLOTS = 1 << 12
# longs travel as text, which pandas does not turn into floating numbers beside a null
_TEXT_SCHEMA = "kind string, origin string, tablename string, pks string, op string, id string, row_hash string"


class EchoProcessor(StatefulProcessor):
    """Cancels captured rows against the applied rows of their key, in id order, for the keys of a slot."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle) -> None:
        self.handle = handle
        # a list of rows as JSON, which is read and written much faster than nested rows
        self.pending = handle.getMapState("pending", "group string", "waiting string")
        self.due = handle.getMapState("due", "until bigint", "groups array<string>")

    def handleInputRows(self, key, rows, timerValues):
        until, brought = 0, {}
        for part in rows:
            for group, side, arrived, *texts, number, row_hash, _ in part.to_numpy().tolist():
                until = max(until, arrived + self.wait_ms)
                numbers = (None if n is None else int(n) for n in (number, row_hash))
                brought.setdefault(group, ([], []))[side == "applied"].append((*texts, *numbers))
        sent, late = [], []
        held = self.pending.exists()
        for group, (captured, applied) in brought.items():
            captured.sort(key=_by_id)
            applied.sort(key=_by_id)
            waiting = self._waiting(group) if held else []
            was = len(waiting)
            waiting += [(until, *row) for row in applied]
            used = min(len(waiting), len(captured))
            sent += captured[used:]
            if was or used < len(waiting):
                self._keep(group, waiting[used:])
            if applied and used < len(waiting):
                late.append(group)
        if late:
            before = self.due.getValue((until,))
            if before is None:
                self.handle.registerTimer(until)
            self.due.updateValue((until,), ([*dict.fromkeys([*(before[0] if before else ()), *late])],))
        if sent:
            yield _rows(FORWARD, sent)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        due, missing = self.due.getValue((now,)), []
        for group in due[0] if due else ():
            waiting = self._waiting(group)
            given_up = [w[1:] for w in waiting if w[0] <= now]
            if given_up:
                self._keep(group, [w for w in waiting if w[0] > now])
                missing += given_up
        if due:
            self.due.removeKey((now,))
        if missing:
            yield _rows(MISSING, missing)

    def _waiting(self, group: str) -> list[Sequence]:
        found = self.pending.getValue((group,))
        return json.loads(found[0]) if found else []

    def _keep(self, group: str, waiting: list[Sequence]) -> None:
        if waiting:
            self.pending.updateValue((group,), (json.dumps(waiting),))
        else:
            self.pending.removeKey((group,))


def _by_id(row: Sequence) -> tuple[bool, int]:
    number = row[_CARRIED.index("id")]
    return number is None, number or 0


def _rows(kind: str, found: list[Sequence]) -> pd.DataFrame:
    rows = [
        (kind, *texts, *(None if n is None else str(n) for n in (number, row_hash)))
        for *texts, number, row_hash in found
    ]
    return pd.DataFrame(rows, columns=["kind", *_CARRIED], dtype=object)


def _state_key(fields: Sequence[FieldSpec] | None, side: str, hashed: bool, span_bits: int | None) -> Column:
    """The key as one text, different for different keys: a null is left out, another value is named."""
    parts = {
        "table": F.upper("tablename"),
        "key": comparable_pks(F.col("pks"), fields, side=side),
        "op": F.col("op"),
    }
    if hashed:
        parts["hash"] = F.coalesce("row_hash", F.lit(0).cast("long"))
    if span_bits is not None:
        parts["span"] = F.shiftright("id", span_bits)
    return F.to_json(F.struct(*[c.alias(n) for n, c in parts.items()]), {"ignoreNullFields": "true"})


def echo_state(
    changes: DataFrame,
    *,
    ttl_seconds: float = TTL_SECONDS,
    hashed: bool = False,
    span_bits: int | None = None,
    fields: Sequence[FieldSpec] | None = None,
    side: str = "source",
) -> DataFrame:
    """Captured changes that are no echo (``forward``), and applied rows given up (``missing``), as a stream.

    ``changes`` mixes both in the columns of the applied-changes table, told apart by
    ``side``: ``applied`` (written here for the peer) and ``captured``. With the ``fields``
    of the table keys are compared by their typed values, otherwise by their texts.
    """
    spark = changes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    clock = min(CLOCK_SECONDS, ttl_seconds / 2)
    known = F.col("side").isin("captured", "applied")
    side_of = F.when(known, F.col("side")).otherwise(
        F.raise_error(F.concat(F.lit("neither captured nor applied: "), F.col("side").cast("string")))
    )
    keyed = changes.select(
        _state_key(fields, side, hashed, span_bits).alias("group"),
        side_of.alias("side"),
        F.current_timestamp().alias("arrived"),
        *[F.col(c).cast("string").alias(c) for c in _CARRIED],
    )
    # the watermark is noted where it stands; a number of milliseconds goes on to Python
    clocked = keyed.withWatermark("arrived", f"{round(clock * 1000)} milliseconds").withColumns(
        {"arrived": F.unix_millis("arrived"), "slot": F.pmod(F.xxhash64("group"), F.lit(SLOTS))}
    )
    found = clocked.groupBy("slot").transformWithStateInPandas(
        EchoProcessor(round((ttl_seconds - clock) * 1000)), _TEXT_SCHEMA, "Append", "EventTime"
    )
    return found.withColumns({c: F.col(c).cast("long") for c in ("id", "row_hash")})


def stream_echo_state(
    changes: DataFrame, path: str, checkpoint: str, *, once: bool = False, interval: int = 1, **options
) -> StreamingQuery:
    """Write :func:`echo_state` to Parquet files below ``path``, each row once, also over restarts."""
    writer = (
        echo_state(changes, **options)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    if once:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=f"{interval} seconds").start()


def pending_echoes(spark: SparkSession, checkpoint: str) -> DataFrame:
    """Applied rows whose echo is still to come, from the state of a query: what it holds, and until when."""
    state = (
        spark.read.format("statestore")
        .option("path", checkpoint)
        .option("stateVarName", "pending")
        .option("flattenCollectionTypes", True)
        .load()
    )
    row = F.explode(F.from_json("user_map_value.waiting", "array<array<string>>")).alias("row")
    values = [F.get("row", F.lit(n)).cast("long" if c in _NUMBERS else "string") for n, c in enumerate(_PENDING)]
    held = state.select(row).select(*[v.alias(c) for v, c in zip(values, _PENDING, strict=True)])
    return held.withColumn("until", F.timestamp_millis("until"))
