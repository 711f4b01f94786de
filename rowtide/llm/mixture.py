"""Mixture-controlled packing: deficit round-robin over the sources' queues.

Every source is a queue of packets: its documents in order, cut where they are longer than
a window. In each round, a source's counter grows by its quantum, its target share of one
window, and the source sends packets while the counter is above zero. What the last packet
takes beyond is a deficit, paid off in later rounds, so that after any number of windows
no source is further from its target than a packet and a quantum. A source that has run out
leaves its share to the others.

Counters need not be run one after the other: a packet that lies ``t`` tokens behind the
head of its queue is sent in round ``t // quantum``, which holds all deficits of the windows
and partitions before it. So the rounds are given by sums of lengths over each queue, and
places in the packed stream by sums over the rounds; both are made in parallel. The stream is
cut into full windows, packets at most once; what is left at its end is cut into lengths that
are powers of two, which take no padding.

Defined results: a null text is an empty one, of nothing but its end token; a null source
is a source of its own; documents of a source come in the order of their identifiers, null
first; rows with equal or null identifiers are rows of their own; texts of any length are
read whole; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import bounded_batches, broadcast_small, per_process, quoted, whole
from rowtide.llm.prefix import prefix_sums
from rowtide.llm.token_ids import Encoder
from rowtide.session import settle

WINDOW = 4096
END = 2
# Sources (a name and a few numbers) that are broadcast at most.
BROADCAST_SOURCES = 1 << 18


def token_packets(
    docs: DataFrame,
    tokenizer: str,
    end: int = END,
    longest: int = WINDOW,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``_uid doc_id source start length doc_tokens ids``: the tokens of each document in packets; written once."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(
        F.monotonically_increasing_id().alias("_uid"),
        F.col(quoted(id_col)).alias("doc_id"),
        F.col(quoted(source_col)).alias("source"),
        whole(F.col(quoted(text_col))).alias("_text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}

    def work(batches):
        encoder = per_process(("ids", tokenizer), lambda: Encoder(tokenizer))
        last = np.array([end], encoder.kind)
        for batch in batches:
            ids = [np.concatenate((i, last)) for i in encoder.encode(batch.column("_text").to_pylist())]
            sizes = np.array([len(i) for i in ids], np.int64)
            row = np.repeat(np.arange(len(ids)), -(-sizes // longest))
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            start = (np.arange(len(row)) - first[row]) * longest
            length = np.minimum(longest, sizes[row] - start)
            parts = [ids[r][a : a + n].tobytes() for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(at) for c in ("_uid", "doc_id", "source")),
                    pa.array(start),
                    pa.array(length),
                    pa.array(sizes[row]),
                    pa.array(parts, pa.binary()),
                ],
                ["_uid", "doc_id", "source", "start", "length", "doc_tokens", "ids"],
            )

    schema = (
        f"_uid long, doc_id {kinds['doc_id']}, source {kinds['source']}, start long, length long, "
        "doc_tokens long, ids binary"
    )
    return settle(slim.mapInArrow(work, schema))


def _weight(targets: Mapping[str | None, float] | None) -> Column:
    """A source's weight: its tokens, or as given; sources that are not named get the least."""
    if targets is None:
        return F.col("_tokens").cast("double")
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    weight = F.lit(float(min(targets.values())))
    for name, value in targets.items():
        weight = F.when(F.col("_name").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    return weight


def packed_stream(
    packets: DataFrame, targets: Mapping[str | None, float] | None = None, window: int = WINDOW
) -> DataFrame:
    """``_uid start length _round _pos``: the round each packet is sent in, and the tokens sent before it.

    Target shares are those of the ``targets`` or, without, of all tokens.
    """
    slim = packets.select("_uid", "doc_id", "source", "start", "length")
    queue = prefix_sums(slim, ["source", "doc_id", "_uid", "start"], "length", "_g")
    sources = queue.groupBy(F.col("source").alias("_name")).agg(
        F.sum("length").alias("_tokens"), F.min("_g").alias("_head")
    )
    sources = settle(sources.withColumn("_weight", _weight(targets)))
    total = sources.agg(F.sum("_weight")).first()[0] or 1.0
    quantum = F.col("_weight") * F.lit(window / total)
    sources = broadcast_small(sources.select("_name", "_head", quantum.alias("_quantum")), BROADCAST_SOURCES)
    sent = queue.join(sources, F.col("source").eqNullSafe(F.col("_name"))).select(
        "_uid",
        "start",
        "length",
        F.floor((F.col("_g") - F.col("_head")) / F.col("_quantum")).cast("long").alias("_round"),
        "_g",
    )
    # in a round, source after source: the order of _g
    return prefix_sums(settle(sent), ["_round", "_g"], "length", "_pos")


def window_ends(total: int, window: int = WINDOW) -> list[int]:
    """Where the sequences of what is left after the full windows end: falling powers of two."""
    at, ends = total - total % window, []
    for bit in range((window - 1).bit_length() - 1, -1, -1):
        if (total - at) >> bit:
            at += 1 << bit
            ends.append(at)
    return ends


def cut(pos: int, length: int, total: int, window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """The pieces of a packet: where each starts in it, its length, sequence and offset there."""
    full, tail = total // window, window_ends(total, window)
    pieces, at = [], pos
    while at < pos + length:
        sequence = at // window
        if sequence < full:
            begin, end = sequence * window, (sequence + 1) * window
        else:
            n = next(i for i, e in enumerate(tail) if e > at)
            sequence, begin, end = full + n, tail[n - 1] if n else full * window, tail[n]
        end = min(end, pos + length)
        pieces.append((at - pos, end - at, sequence, at - begin))
        at = end
    return pieces


def pack_mixture(
    docs: DataFrame,
    tokenizer: str,
    targets: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    end: int = END,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """``doc_id start length ids_crc32 doc_tokens sequence_id offset source ids`` of every piece."""
    packets = token_packets(docs, tokenizer, end, window, id_col, source_col, text_col)
    stream = settle(packed_stream(packets, targets, window).select("_uid", "start", "_pos"))
    total = packets.agg(F.sum("length")).first()[0] or 0
    kinds = {f.name: f.dataType.simpleString() for f in packets.schema}

    def work(batches):
        for batch in batches:
            row, found, parts, sums = [], [], [], []
            columns = (batch.column(c).to_pylist() for c in ("_pos", "start", "length", "ids"))
            for r, (pos, start, length, ids) in enumerate(zip(*columns, strict=True)):
                ids = np.frombuffer(ids, np.dtype(f"<u{len(ids) // length}"))
                for a, n, sequence, offset in cut(pos, length, total, window):
                    row.append(r)
                    found.append((start + a, n, sequence, offset))
                    parts.append(ids[a : a + n].astype("<u4").tobytes())
                    sums.append(zlib.crc32(parts[-1]))
            at = pa.array(row, pa.int64())
            start, length, sequence, offset = np.array(found, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(at),
                    pa.array(start),
                    pa.array(length),
                    pa.array(sums, pa.int64()),
                    batch.column("doc_tokens").take(at),
                    pa.array(sequence),
                    pa.array(offset),
                    batch.column("source").take(at),
                    pa.array(parts, pa.binary()),
                ],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "ids"],
            )

    schema = (
        f"doc_id {kinds['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, "
        f"sequence_id long, offset long, source {kinds['source']}, ids binary"
    )
    return packets.join(stream, ["_uid", "start"]).mapInArrow(work, schema)
