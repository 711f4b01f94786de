"""Best-fit packing of documents into sequences of several permitted lengths.

A document is as long as its text in UTF-8 bytes plus one end mark. It is cut into pieces
of the longest permitted length; what is left is a last piece. Rows are dealt into groups
of bounded mass, and each group is packed by itself: pieces by falling length, each into
the open bin that it leaves the least room in. A piece that fits nowhere opens the bin
size of least cost for each unit that is still to come, so that large bins are opened
while there is much left to fill them with, and small ones at the end. When a group is
done, each bin is downsized to the least permitted length that holds its contents.

A group holds slim rows, so its size is bounded whatever the texts are like; groups lose
at most a few part-filled bins each, out of thousands.

Defined results: a null text is an empty one, of length 1; rows with equal or null
identifiers are rows of their own; pieces of a document are all there, and cover it
without gap or overlap; an empty table gives no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import quoted, whole
from rowtide.session import settle

# Permitted lengths; a bin costs its length and a fixed part.
LENGTHS = (1024, 2048, 4096, 8192)
FIXED_COST = 64
# Mass (length of all pieces) of a group, about, and rows.
GROUP_MASS = 32 << 20
GROUP_ROWS = 20_000


def pack(pieces: list[int], lengths: tuple[int, ...], fixed: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (given by falling length), and the length of each bin."""
    longest = lengths[-1]
    room_of: list[int] = []
    size_of: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(longest + 1)]
    open_rooms = 0  # bit r is set if a bin has room r
    bins, offsets = [], []
    left = sum(pieces)
    for piece in pieces:
        fitting = open_rooms >> piece
        if fitting:
            room = piece + (fitting & -fitting).bit_length() - 1
            stack = by_room[room]
            b = stack.pop()
            if not stack:
                open_rooms &= ~(1 << room)
        else:
            size = min(
                (s for s in lengths if s >= piece), key=lambda s: ((s + fixed) / min(s, left), s)
            )
            b, room = len(size_of), size
            size_of.append(size)
            room_of.append(size)
        bins.append(b)
        offsets.append(size_of[b] - room)
        room -= piece
        room_of[b] = room
        if room:
            by_room[room].append(b)
            open_rooms |= 1 << room
        left -= piece
    final = [min(s for s in lengths if s >= size - room) for size, room in zip(size_of, room_of, strict=True)]
    return bins, offsets, final


def pack_documents(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    fixed: int = FIXED_COST,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A row for each piece: where it is cut from its document and where it lies in which bin.

    ``doc_id piece start length bin_group bin bin_offset bin_length bin_fill``; a bin is
    named by its group and number.
    """
    lengths = tuple(sorted(set(lengths)))
    longest = lengths[-1]
    slim = settle(
        docs.select(
            F.col(quoted(id_col)).alias("_id"),
            (F.octet_length(whole(F.col(quoted(text_col)))) + 1).cast("long").alias("_length"),
            F.monotonically_increasing_id().alias("_uid"),
        )
    )
    size = slim.agg(F.count(F.lit(1)), F.sum("_length")).first()
    groups = max(1, -(-int(size[1] or 0) // GROUP_MASS), -(-size[0] // GROUP_ROWS))
    last = F.floor((F.col("_length") - 1) / longest).cast("int")
    pieces = slim.select(
        "_id",
        "_uid",
        "_length",
        F.explode(F.sequence(F.lit(0), last)).alias("piece"),
    ).select(
        "_id",
        "_uid",
        "piece",
        (F.col("piece").cast("long") * longest).alias("start"),
        F.least(F.lit(longest), F.col("_length") - F.col("piece").cast("long") * longest)
        .cast("long")
        .alias("length"),
        F.pmod(F.xxhash64("_uid", "piece"), F.lit(groups)).alias("bin_group"),
    )
    kind = slim.schema["_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, piece int, start long, length long, bin_group long, bin int, "
        "bin_offset long, bin_length long, bin_fill long"
    )

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "_uid", "piece"], ascending=[False, True, True])
        bins, offsets, final = pack(rows["length"].tolist(), lengths, fixed)
        bins_column = pd.Series(bins, index=rows.index, dtype="int32")
        return pd.DataFrame(
            {
                "doc_id": rows["_id"],
                "piece": rows["piece"],
                "start": rows["start"],
                "length": rows["length"],
                "bin_group": rows["bin_group"],
                "bin": bins_column,
                "bin_offset": pd.Series(offsets, index=rows.index, dtype="int64"),
                "bin_length": bins_column.map(dict(enumerate(final))).astype("int64"),
                "bin_fill": rows["length"].groupby(bins_column).transform("sum"),
            }
        )

    return pieces.groupBy("bin_group").applyInPandas(work, schema)
