"""Connected components of an edge list by contraction.

Each round gives every vertex its least neighbour or itself, moves all edges onto those,
and drops loops and repeats. Vertices are first renamed by a bijective mix of their bits,
so that the order is random and a round leaves a fraction of the vertices, also on long
chains. Rounds are cut from their lineage by a table in the shared scratch folder. Nothing
but counts comes to the driver; the rows of a hub are reduced before the exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``v root``: every vertex of ``edges`` (longs ``a b``) and its component's name.

    The name is one of the component's vertices, the same for all of them.
    """
    mixed = edges.where("a <> b").select(
        F.xxhash64("a").alias("x"), F.xxhash64("b").alias("y"), "a", "b"
    )
    names = settle(
        mixed.select(F.col("x").alias("h"), F.col("a").alias("v"))
        .union(mixed.select("y", "b"))
        .distinct()
    )
    live = settle(_ordered(mixed.select("x", "y")))
    steps = []
    while not live.isEmpty():
        both = live.union(live.select(F.col("y").alias("x"), F.col("x").alias("y")))
        step = settle(
            both.groupBy("x").agg(F.min("y").alias("_low")).select("x", F.least("x", "_low").alias("to"))
        )
        steps.append(step)
        moved = live.join(step, "x").select(F.col("to").alias("p"), F.col("y").alias("x"))
        moved = moved.join(step, "x").select(F.col("p").alias("x"), F.col("to").alias("y"))
        live = settle(_ordered(moved))
    # from the last round back: where a vertex of that round ends up
    ends = None
    for step in reversed(steps):
        if ends is None:
            ends = step.select("x", F.col("to").alias("end"))
            continue
        later = ends.select(F.col("x").alias("to"), "end")
        ends = settle(
            step.join(later, "to", "left").select("x", F.coalesce("end", "to").alias("end"))
        )
    if ends is None:
        return names.select("v", F.col("v").alias("root"))
    root = names.select(F.col("h").alias("end"), F.col("v").alias("root"))
    return (
        names.join(ends.withColumnRenamed("x", "h"), "h")
        .join(root, "end")
        .select("v", "root")
    )


def _ordered(pairs: DataFrame) -> DataFrame:
    low, high = F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")
    return pairs.where("x <> y").select(low, high).distinct()
