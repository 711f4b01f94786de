"""Bringing two sequences to the same value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _paired(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """Both catalogs side by side: ``name, last_number, increment_by, cache_size[, currval]``."""

    def side(df: DataFrame, prefix: str) -> DataFrame:
        current = F.col("currval") if "currval" in df.columns else F.col("last_number")
        return df.select(
            F.upper("name").alias("name"),
            F.col("last_number").alias(f"{prefix}_last"),
            F.col("increment_by").alias(f"{prefix}_inc"),
            F.col("cache_size").alias(f"{prefix}_cache"),
            current.alias(f"{prefix}_cur"),
        )

    pairs = side(src, "src").join(side(tgt, "tgt"), "name")
    by_last = (
        (F.col("src_inc") == F.col("tgt_inc"))
        & (F.col("src_cache") == F.col("tgt_cache"))
        & (F.col("src_cache") == F.col("src_inc"))
    )
    mode = F.when(by_last, "last_number").otherwise("currval")

    def value(prefix: str) -> Column:
        return F.when(by_last, F.col(f"{prefix}_last")).otherwise(F.col(f"{prefix}_cur"))

    return pairs.select(
        "name",
        mode.alias("mode"),
        value("src").cast("long").alias("src_value"),
        value("tgt").cast("long").alias("tgt_value"),
        F.col("src_inc").cast("long").alias("src_inc"),
        F.col("tgt_inc").cast("long").alias("tgt_inc"),
    )


def sequence_plan(src: DataFrame, tgt: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Which side of each sequence pair lags, by how much, and how it catches up.

    ``step`` is ``single`` when one ordinary increment closes the gap, else
    ``temporary``: set the increment to ``delta``, draw one value, and set it back
    to ``restore_increment``. Nothing is drawn from either sequence here. Of the
    ``known`` pairs (``name``) those that a catalog lacks are ``missing``; ``side``
    says where.
    """
    plan = _both_sides(src, tgt)
    if known is None:
        return plan
    found = known.select(F.upper("name").alias("name"))
    for df, mark in ((src, "_src"), (tgt, "_tgt")):
        names = df.select(F.upper("name").alias("name"), F.lit(True).alias(mark)).distinct()
        found = found.join(names, "name", "left")
    no_src, no_tgt = F.col("_src").isNull(), F.col("_tgt").isNull()
    lacks = F.when(no_src & no_tgt, "both").when(no_src, "source").otherwise("target")
    missing = found.where(no_src | no_tgt).select(
        "name", lacks.alias("side"), F.lit("missing").alias("step")
    )
    return plan.unionByName(missing, allowMissingColumns=True)


def _both_sides(src: DataFrame, tgt: DataFrame) -> DataFrame:
    lagging_inc = F.when(F.col("side") == "target", F.col("tgt_inc")).when(
        F.col("side") == "source", F.col("src_inc")
    )
    side = F.when(F.col("src_value") > F.col("tgt_value"), "target").when(
        F.col("src_value") < F.col("tgt_value"), "source"
    )
    step = (
        F.when(F.col("side").isNull(), "none")
        .when(F.col("delta") == F.col("lag_inc"), "single")
        .otherwise("temporary")
    )
    return (
        _paired(src, tgt)
        .withColumn("side", side)
        .withColumn("delta", F.abs(F.col("src_value") - F.col("tgt_value")))
        .withColumn("lag_inc", lagging_inc)
        .withColumn("step", step)
        .select(
            "name",
            "mode",
            "src_value",
            "tgt_value",
            "side",
            "delta",
            "step",
            F.when(F.col("step") == "temporary", F.col("lag_inc")).alias("restore_increment"),
        )
    )


def sequence_reconciled(src: DataFrame, tgt: DataFrame) -> DataFrame:
    """State after the plan is carried out: both sides at the higher value."""
    high = F.greatest("src_value", "tgt_value")
    return _paired(src, tgt).select(
        "name", high.alias("src_value"), high.alias("tgt_value"), "src_inc", "tgt_inc"
    )
