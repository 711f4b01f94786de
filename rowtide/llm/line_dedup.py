"""Removal of lines that many sites share.

The spread of a line is the number of distinct sites it occurs on. A HyperLogLog sketch
of sites is kept per line hash; sketches of the same line merge by aggregation, so a
line that every document has is one small sketch per task before the exchange. Lines
whose estimate is clearly below or above the threshold are decided by it. Lines near it
get an exact distinct count. What the decision is based on is thus exact wherever the
sketch's error could turn it.

Defined results: a null text is an empty one and comes back empty; blank lines are never
boilerplate; lines are compared after trimming blanks at both ends; a null site is no
site; a line is taken out wherever it occurs, also several times in one text; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import quoted, whole
from rowtide.session import settle

# Sites from which on a line is boilerplate.
MIN_SITES = 8
# Sketch size (log2 of its registers) and the relative error, six times the standard
# one of 1.04/sqrt(2**LG), within which a line counts as near the threshold.
LG = 12
NEAR = 6 * 1.04 / 2 ** (LG / 2)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """A row per line that is not blank: identifier, site, position, 128-bit line hash."""
    line = F.trim(F.col("_line"))
    return (
        docs.select(
            F.col(quoted(id_col)).alias("_id"),
            F.col(quoted(site_col)).cast("string").alias("_site"),
            F.posexplode(F.split(whole(F.col(quoted(text_col))), "\n")).alias("_pos", "_line"),
        )
        .where(line != "")
        .select("_id", "_site", "_pos", *line_hash(line))
    )


def line_hash(line: Column) -> list[Column]:
    """Two independent 64-bit hashes; together they name a line."""
    return [F.xxhash64(line).alias("_h"), F.xxhash64(F.lit(17), line).alias("_g")]


def spread_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """Hashes ``_h _g`` of the lines found on at least ``min_sites`` distinct sites."""
    lines = _lines(docs, id_col, text_col, site_col).where("_site is not null")
    low, high = min_sites * (1 - NEAR), min_sites * (1 + NEAR)
    guess = settle(
        lines.groupBy("_h", "_g")
        .agg(F.hll_sketch_estimate(F.hll_sketch_agg("_site", F.lit(LG))).alias("_sites"))
        .where(F.col("_sites") >= low)
    )
    near = guess.where(F.col("_sites") <= high).select("_h", "_g")
    exact = (
        lines.select("_h", "_g", "_site")
        .join(near, ["_h", "_g"], "left_semi")
        .groupBy("_h", "_g", "_site")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h", "_g")
        .agg(F.count(F.lit(1)).alias("_sites"))
        .where(F.col("_sites") >= min_sites)
        .select("_h", "_g")
    )
    return settle(guess.where(F.col("_sites") > high).select("_h", "_g").union(exact))


def remove_spread_lines(
    docs: DataFrame,
    min_sites: int = MIN_SITES,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
) -> DataFrame:
    """``doc_id text n_lines n_removed``: every row, its text without boilerplate lines.

    Each document meets the set of its own boilerplate hashes, so that rows which share
    an identifier, or have none, are still decided line by line.
    """
    shared = spread_lines(docs, min_sites, id_col, text_col, site_col)
    found = (
        _lines(docs, id_col, text_col, site_col)
        .join(shared, ["_h", "_g"], "left_semi")
        .groupBy("_id")
        .agg(F.collect_set(F.struct("_h", "_g")).alias("_drop"))
        .withColumnRenamed("_id", "_found_id")
    )
    base = docs.select(
        F.col(quoted(id_col)).alias("_id"),
        F.split(whole(F.col(quoted(text_col))), "\n").alias("_all"),
    )

    def stays(line: Column) -> Column:
        return ~F.array_contains("_drop", F.struct(*line_hash(F.trim(line))))

    return (
        base.join(found, F.col("_id").eqNullSafe(F.col("_found_id")), "left")
        .withColumn(
            "_kept", F.when(F.col("_drop").isNull(), F.col("_all")).otherwise(F.filter("_all", stays))
        )
        .select(
            F.col("_id").alias("doc_id"),
            F.array_join("_kept", "\n").alias("text"),
            F.size("_all").cast("long").alias("n_lines"),
            (F.size("_all") - F.size("_kept")).cast("long").alias("n_removed"),
        )
    )
