"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition is one *run*: its distinct digests, each with the best identifier
and the number of rows seen. Runs meet in rounds. In each round the runs whose numbers
agree but for their lowest digit (base ``2**bits``) are merged, as in a binomial tree of
that order: n runs need log(n) rounds, and a digest leaves a round once per merged run.
A merge keeps the first identifier by rank and verifies that a digest stands for one
text: length and an independent 64-bit hash must be equal in all rows merged, or the job
fails. A digest that a third of all rows share is one row per run before any exchange.

Defined results: a null text is an empty one; null identifiers rank last (a group of
nothing else has a null ``keep_id``); rows that repeat identifier and text are one
document, returned once, and each counts in ``group_size``; an empty table gives no rows;
other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import (
    ascii_lower,
    broadcast_small,
    free_name,
    quoted,
    raw_hash,
    whole,
    without,
)
from rowtide.session import settle

# Runs merged at once: 2**BITS.
BITS = 4
# Groups (a digest and two longs) that are broadcast to the rows at most: about 30 MB.
BROADCAST_GROUPS = 1 << 18


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Identifier, SHA-256, what verifies it, and the run of each row; written once."""
    text = ascii_lower(whole(F.col(quoted(text_col))))
    return settle(
        docs.select(
            F.col(quoted(id_col)).cast("long").alias("_id"),
            text.alias("_text"),
            raw_hash(text_col).alias("_raw"),
        ).select(
            "_id",
            sha256(F.col("_text")).alias("_sha"),
            F.octet_length("_text").cast("long").alias("_size"),
            F.xxhash64("_text").alias("_check"),
            "_raw",
            F.spark_partition_id().alias("_run"),
        )
    )


def merge_runs(rows: DataFrame, bits: int = BITS, keep: str = "largest") -> DataFrame:
    """One row per digest: ``_best`` identifier and ``_n`` rows, by rounds of merging.

    ``keep`` says which identifier of a group stays: the ``largest`` or the ``smallest``.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    runs = rows.agg(F.max("_run")).first()[0]
    level = rows.select(
        "_sha",
        "_run",
        F.col("_id").alias("_best"),
        F.lit(1).cast("long").alias("_n"),
        *[F.col(c).alias(c + end) for c in ("_size", "_check") for end in ("_min", "_max")],
    )
    left = 0 if runs is None else runs
    while True:
        left >>= bits
        level = (
            level.withColumn("_run", F.shiftright("_run", bits))
            .groupBy("_sha", "_run")
            .agg(
                best("_best").alias("_best"),
                F.sum("_n").alias("_n"),
                *[
                    how(c + end).alias(c + end)
                    for c in ("_size", "_check")
                    for end, how in (("_min", F.min), ("_max", F.max))
                ],
            )
        )
        if left == 0:
            break
    same = (F.col("_size_min") == F.col("_size_max")) & (F.col("_check_min") == F.col("_check_max"))
    return level.select(
        "_sha",
        "_best",
        F.when(same, F.col("_n"))
        .otherwise(F.raise_error(F.lit("two texts share a digest")).cast("long"))
        .alias("_n"),
    )


def classify(rows: DataFrame, bits: int = BITS, keep: str = "largest") -> DataFrame:
    """Each document of ``digests`` with its group: ``_id _sha keep_id group_size kept``.

    Only groups of several rows are joined back; the rest keep themselves.
    """
    groups = broadcast_small(settle(merge_runs(rows, bits, keep).where("_n > 1")), BROADCAST_GROUPS)
    found = rows.select("_id", "_sha").join(groups, "_sha", "left")
    once = found.where("_n is null").union(_each_once(found.where("_n is not null")))
    alone = F.col("_n").isNull()
    return once.select(
        "_id",
        "_sha",
        F.when(alone, F.col("_id")).otherwise(F.col("_best")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (alone | F.col("_id").eqNullSafe(F.col("_best"))).alias("kept"),
    )


def _each_once(found: DataFrame) -> DataFrame:
    """Rows of shared texts, repeated (identifier, text) pairs given once."""
    return found.select("_sha", "_id", "_best", "_n").distinct()


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    keep: str = "largest",
) -> DataFrame:
    """``doc_id keep_id group_size kept text_sha256``, one row per document.

    Texts are equal when identical after lower-casing A-Z only.
    """
    rows = classify(digests(docs, id_col, text_col), bits, keep)
    return rows.select(
        F.col("_id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits: int = BITS,
    keep: str = "largest",
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    What goes is looked up, not what stays: copies are far fewer than documents. Rows that
    repeat the identifier that stays are taken out, too, but for one.
    """
    rows = digests(docs, id_col, text_col)
    groups = broadcast_small(settle(merge_runs(rows, bits, keep).where("_n > 1")), BROADCAST_GROUPS)
    found = rows.select("_id", "_sha", "_raw").join(groups, "_sha")
    best = F.col("_id").eqNullSafe(F.col("_best"))
    # one row for each spelling of the text that the identifier which stays comes with
    stay = settle(
        found.where(best).groupBy("_sha", "_id", "_raw").agg(F.count(F.lit(1)).alias("_times"))
    )
    first = stay.groupBy("_sha").agg(F.min("_raw").alias("_first"))
    stay = stay.join(first, "_sha")
    other = stay.where("_raw <> _first").select("_id", "_raw")
    gone = settle(found.where(~best).select("_id", "_raw").union(other).distinct())
    again = settle(stay.where("_raw = _first and _times > 1").select("_id", "_raw"))
    left = without(docs, gone, id_col, text_col)
    if again.isEmpty():
        return left
    names = [free_name(docs, "_one_id"), free_name(docs, "_one_raw")]
    keyed = docs.withColumns(
        {names[0]: F.col(quoted(id_col)).cast("long"), names[1]: raw_hash(text_col)}
    )
    same = keyed[names[0]].eqNullSafe(again["_id"]) & (keyed[names[1]] == again["_raw"])
    once = keyed.join(again, same, "left_semi").dropDuplicates(names).drop(*names)
    return without(left, again, id_col, text_col).union(once)
