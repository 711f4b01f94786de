"""Language identification by fusing text with what is known about where it comes from.

The likelihood of a text in each language comes from its byte trigrams, under a model
fitted on a bounded sample of the labelled rows of each language. To it are added, as in Bayes' rule,

* how often rows of each language declare what this row declares (markup language) or
  carry its address code (a language segment such as ``/fr/``), and
* a prior of its host, smoothed towards the prior of the host's address suffix, which is
  smoothed towards that of all rows. A row's own share is left out of its host's counts.

All these tables are sums of text posteriors over all rows, by grouped aggregation; rows
meet them by joins, so that the number of hosts is not limited and a host with a third of
all rows is one row per task before the exchange.

A row is rejected if its text has no letters, or if no language reaches ``LEAST``.

Defined results: a null text is an empty one and is rejected with a null language; null
declarations, addresses and hosts are no evidence; without any labelled row the language is
null and rows with letters are not rejected; rows with equal identifiers are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import BROADCAST_ROWS, bounded_batches, broadcast_small, quoted, raw_hash, whole, without
from rowtide.session import settle

# Distinct texts of each language that the text model is fitted on at most (expected).
FIT_ROWS = 4000
BUCKETS = 1 << 16
# Trigrams from which on more text adds no certainty, and the weight of each.
ENOUGH = 60
# Rows that a prior of the level above counts for, and the least posterior accepted: a text in
# two languages, which has half of either, is in order.
STRENGTH = 20.0
LEAST = 0.4

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class TextModel:
    """Log likelihood of each trigram bucket in each language."""

    languages: list[str]
    table: np.ndarray  # languages x BUCKETS


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams that hold a letter, lower-cased."""
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
    if len(raw) < 3:
        raw = np.concatenate([raw, np.full(3 - len(raw), 32, np.uint8)])
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    letter = _LETTER[raw]
    keep = letter[:-2] | letter[1:-1] | letter[2:]
    code = (a[keep].astype(np.uint32) << 16) | (b[keep].astype(np.uint32) << 8) | c[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "lang",
    rows: int = FIT_ROWS,
    id_col: str = "doc_id",
) -> TextModel:
    """Fit on about ``rows`` distinct texts of each label, all of a label that has fewer.

    They are chosen by a hash of identifier and text. The table takes 256 KB a language.
    """
    bounded_batches(labelled.sparkSession)
    text = F.col(quoted(text_col))
    slim = labelled.select(
        F.col(quoted(label_col)).cast("string").alias("_label"),
        F.xxhash64(F.col(quoted(id_col)), whole(text)).alias("_rank"),
        raw_hash(text_col).alias("_raw"),
        whole(text).alias("_text"),
    ).where("_label is not null")
    # copies are one text
    once = settle(slim.groupBy("_label", "_raw").agg(F.min("_rank").alias("_rank")))
    counts = broadcast_small(settle(once.groupBy("_label").agg(F.count(F.lit(1)).alias("_all"))), BROADCAST_ROWS)
    place = F.shiftrightunsigned("_rank", 11) / F.lit(float(1 << 53))
    few = settle(once.join(counts, "_label").where(place * F.col("_all") <= rows).select("_label", "_raw", "_rank"))
    chosen = slim.join(broadcast_small(few, BROADCAST_ROWS), ["_label", "_raw", "_rank"], "left_semi")
    chosen = chosen.dropDuplicates(["_label", "_raw"])

    def work(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, t in zip(batch.column("_label").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if label not in sums:
                    sums[label] = np.zeros(BUCKETS, np.int64)
                np.add.at(sums[label], trigrams(t), 1)
        for label, sum_ in sums.items():
            at = np.flatnonzero(sum_)
            yield pa.RecordBatch.from_arrays(
                [pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(sum_[at])], ["_label", "_bucket", "_n"]
            )

    counted = settle(
        chosen.select("_label", "_text").mapInArrow(work, "_label string, _bucket long, _n long").groupBy("_label", "_bucket").agg(F.sum("_n").alias("_n"))
    )
    languages = sorted(r[0] for r in counted.select("_label").distinct().collect())
    index = {name: i for i, name in enumerate(languages)}
    table = np.full((len(languages), BUCKETS), 0.5, np.float32)
    # at most BUCKETS rows a language
    for label, bucket, n_ in counted.toLocalIterator():
        table[index[label], bucket] += n_
    for row in table:
        row[:] = np.log(row / row.sum(dtype=np.float64))
    return TextModel(languages, table)


def text_posterior(model: TextModel, text: str) -> tuple[list[float], int]:
    """Posterior of each language from the text alone, and how many trigrams it has."""
    grams = trigrams(text)
    count = len(model.languages)
    if not len(grams) or not count:
        return [1.0 / max(1, count)] * count, len(grams)
    mean = model.table[:, grams].mean(axis=1, dtype=np.float64)
    logs = mean * min(len(grams), ENOUGH)
    weights = np.exp(logs - logs.max())
    return (weights / weights.sum()).tolist(), len(grams)


_CODE = re.compile(r"^[a-z][a-z0-9+.-]*://[^/?#]*/([a-z]{2})(?:[/?#]|$)")


def address_code(url: Column) -> Column:
    """A two-letter first segment of the path, or null."""
    code = F.regexp_extract(F.lower(url), _CODE.pattern, 1)
    return F.when(code != "", code)


def address_suffix(host: Column) -> Column:
    """The last part of a host's name, or null."""
    suffix = F.regexp_extract(host, r"\.([A-Za-z0-9-]+)$", 1)
    return F.when(suffix != "", F.lower(suffix))


def evidence(
    rows: DataFrame,
    model: TextModel,
    id_col: str,
    text_col: str,
    declared: Column | None = None,
    address: Column | None = None,
    host: Column | None = None,
) -> DataFrame:
    """``_id _check _n _p`` (text posterior) and the row's other evidence; written once."""
    bounded_batches(rows.sparkSession)
    none = F.lit(None).cast("string")
    text = whole(F.col(quoted(text_col)))
    host = none if host is None else host.cast("string")
    slim = rows.select(
        F.col(quoted(id_col)).alias("_id"),
        raw_hash(text_col).alias("_check"),
        (none if declared is None else F.lower(F.substring(declared.cast("string"), 1, 2))).alias("_declared"),
        (none if address is None else address_code(address)).alias("_code"),
        host.alias("_host"),
        address_suffix(host).alias("_suffix"),
        text.alias("_text"),
    )
    names = ["_id", "_check", "_declared", "_code", "_host", "_suffix"]

    def work(batches):
        for batch in batches:
            found = [text_posterior(model, t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([n for _, n in found], pa.int64()),
                    pa.array([p for p, _ in found], pa.list_(pa.float64())),
                ],
                [*names, "_n", "_p"],
            )

    kind = slim.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _check long, _declared string, _code string, _host string, _suffix string, _n long, _p array<double>"
    return settle(slim.mapInArrow(work, schema))


def _sums(rows: DataFrame, key: str | None, count: int) -> DataFrame:
    """Text posteriors of all rows, added up by a key: ``_sum`` and the number of rows."""
    each = [F.sum(F.when(F.col("_n") > 0, F.element_at("_p", i + 1)).otherwise(0.0)) for i in range(count)]
    keys = [key] if key else []
    seen = rows.where(F.col(key).isNotNull()) if key else rows
    return seen.groupBy(*keys).agg(
        F.array(*each).alias("_sum"), F.sum(F.when(F.col("_n") > 0, 1).otherwise(0)).alias("_rows")
    )


def _smooth(sums: Column, parent: Column) -> Column:
    """Counts by language made a prior, the parent's counting for ``STRENGTH`` rows."""
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x)
    return F.transform(
        F.zip_with(sums, parent, lambda s, p: F.greatest(s, F.lit(0.0)) + STRENGTH * p),
        lambda v: v / (F.greatest(total, F.lit(0.0)) + STRENGTH),
    )


def fuse(rows: DataFrame, model: TextModel, least: float = LEAST) -> DataFrame:
    """``_id _check language probability rejected`` of the rows of ``evidence``."""
    names, count = model.languages, len(model.languages)
    if not count:
        return rows.select(
            "_id", "_check", F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("probability"), (F.col("_n") == 0).alias("rejected")
        )
    first = _sums(rows, None, count).first()
    totals = [float(x or 0.0) for x in (first[0] or [0.0] * count)]
    whole_sum = sum(totals)
    overall = F.array(*[F.lit((x + 1.0) / (whole_sum + count)) for x in totals])

    out = rows
    # P(declared | language): how a language's rows are spread over the declarations
    for key in ("_declared", "_code"):
        table = settle(_sums(rows, key, count)).select(key, F.col("_sum").alias(f"_of{key}"))
        out = out.join(table, key, "left")
    suffixes = settle(_sums(rows, "_suffix", count))
    hosts = settle(_sums(rows, "_host", count))
    out = out.join(suffixes.select("_suffix", F.col("_sum").alias("_of_suffix")), "_suffix", "left")
    out = out.join(hosts.select("_host", F.col("_sum").alias("_of_host")), "_host", "left")

    def seen(key: str) -> Column:
        """Log of P(value | language), this row's own share left out; 0 without evidence."""
        own = F.when(F.col("_n") > 0, F.col("_p")).otherwise(F.array(*[F.lit(0.0)] * count))
        others = F.zip_with(f"_of{key}", own, lambda s, p: F.greatest(s - p, F.lit(0.0)))
        total = F.aggregate(others, F.lit(0.0), lambda a, x: a + x)
        share = (total + 1.0) / (whole_sum + 2.0)
        spread = F.zip_with(
            others, F.array(*map(F.lit, totals)), lambda s, t: F.log((s + STRENGTH * share) / (t + STRENGTH))
        )
        return F.when(F.col(key).isNull(), F.array(*[F.lit(0.0)] * count)).otherwise(spread)

    own = F.when(F.col("_n") > 0, F.col("_p")).otherwise(F.array(*[F.lit(0.0)] * count))
    no_sum = F.array(*[F.lit(0.0)] * count)
    suffix_prior = _smooth(F.coalesce("_of_suffix", no_sum), overall)
    out = out.withColumn("_suffix_prior", suffix_prior)
    without = F.zip_with(F.coalesce("_of_host", own), own, lambda s, p: s - p)
    out = out.withColumn("_prior", _smooth(without, F.col("_suffix_prior")))
    logs = F.zip_with(
        F.zip_with("_p", "_prior", lambda p, q: F.log(F.greatest(p, F.lit(1e-30))) + F.log(q)),
        F.zip_with(seen("_declared"), seen("_code"), lambda a, b: a + b),
        lambda a, b: a + b,
    )
    out = out.withColumn("_logs", logs).withColumn("_top", F.array_max("_logs"))
    mass = F.aggregate("_logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))
    best = F.element_at(F.array(*map(F.lit, names)), F.array_position("_logs", F.col("_top")).cast("int"))
    heard = F.col("_n") > 0
    out = out.select("_id", "_check", "_n", best.alias("_best"), (1.0 / mass).alias("_prob"))
    return out.select(
        "_id",
        "_check",
        F.when(heard, F.col("_best")).alias("language"),
        F.when(heard, F.col("_prob")).otherwise(0.0).alias("probability"),
        (~heard | (F.col("_prob") < least)).alias("rejected"),
    )


def identify_documents(docs: DataFrame) -> DataFrame:
    """Languages of ``documents``: the ``lang`` column is the declaration, the source the host."""
    model = fit(docs)
    return fuse(evidence(docs, model, "doc_id", "text", declared=F.col("lang"), host=F.col("source")), model)


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows that identification rejects, all columns as they were."""
    gone = identify_documents(docs).where("rejected").select("_id", F.col("_check").alias("_raw"))
    return without(docs, settle(gone.distinct()))


def identify_pages(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """``page_id url language probability rejected`` of web pages.

    The text is what the markup leaves; the declaration is the html element's language.
    """
    model = fit(labelled)
    html = whole(F.col("html"))
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)|<[^>]*>", " ")
    declared = F.regexp_extract(html, r"(?i)<html\b[^>]*\blang\s*=\s*[\"']?([A-Za-z]{2})", 1)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.struct("page_id", "url").alias("_key"),
        bare.alias("_bare"),
        F.when(declared != "", declared).alias("_lang"),
        F.col("url").alias("_url"),
        F.when(host != "", host).alias("_at"),
    )
    found = fuse(
        evidence(rows, model, "_key", "_bare", F.col("_lang"), F.col("_url"), F.col("_at")), model
    )
    return found.select("_id.page_id", "_id.url", "language", "probability", "rejected")
