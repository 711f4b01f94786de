"""Languages of skewed corpora and of corpora without labels."""

from __future__ import annotations

import random

from rowtide.llm.language_id import fit, identify_documents, keep_identified


def own_words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def test_every_label_is_fitted(spark):
    rng = random.Random(1)
    rows = [(i, f"l{i % 70:02}", f"common {own_words(rng, 8 + i % 70)}") for i in range(140)]
    rows += [(1000 + i, "big", own_words(rng, 9)) for i in range(3000)]
    rows += [(9000 + i, "copies", "one text that many rows have") for i in range(2000)] + [(99999, "rare", "zzyzx quux")]
    model = fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4), rows=50)
    assert model.languages == sorted({r[1] for r in rows})
    assert len(model.languages) == 73


def test_rows_stay_when_nothing_is_labelled(spark):
    rows = [(1, None, "Words of some language", "a"), (2, None, "123", "a"), (3, None, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, source string")
    assert [r.doc_id for r in keep_identified(docs).collect()] == [1]
    assert {r.language for r in identify_documents(docs).collect()} == {None}
