"""Tokenizers, fingerprints, HTML and languages against libraries, brute force and held-out rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from rowtide.llm import transducer
from rowtide.llm.bpe import ByteCodec, decode_ids, encode_texts, round_trip
from rowtide.llm.html_extract import RUN, extract_main_text, read_page, suffix_classes
from rowtide.llm.language_id import (
    LEAST,
    fit,
    identify_documents,
    identify_pages,
    keep_identified,
)
from rowtide.llm.transducer import TokenCounter, count_tokens
from rowtide.llm.winnowing import edited_fingerprints, fingerprints, gram_hashes, likeness, winnow

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"

TRICKY = [
    "", " ", "  a  b ", "\n\n x", "aaaaaaaaaaa aaaa", "<|endoftext|>", "don't I'll 's 'S", "é " * 50,
    "a<|endoftext|> b <|startoftext|><|endoftext|>x", "日本語 テスト   \t\n", "x" * 3000, "a\xa0b　c",
    "a \n b\r\n", "👩‍👩‍👧 ok", "\x00 \x00", "ΣΑΣ ΟΔΥΣΣΕΥΣ", "é É", "a\x1cb \x1d", "İstanbul",
    "½ ２３ ﬁ", "̈ a ̈b",
]


def texts(n: int = 1500) -> list[str]:
    rng = random.Random(1)
    letters = " \n\tabe'sltdm1é日<|endoftx>. TH"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(n)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 40))) for _ in range(n)]
    return TRICKY + made + words


SCHEMA = "doc_id long, text string, lang string, source string, _text string, _id string, _p int, _part int"


def awkward(spark):
    """Nulls, ties, repeated rows, a very long text and columns named like inner ones."""
    rows = [
        (5, None, "en", "a"), (5, "", None, None), (None, "No id here at all", "en", "a"), (1, "One two three four", "en", "b"),
        (1, "One two three four", "en", "b"), (2, "one TWO three four", "en", "c"), (9, "long words and more " * 6000, "en", "a"),
        (3, "!!! 123", "xx", "a"), (4, "é<|endoftext|>\n\n ñ", "es", "b"),
    ]
    return spark.createDataFrame([(*r, "x", "y", 1, 2) for r in rows], SCHEMA)


def test_codec_equals_library():
    codec, library = ByteCodec(BYTE), Tokenizer.from_file(BYTE)
    batch = texts()
    for text, ids, want in zip(
        batch, codec.encode_all(batch), library.encode_batch(batch, add_special_tokens=False), strict=True
    ):
        assert ids.tolist() == want.ids, text
        assert codec.decode(ids).decode() == library.decode(want.ids, skip_special_tokens=False)


def test_codec_decodes_broken_bytes():
    codec, library = ByteCodec(BYTE), Tokenizer.from_file(BYTE)
    rng = np.random.default_rng(3)
    for _ in range(200):
        ids = rng.integers(0, 50257, 12)
        assert codec.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)


def test_codec_forgets_and_goes_on(monkeypatch):
    from rowtide.llm import bpe

    monkeypatch.setattr(bpe, "REMEMBER", 10)
    codec, library = ByteCodec(BYTE), Tokenizer.from_file(BYTE)
    for text in texts(40):
        (ids,) = codec.encode_all([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_round_trip_rows(spark):
    docs, library = awkward(spark), Tokenizer.from_file(BYTE)
    want = []
    for row in docs.collect():
        ids = library.encode(row.text or "", add_special_tokens=False).ids
        joined = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        text = library.decode(ids, skip_special_tokens=False)
        want.append((row.doc_id, len(ids), joined, hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in round_trip(docs, BYTE).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert round_trip(docs.limit(0), BYTE).collect() == []


def test_ids_decode_to_texts(spark):
    docs = awkward(spark)
    back = decode_ids(encode_texts(docs, BYTE), BYTE)
    assert sorted((r.text for r in back.collect())) == sorted(r.text or "" for r in docs.collect())


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_counter_equals_library(monkeypatch, chunk):
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    counter, library = TokenCounter(WORD), Tokenizer.from_file(WORD)
    batch = texts(400)
    for text, want in zip(batch, library.encode_batch(batch, add_special_tokens=False), strict=True):
        assert counter.count(text) == len(want.ids), text


def test_counter_forgets_states(monkeypatch):
    monkeypatch.setattr(transducer, "STATES", 5)
    monkeypatch.setattr(transducer, "REMEMBER", 3)
    counter, library = TokenCounter(WORD), Tokenizer.from_file(WORD)
    for text in texts(60):
        assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_count_rows(spark):
    docs, library = awkward(spark), Tokenizer.from_file(WORD)
    want = []
    for row in docs.collect():
        n = len(library.encode(row.text or "", add_special_tokens=False).ids)
        want.append((row.doc_id, len((row.text or "").encode()), n, n > 2048))
    got = [tuple(r) for r in count_tokens(docs, WORD).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("k", [1, 3, 5, 16])
@pytest.mark.parametrize("window", [1, 3, 4, 31, 32])
def test_winnow_by_definition(k, window):
    rng = random.Random(2)
    for n in (1, 2, 5, 16, 17, 40, 150):
        text = "".join(rng.choice("ab é日") for _ in range(n))
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = min(k, n)
        grams = [int(gram_hashes(points[i : i + size], size)[0]) for i in range(n - size + 1)]
        width, chosen = min(window, len(grams)), []
        for i in range(len(grams) - width + 1):
            least = min(grams[i : i + width])
            at = max(j for j in range(i, i + width) if grams[j] == least)
            if at not in chosen:
                chosen.append(at)
        hashes, at = winnow(text, k, window)
        assert at.tolist() == chosen and hashes.tolist() == [grams[p] for p in chosen]


def test_winnow_finds_every_long_match():
    rng = random.Random(4)
    for _ in range(50):
        shared = "".join(rng.choice("abcdef ") for _ in range(47))  # WINDOW + K - 1
        a, b = ("".join(rng.choice("abcdef ") for _ in range(90)) for _ in range(2))
        assert set(winnow(a + shared + b)[0]) & set(winnow(b + shared + a)[0])


def _edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out = []
    for i, (ident, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        a, b, c = (winnow(t)[0] for t in (text, edit, after))
        digest = hashlib.sha256(edit.encode()).hexdigest()
        out.append((ident, len(text), digest, round(likeness(a, b), 9), round(likeness(a, c), 9)))
    return out


@pytest.mark.parametrize("n", [1, 2, 9, 60])
def test_edited_fingerprints_rows(spark, n):
    rng = random.Random(n)
    rows = [(i * 7 % 101, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 300)))) for i in range(n)]
    if n > 2:
        rows += [(None, "first of all"), (500, "last"), (501, "")]
    got = edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    short = [(r[0], r[1], r[2], round(r.near_edited, 9), round(r.near_next, 9)) for r in got]
    assert sorted(short, key=str) == sorted(_edited(rows), key=str)


def test_fingerprint_rows_of_awkward(spark):
    docs = awkward(spark)
    assert edited_fingerprints(docs).count() == docs.count() == fingerprints(docs).count()
    assert edited_fingerprints(docs.limit(0)).collect() == []


PAGE = """<!DOCTYPE html><html lang=en><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<script>var t="</p><article>no";</script><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="cookie-notice">We use cookies</div><form>Search <input></form><article><header><h1>A &amp; B</h1></header>
<p>Fi<b>rst</b> line<br>second   line<p>Third &lt;x&gt;&nbsp;y<!-- no --><aside>Side</aside>
<div class="ad">Buy</div><p title="a>b">Fourth.<section class="comments"><article><p>Nice!</article></section></article>
<footer>&copy; us</footer>"""


def test_page_is_its_article():
    blocks, others = read_page(PAGE)
    assert blocks == ["A & B", "First line", "second line", "Third <x> y", "Fourth."]
    assert all(drop for _, drop in others)


def test_unclosed_and_odd_markup():
    assert read_page("") == ([], [])
    assert read_page("<article>a < b <!-- open")[0] == ["a < b"]
    assert read_page("<main><p class=ad>no<p>yes</main>")[0] == ["yes"]
    assert read_page("<script>never ends")[0] == []


def test_suffix_classes_by_definition():
    rng = np.random.default_rng(0)
    for depth in (1, 2, 5, 8):
        stream = rng.integers(0, 3, 60)
        order, rank = suffix_classes(stream, depth)
        prefix = [tuple(stream[i : i + depth]) for i in range(60)]
        assert [prefix[i] for i in order] == sorted(prefix)
        assert all((rank[i] == rank[j]) == (prefix[i] == prefix[j]) for i in range(60) for j in range(60))


def test_pages_without_article_lose_what_a_host_repeats(spark):
    menu = "home news sport weather travel money arts more about us"
    def page(i):
        own = " ".join(f"w{i}x{k}" for k in range(30))
        return f"<body><div>{menu}</div><div>{own}</div><div>{menu} again{i}</div></body>", own
    rows = [(i, f"http://h{i % 2}.example/{i}", page(i)[0], 1) for i in range(8)]
    rows += [(90, "http://lonely.example/", page(90)[0], 1), (91, None, None, 1), (92, "x", PAGE, 1), (None, "x", "", 1)]
    got = {r.page_id: r for r in extract_main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string, _uid int").repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in range(8):
        assert got[i].text == page(i)[1] + f" again{i}"
        assert got[i].n_repeated == 2 * len(menu.split()) and len(menu.split()) >= RUN
    assert got[90].text == f"{menu} {page(90)[1]} {menu} again90"
    assert got[91].text == got[None].text == "" and got[91].n_chars == 0
    assert got[92].text == "A & B First line second line Third <x> y Fourth."


def test_copies_of_a_whole_page_stay(spark):
    body = "<div>" + " ".join(f"w{k}" for k in range(40)) + "</div>"
    rows = [(i, f"http://h.example/{i}", body) for i in range(4)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert all(r.text == " ".join(f"w{k}" for k in range(40)) for r in got)


def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = fit(docs.where("doc_id % 2 = 0"))
    assert model.languages == ["de", "en", "es", "fr"]
    held_out = docs.where("doc_id % 2 = 1 and n_chars > 200").select("text", "lang").collect()
    from rowtide.llm.language_id import text_posterior

    right = sum(model.languages[int(np.argmax(text_posterior(model, r.text)[0]))] == r.lang for r in held_out)
    assert right >= 0.97 * len(held_out)


def test_languages_of_pages(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    got = identify_pages(pages, docs).collect()
    want = {r.page_id: r.html.split('lang="')[1][:2] for r in pages.collect()}
    assert len(got) == len(want)
    assert sum(r.language == want[r.page_id] for r in got) >= 0.97 * len(got)


def test_languages_of_awkward_rows(spark):
    docs = awkward(spark)
    got = {(r._id, r._check): r for r in identify_documents(docs).collect()}
    assert len([1 for _ in identify_documents(docs).collect()]) == docs.count()
    assert all(r.rejected == (r.language is None) or r.probability < LEAST for r in got.values())
    kept = keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.text for r in kept.collect()}.isdisjoint({None, "", "!!! 123"})
    assert keep_identified(docs.limit(0)).collect() == []
    assert keep_identified(docs.where("lang is null")).collect() == []
