"""Main text of web pages, from their markup and from what the pages of a host share.

A page is read into blocks. Those inside an article (or main) element that no
boilerplate element or mark encloses are its main text. All other text is boilerplate if
the markup says so, and otherwise open.

Text that is open is decided by the host's suffix array: the token streams of a host's
pages, without their articles, are concatenated, the suffixes sorted, and long substrings
that distinct pages share are found as neighbours in that order. Tokens that such
substrings cover are boilerplate, the runs between them are kept. Only the order of the
first ``RUN`` tokens matters for that. Tasks sort the suffixes of the pages they hold, by
prefix doubling, and keep one row for each class of suffixes that agree so far; classes
of all tasks are merged by aggregation, so that a host with a third of all pages, or a
menu that all of them have, never meets in one task.

Unique runs are kept in page order, beside the article if there is one. Repetition never
removes text of an article: copies of an article are whole articles. On a page without
article, blocks with a shared run of ``COPY`` tokens or more stay if that run is longer than
all that is unique: they are a copied text, where what templates repeat are short runs.

Marks are words of a class, id or role; an article (or main) element itself is marked only as a reader's
comment. If marks and forms leave a page
nothing at all, it is read again without them.

Defined results: a null or empty page has an empty text; a null address is a host of its
own; rows of one page_id are pages of their own, but runs count once for one (page_id,
url); an empty table gives no rows; pages of any length are read whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowtide.llm.common import bounded_batches, gathered, quoted, whole
from rowtide.session import settle

# Tokens of a shared substring at least, and of one from which it is a copied text.
RUN = 8
COPY = 32
# Bytes of parsed pages sorted together in a task.
GATHER = 8 << 20
# Part of a block's letters inside links from which it is a menu.
LINKS = 0.6

# HTML elements by what they hold.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s "
    "samp small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset(
    "head nav footer aside form button select option optgroup menu dialog svg canvas object audio "
    "video map fieldset datalist".split()
)
FORMS = ("form", "fieldset")
CLOSES_P = frozenset(
    "address article aside blockquote div dl dd dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "li main menu nav ol p pre section table ul".split()
)
# Words that mark what is not the article, as the last word of a class, id or role.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored "
    "cookie cookies consent gdpr newsletter subscribe subscription "
    "signup login paywall share sharing rail menu menus nav navbar navigation sidebar sidebars "
    "breadcrumb breadcrumbs pagination pager footer masthead topbar toolbar comment comments reply "
    "replies respond disqus outbrain taboola trending related recommended recommendations discussion "
    "copyright disclaimer complementary contentinfo skip".split()
)
# Words that mark only if no word of the class, id or role says more than where it stands.
NOTICES = frozenset("banner promo promotion notice notices alert popup modal overlay widget widgets legal social search".split())
# Words for a container or a place, which the word that matters stands before or behind.
PLACES = frozenset(
    "area bar block body box column container content entries feed form holder inner item items link links list "
    "module outer panel part post posts row section slot stories thread unit widget wrap wrapper zone articles "
    "left right top bottom main page site global primary secondary".split()
)
# Words that say an element has or lacks something elsewhere.
STATES = frozenset("has have with without no not hide hides hidden show shows is enable enabled disable disabled".split())
# What an article element is marked by, itself.
REMARKS = frozenset("comment comments reply replies".split())

# Kinds of blocks: of the main region, boilerplate, undecided.
MAIN, DROP, OPEN = range(3)

_OPENS = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_STOP = re.compile(r">|=\s*[\"']?")
_VALUE_ENDS = re.compile(r"[\s>]")
_ATTRIBUTE = re.compile(r"""([^\s=>/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def tag_end(html: str, at: int) -> int:
    """Where the tag whose name ends at ``at`` is over, behind its ``>``; -1 if it never is.

    Quotation marks count only where a value begins, so every character is passed once.
    """
    while True:
        found = _STOP.search(html, at)
        if found is None:
            return -1
        at = found.end()
        if found[0] == ">":
            return at
        if found[0][-1] in "\"'":
            at = html.find(found[0][-1], at) + 1
            if not at:
                return -1
        else:
            ends = _VALUE_ENDS.search(html, at)
            if ends is None:
                return -1
            at = ends.start()


def is_mark(name: str, marks: frozenset = MARKS) -> bool:
    """Whether one class, id or role names boilerplate: ``post-comments`` and ``commentList`` do,
    ``has-comments`` and ``story-banner`` do not."""
    words = [w.lower() for w in _WORDS.findall(name)]
    if not words or words[0] in STATES:
        return False
    telling = [w for w in words if w not in PLACES] or words[-1:]
    if telling[-1] in marks:
        return True
    return marks is MARKS and all(w in NOTICES or w in MARKS for w in telling)


def _marks(attributes: str, tag: str) -> tuple[bool, bool, bool]:
    """Whether attributes hide an element, mark it as boilerplate, or as the main region."""
    hidden = marked = main = False
    marks = REMARKS if tag in ("article", "main") else MARKS
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden":
            hidden = True
        elif name == "aria-hidden":
            hidden |= value.lower() == "true"
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        elif name in ("class", "id", "role"):
            marked |= any(is_mark(one, marks) for one in value.split())
            main |= name == "role" and "main" in value.lower().split()
        elif name == "aria-label":
            marked |= is_mark(value, marks)
    return hidden, marked, main


def read_page(html: str) -> tuple[list[str], list[tuple[str, bool]]]:
    """Blocks of the main region, and all other blocks with whether they are boilerplate."""
    blocks = page_blocks(html)
    return [t for t, kind in blocks if kind == MAIN], [(t, kind == DROP) for t, kind in blocks if kind != MAIN]


def page_blocks(html: str) -> list[tuple[str, int]]:
    """All blocks in page order with their kinds."""
    blocks = _blocks(html, True)
    if blocks and all(kind == DROP for _, kind in blocks):
        blocks = _blocks(html, False)
    return blocks


def _blocks(html: str, strict: bool) -> list[tuple[str, int]]:
    """Blocks and kinds; only if ``strict`` do marks and forms drop what they hold."""
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = [("", False, False)]  # tag, dropped, in main
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                _, drop, main = stack[-1]
                if main and not drop:
                    blocks.append((text, MAIN))
                else:
                    menu = linked >= LINKS * sum(map(len, pieces))
                    blocks.append((text, DROP if drop or menu else OPEN))
            pieces.clear()
        linked = 0

    at, anchors = 0, 0
    end = len(html)
    opened: Counter = Counter()

    def take(stop: int) -> None:
        nonlocal linked
        if stop > at:
            pieces.append(html[at:stop])
            linked += (stop - at) if anchors else 0

    def leave() -> None:
        opened[stack.pop()[0]] -= 1

    while at < end:
        found = _OPENS.search(html, at)
        take(found.start() if found else end)
        if not found:
            break
        at = found.end()
        name = _NAME.match(html, at)
        if name is None:
            # a comment or a declaration, or an end tag without a name
            mark = next((m for o, m in (("!--", "-->"), ("![CDATA[", "]]>")) if html.startswith(o, at)), ">")
            over = html.find(mark, at)
            at = over + len(mark) if over >= 0 else end
            continue
        over = tag_end(html, name.end())
        if over < 0:
            break  # the page ends inside a tag
        attributes, at = html[name.end() : over - 1], over
        tag, closing = name[0].lower().lstrip("/"), name[0][0] == "/"
        if tag == "a":
            anchors = 0 if closing else 1
        if tag == "br" or (tag not in INLINE and tag != "img"):
            flush()
        if closing:
            if opened[tag]:
                if stack[-1][0] != tag:
                    flush()
                while stack[-1][0] != tag:
                    leave()
                if stack[-1][1] or tag not in INLINE:
                    flush()
                leave()
            continue
        if tag in RAW:
            over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            at = over.end() if over else end
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if tag in CLOSES_P and stack[-1][0] == "p":
            leave()
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th") and stack[-1][0] == tag:
            leave()
        _, drop, main = stack[-1]
        hidden, marked, is_main = _marks(attributes, tag) if attributes.strip() else (False, False, False)
        is_main |= tag in ("article", "main")
        own = hidden and tag not in ("html", "body")
        own |= tag in BOILERPLATE and (strict or tag not in FORMS)
        own |= strict and marked and tag not in ("html", "body")
        own |= tag == "header" and not main
        if own and not drop:
            flush()
        stack.append((tag, drop or own, main or is_main))
        opened[tag] += 1
    flush()
    return blocks


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def suffix_classes(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of a stream to a depth, by prefix doubling.

    Returns the suffixes in order, and the class of each: suffixes of one class agree in
    their first ``depth`` tokens. Past the end of the stream comes a token that is no other.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    reach = 1
    while reach < depth:
        step = min(reach, depth - reach)
        far = np.full(n, -1, np.int64)
        far[: max(0, n - step)] = rank[step:] if step < n else []
        rank = np.unique((rank + 1) * (n + 2) + far + 1, return_inverse=True)[1].astype(np.int64)
        reach += step
    order = np.argsort(rank, kind="stable")
    return order, rank


def _streams(table: pa.Table) -> dict[str, list[tuple[int, int, np.ndarray]]]:
    """For each host the pages' (row name, page name, token codes) of what is not their article."""
    streams = defaultdict(list)
    digest = xxhash.xxh64_intdigest
    columns = [table.column(c).to_pylist() for c in ("_row", "_page", "_host", "_others")]
    for row, page, host, others in zip(*columns, strict=True):
        words = [w for block in others for w in block["text"].split()]
        if len(words) >= RUN:
            codes = np.fromiter((digest(w.encode()) for w in words), np.uint64, len(words))
            streams[host].append((row, page, codes))
    return streams


def _grams(codes: np.ndarray) -> np.ndarray:
    """A 64-bit name of the RUN tokens from each position on."""
    n = len(codes) - RUN + 1
    out = np.zeros(n, np.uint64)
    for i in range(RUN):
        out = (out ^ codes[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _shared_classes(batches):
    """One row for each class of a task's host streams: host, gram, least and greatest page."""
    for table in gathered(batches, GATHER):
        rows = [[], [], [], []]
        for host, pages in _streams(table).items():
            lengths = np.array([len(c) for _, _, c in pages])
            stream = np.concatenate([c for _, _, c in pages])
            page = np.repeat(np.array([p for _, p, _ in pages]), lengths)
            into = np.arange(len(stream)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            inside = into <= np.repeat(lengths, lengths) - RUN  # suffixes of RUN tokens of one page
            order, rank = suffix_classes(stream, RUN)
            order = order[inside[order]]
            first = np.flatnonzero(np.concatenate(([True], np.diff(rank[order]) != 0)))
            gram = np.concatenate([np.append(_grams(c), np.zeros(RUN - 1, np.uint64)) for _, _, c in pages])
            rows[0] += [host] * len(first)
            rows[1].append(gram[order[first]])
            rows[2].append(np.minimum.reduceat(page[order], first))
            rows[3].append(np.maximum.reduceat(page[order], first))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(rows[0], pa.string()),
                *[pa.array(np.concatenate(r).astype(np.int64) if r else np.zeros(0, np.int64)) for r in (
                    [x.view(np.int64) for x in rows[1]], rows[2], rows[3])],
            ],
            ["_host", "_gram", "_least", "_most"],
        )


def _positions(batches):
    """A row for each suffix of RUN tokens: its page's row number and host, position, gram."""
    for table in gathered(batches, GATHER):
        for host, pages in _streams(table).items():
            counts = [len(c) - RUN + 1 for _, _, c in pages]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([host] * sum(counts), pa.string()),
                    pa.array(np.repeat(np.array([u for u, _, _ in pages]), counts)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in counts])),
                    pa.array(np.concatenate([_grams(c) for _, _, c in pages]).view(np.int64)),
                ],
                ["_host", "_row", "_pos", "_gram"],
            )


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("drop", pa.bool_())]))


def parse_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """Each page's blocks in order (compressed; of dropped ones the number of tokens), and its other blocks.

    ``_row`` names a row by all that is read of it, ``_page`` by its id and address.
    """
    bounded_batches(pages.sparkSession)
    names = ["page_id", "url", "_row", "_page"]

    def work(batches):
        for batch in batches:
            read = [page_blocks(h) for h in batch.column("_html").to_pylist()]
            packed = [json.dumps([[len(t.split()) if k == DROP else t, k] for t, k in b]) for b in read]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in names],
                    pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()),
                    pa.array([zlib.compress(p.encode(), 1) for p in packed], pa.binary()),
                    pa.array([[{"text": t, "drop": k == DROP} for t, k in b if k != MAIN] for b in read], _BLOCKS),
                ],
                [*names, "_host", "_blocks", "_others"],
            )

    html = whole(F.col(quoted(html_col)))
    slim = pages.select(
        F.col(quoted(id_col)).alias("page_id"),
        F.col(quoted(url_col)).cast("string").alias("url"),
        F.xxhash64(quoted(id_col), quoted(url_col), html).alias("_row"),
        F.xxhash64(quoted(id_col), quoted(url_col)).alias("_page"),
        html.alias("_html"),
    )
    kind = slim.schema["page_id"].dataType.simpleString()
    schema = (
        f"page_id {kind}, url string, _row long, _page long, _host string, _blocks binary, "
        "_others array<struct<text: string, drop: boolean>>"
    )
    return slim.mapInArrow(work, schema)


def covered_positions(parsed: DataFrame) -> DataFrame:
    """``_row _covered``: for pages with shared substrings, where RUN covered tokens begin."""
    slim = settle(parsed.select("_row", "_page", "_host", "_others"))
    shared = settle(
        slim.mapInArrow(_shared_classes, "_host string, _gram long, _least long, _most long")
        .groupBy("_host", "_gram")
        .agg(F.min("_least").alias("_least"), F.max("_most").alias("_most"))
        .where("_least <> _most")
        .select("_host", "_gram")
    )
    return (
        slim.mapInArrow(_positions, "_host string, _row long, _pos int, _gram long")
        .join(shared, ["_host", "_gram"], "left_semi")
        .groupBy("_row")
        .agg(F.collect_set("_pos").alias("_covered"))
    )


def covered_tokens(covered: list[int] | None) -> np.ndarray:
    """The numbers of the tokens that runs of RUN tokens from these positions on cover."""
    at = np.array(covered or [], np.int64)
    return np.unique(at[:, None] + np.arange(RUN)[None, :])


def unique_runs(blocks: list, covered: np.ndarray) -> str:
    """The main blocks and the open text without covered tokens, in page order.

    Token numbers leave out the main blocks.
    """
    taken = set(covered.tolist())
    at, unique, longest, parts, main = 0, 0, 0, [], False
    for text, kind in blocks:
        if kind == MAIN:
            main = True
            parts.append(([text], [text], 0))
            continue
        if kind == DROP:
            at += text
            continue
        words = text.split()
        own = [w for i, w in enumerate(words, at) if i not in taken]
        run = most = 0
        for i in range(at, at + len(words)):
            run = run + 1 if i in taken else 0
            most = max(most, run)
        at += len(words)
        unique += len(own)
        longest = max(longest, most)
        parts.append((own, words, most))
    copied = not main and longest >= COPY and longest > unique
    return " ".join(w for own, words, run in parts for w in (words if copied and run >= COPY else own))


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``page_id url text n_chars n_repeated`` of every page.

    ``n_repeated`` counts the tokens outside its article that other pages of the host share.
    """
    parsed = parse_pages(pages, id_col, url_col, html_col)
    kind = parsed.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "text", "n_repeated"]

    def work(batches):
        for batch in batches:
            covered = [covered_tokens(c) for c in batch.column("_covered").to_pylist()]
            rows = zip(batch.column("_blocks").to_pylist(), covered, strict=True)
            text = [unique_runs(json.loads(zlib.decompress(b)), c) for b, c in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"),
                    batch.column("url"),
                    pa.array(text, pa.string()),
                    pa.array([len(c) for c in covered], pa.int64()),
                ],
                names,
            )

    # pages are read a second time here: cheaper than to keep all texts between the passes
    texts = parsed.select("page_id", "url", "_row", "_blocks")
    return (
        texts.join(covered_positions(parsed), "_row", "left")
        .select("page_id", "url", "_blocks", "_covered")
        .mapInArrow(work, f"page_id {kind}, url string, text string, n_repeated long")
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
    )
