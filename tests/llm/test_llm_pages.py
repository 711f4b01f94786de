"""Pages whose story is not, or not only, in a plain article element."""

from __future__ import annotations

import random
import time

import pytest

from rowtide.llm.html_extract import (
    RUN,
    covered_positions,
    covered_tokens,
    extract_main_text,
    parse_pages,
    read_page,
)


@pytest.mark.parametrize(
    "page",
    [
        "<article class='post has-comments'><p>Story</article>", "<main class='no-sidebar'><p>Story</main>",
        "<form id=aspnetForm><article><p>Story</article></form>",
        "<div class='content with-sidebar'><article><p>Story</article></div>",
    ],
)
def test_marks_leave_the_article(page):
    assert read_page(page)[0] == ["Story"]


STORY = "<article><p>Story</p>{}</article>"


@pytest.mark.parametrize(
    "page",
    [
        STORY.format('<section class="post-comments"><p>Nice</p></section>'),
        STORY.format('<ol class="comment-list"><li>Nice</li></ol>'),
        STORY.format('<div class="reader-comments"><article class="comment">Nice</article></div>'),
        STORY.format('<div id=commentThread>Nice</div>'),
        STORY.format("") + '<article class="comment depth-1"><p>Nice</p></article>',
        STORY.format("") + '<div class="left-sidebar"><p>Other news</p></div>',
        STORY.format("") + '<div class="related-posts"><p>Other news</p></div>',
        STORY.format("") + '<div class="promo-banner">Buy</div><div role=alert>Mind</div>',
        STORY.format("") + '<div class="ad-slot">Buy</div><div class="site-footer">Us</div>',
        '<article><div class="story-banner"><p>Story</p></div></article>',
        '<article><p title=5"x>Story</p></article>',
        "<article><p title='a>b' class=x>Story</p></article>",
        '<article><p>Story</p><script>"</article>"</script ></article>',
    ],
)
def test_story_without_comments_sidebars_and_marks(page):
    assert read_page(page)[0] == ["Story"]
    assert not any(not drop for _, drop in read_page(page)[1])


@pytest.mark.parametrize(
    "piece", ["<a ", "<a b=\"", "<div>", "</x>", "<!--", "<a b='>", "<textarea>", "<a title=5\"x>", "<p><b>", "< ", "&amp"]
)
def test_pages_of_any_markup_take_linear_time(piece):
    page = "<article><p>Story " + piece * (1_000_000 // len(piece))
    begin = time.process_time()
    assert read_page(page)[0][0].startswith("Story")
    assert time.process_time() - begin < 6


def naive_shared(streams, run):
    """Per page the tokens covered by a run of so many tokens that another page has, too."""
    grams = {}
    for page, words in streams.items():
        for i in range(len(words) - run + 1):
            grams.setdefault(tuple(words[i : i + run]), set()).add(page)
    return {
        page: sorted({
            i + k for i in range(len(words) - run + 1)
            if len(grams[tuple(words[i : i + run])]) > 1 for k in range(run)
        })
        for page, words in streams.items()
    }


def test_shared_runs_equal_brute_force(spark):
    rng = random.Random(8)
    rows, streams = [], {}
    for i in range(40):
        host = f"h{i % 3}"
        pieces = [" ".join(rng.choice("abc") for _ in range(rng.randint(3, 25))) for _ in range(4)]
        rows.append((i, f"http://{host}/{i}", "".join(f"<div>{p}</div>" for p in pieces)))
        streams.setdefault(host, {})[i] = " ".join(pieces).split()
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    parsed = parse_pages(frame)
    named = {r["_row"]: r["page_id"] for r in parsed.select("_row", "page_id").collect()}
    got = {named[r["_row"]]: covered_tokens(r["_covered"]).tolist() for r in covered_positions(parsed).collect()}
    want = {p: c for pages in streams.values() for p, c in naive_shared(pages, RUN).items() if c}
    assert len(want) > 10 and got == want


def test_wide_words_leave_text_open():
    assert read_page("<div class='legal-news'><p>Story</div><div class=related>No</div>")[1] == [("Story", False), ("No", True)]
    assert read_page("<form id=aspnetForm><div>Story</div></form>")[1] == [("Story", False)]


def test_unique_text_beside_an_article_stays(spark):
    menu = "home news sport weather travel money arts more about us"
    def page(i):
        story = " ".join(f"s{i}x{k}" for k in range(40))
        return f"<div>{menu}</div><div id=content>{story}</div><article>Teaser {i}</article><div>{menu}</div>", story
    rows = [(i, f"http://h.example/{i}", page(i)[0]) for i in range(4)]
    rows += [(10 + i, f"http://h.example/{10 + i}", f"<div>{menu}</div>") for i in range(2)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(4)] == [f"{page(i)[1]} Teaser {i}" for i in range(4)]
    assert got[10] == got[11] == ""
