"""Site templates are found by recurrence alone, inside articles and without them."""

import random
import time

import pytest

from lumenledger.llm import htmltext

PAGE = """<html><body><div><ul><li><a href="/">Home</a></li><li><a href="/x">All stories</a></li></ul></div>{body}
<section><h2>Read this next</h2><ul><li><a href="/1">One</a></li></ul></section></body></html>"""
IN_ARTICLE = "<article><h1>Story {i}</h1><div><p>Sign up for our letter today</p></div><p>All rights of this text are ours.</p><p>Body {i}</p><ul><li><a>Top</a></li></ul><ul><li>Own {i}</li></ul></article>"
ALONE = "<div><h1>Story {i}</h1><p>Body {i}</p></div>"


def texts(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    return {r.page_id: r.text for r in htmltext.extract_text(pages, **more).collect()}


def test_boxes_that_recur_leave_articles_and_prose_stays(spark):
    rows = [(i, f"https://a.example.org/{i}", PAGE.format(body=IN_ARTICLE.format(i=i))) for i in range(8)]
    # Another host, where nothing recurs often enough.
    rows += [(100 + i, f"https://b.example.org/{i}", PAGE.format(body=IN_ARTICLE.format(i=i))) for i in range(3)]
    got = texts(spark, rows)
    assert {i: got[i] for i in range(8)} == {i: f"Story {i}\nAll rights of this text are ours.\nBody {i}\nOwn {i}" for i in range(8)}
    assert got[101] == "Story 1\nSign up for our letter today\nAll rights of this text are ours.\nBody 1\nTop\nOwn 1"


def test_pages_without_articles_lose_what_recurs(spark):
    rows = [(i, f"https://a.example.org/{i}", PAGE.format(body=ALONE.format(i=i))) for i in range(8)]
    assert texts(spark, rows) == {i: f"Story {i}\nBody {i}" for i in range(8)}


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "https://a.example.org/same", PAGE.format(body=ALONE.format(i=0))) for i in range(9)] + [(50, None, None), (None, "u", "<p>x</p>")]
    got = texts(spark, rows)
    assert all("Story 0\nBody 0" in got[i] for i in range(9))
    assert (got[50], got[None]) == ("", "x")


def test_many_pages_of_a_large_host_are_enough(spark):
    rows = [(i, f"https://a.example.org/{i}", PAGE.format(body=IN_ARTICLE.format(i=i))) for i in range(6)]
    rows += [(100 + i, f"https://a.example.org/x{i}", f"<article><p>Else {i}</p></article>") for i in range(40)]
    assert "Sign up" in texts(spark, rows)[3]
    assert "Sign up" not in texts(spark, rows, many_pages=6)[3]


def test_names_of_prose_say_nothing_and_ids_in_articles_neither():
    page = """<div id="login-box">go</div><article><h2 id="related-work" class="related">Related work</h2><section id="login-flow"><p class="notice">prose</p></section>
    <p>see <span class="social">social</span> history</p><div class="related-posts">go</div><div data-id="x" role="complementary">go</div></article>"""
    assert htmltext.extract(htmltext.parse(page)) == "Related work\nprose\nsee social history"
    assert htmltext.extract(htmltext.parse("<div id='comments'>go</div><div data-id='comments' title='class=comments'>stay</div>")) == "stay"


@pytest.mark.parametrize(
    "page,want",
    [
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<p>a<p>b<div>c</p>d</div>e", "a\nb\ncd\ne"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ('a < b <c d="1>2">e</c> f <', "a < b e f <"),
        ("<a title='it>x</a> y", "<a title='it>x y"),  # a quote that nothing ends hides the tag's end
        ('<p title=">" class=\'"\'>x', "x"),
        ("x<!--y-->z<?php a?><!doctype q>w<!-- u", "xzw"),
        ("a &#" + "1" * 5000 + "; b &amp;", "a � b &"),
        ("<br/>a<script/>b<SCRIPT>c</script >d", "abd"),
    ],
)
def test_tags_as_browsers_read_them_roughly(page, want):
    assert htmltext.extract(htmltext.parse(page)) == want


@pytest.mark.parametrize(
    "page",
    ["<a " * 330_000, '<a ">"' * 160_000 + "'", "<div>" * 90_000 + "</i>" * 140_000, "<b>" * 90_000 + "<hr>" * 90_000, "<li><div>" + "<b>" * 90_000 + "<li></li>" * 50_000, "<article>x</article>" * 50_000, "<!" * 400_000],
    ids=["open", "quotes", "stray", "flat", "container", "articles", "declarations"],
)
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    root = htmltext.parse(page)
    htmltext.extract(root, frozenset([1]))
    htmltext.subtrees(root)
    assert time.process_time() - began < 25


def brute_templates(rows, min_pages, min_share, many_pages):
    """Counted host by host, page by page."""
    host = lambda u: u.split("//")[1].split("/")[0] if u else ""
    found = {i: htmltext.subtrees(htmltext.parse(h)) for i, _, h in rows}
    out = {}
    for i, u, _ in rows:
        own = {}
        for j, v, _ in rows:
            if host(u) == host(v):
                own[found[j][0]] = found[j][1]  # copies of a page once
        keep = {s for s in found[i][1] if (n := sum(s in x for x in own.values())) >= min_pages and (n >= len(own) * min_share or n >= many_pages)}
        if keep:
            out[i] = keep
    return out


def test_counted_templates_are_those_of_brute_force(spark):
    rng = random.Random(4)
    box = lambda: rng.choice([f"<div>box {rng.randint(0, 4)}</div>", f"<ul><li>{rng.randint(0, 3)}</li></ul>", f"<p>{rng.randint(0, 9)}</p>", "<section><div>in</div></section>"])
    page = lambda: "".join(box() for _ in range(rng.randint(0, 4))) + rng.choice(["", f"<article>{box()}{box()}</article>"])
    rows = [(i, f"https://{rng.choice('abc')}.org/{i}", page()) for i in range(90)]
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(0, 30, 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for least in ((3, 0.3, 50), (2, 0.9, 8)):
        got = {r.page_id: set(r.template) for r in htmltext.template_subtrees(pages, *least).collect()}
        assert got == brute_templates(rows, *least) and got
