"""Main text of pages: the given pages against their articles, low branches of a site, odd pages."""

import html
import math
import random
import re
import time

from scriptorium.llm import page_text, queries


def _text(page):
    return "\n".join(t for t, _ in page_text.parse(page)[0])


def test_given_pages(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op13_page_text(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r.page_id].html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_that_say_what_they_are():
    page = """<!DOCTYPE html><html><head><title>No</title></head><body class="no-sidebar"><header class="site"><h1>Site</h1></header><div class="top-menu"><ul><li><a href=x>A</a><li><a>B</a></ul></div>
    <div class="wrap"><div id="main-content"><article class="post has-comments"><header><h1>Title &amp; more</h1><p>by me</p></header><p>One <b>two</b>&nbsp;three<br>four<p>Five <span class="ad">buy</span> six
    <table><tr><td>a<td>b<tr><td>c</table><div class="newsletterBox">Join</div><!-- x > --><pre> code
     more </pre><script>if (a<b) "</p>"</script><section id="comments"><article class="comment"><p>nice</p></article></section></article></div><aside>side</aside></div><form><label>q</label></form><footer>f</footer> tail <b"""
    assert _text(page) == "Title & more\nOne two three four\nFive six\na\nb\nc\ncode more"
    assert _text("<p>a &lt; b<p>c<div>d<!-- open <p>e</p>") == "a < b\nc\nd"
    assert _text("<ul><li><a>x</a><li><a>y</a><li><a>z</a></ul><p>text <a>with a link</a>") == "text with a link"
    assert _text("x < y &amp; z") == "x < y & z"
    assert _text(None) == _text("") == _text("<script>a") == _text("<nav>only</nav>") == ""


def test_low_branches_go(spark):
    """A branch without telling names that a host's pages share goes, on that host only; articles that agree stay."""
    rng = random.Random(1)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    shared, rows, want = words(60), [], {}

    def add(url, body, text):
        rows.append((len(rows), url, body))
        want[len(rows) - 1] = text

    for i in range(12):
        t, p = words(4), [words(30), shared, words(25)]
        body = f"<div class='x1'><h1>{t}</h1>" + "".join(f"<p>{x}</p>" for x in p) + f"</div><div class='q7'><p>Copyright 20{i:02d} of this site</p><div>All rights {i}</div></div>"
        add(f"http://A.example.org:80/{i}", body, "\n".join([t, *p]))
        add(f"http://b{i}.example.org/", body, "\n".join([t, *p, f"Copyright 20{i:02d} of this site", f"All rights {i}"]))
    same = "<article><h1>one</h1><div class='z'><p>the same everywhere, and most of it</p></div></article>"
    for i in range(5):
        add(f"https://copies.example.org/{i}", same, "one\nthe same everywhere, and most of it")
        add(None, same, "one\nthe same everywhere, and most of it")
    add("http://a.example.org/none", None, "")
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS text")
    assert {r.page_id: r.text for r in page_text.extract(pages).collect()} == want


def test_importance(spark):
    """Entropy of presentations and contents, computed by hand."""
    rows = [(i, "http://h.example.org/", f"<section><p>{'same' if i < 3 else i}</p></section>" + "<section class=k><i class=u>" + "abcd"[i] + "</i></section>") for i in range(4)]
    parsed = spark.createDataFrame(rows, "page_id long, url string, html string").mapInArrow(page_text._parsed, page_text._PARSED)
    got = {r.node: r.worth for r in page_text.importance(parsed).collect()}
    assert sorted(round(x, 6) for x in got.values()) == [0, round(1 - math.log(3) / 2 / math.log(4), 6), 1.0]


def test_long_pages_take_linear_time():
    took = []
    for n in (20_000, 80_000):
        page = "<div>" * n + "x<p>y" + '<a "' * n + ">z</a>" + "</b>" * n + "<p class='" * n
        began = time.process_time()
        page_text.parse(page)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5


def test_empty(spark):
    assert page_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
