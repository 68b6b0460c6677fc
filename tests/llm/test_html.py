import random
import time
from html.parser import HTMLParser

import pytest

from sieveline.llm import html_extraction as H

SCHEMA = "page_id long, url string, html string, host string, text string"


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(spark, rows, limit=None):
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], SCHEMA)
    return [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)]


@pytest.mark.parametrize(("body", "text"), [
    ("<nav><a>Home</a></nav><article><h1>Title</h1><p>One  two<br>three <b>bo</b>ld.</p></article><footer>f</footer>", "Title One two three bold."),
    ("<header>h</header><main><p>A &amp; B&nbsp;c &#233; &copy;</p><form>f <input></form></main>", "A & B c é ©"),
    ("<article><p>a<p>b<b>c<p>d</article><aside>no</aside>", "a bc d"),
    ("<article><p>x</p><div class='comments'><p>reader</p></div><script>if (a<b) '</p>'</script><!-- no --><div class=ad>buy</div><p>y</p></article>", "x y"),
    ("<div id='cookie-notice'>ok</div><div class='post-content'><p>The text of it.</p><ul><li>1<li>2</ul></div><div class='sidebar'>s</div>", "The text of it. 1 2"),
    ("<article>a < b and c > d</article>", "a < b and c > d"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("", ""), ("<nav>only</nav>", ""),
])
def test_single_pages(spark, body, text):
    assert texts(spark, [("http://h.example/1", page(body))]) == [text]


STORY = "<article><h1>Title</h1><p>The story of it.</p></article>"


@pytest.mark.parametrize("html", [
    f"<body class='single no-sidebar'>{STORY}</body>", f"<body class='page has-comments search'><div>{STORY}</div></body>", f"<html class='no-js nav'><body>{STORY}</body></html>", f"<div class='layout has-sidebar'>{STORY}<div class='sidebar'>s</div></div>",
    f"<form id='aspnetForm'><div>{STORY}</div><input><button>Go</button></form>", f"<form><main>{STORY}</main></form>", "<main><section class='search-engines'><h1>Title</h1><p>The story of it.</p></section></main>", f"<div class='promo-layout'>{STORY}</div><footer>f</footer>",
    f"<div class='with-banner'><div class='share-page'>{STORY}</div><div class='content'>(c) 2024</div></div>", "<article class='related-works'><h1>Title</h1><p>The story of it.</p></article>", "<main class='menu'><h1>Title</h1><p>The story of it.</p></main>",
    "<article><div class='notice-board'><h1>Title</h1><p>The story of it.</p></div></article>", f"<div class='sidebar'>{STORY}</div><footer>f</footer>", "<main><h1>Title</h1><p>The story of it.</p></main><div class='sidebar'><article>teaser</article></div>",
    "<div><h1>Title</h1><p>The story of it.</p></div><aside><article>teaser</article></aside>", f"{STORY}<div class='comments'><article class='comment'>{'long reply ' * 50}</article></div>", f"<div class='noSidebar hideBanner'>{STORY}</div>",
])
def test_class_words_around_an_article_never_make_it_empty(html):
    assert H.main_text(html) == "Title The story of it."


def test_comments_within_an_article_go_however_long(spark):
    assert H.main_text(f"<article><p>x</p><div class='comments'><p>{'reader ' * 500}</p></div><form><p>Leave a reply</p></form></article>") == "x"


def test_wrappers_tell_template_from_slots(spark):
    rows = [("http://w.example/%d" % i, page(f"<div class=top>Our site</div><table><tr><td>Menu A</td><td><div><p>Story {i} is {'long ' * (20 + i)}.</p><p>More of {i}.</p></div><p>All rights reserved</p></td></tr></table>")) for i in range(8)]
    for i, text in enumerate(texts(spark, rows)):
        assert text == f"Story {i} is {'long ' * (20 + i)}. More of {i}."


def sentence(i, n=14):
    draw = random.Random(i)
    return " ".join("".join(draw.choice("abcdefghij") for _ in range(5)) for _ in range(n))


@pytest.mark.parametrize("fan", [1, 7])
def test_boilerplate_without_a_telling_class_or_tag(spark, fan):
    """Pages put together of known parts: what they share at one place goes, also in an article and between paragraphs; what differs stays."""
    rows, want = [], []
    for i in range(30):
        own = [sentence(100 * i + k) for k in range(2 + i % 4)]
        promo = "<section><b>Read us daily</b></section>" if i % 3 else ""
        rows.append((f"http://b.example/{i}", page(f"<article><div>By the desk</div><h1>{sentence(9000 + i, 4)}</h1><p>Please sign in to reply.</p>{promo}" + "".join(f"<p>{x}</p>" for x in own) + "<p>All of it is ours.</p></article>")))
        want.append(" ".join([sentence(9000 + i, 4), *own]))
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, (u, h) in enumerate(rows)], SCHEMA).repartition(fan)
    assert [r.text for r in sorted(H.extract(df).collect(), key=lambda r: r.page_id)] == want
    wrapper = {(r.label, r.optional, r.repeated, r.slot, r.template) for r in H.infer_wrappers(df).collect()}
    assert {("section", True, False, False, False), ("p", False, True, False, False), ("#-1", False, False, False, True), ("#1", False, False, True, False)} <= wrapper


def test_copies_and_few_pages_keep_their_texts(spark):
    same = page(f"<article><h1>Title</h1><p>{sentence(1)}</p></article>")
    rows = [("http://s.example/%d" % i, same) for i in range(8)] + [("http://f.example/%d" % i, page(f"<article><p>{sentence(i)}</p><p>Shared.</p></article>")) for i in range(4)]
    found = texts(spark, rows)
    assert found == [f"Title {sentence(1)}"] * 8 + [f"{sentence(i)} Shared." for i in range(4)]


class Plain(HTMLParser):
    """Text of articles, without inline elements' borders."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth, self.out = 0, []

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.out += [] if tag in H.INLINE else [" "]

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.out += [] if tag in H.INLINE else [" "]

    def handle_data(self, data):
        self.out += [data] if self.depth else []


def test_all_pages_equal_a_plain_parser(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: r.html for r in pages.collect()}
    for r in H.extract(pages).collect():
        plain = Plain()
        plain.feed(html[r.page_id])
        plain.close()
        assert r.text == " ".join("".join(plain.out).split()) and r.n_chars == len(r.text)


@pytest.mark.parametrize("html", ["<div>" * 100_000 + "x", "<div>" * 100_000 + "x" + "</div>" * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000 + "x", "<a '" * 50_000, "<p>x" * 50_000, "<td><th>" * 50_000 + "x", "<!--" * 100_000, "<p class='" * 50_000, "<p " * 100_000])
def test_odd_markup_stays_linear(html):
    began = time.process_time()
    assert set(H.main_text(html, frozenset({1}))) <= {"x", " "}
    H._align({}, "h", H.Page(html))
    assert time.process_time() - began < 10


def test_pages_without_the_hosts_article(spark):
    rows = [("http://m.example/%d" % i, page(f"<article>text {i}</article>")) for i in range(3)] + [("http://m.example/x", page("<div><p>other kind of page</p></div>")), ("http://m.example/y", page("<article></article><div>promise</div>"))]
    assert texts(spark, rows) == ["text 0", "text 1", "text 2", "other kind of page", ""]


def test_odd_pages(spark):
    good = page("<article>x</article>")
    rows = [(None, good), ("http://[bad", good), ("http://a.example", None), ("http://a.example", ""), ("http://a.example", "no tags at all"), ("http://a.example", "<"), ("http://b.example", good), ("http://b.example", good), ("http://c.example", page("<article>" + "<p>w</p>" * 30_000 + "</article>"))]
    found = texts(spark, rows)
    assert found[:4] == ["x", "x", "", ""] and found[6:8] == ["x", "x"] and found[8] == " ".join("w" * 30_000)
    assert H.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_joining_by_host_is_the_same(spark, monkeypatch):
    rows = [("http://h%d.example/%d" % (i % 3, i), page(f"<article>text {i}</article>")) for i in range(12)]
    want = texts(spark, rows)
    monkeypatch.setattr(H, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(H, "HELD", 2)
    assert texts(spark, rows) == want
