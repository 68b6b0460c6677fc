"""HTML main text by wrappers that are inferred from the pages of each host.

A page is a stream of tokens: open tags (labelled by tag, class and id), close tags and texts. The streams of a host are aligned into one
expression without unions. An open tag is aligned by its label below what its parent was aligned with; the mismatches are resolved so: a label that comes again
below the same parent goes back to where it was, which makes what lies between a repeated group; a label that some streams lack is optional; the
texts at a place either agree in all streams, then they are template, or they are a slot. In a repeated group texts are aligned from its
front and from its end, so a notice before or behind the paragraphs is told from them. An alignment is sums, minima and maxima over places, so the
streams may be aligned in any order, a partition at a time: the result doesn't depend on how pages are dealt out, and no task holds a host.

Template text goes wherever it stands, also within an article. It is what at least LEAST_PAGES pages and half of the pages of a host have at one place, if it is
the same on all that have the place; where it would be more than half of a host's text, the pages are copies of one another, and it stays.
What is left is cut by the page's own tree: the article, main element or content class less menus, forms, notices and the like by tag and
class words, else the element below which most of the unlinked text lies. Class words are guesses, so none of them makes a page empty: where the text of a kind of element would be, only whole
class names of such words count in a second look, and in a last one, after all other kinds, no class words; from the second look on forms may hold text too. An article that has no text at all is an
empty one.

Null html is empty; a null url is a host of its own. Empty pages have empty text. Elements may be nested and left open at will. Repeated rows give repeated
rows and count as often in alignments; a null page_id stays null; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import Remembered, map_rows, materialize

SCHEMA = "page_id long, url string, text string, n_chars long"
#: Bytes of template places of all hosts that are broadcast; beyond, they are joined by host.
BROADCAST_BYTES = 32_000_000
#: Places that a task holds before it passes them on.
HELD = 100_000
#: Pages of a host that must have a text at one place before it can be template.
LEAST_PAGES = 5
#: Texts that are aligned from the front and from the end of a repeated group.
ENDS = 2

# Elements by what they are.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
DROPPED = {"head", "nav", "footer", "aside", "form", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "select", "button", "textarea", "dialog", "menu", "title", "audio", "video", "datalist"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "blockquote", "aside", "nav", "form"}
# Words in class, id and role of what is no main text, and of what is.
BOILERPLATE = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "complementary", "contentinfo", "dialog", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
CONTENT = {"article", "content", "entry", "post", "story", "main", "body", "text"}

HAS = re.compile(r"(?:no|not|non|has|have|with|without|hide|hides)(?:[-_]|(?=[A-Z]))")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|textarea|iframe|title|svg|select)\b(?P<rawattrs>[^>]*)>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<tag>/?[a-zA-Z][^\s/>"'<]*+)(?P<attrs>(?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/a-zA-Z][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)""", re.DOTALL | re.IGNORECASE)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _label(tag: str, attrs: str) -> tuple[str, bool]:
    """tag, then class, id and role words without digits, `!` for hidden elements; and whether a class name has no other words than those of boilerplate."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return tag, False
    words, hidden, whole = [], "", False
    for name, a, b, c in ATTRIBUTE.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            # What a page has, or hasn't, isn't what an element is.
            for own in ([w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", n)] for n in value.split() if not HAS.match(n)):
                words += own
                whole |= bool(own) and BOILERPLATE.issuperset(own)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
            hidden = "!"
    return ".".join([tag, *sorted(set(words))]) + hidden, whole


_labels = Remembered(lambda key: _label(*key), 20_000)
_below = Remembered(lambda key: xxhash.xxh3_64_intdigest(f"{key[0]} {key[1]}"), 50_000)


class Page:
    """A page's elements in the order of their open tags, and its texts.

    tags, labels, parents: of each element; 0 is the page. tokens: (element, text) in page order, where a text of None is a border of a block.
    """

    def __init__(self, html: str) -> None:
        self.tags, self.labels, self.parents, self.whole = [""], [""], [-1], [False]
        self.tokens: list[tuple[int, str | None]] = []
        stack = [0]
        opened: dict[str, list[int]] = {}  # places in the stack by tag
        scopes = [0]  # places in the stack of elements that end tags don't reach beyond

        def close_from(at: int) -> None:
            while len(stack) > at:
                tag = self.tags[stack.pop()]
                opened[tag].pop()
                if scopes[-1] == len(stack):
                    scopes.pop()
                if tag not in INLINE:
                    self.tokens.append((0, None))

        for m in TOKEN.finditer(html):
            text = m["text"]
            if text is not None:
                self.tokens.append((stack[-1], text))
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if tag[0] == "/":
                tag = tag[1:]
                if (places := opened.get(tag)) and (tag not in INLINE or places[-1] >= scopes[-1]):
                    close_from(places[-1])
                elif tag not in INLINE:
                    self.tokens.append((0, None))
                continue
            closes = CLOSES_SAME.get(tag) or (("p",) if tag in CLOSES_P else ())
            at = max((opened[t][-1] for t in closes if opened.get(t)), default=-1)
            if at >= scopes[-1] and at > 0:
                close_from(at)
            self.tags.append(tag)
            label, whole = _labels[tag, m["attrs"]]
            self.labels.append(label)
            self.whole.append(whole)
            self.parents.append(stack[-1])
            if tag not in INLINE:
                self.tokens.append((0, None))
            if tag not in VOID and not m["attrs"].endswith("/"):
                opened.setdefault(tag, []).append(len(stack))
                if tag in SCOPES:
                    scopes.append(len(stack))
                stack.append(len(self.tags) - 1)
        own: dict[int, list[str]] = {}
        for at, (i, text) in enumerate(self.tokens):
            if text is not None:
                if "&" in text:
                    text = entities.unescape(text)
                    self.tokens[at] = i, text
                own.setdefault(i, []).append(text)
        #: The text of each element that has some of its own, white space as single spaces.
        self.texts = {i: t for i in sorted(own) if (t := " ".join("".join(own[i]).split()))}

    def __len__(self) -> int:
        return len(self.tags)

    def passed_down(self, own) -> list[bool]:
        """For each element whether own(element) holds for it or for one that it lies in."""
        out: list[bool] = []
        for i, parent in enumerate(self.parents):
            out.append((parent >= 0 and out[parent]) or own(i))
        return out

    def places(self) -> list[int]:
        """Where each element is in its host's expression."""
        out = [0]
        for i in range(1, len(self)):
            out.append(_below[out[self.parents[i]], self.labels[i]])
        return out

    def aligned_texts(self, places: list[int]) -> list[tuple[int, dict[str, int]]]:
        """Each element with text that is aligned, and the labels and places of its text: among its place's texts from the front, and from the end."""
        by_place: dict[int, list[int]] = {}
        for i in self.texts:
            by_place.setdefault(places[i], []).append(i)
        found = []
        for place, own in by_place.items():
            n = len(own)
            for k in range(min(n, 2 * ENDS)) if n < 2 * ENDS else (*range(ENDS), *range(n - ENDS, n)):
                found.append((own[k], {f"#{e}": _below[place, f"#{e}"] for e in (k, k - n) if -ENDS <= e < ENDS}))
        return found


def _dropped(label: str, in_region: bool, look: int = 0, whole: bool = False) -> bool:
    """Whether an element is no main text. look: 0 for the first one, in which any class word counts; 1, in which only whole class names do; 2, in which none does."""
    tag, _, words = label.rstrip("!").partition(".")
    if label.endswith("!") or tag in DROPPED and not (look and tag == "form") or tag == "header" and not in_region:
        return True
    if look == 2 or look == 1 and not whole or tag in ("html", "body"):
        return False
    words = set(words.split("."))
    return bool(words & BOILERPLATE) and not (tag in ("article", "main") and words & CONTENT)


_out = Remembered(lambda label: (_dropped(label, False), _dropped(label, True)), 20_000)
_out_later = Remembered(lambda key: (_dropped(key[0], False, *key[1:]), _dropped(key[0], True, *key[1:])), 20_000)


def _is_article(tag: str, words: set[str]) -> bool:
    return tag == "article"


def _is_main(tag: str, words: set[str]) -> bool:
    return tag == "main" or "main" in words and tag in ("div", "section")


def _is_content(tag: str, words: set[str]) -> bool:
    return bool(words & CONTENT) and tag in ("div", "section", "td")


#: Kinds of elements, with how closely class words are looked at, in the order in which they are tried; None is the element that most of the text lies below.
TRIED = [(_is_article, 0), (_is_article, 1), (_is_main, 0), (_is_main, 1), (_is_content, 0), (_is_content, 1), (None, 0), (_is_article, 2), (_is_main, 2), (_is_content, 2), (None, 1), (None, 2)]


def main_text(html: str, template: frozenset | set = frozenset()) -> str:
    """The page's main text: blocks in page order, joined by a space. template: places of its host's template texts."""
    page = Page(html)
    texts, gone = page.texts, set()
    if template:
        gone = {i for i, keys in page.aligned_texts(page.places()) if not template.isdisjoint(keys.values())}
        texts = {i: t for i, t in texts.items() if i not in gone}
    if "article" in page.tags:
        within = page.passed_down(lambda i: page.tags[i] == "article")
        if not any(within[i] for i in page.texts):
            return ""
    linked = page.passed_down(lambda i: page.tags[i] == "a")
    for wanted, look in TRIED:
        if found := _text_of(page, texts, gone, linked, wanted, look, bool(template)):
            return found
    return ""


def _text_of(page: Page, texts: dict[int, str], gone: set[int], linked: list[bool], wanted, look: int, template: bool) -> str:
    out = [_out_later[label, look, whole] for label, whole in zip(page.labels, page.whole, strict=True)] if look else [_out[label] for label in page.labels]
    outside = page.passed_down(lambda i: out[i][0])
    # Characters of unlinked text at and below an element, less what is dropped.
    mass = [0] * len(page)
    for i, t in texts.items():
        if not linked[i]:
            mass[i] = len(t)
    for i in range(len(page) - 1, 0, -1):
        if not out[i][1]:
            mass[page.parents[i]] += mass[i]
    if wanted is None:
        region = {_densest(page, mass, out)}
        if template:  # lists of links
            times = Counter(own := page.places())
            gone = gone | {i for i in texts if linked[i] and times[own[i]] > 2}
    else:
        region = {i for i in range(1, len(page)) if not outside[i] and mass[i] and wanted(page.tags[i], set(page.labels[i].split(".")[1:]))}
        if not region:
            return ""
    inside, dropped = [False] * len(page), [False] * len(page)
    for i, parent in enumerate(page.parents):
        below = parent >= 0 and inside[parent]
        inside[i] = below or i in region
        dropped[i] = parent >= 0 and dropped[parent] or below and out[i][1]
    pieces = [" " if text is None else text for i, text in page.tokens if text is None or inside[i] and not dropped[i] and i not in gone]
    return " ".join("".join(pieces).split())


def _densest(page: Page, mass: list[int], out: list[tuple[bool, bool]]) -> int:
    """Down from the page while one child has most of the text."""
    found = 0
    for i in range(1, len(page)):
        if page.parents[i] == found and mass[i] > 0.6 * mass[found] and page.tags[i] != "p" and page.tags[i] not in INLINE and not out[i][0]:
            found = i
    return found


def _expressions(pages: DataFrame) -> DataFrame:
    """The places of each host's expression with their figures, and whether they are template."""

    def make():
        held: dict[tuple, list] = {}

        def step(batch):
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                if html:
                    _align(held, host_of(url), Page(html))
            return last() if len(held) > HELD else None

        def last():
            if not held:
                return None
            columns = list(map(list, zip(*((*key, *figures) for key, figures in held.items()), strict=True)))
            held.clear()
            return dict(zip(names, columns, strict=True))

        step.last = last
        return step

    names = ["host", "place", "parent", "label", "pages", "times", "least", "most", "chars"]
    found = map_rows(pages, ["url", "html"], make, "host string, place long, parent long, label string, pages long, times long, least long, most long, chars long", text="html")
    # A host of very many pages comes as a row for each place and task.
    places = found.groupBy("host", "place").agg(*(F.min(c).alias(c) for c in ("parent", "label", "least")), F.max("most").alias("most"), *(F.sum(c).alias(c) for c in ("pages", "times", "chars")))
    places = materialize(places, "places")
    of_host = places.where("place = 0").select("host", F.col("pages").alias("host_pages"), F.col("chars").alias("host_chars"))
    agrees = F.col("label").startswith("#") & (F.col("least") == F.col("most")) & (F.col("pages") >= LEAST_PAGES) & (2 * F.col("pages") >= F.col("host_pages"))
    told = places.join(of_host, "host").withColumn("agrees", agrees)
    share = told.where("agrees").groupBy("host").agg(F.sum("chars").alias("agreed"))
    return told.join(share, "host", "left").withColumn("template", F.col("agrees") & (2 * F.coalesce("agreed", F.lit(0)) <= F.col("host_chars")))


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, place, parent, label, pages, optional, repeated, slot, template of each place of each host's expression.

    A text's label is #0, #1 (from the front) or #-1, #-2 (from the end of its group); slot says whether it differs between pages. The row of place 0 counts the host's pages.
    """
    places = _expressions(pages)
    above = places.select("host", F.col("place").alias("parent"), F.col("pages").alias("parent_pages"))
    slot = F.col("label").startswith("#") & (F.col("least") != F.col("most"))
    return places.join(above, ["host", "parent"], "left").select("host", "place", "parent", "label", "pages", (F.col("pages") < F.col("parent_pages")).alias("optional"), (F.col("times") > F.col("pages")).alias("repeated"), slot.alias("slot"), "template")


def _align(held: dict[tuple, list], host: str, page: Page) -> None:
    """The page's stream aligned with its host's expression so far, whose places are in held: pages, times, least and greatest hash of a text, characters."""
    places = page.places()
    outside = page.passed_down(lambda i: _out[page.labels[i]][0])
    rows: dict[tuple, list] = {(host, 0, 0, ""): [1, 1, 0, 0, sum(len(t) for i, t in page.texts.items() if not outside[i])]}
    for i in range(1, len(page)):
        key = host, _signed(places[i]), _signed(places[page.parents[i]]), page.labels[i]
        if key in rows:
            rows[key][1] += 1
        else:
            rows[key] = [1, 1, 0, 0, 0]
    for i, keys in page.aligned_texts(places):
        text = page.texts[i]
        hashed, chars = _signed(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))), 0 if outside[i] else len(text)
        for label, k in keys.items():
            rows[host, _signed(k), _signed(places[i]), label] = [1, 1, hashed, hashed, chars]
            chars = 0  # a text counts once, however it is aligned
    for key, own in rows.items():
        if key in held:
            old = held[key]
            held[key] = [old[0] + own[0], old[1] + own[1], min(old[2], own[2]), max(old[3], own[3]), old[4] + own[4]]
        else:
            held[key] = own


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages."""
    spark = pages.sparkSession
    # A host has no more template places than half of its pages have on average.
    template = _expressions(pages).where("template").groupBy("host").agg(F.collect_list("place").alias("places"))
    template = materialize(template, "templates")
    size = template.agg(F.sum(F.octet_length("host") + 64 * F.size("places") + 200).alias("b")).first()["b"] or 0
    sent = spark.sparkContext.broadcast({r["host"]: frozenset(x % (1 << 64) for x in r["places"]) for r in template.collect()} if size <= BROADCAST_BYTES else None)

    def make():
        known = sent.value

        def step(batch):
            urls, htmls = batch.column("url"), batch.column("html").to_pylist()
            if known is not None:
                own = [known.get(host_of(u), frozenset()) for u in urls.to_pylist()]
            else:
                own = [{x % (1 << 64) for x in p or ()} for p in batch.column("places").to_pylist()]
            texts = [main_text(h, t) if h else "" for h, t in zip(htmls, own, strict=True)]
            return {"page_id": batch.column("page_id"), "url": urls, "text": texts, "n_chars": [len(t) for t in texts]}

        return step

    if sent.value is not None:
        return map_rows(pages, ["page_id", "url", "html"], make, SCHEMA, text="html")
    hosts = map_rows(pages, ["page_id", "url", "html"], lambda: lambda b: {c: b.column(c) for c in ("page_id", "url", "html")} | {"host": [host_of(u) for u in b.column("url").to_pylist()]}, "page_id long, url string, html string, host string", text="html")
    return map_rows(hosts.join(template, "host", "left"), ["page_id", "url", "html", "places"], make, SCHEMA, text="html")
