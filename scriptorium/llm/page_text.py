"""Main text of web pages, by a site style tree.

Each page is read into elements. Menus, headers, footers, sidebars, notices,
adverts, forms and reader comments that say what they are (by element or by
a word of their class, id or role) go at once, and where a page has an
article, only that stays. What is left of the pages of one host is merged
into a style tree: a node is the path of elements with their classes, digits
aside, below which pages agree. A node without text of its own is as important
as the entropy of its presentations (the sequences of its children), one with
text as that of its contents: 1 - log k averaged over its distinct blocks, k
being the number of pages that have the block, with the number of the node's
pages as base. A branch goes from all pages of the host if neither it nor
anything below it reaches the threshold, at least three different pages have
it, and it holds less than half of their text.

Only containers can go that way. Paragraphs, headings and the like without a
class or id are the flow of an article, so a passage that many articles share
stays.

Statistics are counts of hashed (host, node, feature, page) rows, summed before
they are shuffled, so a host with a third of all pages is dealt out. Python
reads each page once; texts are cut in the shared folder and not shuffled,
unless the table of low branches is too large for Spark to broadcast.

Cases: a null or empty page, or one without text, gives an empty text; a page
without a url, or with one that names no host, is judged by itself; equal
pages of a host count as one page; repeated rows and ids are answered row by
row; a page of any length is read whole, in linear time; elements nested
deeper than 512 count as lying side by side there, their text stays; unclosed
comments, scripts and tags end with the page; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import cut, prepare

#: Branches of a host whose importance stays below this are low.
THRESHOLD = 0.2
#: A host's branch is judged by this many different pages or more.
PAGES = 3

_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_FLOW = frozenset("address blockquote center dd dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary table tbody td tfoot th thead tr ul caption details".split())
_CONTAINERS = frozenset("html body main article section div aside nav header footer form dialog menu template".split())
_BLOCKS = _FLOW | _CONTAINERS
_AROUND_P = _CONTAINERS | {"td", "th", "li", "dd", "button", "table", "blockquote", "figure"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the key closes an open element of the first kinds, unless one of the second lies between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
#: Elements that never hold an article's text.
_DROP = frozenset("nav aside footer form dialog template button select svg math object canvas audio video map menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of a class or id that say what an element is for.
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promoted promotion nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs header masthead topbar footer colophon sidebar sidebars "
    "aside widget widgets cookie cookies consent gdpr notice notices notification notifications banner banners popup popups modal overlay newsletter subscribe subscription signup signin login share sharing sharebar social comment comments commentlist discussion "
    "disqus reply replies respond responses related recommended recommendations pagination pager toolbar skip skiplink paywall".split()
)
_HEADS = frozenset(("header", "masthead"))
_COMMENTS = frozenset(("comment", "comments", "reply"))
_LAYOUT = frozenset(("has", "with", "no", "without"))
_MAIN = re.compile(r"^(?:.*[_-])?(?:article|post|entry|story)[_-]?(?:body|content|text)$|^(?:main[_-]?)?content$|^main$", re.I)
_OPENS = re.compile(r"<[a-zA-Z/!?]")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_DIGITS = re.compile(r"\d+")
_LETTER = re.compile(r"\w")
_DEPTH = 512


@functools.lru_cache(100_000)
def _style(up: int, key: str) -> int:
    """The node of elements with this key below that node."""
    return _hash(up, key)


def _hash(*parts) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


class _Element:
    """An open element: its style node, whether its text goes, and the container of main text that it belongs to."""

    __slots__ = ("tag", "up", "label", "key", "node", "depth", "shape", "flows", "gone", "titles", "rank", "root")

    def __init__(self, tag: str = "", up: _Element | None = None, label: str = ""):
        self.tag, self.up, self.label = tag, up, label
        self.key, self.node, self.depth, self.shape, self.flows, self.gone, self.titles, self.rank, self.root = "", 0, 0, [], True, False, False, 0, None


def _words(label: str) -> list[str]:
    return [w.lower() for w in _SPLIT.split(label) if w]


def _says(tag: str, labels: str) -> bool:
    """Whether a class or id names a part that is no article: by its first or last word. "with-sidebar" and the like describe a layout."""
    known = _COMMENTS if tag == "article" else _WORDS
    for words in map(_words, labels.split()):
        if words and not _LAYOUT & set(words) and (words[0] in known or words[-1] in known) and not (tag in _HEADINGS and words[-1] in ("header", "banner")):
            return True
    return False


class _Page:
    """One page's blocks in order, as (element, text, how many links, whether all is linked)."""

    def __init__(self, html: str):
        self.blocks: list[tuple[_Element, str, int, bool]] = []
        self.text: list[str] = []
        self.links, self.bare = 0, False
        self.top = _Element()
        self.open: dict[str, int] = {}
        self.read(html)

    def end_block(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            self.text = []
            if text:
                at = self.top
                while at.tag not in _BLOCKS and at.up is not None:
                    at = at.up
                self.blocks.append((at, text, self.links, self.links > 0 and not self.bare))
        self.links, self.bare = 0, False

    def add(self, text: str) -> None:
        top = self.top
        if text and not top.gone and not (top.titles and not any(self.open.get(h) for h in _HEADINGS)):
            self.text.append(text)
            if not self.bare and not self.open.get("a") and _LETTER.search(text):
                self.bare = True

    def push(self, tag: str, attributes: str) -> None:
        found: dict[str, str] = {}
        if attributes:
            for m in _ATTRIBUTE.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        label = unescape(f"{found.get('class', '')} {found.get('id', '')}").strip() if found else ""
        role = found.get("role", "").lower().strip()
        up, e = self.top, _Element(tag, self.top, label)
        e.gone, e.titles, e.rank, e.root = up.gone, up.titles, up.rank, up.root
        if tag == "a":
            self.links += 1
        if tag not in ("html", "body"):
            words = set(_words(label)) if label else frozenset()
            if up.rank and (tag == "header" or words & _HEADS and not words & (_WORDS - _HEADS)):
                e.titles = True  # an article's own header keeps its title
            elif tag == "header" or tag in _DROP or role in _ROLES or tag != "main" and label and _says(tag, label):
                e.gone = True
            if not e.gone:
                rank = 3 if tag == "article" or found.get("itemprop", "").lower() == "articlebody" else 2 if tag == "main" or role == "main" else 1 if label and any(_MAIN.search(x) for x in label.split()) else 0
                if rank > e.rank:
                    e.rank, e.root = rank, e
        e.key, e.node, e.depth, e.shape, e.flows = up.key, up.node, up.depth, up.shape, up.flows
        if tag in _BLOCKS:
            key = tag + "".join(f".{w}" for w in sorted({_DIGITS.sub("#", w) for w in label.split()})) if label else tag
            # Equal elements nested in each other are one style, and so is what lies too deep.
            if key != up.key and up.depth < _DEPTH:
                e.key, e.node, e.depth, e.shape, e.flows = key, _style(up.node, key), up.depth + 1, [], tag in _FLOW and not label
                if not e.gone and up.shape[-1:] != [key]:
                    up.shape.append(key)
        self.open[tag] = self.open.get(tag, 0) + 1
        self.top = e

    def pop(self) -> None:
        self.open[self.top.tag] -= 1
        self.top = self.top.up

    def close(self, tags: set[str], stop: set[str] | frozenset[str]) -> None:
        """Close the nearest open element of these kinds, and what lies in it, unless one of `stop` is nearer."""
        if any(self.open.get(t) for t in tags):
            at = self.top
            while at.up is not None and at.tag not in tags and at.tag not in stop:
                at = at.up
            if at.tag in tags:
                while self.top is not at:
                    self.pop()
                self.pop()

    def read(self, html: str) -> None:
        # Nothing after the last ">" can be a whole tag.
        end = html.rfind(">") + 1
        at = 0
        while (m := _TAG.search(html, at, end)) is not None:
            self.add(html[at : m.start()])
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith(">"):
                at = len(html)
            tag, attributes = (m[2] or m[5] or "").lower(), (m[3] if m[2] else m[6]) or ""
            if tag and (m[1] or m[4]):
                self.end_tag(tag)
            elif tag:
                at = self.start_tag(tag, attributes, html, at)
        cut_off = _OPENS.search(html, max(at, end))
        self.add(html[at : cut_off.start() if cut_off else len(html)])
        self.end_block()

    def start_tag(self, tag: str, attributes: str, html: str, at: int) -> int:
        if tag in _RAW:
            shut = _RAW[tag].search(html, at)
            return shut.end() if shut else len(html)
        if tag == "br":
            self.add(" ")
        if tag in _BLOCKS or tag in _CLOSES:
            self.end_block()
        if tag in _BLOCKS:
            self.close({"p"}, _AROUND_P)
        if tag in _CLOSES:
            self.close(*_CLOSES[tag])
        if tag not in _VOID and (tag in _BLOCKS or not attributes.endswith("/")):
            self.push(tag, attributes)
        return at

    def end_tag(self, tag: str) -> None:
        if tag in _BLOCKS:
            self.end_block()
        self.close({tag}, frozenset() if tag in _BLOCKS else _CONTAINERS)

    def kept(self) -> list[tuple[_Element, str]]:
        """Blocks of the main text: of the containers of the highest rank, or of the page where it has none, without its lists of links."""
        best = max((b[0].rank for b in self.blocks), default=0)
        if best:
            return [(e, text) for e, text, *_ in self.blocks if e.rank == best]
        lists: dict[int, list[tuple[int, bool]]] = {}
        inside = []
        for e, _, links, linked in self.blocks:
            at, over = e, None
            while at.up is not None:
                over = at if at.tag in ("ul", "ol", "dl", "table") else over
                at = at.up
            inside.append(id(over or e))
            lists.setdefault(inside[-1], []).append((links, linked))
        menus = {k for k, rows in lists.items() if all(linked for _, linked in rows) and sum(n for n, _ in rows) >= 3}
        return [(b[0], b[1]) for b, k in zip(self.blocks, inside, strict=True) if k not in menus]


def _host(url: str | None) -> str | None:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", url or "")
    host = m[1].rpartition("@")[2].lower() if m else ""
    return re.sub(r":\d*$", "", host) or None


def parse(html: str | None) -> tuple[list[tuple[str, list[int]]], list[tuple[int, int, int, int, list[int]]], list[int]]:
    """(blocks with their nodes from the top, facts (node, kind, feature, chars, nodes from the top), nodes that may go).

    Kinds of facts: 0 a presentation of the node, 1 a content, 2 the node
    itself with the length of its text.
    """
    kept = _Page(html or "").kept()
    best = max((e.rank for e, _ in kept), default=0)
    paths: dict[int, list[int]] = {0: []}
    blocks, facts, chars, around, loose = [], set(), {}, {}, set()
    for e, text in kept:
        at = e
        chain = []
        while at.up is not None and id(at) not in around:
            around[id(at)] = at
            chain.append(at)
            at = at.up
        for x in reversed(chain):
            paths.setdefault(x.node, [*paths[x.up.node], x.node])
        blocks.append((text, paths[e.node]))
        facts.add((e.node, 1, _hash(_DIGITS.sub("#", text.lower()))))
        for n in paths[e.node]:
            chars[n] = chars.get(n, 0) + len(text)
    texts = {e.node for e, _ in kept}
    for e in around.values():
        if e.node not in texts:
            facts.add((e.node, 0, _hash(*e.shape)))
        if not e.flows and e.tag not in ("html", "body") and (not best or e.rank == best and e.root is not e):
            loose.add(e.node)
    rows = [(n, kind, feature, 0, []) for n, kind, feature in facts if n] + [(n, 2, 0, c, paths[n]) for n, c in chars.items()]
    return blocks, rows, sorted(loose)


_BIG = pa.int64()
_FIELDS = {
    "page_id": _BIG, "url": pa.string(), "host": pa.string(), "digest": _BIG, "total": _BIG, "blocks": pa.list_(pa.struct([("text", pa.string()), ("nodes", pa.list_(_BIG))])),
    "facts": pa.list_(pa.struct([("node", _BIG), ("kind", pa.int32()), ("feature", _BIG), ("chars", _BIG), ("path", pa.list_(_BIG))])), "loose": pa.list_(_BIG), "template": _BIG,
}
_PARSED = "page_id long, url string, host string, digest long, total long, blocks array<struct<text: string, nodes: array<long>>>, facts array<struct<node: long, kind: int, feature: long, chars: long, path: array<long>>>, loose array<long>, template long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        # Few pages at a time: their facts are larger than they are.
        for at in range(0, batch.num_rows, 200):
            rows = []
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                blocks, facts, loose = parse(html)
                host = _host(url)
                rows.append({
                    "page_id": page_id, "url": url, "host": host, "digest": _hash(*[t for t, _ in blocks]), "total": sum(len(t) for t, _ in blocks), "blocks": [{"text": t, "nodes": p} for t, p in blocks],
                    "facts": [dict(zip(("node", "kind", "feature", "chars", "path"), f, strict=True)) for f in facts] if host else [], "loose": loose, "template": _hash(*loose) if host and loose else None,
                })
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(_FIELDS))


def importance(parsed: DataFrame) -> DataFrame:
    """(host, node, path, share, worth): the merged tree of each host; share is the node's part of the text of the pages that have it."""
    facts = parsed.where(F.size("facts") > 0).select("host", "digest", "total", F.explode("facts").alias("f")).select("host", "digest", "total", "f.*")
    once = facts.groupBy("host", "node", "kind", "feature", "digest").agg(F.max("chars").alias("chars"), F.max("total").alias("total"), F.max("path").alias("path"))
    counts = once.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"), F.sum("total").alias("total"), F.max("path").alias("path"))
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    log = F.log("k")
    nodes = counts.groupBy("host", "node").agg(
        F.max(of(2, F.col("k"))).alias("m"), F.max(of(2, F.col("path"))).alias("path"), F.max(of(2, F.col("chars") / F.col("total"))).alias("share"),
        F.sum(of(0, F.col("k"))).alias("shown"), F.sum(of(0, F.col("k") * log)).alias("k_log_k"), F.sum(of(1, F.lit(1))).alias("contents"), F.sum(of(1, log)).alias("logs"),
    )
    base = F.log("m")
    shape = (F.log("shown") - F.col("k_log_k") / F.col("shown")) / base
    content = 1 - F.col("logs") / F.col("contents") / base
    worth = F.when(F.col("m") < PAGES, 1.0).otherwise(F.greatest(F.coalesce(shape, F.lit(0.0)), F.coalesce(content, F.lit(0.0))))
    return nodes.select("host", "node", "path", "share", worth.alias("worth"))


def _low_branches(parsed: DataFrame) -> DataFrame:
    """(host, node) of the branches that go."""
    judged = importance(parsed)
    branch = judged.select("host", F.explode("path").alias("node"), "worth").groupBy("host", "node").agg(F.max("worth").alias("worth"))
    return branch.where(F.col("worth") < THRESHOLD).join(judged.where("share < 0.5").select("host", "node"), ["host", "node"], "left_semi").select("host", "node")


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    prepare(pages.sparkSession)
    read = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    parsed = cut(read.mapInArrow(_parsed, _PARSED), "zstd")
    low = cut(_low_branches(parsed))
    # Pages with the same containers are one template; what goes from it is found once.
    templates = parsed.where("template is not null").groupBy("host", "template").agg(F.first("loose").alias("loose"))
    hit = templates.select("host", "template", F.explode("loose").alias("node")).join(low, ["host", "node"])
    gone = cut(hit.groupBy("host", "template").agg(F.collect_set("node").alias("gone")))
    judged = parsed.select("page_id", "url", "host", "template", "blocks").join(gone, ["host", "template"], "left")
    stays = F.filter("blocks", lambda b: F.col("gone").isNull() | ~F.arrays_overlap(b["nodes"], F.col("gone")))
    out = judged.select("page_id", "url", F.array_join(F.transform(stays, lambda b: b["text"]), "\n").alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
