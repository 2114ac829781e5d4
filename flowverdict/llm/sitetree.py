"""Main text of web pages by site style trees (Yi, Liu and Li, 2003).

The DOMs of all pages of a host are merged: an element node is a path of tags and classes, with
the presentation styles (sequences of children) and the contents that pages have there. A node
where pages differ is important, one that looks and reads the same everywhere is not: the
importance of a node is the entropy of its styles, that of content one minus the mean entropy
with which a text spreads over pages, and both are combined up the tree of each page.

Branches of low importance are removed from a page, as are elements whose names say that they
are menus, adverts, notices, forms, comments and the like. Two things are never judged by
entropy: what lies in an ``article`` or ``main`` element, since many pages may hold the same
article, and branches that hold such an element. A page that would lose everything keeps what
its names allow.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, table
from .registry import query

GAMMA, LEAST = 0.9, 0.25
TREE_ROWS = 200_000  # nodes of all hosts up to which they are sent to all tasks

# Element names of HTML and the words by which pages name what is not content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend li optgroup option summary tbody td tfoot th thead tr dd dt".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tr": ("tr", "td", "th"),
            "td": ("td", "th"), "th": ("td", "th"), "thead": ("tbody", "tr", "td"), "tbody": ("thead", "tbody", "tr", "td", "th"),
            "tfoot": ("tbody", "tr", "td", "th")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "tr": ("table",),
          "td": ("table",), "th": ("table",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",)}
NEVER = frozenset(
    "aside audio button canvas datalist dialog embed footer form head iframe input map menu nav noscript "
    "object script select style svg template textarea title video".split())
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "subscription signup login menu menus nav navbar navigation breadcrumb breadcrumbs sidebar aside widget "
    "widgets footer masthead topbar toolbar comment comments disqus respond reply replies related recommended "
    "recommendations share sharing social pagination pager search".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
KEPT = frozenset(("article", "main"))


@lru_cache(4096)
def _signature(tag: str, names: str) -> str:
    return ".".join([tag, *sorted(set(re.sub(r"\d+", "", names).lower().split()))])


@lru_cache(4096)
def _words(*names: str) -> frozenset[str]:
    return frozenset(re.split(r"[^a-z]+", " ".join(names).lower()))


class Element:
    __slots__ = ("tag", "attrs", "parent", "parts", "path", "kept", "holds_kept", "signature")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.signature = _signature(tag, attrs["class"]) if "class" in attrs else tag
        self.path = zlib.crc32(self.signature.encode(), parent.path) if parent else 0
        self.kept = tag in KEPT or (parent is not None and parent.kept) or attrs.get("role") == "main"
        self.holds_kept = False

    def named_noise(self) -> bool:
        """Whether its tag, role, class or id says that it is not content."""
        if self.tag in NEVER or "hidden" in self.attrs or (self.attrs.get("role") or "").lower() in ROLES:
            return True
        if self.tag == "header" and not self.kept:
            return not self.holds_kept
        if self.holds_kept or self.tag in ("html", "body"):
            return False
        if "class" not in self.attrs and "id" not in self.attrs:
            return False
        words = _words(self.attrs.get("class", ""), self.attrs.get("id", ""))
        if "header" in words and not self.kept:
            return True
        return not NOISE.isdisjoint(words)


class Dom(HTMLParser):
    """Tree of a page; missing end tags are supplied where HTML lets them be left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {}, None)
        self.open, self.elements = [self.root], [self.root]
        self.feed(re.sub(r"<!\[(?!CDATA\[)[^>]*>", "", html) if "<![" in html else html)
        self.close()
        for e in self.elements:
            if e.tag in KEPT or e.attrs.get("role") == "main":
                up = e.parent
                while up is not None and not up.holds_kept:
                    up.holds_kept = True
                    up = up.parent

    def _close(self, tags: tuple[str, ...], scope: tuple[str, ...]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._close(("p",), ("article", "section", "div", "td", "th", "li", "main", "body", "button", "blockquote"))
        if tag in SIBLINGS:
            for _ in range(3):
                self._close(SIBLINGS[tag], SCOPES[tag])
        parent = self.open[-1]
        e = Element(tag, {k: v or "" for k, v in attrs}, parent)
        parent.parts.append(e)
        self.elements.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # "/>" does not close an HTML element

    def handle_endtag(self, tag: str) -> None:
        self._close((tag,), ())

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return zlib.crc32(data) << 32 | zlib.crc32(data[::-1])


def observations(dom: Dom) -> Iterator[tuple[int, bool, int]]:
    """(path, is content, value) of a page: each style and each text once for a path."""
    styles: dict[int, set[str]] = {}
    for e in dom.elements:
        children = [p.signature for p in e.parts if isinstance(p, Element)]
        style = "|".join(s for s, before in zip(children, ["", *children]) if s != before)
        styles.setdefault(e.path, set()).add(style)
    for path, found in styles.items():
        yield path, False, _hash("\n".join(sorted(found)))
    texts = {(e.path, " ".join(p.split())) for e in dom.elements for p in e.parts if isinstance(p, str)}
    for path, text in texts:
        if text:
            yield path, True, _hash(text)


def _importance(dom: Dom, tree: dict[int, tuple[float, float | None]]) -> dict[int, float]:
    """Composite importance of every element of a page (by ``id``); nodes unknown to the tree
    were met on one page only and are important."""
    out: dict[int, float] = {}
    for e in reversed(dom.elements):
        node, content = tree.get(e.path, (1.0, 1.0))
        below = [out[id(p)] for p in e.parts if isinstance(p, Element) and (p.parts or p.tag not in VOID)]
        if any(isinstance(p, str) and not p.isspace() for p in e.parts):
            below.append(1.0 if content is None else content)
        out[id(e)] = node if not below else (1 - GAMMA) * node + GAMMA * sum(below) / len(below)
    return out


def _blocks(dom: Dom, dropped: set[int]) -> list[str]:
    blocks, run = [], []

    def end_block() -> None:
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [dom.root]
    while stack:
        part = stack.pop()
        if part is None:
            end_block()
        elif isinstance(part, str):
            run.append(part)
        elif id(part) not in dropped:
            if part.tag in BLOCK:
                end_block()
                stack.append(None)
            elif part.tag in ("br", "wbr"):
                run.append(" " * (part.tag == "br"))
            stack += reversed(part.parts)
    end_block()
    return blocks


def main_text(html: str | None, tree: dict[int, tuple[float, float | None]]) -> str:
    """Text of a page without its low-importance branches, one line for each block."""
    if not html:
        return ""
    dom = Dom(html)
    named = {id(e) for e in dom.elements if e.named_noise()}
    landmark = dom.root.holds_kept
    dropped = set(named)
    if tree:
        worth = _importance(dom, tree)
        dropped |= {id(e) for e in dom.elements if e.parent is not None and not e.kept
                    and not e.holds_kept and e.tag not in ("html", "body") and worth[id(e)] < LEAST}
    blocks = _blocks(dom, dropped)
    if not blocks and not landmark:
        blocks = _blocks(dom, named)
    return "\n".join(blocks)


def _host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_trees(pages: DataFrame) -> DataFrame:
    """``(host, path, node, content)``: importance of every node that several pages of a host
    have; ``content`` is NULL for a node without text. ``pages``: ``(host, html)``.

    Pages are reduced to counts in the tasks that parse them; a very large host only makes
    larger counts.
    """

    def observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if html:
                    seen.update((host, *x) for x in observations(Dom(html)))
            columns = list(zip(*((*key, n) for key, n in seen.items()))) or [()] * 5
            kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            signed = [x - (1 << 64) if x >= 1 << 63 else x for x in columns[3]]
            yield pa.record_batch([pa.array(c, k) for c, k in zip([*columns[:3], signed, columns[4]], kinds)],
                                  ["host", "path", "is_content", "value", "n"])

    counts = pages.mapInArrow(observe, "host string, path long, is_content boolean, value long, n long").groupBy(
        "host", "path", "is_content", "value").agg(F.sum("n").alias("n"))
    style, content = ~F.col("is_content"), F.col("is_content")
    nodes = counts.groupBy("host", "path").agg(
        F.sum(F.when(style, F.col("n"))).alias("m"),
        F.sum(F.when(style, F.col("n") * F.ln("n"))).alias("same_style"),
        F.count(F.when(content, 1)).alias("texts"),
        F.sum(F.when(content, F.ln("n"))).alias("spread")).where("m > 1")
    m = F.ln("m")
    return nodes.select(
        "host", "path", ((m - F.col("same_style") / F.col("m")) / m).alias("node"),
        F.when(F.col("texts") > 0, 1 - F.col("spread") / F.col("texts") / m).alias("content"))


def extracted(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every row of ``pages (page_id, url, html)``.

    NULL and empty pages give an empty text; pages without a host share the host ''. Repeated
    rows each give a row (and each count in the tree). Other columns are not read.
    """
    source = pages.select("page_id", "url", "html").withColumn("host", _host(F.col("url")))
    nodes = cut(style_trees(source.select("host", "html")), "nodes")
    trees = nodes.groupBy("host").agg(F.collect_list(F.struct("path", "node", "content")).alias("tree"))
    if nodes.count() <= TREE_ROWS:
        trees = F.broadcast(trees)
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            hosts, texts = batch.column("host").to_pylist(), []
            for k, html in enumerate(batch.column("html").to_pylist()):
                if hosts[k] not in known:
                    known.clear()
                    known[hosts[k]] = {x["path"]: (x["node"], x["content"])
                                       for x in batch.column("tree")[k].as_py() or []}
                texts.append(main_text(html, known[hosts[k]]))
            yield pa.record_batch([batch.column("page_id").cast(pa.int64()), batch.column("url"),
                                   pa.array(texts, pa.string())], kind)

    joined = source.join(trees, "host", "left").select("page_id", "url", "html", "host", "tree")
    out = joined.mapInArrow(read, "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))


@query("op6_site_style_tree")
def op6_site_style_tree(spark, sf_dir):
    return extracted(table(spark, sf_dir, "pages"))
