"""Main text of web pages by removing what a site repeats.

Every element is hashed bottom-up from its tag, its text and the hashes of the
elements in it; attributes, and so links, don't count. The hashes of a host's
pages are counted in Spark by the distinct main texts that they stand beside: a
block beside many different articles is the site's template and is deleted, a
copied article is one text however often it comes. The count covers all block
elements outside an article, and containers within one: paragraphs and
headings of an article are never template, since articles may share them.
Elements whose name, role or class says what they are (menus, forms, adverts,
comments) go as well, whatever their count.

A page is parsed once; its blocks and the hashes with the blocks that each
spans are written, and all that follows works on them.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import met_by_key, table, written

#: Distinct main texts of a host that make a subtree template; template hashes
#: in one broadcast, 8 bytes each.
MANY_TEXTS, TEMPLATES_AT_ONCE = 5, 2_000_000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg xmp noframes".split())
DROPPED = frozenset(
    "head nav header footer aside form button select option label datalist fieldset menu dialog object applet canvas audio video map math".split()) | RAW
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr blockquote pre "
    "figure figcaption address hr details summary center hgroup search".split()) | DROPPED - frozenset("button select option label".split())
SPACED = frozenset(("br", "td", "th", "img"))
CONTAINERS = frozenset("section div ul ol dl table figure details blockquote address center nav header footer aside form".split())
#: Elements that are the page or its article, and are never template.
WHOLE = frozenset(("html", "head", "body", "main", "article"))
#: Words of a class, id or role that name what isn't the article.
NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs header footer masthead comment comments reply replies respond disqus share sharing "
    "social related recommended newsletter subscribe subscription signup login popup modal overlay widget pagination pager toolbar search "
    "contentinfo complementary".split())
CLOSES_P = BLOCKS - frozenset(("html", "body"))
#: An open element that ends when one of its own kind, or of these, starts.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Where the search for an element to end stops.
WALLS = frozenset("ul ol dl table article main section div body html td th blockquote".split())
TOKEN = re.compile(r"<(?:!--(.*?)(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[!?/][^>]*>)", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)


def _unwanted(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in DROPPED and not (tag == "header" and in_main):
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    if HIDDEN.search(attributes):
        return True
    for m in ATTRIBUTE.finditer(attributes):
        if not NAMED.isdisjoint(re.split(r"[^a-z0-9]+", (m[2] or m[3] or m[4] or "").lower())):
            return True
    return False


_ODD, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Element:
    """An open element: its tag, the blocks before it, whether it goes, the
    main elements around it, and a running hash of what it holds so far."""

    __slots__ = ("before", "dropped", "hash", "mains", "tag")

    def __init__(self, tag: str, before: int, dropped: bool, mains: int):
        self.tag, self.before, self.dropped, self.mains, self.hash = tag, before, dropped, mains, 0


class Page:
    """One walk over a page's markup; unclosed and misplaced tags are met as
    browsers do. Time is linear in the page, however deep it is nested."""

    def __init__(self, source: str):
        self.source = source
        #: Depth of each block's main element, or -1 for one that goes; its text.
        self.levels: list[int] = []
        self.texts: list[str] = []
        #: (hash, first block, block behind the last) of the elements that are counted.
        self.parts: list[tuple[int, int, int]] = []
        self.line: list[str] = []
        self.open: list[Element] = [Element("", 0, False, 0)]
        self.tags: Counter[str] = Counter()
        self._walk()

    def _flush(self) -> None:
        if self.line:
            text = " ".join("".join(self.line).split())
            self.line = []
            if text:
                inner = self.open[-1]
                self.levels.append(-1 if inner.dropped else inner.mains)
                self.texts.append(text)

    def _add(self, x: int) -> None:
        inner = self.open[-1]
        inner.hash = ((inner.hash ^ x) * _ODD + 1) & _MASK

    def _text(self, raw: str) -> None:
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            self.line.append(text)
            if not text.isspace():
                self._add(xxhash.xxh3_64_intdigest(" ".join(text.split())))

    def _close(self, count: int) -> None:
        """Close the innermost `count` elements."""
        for _ in range(count):
            e = self.open[-1]
            if e.tag in BLOCKS:
                self._flush()
            self.open.pop()
            self.tags[e.tag] -= 1
            code = xxhash.xxh3_64_intdigest(f"{e.tag} {e.hash}")
            self._add(code)
            if len(self.texts) > e.before and (e.tag in CONTAINERS or e.mains < 4 and e.tag in BLOCKS and e.tag not in WHOLE):
                self.parts.append((code - (1 << 63), e.before, len(self.texts)))

    def _close_open(self, tags: tuple[str, ...]) -> None:
        if not any(self.tags[tag] for tag in tags):
            return
        for depth, e in enumerate(reversed(self.open), 1):
            if e.tag in tags:
                self._close(depth)
                return
            if e.tag in WALLS:
                return

    def _walk(self) -> None:
        source, at, size = self.source, 0, len(self.source)
        while at < size:
            low = source.find("<", at)
            if low < 0:
                break
            self._text(source[at:low])
            m = TOKEN.match(source, low)
            slash, tag, attributes = m.group(2, 3, 4) if m else ("", None, "")
            if m is None:
                m = LOOSE.match(source, low)
                if m is None:
                    self._text("<")
                    at = low + 1
                    continue
                slash, tag, attributes = m.groups()
            at = m.end()
            if tag is None:
                continue
            tag = tag.lower()
            if slash:
                self._end(tag)
            else:
                at = self._start(tag, attributes, at)
        self._text(source[at:])
        self._close(len(self.open) - 1)
        self._flush()

    def _end(self, tag: str) -> None:
        if tag == "br":
            self._text(" ")
            return
        if self.tags[tag]:
            for depth, e in enumerate(reversed(self.open), 1):
                if e.tag == tag:
                    self._close(depth)
                    return
                if tag not in BLOCKS and e.tag in BLOCKS:
                    break
        if tag in BLOCKS:
            self._flush()

    def _start(self, tag: str, attributes: str, at: int) -> int:
        if tag in ENDS:
            self._close_open(ENDS[tag])
        if tag in CLOSES_P:
            self._close_open(("p",))
        if tag in BLOCKS:
            self._flush()
        elif tag in SPACED:
            self._text(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            return at
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(self.source, at)
            return end.end() if end else len(self.source)
        if tag == "body" and self.tags["head"]:
            self._close(len(self.open) - [e.tag for e in self.open].index("head"))
        inner = self.open[-1]
        own = 4 if tag == "article" else 2 if tag == "main" or re.search(r"role\s*=\s*[\"']?main\b", attributes) else 0
        self.open.append(Element(tag, len(self.texts), inner.dropped or _unwanted(tag, attributes, inner.mains >= 2), max(inner.mains, own)))
        self.tags[tag] += 1
        return at


def assembled(levels: list[int], texts: list[str], parts: list[tuple[int, int, int]], template: set[int]) -> str:
    """The blocks of the articles, or of the main element, or of the page, less
    those that go and those of template elements."""
    gone = np.zeros(len(texts) + 1, np.int64)
    for code, low, high in parts if template else ():
        if code in template:
            gone[low] += 1
            gone[high] -= 1
    kept = [k for k, n in enumerate(np.cumsum(gone[:-1]).tolist()) if not n and levels[k] >= 0]
    best = max((levels[k] for k in kept), default=0)
    return "\n".join(texts[k] for k in kept if levels[k] == best)


_PARSED = "levels array<int>, packed binary, parts array<struct<code:long,low:int,high:int>>, whole long"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns before host and html, and the page's blocks and elements.
    Blocks hold no line break, so they are joined by it and compressed; the
    host goes into the hashes of elements."""
    element = pa.struct([("code", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
    pack, digest = zstandard.ZstdCompressor(level=1).compress, xxhash.xxh3_64_intdigest
    for batch in batches:
        *others, hosts, sources = batch.columns
        pages = [Page(x.as_py()) for x in sources]
        seeds = [digest(x.as_py()) for x in hosts]
        parts = [[{"code": digest(c.to_bytes(8, "little", signed=True), seed) - (1 << 63), "low": a, "high": b} for c, a, b in p.parts] for p, seed in zip(pages, seeds, strict=True)]
        wholes = [digest(assembled(p.levels, p.texts, [], set())) - (1 << 63) for p in pages]
        packed = [pack("\n".join(p.texts).encode("utf-8", "surrogatepass")) for p in pages]
        yield pa.RecordBatch.from_arrays(
            [*others, pa.array([p.levels for p in pages], pa.list_(pa.int32())), pa.array(packed, pa.binary()), pa.array(parts, pa.list_(element)), pa.array(wholes, pa.int64())],
            names=[*batch.schema.names[:-2], "levels", "packed", "parts", "whole"])


def _assemble(template):
    """Main texts; `template` is a broadcast of all template hashes in order, or
    None where each page has its own in a column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            own, texts = batch.column("codes").to_pylist() if template is None else None, []
            for k, (levels, packed, parts) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("levels", "packed", "parts")), strict=True)):
                elements = [(x["code"], x["low"], x["high"]) for x in parts]
                if own is None:
                    codes = np.array([c for c, *_ in elements], np.int64)
                    met = set(codes[_among(codes, template.value)].tolist())
                else:
                    met = set(own[k] or ())
                texts.append(assembled(levels, unpack(packed).decode("utf-8", "surrogatepass").split("\n") if levels else [], elements, met))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return run


def _among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def site_template(parsed: DataFrame, many: int = MANY_TEXTS) -> DataFrame:
    """(code, pages): element hashes beside `many` main texts of a host or more."""
    codes = parsed.select("whole", F.explode(F.array_distinct("parts.code")).alias("code"))
    return (codes.groupBy("code").agg(F.count_distinct("whole").alias("n"), F.count(F.lit(1)).alias("pages"))
            .where(F.col("n") >= many).drop("n"))


def parse(pages: DataFrame) -> DataFrame:
    """(row, page_id, url) with a page's blocks and elements, written once."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    kind = rows.schema["page_id"].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", host.alias("host"), "html")
                   .mapInArrow(_parse, f"row long, page_id {kind}, url string, {_PARSED}"), "pages")


def main_text(pages: DataFrame, many: int = MANY_TEXTS) -> DataFrame:
    """(page_id, url, text, n_chars), one row for every input row.

    A null page is empty. Pages without a host in their url count as one host.
    Null and repeated page_ids are pages of their own; equal pages count once,
    as one main text, and give equal rows. An empty table gives no rows. Other
    columns are ignored.

    Up to TEMPLATES_AT_ONCE template hashes, which are counted, are broadcast;
    more are joined to the pages.
    """
    parsed = parse(pages)
    template = written(site_template(parsed, many), "template")
    n, total = template.agg(F.count(F.lit(1)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    schema = f"page_id {parsed.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long"
    columns = ("page_id", "url", "levels", "packed", "parts")
    if n <= TEMPLATES_AT_ONCE:
        sent = parsed.sparkSession.sparkContext.broadcast(np.sort(template.select("code").toArrow().column("code").to_numpy()))
        return parsed.select(*columns).mapInArrow(_assemble(sent), schema)
    codes = parsed.select("row", F.explode(F.array_distinct("parts.code")).alias("code"))
    marked = met_by_key(codes, template, ["code"], "pages", total).groupBy("row").agg(F.collect_set("code").alias("codes"))
    return parsed.join(marked, "row", "left").select(*columns, "codes").mapInArrow(_assemble(None), schema)


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES = {"op9_html": op9_html}
#: Parsing markup has no SQL form; the tests hold the operator against pages built from known articles.
ORACLE_SQL: dict[str, str] = {}
