"""Main text of HTML pages: markup structure, and a host-wide suffix array for what structure leaves open.

What lies in an article (or main) element is content; what lies in elements or classes for menus, headers, footers,
side bars, notices, adverts, forms and comments is not. The rest is decided by repetition. The token streams of a
host's pages, outside declared content, are concatenated in shards of bounded size; each shard's suffix array is sorted
to the depth of ``RUN`` tokens, so that its intervals are the runs of that length. Intervals of all shards of a host are
merged, and those on distinct pages cover boilerplate: every longer repeated substring is covered by the runs inside it.

A copied article repeats too. Pages are distinct if their bodies are, and covered tokens are boilerplate only in slots
(paths of elements and classes) that hold repeated text for the most part, counted over all pages of the host and drawn
to the slot's share over all hosts: a menu's slot repeats on every page, an article's seldom. A page without declared
content keeps the uncovered tokens of such slots, and the others whole.

Within declared content, too, the array decides what markup leaves open: blocks in elements that say nothing (``LOOSE``)
lose the covered tokens of such slots, which are notices and adverts without a name. Copies of an article are still
articles: a page keeps all its declared content if that would take half of it or if half of the rest is covered as well.
Prose elements right in an article are never taken away for being repeated.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, map_in_arrow, table, written
from tidemark.llm.url_filters import host as host_of

#: A tag's attributes may hold > in quotes; a tag with an unpaired quote ends at the next >.
MARKUP = re.compile(
    r"""<!--[\s\S]*?(?:-->|\Z)|<!\[CDATA\[[\s\S]*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s>/]*)(?:(?P<attributes>(?:[^>"']|"[^"]*"|'[^']*')*+)(?:>|\Z)|(?P<broken>[^>]*)(?:>|\Z))|</[^>a-zA-Z][^>]*(?:>|\Z)"""
)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Fixed values of HTML: elements by the role of their text.
RAW = {"script", "style", "iframe", "title", "textarea", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "ruby", "rb", "rp", "rt", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"nav", "footer", "aside", "form", "head", "menu", "dialog", "button", "fieldset", "noscript", "template", "object", "svg", "math", "canvas", "audio", "video", "select", "option", "datalist"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NAMES = {
    "ad", "adbox", "ads", "adslot", "advert", "adverts", "advertisement", "advertising", "adsense", "alert", "announcement", "aside", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "commentlist", "consent", "cookie", "cookies", "disclaimer", "discussion", "disqus", "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "pager", "pagination", "paywall", "popup", "promo", "promotion", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "sidenav",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topnav", "widget",
}
#: How a class begins that says what is around an element and not what it is.
AROUND = ("no-", "has-", "with-", "without-", "is-", "not-")
#: Names of a content element, for pages that have neither article nor main.
HINTS = {"article", "articlebody", "content", "entry", "main", "post", "story"}
COMMENTS = {"comment", "comments", "commentlist", "discussion", "replies", "reply"}
#: Tokens of a repeated run.
RUN = 8
#: Tokens of a shard, about.
SHARD = 500_000
WITHIN, CONTENT, OPEN, ASIDES = 3, 2, 1, 0
#: Elements that don't say what their text is; in declared content, what is in them is WITHIN.
LOOSE = {"div", "section", "ul", "ol", "table"}
#: Share of covered tokens from which a slot is one of boilerplate, and the tokens that its share over all hosts counts as.
REPEATED, PRIOR = 0.4, 200


@dataclass
class Page:
    """Blocks in page order, each with its zone and its slot."""

    blocks: list[tuple[int, int, str]] = field(default_factory=list)

    def text(self) -> str | None:
        """Declared content; None if the page declares none."""
        found = [x for zone, _, x in self.blocks if zone >= CONTENT]
        return " ".join(found) if found else None

    def open(self) -> list[tuple[int, str]]:
        """(slot, text) of the blocks that structure leaves open."""
        return [(slot, x) for zone, slot, x in self.blocks if zone == OPEN]

    def loose(self) -> bool:
        return any(zone == WITHIN for zone, _, _ in self.blocks)

    def judged(self) -> list[tuple[int, str, bool]]:
        """(slot, text, whether it stays in any case) of the blocks of which repetition may take some away."""
        if self.text() is None:
            return [(slot, x, False) for slot, x in self.open()]
        return [(slot, x, zone == CONTENT) for zone, slot, x in self.blocks if zone >= CONTENT] if self.loose() else []

    def outside(self) -> list[str]:
        return [x for zone, _, x in self.blocks if zone < CONTENT]

    def stream(self) -> list[str]:
        """The blocks of the suffix array: those outside declared content, and all of a page with loose ones in it."""
        return [x for _, _, x in self.blocks] if self.loose() else self.outside()


def named(attributes: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}


def words_of(own: dict[str, str], *more: str) -> set[str]:
    """The words of an element's classes, id and other attributes."""
    classes = " ".join(c for c in own.get("class", "").lower().split() if not c.startswith(AROUND))
    return set(re.findall(r"[a-z]+", " ".join([classes, own.get("id", ""), *(own.get(m, "") for m in more)]).lower()))


def is_aside(tag: str, attributes: str, within_content: bool) -> bool:
    if tag in ASIDE or tag == "header" and not within_content:
        return True
    if not attributes.strip() or tag in ("html", "body"):
        return False
    own = named(attributes)
    words = words_of(own)
    if tag in ("article", "main"):
        return bool(words & COMMENTS)
    hidden = "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.IGNORECASE)
    return bool(hidden or own.get("role", "").lower() in ROLES or words & NAMES and not (within_content and words & NAMES == {"header"}))


def is_content(attributes: str, roles_only: bool) -> bool:
    """Whether a plain element is named as the page's content."""
    own = named(attributes) if attributes.strip() else {}
    words = words_of(own, "itemprop")
    return own.get("role", "").lower() == "main" or not roles_only and bool(words & HINTS)


class Stack:
    """Open elements as (tag, zone, slot), with the places of each tag, so that none is searched for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int, int]] = [("", OPEN, 0)]
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, zone: int, slot: int) -> None:
        self.places.setdefault(tag, []).append(len(self.items))
        self.items.append((tag, zone, slot))

    def cut(self, size: int) -> None:
        while len(self.items) > size:
            self.places[self.items.pop()[0]].pop()

    def has(self, tag: str) -> bool:
        return bool(self.places.get(tag))


def parse(html: str | None) -> Page:
    """The blocks of a page, in time in proportion to its length. Text in a list item that is all link is a menu's."""
    html = html or ""
    declared = next((t for t in ("article", "main") if re.search(rf"<{t}[\s>]", html, re.IGNORECASE)), "")
    page, stack = Page(), Stack()
    pieces: list[str] = []
    linked = plain = False

    def end_block() -> None:
        nonlocal linked, plain
        if pieces:
            text = "".join(pieces)
            text = " ".join((entities.unescape(text) if "&" in text else text).split())
            if text:
                _, zone, slot = stack.items[-1]
                menu = zone == OPEN and linked and not plain and stack.has("li")
                page.blocks.append((ASIDES if menu else zone, slot, text))
            pieces.clear()
        linked = plain = False

    at, size = 0, len(html)
    while at < size:
        m = MARKUP.search(html, at)
        begin = m.start() if m else size
        if begin > at:
            piece = html[at:begin]
            pieces.append(piece)
            if not piece.isspace():
                if stack.has("a"):
                    linked = True
                else:
                    plain = True
        if not m:
            break
        at = m.end()
        tag, attributes = (m["tag"] or "").lower(), m["attributes"] or m["broken"] or ""
        if not tag:
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag not in INLINE:
            end_block()
        if m["close"]:
            if stack.has(tag):
                opened = stack.places[tag][-1]
                if stack.items[opened - 1][1] != stack.items[-1][1]:
                    end_block()
                stack.cut(opened)
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{tag}[^>]*>", re.IGNORECASE).search(html, at)
                at = close.end() if close else size
            continue
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "article", "a"):
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack.items[-1][0] == tag:
            stack.cut(len(stack.items) - 1)
        _, zone, slot = stack.items[-1]
        if zone != ASIDES:
            if is_aside(tag, attributes, zone >= CONTENT):
                if tag in INLINE:
                    end_block()
                zone = ASIDES
            elif tag == declared or tag in ("div", "section", "td") and declared != "article" and is_content(attributes, bool(declared)):
                zone = CONTENT
            elif zone == CONTENT and tag in LOOSE:
                zone = WITHIN
        if tag not in INLINE:
            classes = " ".join(sorted(re.findall(r"[a-z]+", named(attributes).get("class", "").lower()))) if "class" in attributes else ""
            slot = zlib.crc32(f"{tag}.{classes}>".encode(), slot)
        stack.push(tag, zone, slot)
    end_block()
    return page


def heads(tokens: list[str]) -> np.ndarray:
    """A 64-bit hash of the RUN tokens from each position that has as many."""
    digest = xxhash.xxh64_intdigest
    return np.array([digest(" ".join(tokens[k : k + RUN]).encode()) >> 1 for k in range(len(tokens) - RUN + 1)], dtype=np.int64)


def intervals(pages: list[list[str]]) -> Iterator[tuple[int, int, list[int]]]:
    """(page, position, pages of the interval) of the suffix array of the pages' concatenation, sorted to RUN tokens.

    The array is sorted by prefix doubling. A separator of its own ends each page, so no run spans two pages.
    """
    number: dict[str, int] = {}
    ids = [[number.setdefault(t, len(number)) for t in p] for p in pages]
    stream = np.array([x for k, p in enumerate(ids) for x in [*p, -1 - k]], dtype=np.int64)
    owner = np.repeat(np.arange(len(pages)), [len(p) + 1 for p in pages])
    place = np.concatenate([np.arange(len(p) + 1) for p in pages]) if pages else np.zeros(0, np.int64)
    room = np.concatenate([len(p) - np.arange(len(p) + 1) for p in pages]) if pages else np.zeros(0, np.int64)
    _, rank = np.unique(stream, return_inverse=True)
    depth = 1
    while depth < RUN:
        step = min(depth, RUN - depth)
        ahead = np.concatenate([rank[step:], np.full(min(step, len(rank)), -1)])[: len(rank)]
        _, rank = np.unique(rank.astype(np.int64) * (len(stream) + 2) + ahead + 1, return_inverse=True)
        depth += step
    order = np.argsort(rank, kind="stable")
    order = order[room[order] >= RUN]
    edges = np.flatnonzero(np.diff(rank[order])) + 1
    for group in np.split(order, edges):
        if len(group):
            yield int(owner[group[0]]), int(place[group[0]]), np.unique(owner[group]).tolist()


def body_of(host: str, page: Page) -> int:
    """What tells pages apart: the host and the declared content, or else the open tokens."""
    text = page.text()
    kept = [x for _, x in page.open()] if text is None else [text]
    return xxhash.xxh64_intdigest("\n".join([host, *kept]).encode()) - (1 << 63)


def parsed(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (…, host) without html, with page (a hash of the body), text (null if undeclared), tokens of the stream, and the blocks to be judged, their slots and whether they are firm."""
    made = ("page", "text", "outside", "open", "slots", "firm")
    kept = [c for c in pages.columns if c not in (html, *made)]
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([*(pages.schema[c] for c in kept), T.StructField("page", T.LongType()), T.StructField("text", T.StringType()), T.StructField("outside", strings), T.StructField("open", strings), T.StructField("slots", T.ArrayType(T.LongType())), T.StructField("firm", T.ArrayType(T.BooleanType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x.as_py()) for x in batch.column(batch.schema.get_field_index(html))]
            hosts = batch.column(batch.schema.get_field_index("host")).to_pylist()
            bodies = [body_of(h or "", p) for h, p in zip(hosts, found, strict=True)]
            texts = [p.text() for p in found]
            outside = [[t for x in p.stream() for t in x.split()] for p in found]
            left = [p.judged() for p in found]
            more = [pa.array([[b[k] for b in own] for own in left], pa.list_(t)) for k, t in ((1, pa.string()), (0, pa.int64()), (2, pa.bool_()))]
            arrays = [pa.array(bodies, pa.int64()), pa.array(texts, pa.string()), pa.array(outside, pa.list_(pa.string())), *more]
            yield pa.RecordBatch.from_arrays([*batch.select(kept).columns, *arrays], names=[*kept, *made])

    return pages.select(*kept, html).transform(map_in_arrow, run, schema)


def repeated_heads(streams: DataFrame, shard: int = SHARD) -> DataFrame:
    """(host, head): runs that occur on distinct pages of a host; streams have host, page and tokens in outside.

    Hosts above a shard are dealt to several, and all their intervals are merged; of others only the repeated ones are.
    """
    streams = streams.where(F.size("outside") >= RUN).select("host", "page", "outside")
    large = streams.groupBy("host").agg(F.sum(F.size("outside")).alias("tokens")).where(F.col("tokens") > shard)
    large = cut(large.select("host", F.ceil(F.col("tokens") / shard).cast("int").alias("shards")))
    dealt = streams.join(large, "host", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod("page", F.col("shards")).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        names, tokens, whole = group["page"].to_pylist(), group["outside"].to_pylist(), group["shards"][0].as_py() == 1
        digest = xxhash.xxh64_intdigest
        found = []
        for page, at, on in intervals(tokens):
            low, high = min(names[k] for k in on), max(names[k] for k in on)
            if low != high or not whole:
                found.append((digest(" ".join(tokens[page][at : at + RUN]).encode()) >> 1, low, high))
        host = pa.array([group["host"][0].as_py()] * len(found), pa.string())
        columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(3)]
        return pa.Table.from_arrays([host, *columns], names=["host", "head", "low", "high"])

    merged = dealt.groupBy("host", "shard").applyInArrow(run, "host string, head long, low long, high long")
    return merged.groupBy("host", "head").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high").select("host", "head")


def covered(blocks: list[str], starts: list[int]) -> list[np.ndarray]:
    """For each block, which of its tokens a run that begins at one of starts covers; runs go on over blocks."""
    ends = np.cumsum([len(x.split()) for x in blocks], dtype=np.int64)
    held = np.zeros(ends[-1] if len(ends) else 0, dtype=bool)
    for s in starts:
        held[s : s + RUN] = True
    return np.split(held, ends[:-1]) if len(ends) else []


def slot_counts(rows: DataFrame) -> DataFrame:
    """(host, slot, total, covered): tokens of each slot of each of rows (host, open, slots, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, list[int]] = {}
            for host, blocks, slots, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for slot, held in zip(slots, covered(blocks, starts or []), strict=True):
                    own = total.setdefault((host, slot), [0, 0])
                    own[0] += len(held)
                    own[1] += int(held.sum())
            rows_ = [(*k, *v) for k, v in total.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "slot", "total", "covered"])

    return rows.select("host", "open", "slots", "starts").transform(map_in_arrow, run, "host string, slot long, total long, covered long")


def repeated_slots(rows: DataFrame) -> DataFrame:
    """(host, slot) of the slots of boilerplate."""
    own = cut(slot_counts(rows).groupBy("host", "slot").agg(F.sum("total").alias("total"), F.sum("covered").alias("covered")))
    every = own.groupBy("slot").agg((F.sum("covered") / F.greatest(F.sum("total"), F.lit(1))).alias("share"))
    share = (F.col("covered") + PRIOR * F.col("share")) / (F.col("total") + PRIOR)
    return own.join(every, "slot").where(share >= REPEATED).select("host", "slot")


def is_copy(marks: list[np.ndarray], goes: list[bool]) -> bool:
    """Whether marks, the covered tokens of the blocks of declared content, are an article's own and not those of what goes."""
    total, gone = sum(map(len, marks)), sum(int(m.sum()) for m, g in zip(marks, goes, strict=True) if g)
    rest = [m for m, g in zip(marks, goes, strict=True) if not g]
    return 2 * gone >= total or 2 * sum(int(m.sum()) for m in rest) >= max(1, sum(map(len, rest)))


def uncovered(rows: DataFrame) -> DataFrame:
    """rows (…, undeclared, open, slots, firm, starts, repeated) with the text of the open blocks, without covered tokens of repeated slots.

    Firm blocks stay whole, and so does all declared content of a copy.
    """
    kept = [c for c in rows.columns if c not in ("undeclared", "open", "slots", "firm", "starts", "repeated", "text")]
    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for undeclared, blocks, slots, firm, starts, repeated in zip(*(batch.column(len(kept) + k).to_pylist() for k in range(6)), strict=True):
                blocks, gone, marks = blocks or [], set(repeated or []), covered(blocks or [], starts or [])
                goes = [slot in gone and not stays for slot, stays in zip(slots or [], firm or [], strict=True)]
                if not undeclared and is_copy(marks, goes):
                    goes = [False] * len(goes)
                found = [" ".join(t for t, h in zip(x.split(), held.tolist(), strict=True) if not h) if g else x for x, g, held in zip(blocks, goes, marks, strict=True)]
                texts.append(" ".join(x for x in found if x))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string())], names=[*kept, "text"])

    return rows.select(*kept, "undeclared", "open", "slots", "firm", "starts", "repeated").transform(map_in_arrow, run, schema)


def _heads_of(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = heads([t for x in batch.column(2)[k].as_py() or [] for t in x.split()])
                same = [pa.array([batch.column(c)[k].as_py()] * len(found), batch.schema.field(c).type) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(found), pa.array(np.arange(len(found), dtype=np.int32))], names=["host", "page", "head", "start"])

    return rows.select("host", "page", "open").transform(map_in_arrow, run, "host string, page long, head long, start int")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text) of every row of pages; text is empty where there is none, as for null html.

    Rows of a host with the same body are one page, whose copies don't make it boilerplate; each gets its text. A page
    without a host belongs to the host without a name.
    """
    rows = parsed(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.col(html).alias("html")))
    # What is judged is small, or all of a page with open or loose blocks; kept, so that pages are parsed twice at most.
    small = written(rows.select("page_id", "url", "host", "page", F.col("text").isNull().alias("undeclared"), "outside", "open", "slots", "firm"), "judged")
    judged = small.where((F.size("open") > 0) | F.col("undeclared")).select("page_id", "url", "host", "page", "undeclared", "open", "slots", "firm")
    once = judged.where(F.size("open") > 0).dropDuplicates(["page"])
    settled = rows.where((F.size("open") == 0) & F.col("text").isNotNull()).select("page_id", "url", "text")
    if not once.limit(1).count():
        return settled.union(judged.select("page_id", "url", F.lit("").alias("text")))
    starts = _heads_of(once).join(repeated_heads(small), ["host", "head"]).groupBy("page").agg(F.collect_list("start").alias("starts"))
    once = written(once.select("host", "page", "open", "slots").join(starts, "page", "left"), "starts")
    gone = once.select("page", "host", F.explode(F.array_distinct("slots")).alias("slot")).join(repeated_slots(once), ["host", "slot"]).groupBy("page").agg(F.collect_list("slot").alias("repeated"))
    known = once.select("page", "starts").join(gone, "page")
    rest = uncovered(judged.drop("host").join(known, "page", "left"))
    return settled.union(rest.select("page_id", "url", "text"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text and n_chars (its code points) of every row of pages.

    Null or empty html and pages without content have an empty text. Repeated rows and ids stay repeated; rows with a
    null id or url are extracted like any other; an empty table gives an empty result; other columns are not read.
    """
    found = extract(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
