"""Main-text extraction by consensus host paths.

1. Each page is parsed into blocks; its containers are scored by the text they
   hold (less what is inside links) and the best one votes, with its score, for
   its generalised tag-class path (classes sorted, digits folded).
2. Spark sums the votes by (host, path), with partial sums before the shuffle, and
   takes each host's winner.
3. Every page is extracted again with its host's winning path; a page without such
   a container uses its own best one.

A host with a third of all pages costs nothing extra: votes are partial sums,
and the winners (one short row per host) are joined by broadcast while there are
at most ``BROADCAST_HOSTS`` of them, else by a join in which every host is split
into ``SALTS`` keys.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of
from tidemark.session import cut_lineage

BROADCAST_HOSTS = 50_000
SALTS = 32

# What follows a tag name: a value may be quoted (and then hold '>'); a quote anywhere else is a character.
_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+'|)[^>=]*+)*+"""
# Raw text runs to its end tag or the end of the page; foreign and form content only to an end tag that
# is there, as an element closed at once, or never, holds nothing.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|iframe|title|textarea)(?=[\s/>]){_ATTRIBUTES}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<box>svg|template|object|select)(?=[\s/>]){_ATTRIBUTES}(?<!/)>.*?</(?P=box)\s*>"
    rf"|</?(?:svg|template|object|select)(?=[\s/>]){_ATTRIBUTES}>"
    rf"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRIBUTES})(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_CLASS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "img", "wbr",
          "math", "mfrac", "mi", "mn", "mo", "mrow", "mspace", "msqrt", "msub", "msubsup", "msup", "mtext", "semantics"}
#: Elements that hold one piece of running text; they are not containers.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "pre", "blockquote", "dd", "dt", "figcaption", "caption",
               "td", "th", "tr", "tbody", "thead", "table", "ul", "ol", "dl", "figure", "address", "summary"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Subtrees that are never main text.
EXCLUDED_TAGS = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "header", "head", "fieldset"}
#: Words of a class, id or role that mark such a subtree.
EXCLUDED_WORDS = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs",
                  "comment", "comments", "complementary", "contentinfo", "consent", "cookie", "cookies", "copyright",
                  "discussion", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
                  "newsletter", "notice", "pagination", "popup", "promo", "promoted", "related", "replies", "responses", "search",
                  "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Words of a class, id or role that mark the content itself: a header in it keeps its headings.
CONTENT_WORDS = {"article", "content", "entry", "main", "post", "story"}
#: Words of a class name that say nothing of what it marks.
NEUTRAL_WORDS = {"area", "bar", "block", "box", "button", "buttons", "container", "inner", "item", "items", "label", "link",
                 "links", "list", "note", "outer", "section", "slot", "text", "title", "unit", "wrap", "wrapper"}
_NEGATION = {"no", "has", "with", "without", "non"}
#: Elements that these start tags close implicitly, up to the nearest stop element.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "body", "td", "th", "nav", "aside", "footer",
          "header", "form", "blockquote"}


class _Element:
    __slots__ = ("tag", "path", "excluded", "heading_only", "content")

    def __init__(self, tag: str, path: str, excluded: bool, heading_only: bool, content: bool):
        self.tag, self.path, self.excluded = tag, path, excluded
        self.heading_only, self.content = heading_only, content


def _label(tag: str, attrs: str) -> tuple[str, set[str], bool]:
    """Generalised name of an element, the marking words of its class, id and role, and whether one
    of these names says nothing but that: ``cookie-notice`` does, ``market-share`` does not."""
    classes: list[str] = []
    marks: set[str] = set()
    plainly = False
    if attrs and not attrs.isspace():
        for m in _CLASS.finditer(attrs):
            value = html.unescape(m[2] or m[3] or m[4] or "")
            if m[1].lower() == "class":
                classes = sorted({_DIGITS.sub("#", c.lower()) for c in value.split()})
            for name in value.split():
                before = ""
                for token in _TOKEN.findall(name):
                    token = token.lower()
                    if before not in _NEGATION:
                        marks.add(token)
                    before = token
                words = {t.lower() for t in _TOKEN.findall(name)}
                # a neutral word in front makes the name a part of the content: section-header
                first = next((t.lower() for t in _TOKEN.findall(name)), "")
                plainly |= bool(words & EXCLUDED_WORDS) and words <= EXCLUDED_WORDS | NEUTRAL_WORDS and (
                    first in EXCLUDED_WORDS)
    return ".".join([tag, *classes]), marks, plainly


class Block:
    """Text of one block: the paths of the elements around it (outermost first),
    the container it belongs to, and how many of its characters are in links."""

    __slots__ = ("text", "paths", "owner", "links")

    def __init__(self, text: str, paths: list[str], owner: int, links: int):
        self.text, self.paths, self.owner, self.links = text, paths, owner, links


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, without excluded subtrees."""
    stack = [_Element("", "", False, False, False)]
    out: list[Block] = []
    parts: list[str] = []
    link_chars = link_depth = 0

    def flush() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                chain = [e for e in stack if e.tag and e.tag not in INLINE]
                owner = len(chain) - 1
                while owner > 0 and chain[owner].tag in TEXT_BLOCKS:
                    owner -= 1
                out.append(Block(text, [e.path for e in chain], max(owner, 0), min(link_chars, len(text))))
        link_chars = 0

    def add(raw: str) -> None:
        nonlocal link_chars
        top = stack[-1]
        if raw and not top.excluded and not (top.heading_only and not any(e.tag in HEADINGS for e in stack)):
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link_depth:
                link_chars += len(text.strip())

    def close(at: int) -> None:
        nonlocal link_depth
        while len(stack) > at:
            gone = stack[-1]
            if gone.tag not in INLINE:
                flush()
            if gone.tag == "a":
                link_depth -= 1
            stack.pop()

    at = 0
    for m in _MARKUP.finditer(page):
        if m.start() > at:
            add(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE and stack[i].tag not in TEXT_BLOCKS:
                    break
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag not in INLINE:
            shut = _CLOSES.get(tag) or ({"p"} if tag not in ("p",) else set())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in shut:
                    close(i)
                    break
                if stack[i].tag in _STOPS:
                    break
            flush()
        parent = stack[-1]
        attrs = m["attrs"] or ""
        name, marks, plainly = _label(tag, attrs)
        excluded, heading_only = parent.excluded, parent.heading_only
        content = parent.content or tag in ("article", "main")
        if not excluded and tag not in ("html", "body", "main", "article"):
            content = content or (tag not in INLINE and bool(marks & CONTENT_WORDS) and not marks & EXCLUDED_WORDS)
            if tag == "header" and parent.content:
                heading_only = True
            elif tag in EXCLUDED_TAGS or (plainly if parent.content else marks & EXCLUDED_WORDS):
                excluded = True
        path = parent.path if tag in INLINE else f"{parent.path}>{name}" if parent.path else name
        if not attrs.rstrip().endswith("/") or tag not in INLINE:
            stack.append(_Element(tag, path, excluded, heading_only, content))
            if tag == "a":
                link_depth += 1
    if at < len(page):
        add(page[at:])
    close(1)
    flush()
    return out


_CONTENT = re.compile(r">(?:article|main)\b[^>]*$|>[^>]*\b(?:article|content|entry|post|story)\b[^>]*$")


def best_container(blocks: list[Block]) -> tuple[str, float]:
    """(path, score) of the container with the most text outside links: a block counts
    in full for its own container and by half for the one around it.  An enclosing
    container that calls itself an article replaces the best one inside it.  Ties go
    to the path first by name; no text: ("", 0)."""
    scores: dict[str, float] = {}
    for b in blocks:
        weight = float(len(b.text) - b.links)
        if weight <= 0:
            continue
        for level, share in ((b.owner, 1.0), (b.owner - 1, 0.5)):
            if level >= 0:
                path = b.paths[level]
                scores[path] = scores.get(path, 0.0) + weight * share
    if not scores:
        return "", 0.0
    best = min(scores, key=lambda p: (-scores[p], p))
    score, outer = scores[best], best
    while ">" in outer:
        outer = outer.rpartition(">")[0]
        if _CONTENT.search(outer):
            best = outer
    return best, score


def text_in(blocks: list[Block], path: str) -> str | None:
    """Blocks inside containers of ``path``, joined by a space; None without one."""
    found = [b.text for b in blocks if path in b.paths]
    return " ".join(found) if found else None


def extract(page: str, host_path: str | None) -> str:
    """Main text by the host's path, or by the page's own best container."""
    blocks = blocks_of(page)
    text = text_in(blocks, host_path) if host_path else None
    if text is None:
        own, _ = best_container(blocks)
        text = text_in(blocks, own) if own else None
    return text or ""


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user and port; "" if there is none."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(rest, r"^.*@", ""), r":\d*$", ""))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path with the largest vote; ties to the path first by
    name.  Pages without text do not vote."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                got = [best_container(blocks_of(t)) for t in texts_of(part, "html")]
                yield pa.RecordBatch.from_arrays(
                    [part.column("host"), pa.array([g[0] for g in got], pa.string()),
                     pa.array([g[1] for g in got], pa.float64())], names=["host", "path", "vote"])

    votes = (pages.select(host_of(F.col("url")).alias("host"), "html")
             .mapInArrow(vote, "host string, path string, vote double").where("vote > 0"))
    summed = votes.groupBy("host", "path").agg(F.sum(F.col("vote").cast("bigint")).alias("vote"))
    return summed.groupBy("host").agg(F.min_by("path", F.struct(-F.col("vote"), F.col("path"))).alias("path"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages`` (page_id, url, html).

    Null or empty html gives an empty text; a null or hostless url belongs to the host
    ""; repeated rows are extracted alike; other columns are ignored; an empty table
    gives no rows."""
    src = pages.select("page_id", "url", "html")
    winners = cut_lineage(host_paths(src))
    keyed = src.withColumn("_host", host_of(F.col("url")))
    if winners.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        joined = keyed.join(F.broadcast(winners), F.col("_host") == F.col("host"), "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")
        split = winners.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = keyed.withColumn("_salt", salt).join(
            split, (F.col("_host") == F.col("host")) & (F.col("_salt") == F.col("_part")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                got = [extract(t, p) for t, p in zip(texts_of(part, "html"), part.column("path").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(got, pa.string()),
                     pa.array([len(g) for g in got], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    id_type = src.schema["page_id"].dataType.simpleString()
    return joined.select("page_id", "url", "html", "path").mapInArrow(
        run, f"page_id {id_type}, url string, text string, n_chars bigint")
