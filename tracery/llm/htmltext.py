"""Main text of web pages by nearest-URL page differencing.

The pages of a host are sorted by URL path, pages with equal text lines merged; a page's
partner is the neighbour whose path shares the longest beginning with its own.  The text
lines (blocks) of both are aligned by a longest common subsequence, and lines that the
pages share are deleted: they are the site's, not the page's.

Differencing alone cannot give right results: a host may have one page only, articles
quote each other, and menus differ from page to page.  So the markup has the last word
where it speaks: lines in an ``article`` or ``main`` element stay even if shared, and
lines in elements that are boilerplate by name, class, id or role go even if not.

A page's lines cross the network as hashes.  The order of all pages is cut into ranges by
their keys, so a host of any size is dealt over many tasks, and each range knows the last
page before it and the first behind it: partners do not depend on the partitioning.
"""

from __future__ import annotations

import html
import os
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Elements without text of their own, removed with all they hold.
MUTE = "script|style|noscript|template|textarea|select|iframe|svg|canvas"
#: Elements removed with all they hold unless they stand in an article.
MUTE_OUTSIDE = frozenset({"math", "object", "title"})
#: Elements that are boilerplate wherever they stand.
BOILERPLATE = {"nav", "footer", "aside", "form", "button", "dialog", "menu"}
#: Words in a class, id or role that mark an element as boilerplate.
MARKS = frozenset(
    "ad ads advert advertisement advertising adverts banner banners breadcrumb breadcrumbs comment comments complementary consent "
    "contentinfo cookie cookies discussion disqus footer gdpr header login masthead menu menubar menus modal nav navbar navigation "
    "newsletter notice notices notification pagination popup promo promoted related reply replies respond search share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe toc toolbar widget widgets alert alertdialog".split()
)
#: Marks that inside an article mean the article's own head.
TITLES = frozenset({"header", "masthead"})
#: Elements that end one block and begin another.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 "
    "h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead "
    "tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A closing tag of these ends the open elements inside it; others without an end tag are left open.
HOLDERS = frozenset("article aside body center dialog div fieldset figure footer form header html main menu nav ol section table td tr ul button".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<mute>{MUTE})\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=mute)\s*>|\Z)|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"[\s\x00]+")


def _is_boilerplate(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BOILERPLATE or (tag == "header" and not in_article):
        return True
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            return True
        marks = MARKS - TITLES if in_article else MARKS
        if name in ("class", "id", "role") and marks & set(re.split(r"[\s_-]+", value)) and tag not in ("html", "body", "article", "main"):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, in an article, in boilerplate) of each block of a page that has text, in page order."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in an article, in boilerplate
    article = mute = False
    buffer: list[str] = []
    skipped = ""  # an element of MUTE_OUTSIDE, until it ends

    def flush() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(buffer))).strip()
        buffer.clear()
        if text:
            out.append((text, article, mute))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at and not skipped:
            buffer.append(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if tag in MUTE_OUTSIDE and not article and not m["attrs"].endswith("/"):
            skipped = "" if m["end"] else tag
        elif tag in ("article", "main", "body"):
            skipped = ""  # it was never closed
        if not tag or skipped:
            continue
        if tag == "br":
            buffer.append(" ")
        if tag not in BLOCKS and tag not in HOLDERS:
            continue
        flush()
        if tag in VOID:
            continue
        if m["end"]:
            if tag in HOLDERS and any(s[0] == tag for s in stack):
                while stack.pop()[0] != tag:
                    pass
        elif tag in HOLDERS and not m["attrs"].endswith("/"):
            inside = article or tag in ("article", "main")
            stack.append((tag, inside, mute or _is_boilerplate(tag, m["attrs"], article)))
        elif tag not in HOLDERS and m["attrs"] and _is_boilerplate(tag, m["attrs"], article):
            # a block such as p or li without a reliable end: it is judged until the next block begins
            stack.append((tag, article, True))
            article, mute = stack[-1][1:]
            continue
        while stack and stack[-1][0] not in HOLDERS:
            stack.pop()
        article, mute = stack[-1][1:] if stack else (False, False)
    if not skipped:
        buffer.append(page[at:])
    flush()
    return out


def shared_lines(a: list, b: list) -> set[int]:
    """Positions of ``a`` in a longest common subsequence with ``b``."""
    where: dict = {}
    for j, line in enumerate(b):
        where.setdefault(line, []).append(j)
    ends: list[int] = []
    tails: list[tuple | None] = []
    for i, line in enumerate(a):
        for j in reversed(where.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, tails[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                tails.append(node)
            else:
                ends[k], tails[k] = j, node
    found, node = set(), tails[-1] if tails else None
    while node is not None:
        found.add(node[0])
        node = node[1]
    return found


def main_text(lines: list[tuple[str, bool, bool]], theirs: list[int] | None) -> str:
    """The page's text, given the hashes of its partner's lines."""
    shared = shared_lines(hashes_of(lines), theirs) if theirs is not None else set()
    marked = any(x[1] and not x[2] for x in lines)
    kept = [text for k, (text, article, mute) in enumerate(lines) if not mute and (article if marked else k not in shared)]
    return " ".join(kept)


def hashes_of(lines: list[tuple[str, bool, bool]]) -> list[int]:
    """A signed 64-bit hash of each line."""
    return np.array([xxhash.xxh64_intdigest(x[0].encode("utf-8", "replace")) for x in lines], np.uint64).view(np.int64).tolist()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The line hashes of each page and one hash of them all."""
    for batch in batches:
        lines = [np.array(hashes_of(lines_of(h)), np.int64) for h in batch.column("html").to_pylist()]
        every = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in lines], np.uint64).view(np.int64)
        columns = [*(batch.column(c) for c in ("host", "path", "page_hash")), pa.array(every), pa.array(lines, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "page_hash", "lines_hash", "lines"])


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the neighbours on the same host, the lines of the one with the longer common beginning of the path, the one before if equal."""
    for batch in batches:
        theirs = []
        for host, path, before, after in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "before", "after")), strict=True):
            near = [(len(os.path.commonprefix([path, x["path"]])), x["lines"]) for x in (before, after) if x is not None and x["host"] == host]
            theirs.append(max(near, key=lambda x: x[0])[1] if near else None)
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("lines_hash"), pa.array(theirs, pa.list_(pa.int64()))], names=["host", "lines_hash", "theirs"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(lines_of(page), theirs) for page, theirs in zip(batch.column("html").to_pylist(), batch.column("theirs").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), pa.array(texts, pa.string())], names=["page", "url", "text"])


def nearest_pages(lines: DataFrame) -> DataFrame:
    """(host, lines_hash, theirs): the partner's lines for each content of ``lines(host, path, lines_hash, lines)``; null on a host with one content."""
    merged = lines.groupBy("host", "lines_hash").agg(F.min(F.struct("path", "lines")).alias("m")).select("host", "m.path", "lines_hash", "m.lines")
    order = ["host", "path", "lines_hash"]
    ranged = merged.repartitionByRange(*order).select("*", F.spark_partition_id().alias("part"))
    ranged = written(ranged, "ranges")
    inner = Window.partitionBy("part").orderBy(*order)
    row = F.struct("host", "path", "lines")
    near = ranged.select("*", F.lag(row).over(inner).alias("b"), F.lead(row).over(inner).alias("a"))
    # one row per range
    whole = F.struct(*order, row.alias("row"))
    ends = ranged.groupBy("part").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))
    outer = Window.orderBy("part")
    borders = ends.select("part", F.lag("last.row").over(outer).alias("b0"), F.lead("first.row").over(outer).alias("a0"))
    both = near.join(written(borders, "borders"), "part").select("host", "path", "lines_hash", F.coalesce("b", "b0").alias("before"), F.coalesce("a", "a0").alias("after"))
    return both.mapInArrow(_partners, "host string, lines_hash long, theirs array<long>")


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Return (id, url, text, n_chars) for every row of ``pages``.

    Character references are decoded, white space inside a block becomes one space,
    blocks are joined by one space in page order.  A null or empty page, or one without
    main text, has the empty text.  A null url, or one without a host, belongs to the
    host "".  Pages of a host with equal lines have one partner.  Rows that repeat an id
    are rows of their own.  Other columns are ignored.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    html_text = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), host.alias("host"), path.alias("path"), F.xxhash64(html_text, F.length(html_text)).alias("page_hash"), html_text.alias("html"))
    parsed = rows.select("host", "path", "page_hash", "html").mapInArrow(_parsed, "host string, path string, page_hash long, lines_hash long, lines array<long>")
    lines = written(parsed, "lines")
    partners = written(nearest_pages(lines), "partners")
    contents = lines.groupBy("host", "page_hash").agg(F.min("lines_hash").alias("lines_hash"))
    known = written(contents.join(partners, ["host", "lines_hash"]).select("host", "page_hash", "theirs"), "known")
    kind = pages.schema[id_col].dataType.simpleString()
    out = rows.join(known, ["host", "page_hash"]).select("page", "url", "html", "theirs").mapInArrow(_extracted, f"page {kind}, url string, text string")
    return out.select(F.col("page").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("long").alias("n_chars"))
