"""Main text of web pages by nearest-URL page differencing.

A page is cut into lines, one for each block of markup. Every page is paired with the
page whose URL path comes next to its own on the same host, the two pages' lines are
aligned by their longest common subsequence, and the lines that they share are deleted.
Markup helps where differencing alone is wrong, as pages vary their menus and adverts and
articles share sentences: lines inside a marked article are not deleted for being
shared, and lines in menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are dropped in any case. If a page marks an article and it has
at least half of the characters that are left, the rest is not main text.

Defined results: null and empty html give an empty text; markup left open ends with
the page; a page without another on its host, or whose lines the neighbour all has,
keeps the lines that markup doesn't drop; repeated rows are one page;
null ids are ids like any other; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from itertools import accumulate
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, small_batches, table

# HTML elements by what they do to the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {
    "script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "audio", "video", "title",
    "noembed", "noframes", "xmp",
}
CHROME = {"nav", "footer", "aside", "form", "button", "select", "textarea", "dialog", "menu", "head", "datalist"}
BLOCK = {
    "address", "article", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
} | CHROME
ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu",
    "menubar", "toolbar", "status",
}
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "outbrain", "pager", "pagination", "popup", "promo", "promoted", "related", "replies", "reply", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "taboola", "toolbar", "widget",
}

# Inside an article only a container whose whole class or id is one of these goes.
INNER_MARKS = {
    "ad", "ads", "advert", "advertisement", "comment-list", "comment-section", "comments", "disqus_thread", "promo",
    "reader-comments", "respond", "share-buttons", "sponsored",
}
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table"}

# An attribute's value is quoted, or goes on to white space or the end of the tag whatever marks it holds.
_VALUE = r"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)"""
_NAME = r"""[^\s/>=][^\s/>=]*+"""
_ATTRS = rf"""(?:[\s/]++|=|{_NAME}(?:\s*+=\s*+{_VALUE}?+)?+)*+"""
_TAG = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)({_ATTRS})(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+({_VALUE}))?+")
_SPLIT = re.compile(r"[^a-z0-9]+")
# End tags that a start tag implies: an open element of the value ends when one of the key's starts.
_CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}


def _chrome(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in CHROME:
        return True
    if not attrs or tag in ("html", "body", "main", "article"):
        return False
    found: dict[str, str] = {}
    for k, v in _ATTR.findall(attrs):
        found.setdefault(k.lower(), html.unescape(v[1:].removesuffix(v[0]) if v[:1] in ("'", '"') else v))
    if found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    names = [found.get(k, "") for k in ("class", "id")]
    if in_article:
        return tag in CONTAINERS and any(w in INNER_MARKS for n in names for w in n.lower().split())
    return any(w in MARKS for n in names for w in _SPLIT.split(re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "-", n).lower()))


IN_ARTICLE, DROPPED = 1, 2
_BROADCAST_PAGES = 50_000


def page_lines(page: str) -> list[tuple[str, int]]:
    """(line, kind) for each block with text; kind adds up IN_ARTICLE and DROPPED (by markup)."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, whether it is dropped, whether it is an article
    dropped = articles = 0

    def end_line() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            if line:
                out.append((line, IN_ARTICLE * (articles > 0) + DROPPED * (dropped > 0)))
            parts.clear()

    def close(n: int) -> None:
        nonlocal dropped, articles
        while len(stack) > n:
            tag, drop, article = stack.pop()
            if tag in BLOCK or drop:
                end_line()
            dropped -= drop
            articles -= article

    at = 0
    for m in iter(lambda: _TAG.search(page, at), None):
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
                # An inline end tag doesn't close blocks, nor any end tag an article but its own.
                if tag not in BLOCK and stack[i][0] in BLOCK or stack[i][2] and tag not in ("main", "body", "html"):
                    break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            parts.append(" ")
            continue
        if tag in BLOCK:
            end_line()
            if stack and stack[-1][0] == "p":
                close(len(stack) - 1)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in _CLOSES.get(tag, ()):
                    close(i)
                    break
                if stack[i][0] in ("ul", "ol", "dl", "table", "article", "select"):
                    break
        if tag in VOID or m[3].endswith("/"):
            continue
        drop = _chrome(tag, m[3], articles > 0) or (tag == "header" and not articles)
        if drop:
            end_line()
        article = tag in ("article", "main") and not dropped and not drop
        stack.append((tag, drop, article))
        dropped += drop
        articles += article
    if at < len(page):
        parts.append(page[at:])
    close(0)
    end_line()
    return out


def _reach(lines: list[str], other: list[str]) -> list[int]:
    """Length of the longest common subsequence of lines and other[:j], for each j; bit-parallel, a bit for each line of other."""
    n, bits = len(other), {}
    for j, line in enumerate(other):
        bits[line] = bits.get(line, 0) | 1 << j
    full = row = (1 << n) - 1
    for line in lines:
        match = row & bits.get(line, 0)
        row = ((row + match) | (row - match)) & full
    return [0, *accumulate(0 if c == "1" else 1 for c in reversed(f"{row:0{n}b}"))] if n else [0]


def shared(lines: list[str], other: list[str]) -> set[int]:
    """Places in lines of a longest common subsequence with other.

    Halves of lines are matched with the best cut of other, so memory stays linear.
    """
    found, todo = set(), []
    in_other, in_lines = set(other), set(lines)
    at = [i for i, line in enumerate(lines) if line in in_other]
    todo.append((at, [line for line in other if line in in_lines]))
    while todo:
        at, y = todo.pop()
        while at and y and lines[at[0]] == y[0]:
            found.add(at[0])
            at, y = at[1:], y[1:]
        while at and y and lines[at[-1]] == y[-1]:
            found.add(at[-1])
            at, y = at[:-1], y[:-1]
        if not at or not y:
            continue
        if len(at) == 1:
            if lines[at[0]] in y:
                found.add(at[0])
            continue
        half = len(at) // 2
        ahead = _reach([lines[i] for i in at[:half]], y)
        back = _reach([lines[i] for i in reversed(at[half:])], y[::-1])[::-1]
        cut = max(range(len(y) + 1), key=lambda j: ahead[j] + back[j])
        todo += [(at[:half], y[:cut]), (at[half:], y[cut:])]
    return found


def outer_places(kinds: list[int]) -> list[int]:
    """Places of the lines outside marked articles, which alignment may delete."""
    return [i for i, k in enumerate(kinds) if not k & IN_ARTICLE]


def main_lines(lines: list[str], kinds: list[int], common: list[int] | set[int] = ()) -> list[str]:
    """The lines of a page's main text; common: which of outer_places the page shares with its neighbour."""
    outer = outer_places(kinds)
    gone = {outer[i] for i in common}
    left = [i for i, k in enumerate(kinds) if not k & DROPPED and i not in gone]
    if not left:
        left = [i for i, k in enumerate(kinds) if not k & DROPPED]
    inside = [i for i in left if kinds[i] & IN_ARTICLE]
    size = lambda at: sum(len(lines[i]) for i in at)
    return [lines[i] for i in (inside if 2 * size(inside) >= size(left) else left)]


def _host_path(url: str | None) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or "").removeprefix("www."), parts.path.rstrip("/") or "/"
    except ValueError:
        return "", url or ""


def _scan(batches):
    for b in batches:
        got = [page_lines(h or "") for h in b.column(2).to_pylist()]
        sites = [_host_path(u) for u in b.column(1).to_pylist()]
        outer = [[x for x, k in g if not k & IN_ARTICLE] for g in got]
        columns = [pa.array([s[i] for s in sites], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), *columns, pa.array(outer, pa.list_(pa.string()))], ["row", "host", "path", "outer"],
        )


def _align(batches):
    for b in batches:
        common = [sorted(shared(x, y)) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(common, pa.list_(pa.int32()))], ["row", "common"])


def _extract(batches):
    for b in batches:
        out = []
        for page, common in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            got = page_lines(page or "")
            out.append(main_lines([x for x, _ in got], [k for _, k in got], common or ()))
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.list_(pa.string()))], ["page_id", "url", "lines"],
        )


def _neighbours(light: DataFrame) -> DataFrame:
    """(row, other): the page next in URL order on the same host, or else the one before, of (row, host, path).

    The rows are range-sorted over the cluster, so that no task holds a large host; the
    first and the last row of each range meet those of the ranges beside it.
    """
    key = ("host", "path", "row")
    ranged = settle(
        light.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id()), "ranged",
    )
    by = Window.partitionBy("part").orderBy(*key)
    sites = F.struct("host", "row")
    inside = ranged.select(
        "part", "row", "host", F.lead(sites).over(by).alias("next"), F.lag(sites).over(by).alias("before"),
    )
    # One row a range.
    parts = Window.orderBy("part")
    ends = ranged.groupBy("part").agg(F.min(F.struct(*key)).alias("first"), F.max(F.struct(*key)).alias("last"))
    ends = ends.select("part", F.lead("first").over(parts).alias("after"), F.lag("last").over(parts).alias("ahead"))
    met = inside.join(F.broadcast(ends), "part")
    same = lambda inner, outer: F.coalesce(
        F.when(F.col(f"{inner}.host") == F.col("host"), F.col(f"{inner}.row")),
        F.when(F.col(inner).isNull() & (F.col(f"{outer}.host") == F.col("host")), F.col(f"{outer}.row")),
    )
    return met.select("row", F.coalesce(same("next", "after"), same("before", "ahead")).alias("other"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, lines (of the main text, in page order)."""
    small_batches(pages.sparkSession)
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    key = F.unhex(F.md5(F.concat_ws("\x01", name(id_col), name(url_col), name(html_col)).cast("binary")))
    cut = pages.select(
        key.alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
        F.col(html_col).alias("html"),
    )
    # What alignment can delete, which is little where the article is marked; repeated rows once.
    light = cut.select("row", "url", "html").mapInArrow(
        _scan, "row binary, host string, path string, outer array<string>",
    )
    light = settle(light.dropDuplicates(["row"]), "outer")
    near = _neighbours(light.select("row", "host", "path")).where("other is not null")
    both = near.join(light.select("row", "outer"), "row").join(
        light.select(F.col("row").alias("other"), F.col("outer").alias("others")), "other",
    )
    common = settle(
        both.select("row", "outer", "others").mapInArrow(
            _align, "row binary, common array<int>",
        ).where("size(common) > 0"),
        "common",
    )
    # Pages that share lines outside their article are sent to all tasks up to a number that is counted, so that pages needn't move.
    common = F.broadcast(common) if common.count() <= _BROADCAST_PAGES else common
    return (
        cut.join(common, "row", "left")
        .select("page_id", "url", "html", "common")
        .mapInArrow(_extract, "page_id long, url string, lines array<string>")
    )


def query(spark, sf_dir: str) -> DataFrame:
    rows = extract_text(table(spark, sf_dir, "pages"))
    text = F.array_join("lines", " ")
    return rows.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
