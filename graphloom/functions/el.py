"""Expression-language scanning of page texts."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expressions(text: str) -> list[str]:
    """The `#{...}` and `${...}` expressions of a text: braces nest, quoted ones don't count, open ends are dropped."""
    out, at = [], 0
    while at < len(text) - 1:
        if text[at] not in "#$" or text[at + 1] != "{":
            at += 1
            continue
        level, quote, i = 1, "", at + 2
        while i < len(text) and level:
            c = text[i]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                level += (c == "{") - (c == "}")
            i += 1
        if level:
            break
        out.append(text[at:i])
        at = i
    return out


class _Page(HTMLParser):
    """(tag, attribute or empty for text, expression), tags in document order, attributes before direct text."""

    _void = {
        "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
    }

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags: list[tuple[str, list[tuple[str, str]]]] = []
        self.open: list[int] = []

    def handle_starttag(self, tag, attrs):
        self.tags.append((tag, [(k, e) for k, v in attrs for e in expressions(v or "")]))
        if tag not in self._void:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag, attrs):
        self.tags.append((tag, [(k, e) for k, v in attrs for e in expressions(v or "")]))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[i]][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open:
            self.tags[self.open[-1]][1].extend(("", e) for e in expressions(data))


def page_actions(html: str) -> list[tuple[str, str, str]]:
    page = _Page()
    page.feed(html)
    page.close()
    return [(tag, attr, e) for tag, found in page.tags for attr, e in found]


def el_expressions(texts: DataFrame, col: str = "text") -> DataFrame:
    """texts with el, one row for each expression, and its position."""

    @F.pandas_udf("array<string>")
    def scan(s: pd.Series) -> pd.Series:
        return s.map(lambda t: expressions(t or ""))

    return texts.select("*", F.posexplode(scan(F.col(col))).alias("pos", "el"))
