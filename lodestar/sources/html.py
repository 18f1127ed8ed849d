"""HTML pages as a column: label/value blocks, people cards and name tables, by one streaming parser a page."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import published_name

VOID = frozenset({"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"})
BREAKS = frozenset({"p", "div", "li", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "br", "section", "article", "table", "ul", "ol"})


class _Blocks(HTMLParser):
    """Text blocks in order, with their tag, the links inside, and the level of nesting."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, str, list[str]]] = []
        self.text: list[str] = []
        self.links: list[str] = []
        self.stack: list[str] = []
        self.mute = 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).replace(" ", " ").split())
        if text or self.links:
            tag = next((t for t in reversed(self.stack) if t in BREAKS or t in ("strong", "b")), "")
            self.blocks.append((tag, text, self.links))
        self.text, self.links = [], []

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.mute += 1
        if tag in BREAKS or tag in ("strong", "b"):
            self.flush()
        if tag == "a" and (href := dict(attrs).get("href")):
            self.links.append(href)
        if tag not in VOID:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style") and self.mute:
            self.mute -= 1
        if tag in BREAKS or tag in ("strong", "b"):
            self.flush()
        if tag in self.stack:
            while self.stack and self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.mute:
            self.text.append(data)


def blocks(html: str | None) -> list[tuple[str, str, list[str]]]:
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.blocks


def label_values(html: str | None) -> list[tuple[str, int, str, str | None]]:
    """label, ordinal, value, link: a label is a bold, term or heading block (a colon may close it), its values what follows."""
    out, label, n = [], None, 0
    for tag, text, links in blocks(html):
        if tag in ("strong", "b", "dt", "th", "h3", "h4") and text:
            label, n = text.rstrip(" :"), 0
        elif label and (text or links):
            out.append((label, n, text.lstrip(": "), links[0] if links else None))
            n += 1
    return out


def looks_like_a_name(s: str) -> bool:
    words = s.split()
    return 2 <= len(words) <= 8 and not any(c.isdigit() or c in "@:/|" for c in s) and sum(w[0].isupper() for w in words) >= 2


def people(html: str | None) -> list[tuple[str, str | None, str | None]]:
    """name, link, role: blocks that look like a name; the block after it is the role if it isn't a name itself."""
    found = blocks(html)
    out = []
    for i, (_, text, links) in enumerate(found):
        name = published_name(text) or ""
        if looks_like_a_name(name):
            after = found[i + 1][1] if i + 1 < len(found) else ""
            out.append((name, links[0] if links else None, after if after and not looks_like_a_name(published_name(after) or "") else None))
    return out


def page_fields(pages: DataFrame) -> DataFrame:
    """page_id, label, ordinal, value_text, href."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, h in zip(b["page_id"], b["html"]) for r in label_values(h)], columns=["page_id", "label", "ordinal", "value_text", "href"])

    return pages.select("page_id", "html").mapInPandas(scan, "page_id long, label string, ordinal int, value_text string, href string")


def page_people(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, name, href, role. least: fewer rows in all are taken for a broken page and raise."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(i, *r) for i, h in zip(b["page_id"], b["html"]) for r in people(h)], columns=["page_id", "name", "href", "role"])

    out = pages.select("page_id", "html").mapInPandas(scan, "page_id long, name string, href string, role string")
    if least and out.limit(least).count() < least:
        raise ValueError(f"fewer than {least} people")
    return out


def typed_fields(fields: DataFrame, first: dict[str, str], many: dict[str, str], key: str = "project_id") -> DataFrame:
    """Label/value rows to one typed row a key: the first value of the labels in first, the list of those in many."""
    low = F.lower("label")
    aggs = [F.min_by(F.when(low == k.lower(), F.col("value_text")), F.when(low == k.lower(), F.col("ordinal"))).alias(v) for k, v in first.items()]
    aggs += [F.transform(F.array_sort(F.collect_list(F.when(low == k.lower(), F.struct("ordinal", "value_text")))), lambda s: s["value_text"]).alias(v) for k, v in many.items()]
    return fields.groupBy(key).agg(*aggs)
