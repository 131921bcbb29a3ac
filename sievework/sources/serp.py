"""Result pages of search engines and links of pages, read from captured HTML.

HTML needs a real parser; pages go through Arrow batches of pandas frames, a row for each result comes back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import host
from sievework.sources.payloads import redirect_target

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator["Node"]:
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def is_a(self, tag: str | None, name: str | None) -> bool:
        return (tag is None or self.tag == tag) and (name is None or name in (self.attrs.get("class") or "").split())

    def find(self, tag: str | None = None, name: str | None = None) -> list["Node"]:
        return [n for n in self.walk() if n.is_a(tag, name)]

    def text(self) -> str:
        parts = [c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.tag not in ("script", "style")]
        return " ".join(" ".join(parts).split())


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [Node("")]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, dict(attrs))
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.stack[0]


# Where each engine puts a result, its link and its text, as (tag, class).
LAYOUTS = {
    "duckduckgo": (("div", "result"), [("a", "result__a")], [(None, "result__snippet")]),
    "bing": (("li", "b_algo"), [("h2", None), ("a", None)], [(None, "b_caption"), ("p", None)]),
    "google": (("div", "g"), [("a", None)], [(None, "VwiC3b")]),
}


def _down(node: Node, path: list[tuple[str | None, str | None]]) -> Node | None:
    """The first node under node that lies on the path."""
    for step in path:
        found = node.find(*step)
        if not found:
            return None
        node = found[0]
    return node


def results_of(html: str | None, engine: str) -> list[tuple[str, str, str]]:
    """(title, href, snippet) of each result with a link."""
    box, link, snippet = LAYOUTS[engine]
    out = []
    for b in parse(html).find(*box):
        a, s = _down(b, link), _down(b, snippet)
        if a is not None and a.attrs.get("href"):
            out.append((a.text(), a.attrs["href"], s.text() if s is not None else ""))
    return out


def _exploded(df: DataFrame, key: str, html: str, rows: Callable[[object], list[tuple]], fields: list[str], more: str | None = None) -> DataFrame:
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = zip(b[key], b[html], b[more] if more else b[html], strict=True)
            found = [(k, i, *r) for k, page, other in pages for i, r in enumerate(rows((page, other) if more else page))]
            yield pd.DataFrame(found, columns=[key, "pos", *fields])

    columns = [key, html, *([more] if more else [])]
    return df.select(*columns).mapInPandas(run, f"{key} {kind}, pos int, " + ", ".join(f"{f} string" for f in fields))


def results(df: DataFrame, engine: str, key: str, html: str = "payload") -> DataFrame:
    """(key, pos, title, url, snippet) of each result of each page; redirects are followed to their targets."""
    x = _exploded(df, key, html, lambda page: results_of(page, engine), ["title", "url", "snippet"])
    return x if engine == "google" else x.withColumn("url", redirect_target(F.col("url")))


def links(df: DataFrame, key: str, html: str, base: str, hosts: tuple[str, ...] = (), markers: tuple[str, ...] = ()) -> DataFrame:
    """(key, pos, text, url): a page's links as whole addresses, once each; on the hosts and with a marker in address or text, if these are given."""

    def found(page: tuple) -> list[tuple]:
        page_html, at = page
        own = [(a.text(), urljoin(at or "", a.attrs["href"])) for a in parse(page_html).find("a") if a.attrs.get("href")]
        once: dict[str, tuple] = {}
        for t, u in own:
            if u.startswith(("http://", "https://")):
                once.setdefault(u, (t, u))
        return list(once.values())

    x = _exploded(df, key, html, found, ["text", "url"], base)
    if hosts:
        under = F.lit(False)
        for h in hosts:
            under = under | (host(F.col("url")) == h) | host(F.col("url")).endswith(f".{h}")
        x = x.where(under)
    if markers:
        hit: Column = F.lit(False)
        for m in markers:
            hit = hit | F.lower("url").contains(m) | F.lower("text").contains(m)
        x = x.where(hit)
    return x
