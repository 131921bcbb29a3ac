"""Excerpts of whole texts: the window of words that says most about a query, chosen among several candidates.

Linear in a text, and native but for fitting_window: windows begin at every stride-th word and are cut from that many words and those that
follow, so that no text is laid out word by word, and no text is cut before it is read.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import TOKEN, let, tokens_of
from sievework.functions.vocabulary import PUNCTUATION
from sievework.operators.paragraphs import fact_density, rank_paragraphs, split_paragraphs

# Words that say nothing about what a page is asked for, short ones that do, and where a sentence ends.
FOCUS_STOPWORDS = (
    "official", "form", "annual", "quarterly", "company", "document", "specification", "section", "sections", "discussion", "definition", "definitions", "policy", "basis", "changes", "change", "latest", "update", "version", "query",
)
SHORT_FOCUS = ("rfc", "cet1")
SENTENCE_END = r"(?<=[.!?。！？；;]) "
BEFORE, AFTER = 8, 17  # chunks of a page around one that is hit
_TOKEN = re.compile(TOKEN)
_FOLDED = str.maketrans({k: v if v != " " else "," for k, v in PUNCTUATION.items()})  # without new spaces, so that words keep their places


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def query_terms(query: Column) -> Column:
    """Distinct tokens: years, ASCII ones of four characters and more, and all others."""
    return F.array_distinct(F.filter(tokens_of(query), lambda t: (F.length(t) >= 4) | ~t.rlike("^[a-z0-9]")))


def focus_terms(query: Column) -> Column:
    """Query terms without years and words that say little."""
    kept = lambda t: t.isin(*SHORT_FOCUS) | (((F.length(t) >= 4) | ~t.rlike("^[a-z0-9]")) & ~t.rlike("^[0-9]{4}$") & ~t.isin(*FOCUS_STOPWORDS))
    return F.array_distinct(F.filter(tokens_of(query), kept))


def hits(text: Column, terms: Column) -> Column:
    """How many of the distinct terms are tokens of the text."""
    return F.size(F.array_intersect(terms, tokens_of(text)))


def whole_words(text: Column, most: int) -> Column:
    """The words that a text of at most so many characters begins with, at least one; text is clean but for a space at its end."""
    head = F.regexp_extract(F.substring(text, 1, most + 1), "(?s)^(.*) ", 1)
    return F.when(F.length(F.rtrim(text)) <= most, F.rtrim(text)).when(head != "", head).otherwise(F.regexp_extract(text, "^[^ ]+", 0))


def windows(text: Column, most: int, stride: int) -> Column:
    """The windows of at most so many characters that begin at every stride-th word of a clean text.

    Groups of stride words have 2 * stride characters at least, so that a few of them hold any window.
    """
    groups = F.regexp_extract_all(text, F.lit(f"(?:[^ ]+ ?){{1,{stride}}}"), F.lit(0))
    enough = (most + 1) // (2 * stride) + 2
    return let(groups, lambda g: F.transform(g, lambda x, i: whole_words(F.array_join(F.slice(g, i + 1, enough), ""), most)))


def best_words(text: Column, terms: Column, most: int, stride: int = 12) -> Column:
    """Of a text's windows the one with most terms, then most words, then nearest to the limit, then the first; a text that fits is its own.

    A text of one word that is too long is cut at the limit. Null is an empty text.
    """

    def best(x: Column) -> Column:
        ranked = F.transform(windows(x, most, stride), lambda w, i: F.struct(hits(w, terms).alias("hits"), F.regexp_count(w, F.lit("[^ ]+")).alias("words"), (-F.abs(F.length(w) - most)).alias("near"), (-i).alias("at"), w.alias("window")))
        return F.when(F.length(x) <= most, x).when(~x.contains(" "), F.substring(x, 1, most)).otherwise(F.array_max(ranked)["window"])

    return let(clean(text), best)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, SENTENCE_END), lambda s: F.trim(s) != "")


def page_excerpt(text: Column, terms: Column, most: int) -> Column:
    """The best window of the sentence that holds most terms (of equals the one nearest to the limit, then the first), or of the whole text where no sentence holds any."""

    def chosen(x: Column) -> Column:
        ranked = F.transform(sentences(x), lambda s, i: F.struct(hits(s, terms).alias("hits"), (-F.abs(F.length(s) - most)).alias("near"), (-i).alias("at"), s.alias("sentence")))
        return let(F.array_max(ranked), lambda b: best_words(F.when(b["hits"] > 0, b["sentence"]).otherwise(x), terms, most))

    return let(clean(text), lambda x: F.when(F.length(x) <= most, x).otherwise(chosen(x)))


def rank_of(excerpt: Column, terms: Column, most: int) -> Column:
    """What excerpts are compared by: density and twice the hits, hits, nearness to the limit."""
    return let(clean(excerpt), lambda x: let(hits(x, terms), lambda n: F.struct((fact_density(x) + n * 2.0).alias("worth"), n.alias("hits"), (-F.abs(F.length(x) - most)).alias("near"))))


def dense_excerpts(pages: DataFrame, key: str, text: str, terms: str, most: int = 320) -> DataFrame:
    """(key, dense): the best window of a page's three densest paragraphs; pages without any are absent. key is unique."""
    parts = split_paragraphs(pages, key, text, 40, max(most, 360)).join(pages.select(key, terms), key)
    best = rank_paragraphs(parts, key, F.col(terms), limit=3, least=1.0)
    x = best.withColumn("_window", best_words(F.col("paragraph"), F.col(terms), most))
    x = x.withColumn("_rank", F.struct(rank_of(F.col("_window"), F.col(terms), most).alias("r"), (-F.col("rank")).alias("at"), F.col("_window").alias("window")))
    return x.groupBy(key).agg(F.max("_rank")["window"].alias("dense"))


def snippets(pages: DataFrame, key: str, text: str = "text", candidate: str = "candidate", terms: str = "terms", most: int = 320) -> DataFrame:
    """(key, snippet): the candidate text, the best sentence's window or the densest paragraph's, whichever says most; of equals the first of them.

    Empty candidates of either sort are passed over; null texts are empty, and a page without any text keeps its candidate. key is unique.
    """
    x = pages.select(key, clean(F.col(candidate)).alias("_candidate"), page_excerpt(F.col(text), F.col(terms), most).alias("_page"), F.col(terms).alias("_terms"))
    x = x.withColumn("_candidate", F.rtrim(F.substring("_candidate", 1, most)))
    x = x.join(dense_excerpts(pages.where(F.col(text).isNotNull()), key, text, terms, most), key, "left")
    options = F.filter(F.array(*(F.struct(F.col(c).alias("text"), F.lit(-i).alias("at")) for i, c in enumerate(("_candidate", "_page", "dense")))), lambda o: F.coalesce(o["text"], F.lit("")) != "")
    ranked = F.transform(options, lambda o: F.struct(rank_of(o["text"], F.col("_terms"), most).alias("r"), o["at"].alias("at"), o["text"].alias("text")))
    return x.select(key, F.coalesce(F.array_max(ranked)["text"], F.lit("")).alias("snippet"))


def text_nodes(html: Column) -> Column:
    """The texts of a page in order: its title, and what is between the tags of its main part, its body or, without either, of all of it; scripts, styles and comments dropped."""
    x = html
    for tag in ("script", "style", "noscript"):
        x = F.regexp_replace(x, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")

    def decoded(part: Column) -> Column:
        for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
            part = F.replace(part, F.lit(name), F.lit(char))
        return clean(part)

    def nodes(x: Column) -> Column:
        title, main, body = (F.regexp_extract(x, rf"(?is)<{tag}\b[^>]*>(.*?)(?:</{tag}\s*>|\z)", 1) for tag in ("title", "main", "body"))
        own = F.when(main != "", main).when(body != "", body).otherwise(x)
        return F.filter(F.transform(F.concat(F.array(title), F.split(own, "<[^>]*>")), decoded), lambda n: n != "")

    return let(x, nodes)


def _held(terms: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many of the terms, given by the places of words that hold them, occur from starts to ends."""
    n = np.zeros(len(starts), np.int64)
    for places in terms:
        n += np.append(places, np.iinfo(np.int64).max)[np.searchsorted(places, starts)] < ends
    return n


def fitting_window(chunks: list[str], terms: set[str], focus: set[str], most: int, stride: int = 4) -> str | None:
    """The window of aligned_excerpts(); None where no chunk is hit.

    A window is known by its first word, unless the end of the chunks around a hit cuts it. So each word's window is
    ranked once, a hit takes the best one that ends within its chunks, and the first of those that are cut there, which
    holds what the later ones hold and more.
    """
    text = " ".join(chunks)
    low = text.translate(_FOLDED).lower()
    begins = lambda x: np.concatenate(([0], np.flatnonzero(np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) == 32) + 1, [len(x) + 1]))
    places: dict[str, list[int]] = {}
    for m in _TOKEN.finditer(low):
        if (t := m[0]) in terms or t in focus:
            places.setdefault(t, []).append(m.start())
    if not places:
        return None
    of = begins(low)
    places = {t: np.searchsorted(of, p, "right") - 1 for t, p in places.items()}
    asked, own = ([places[t] for t in names if t in places] for names in (terms, focus))
    char = begins(text)
    first = np.concatenate(([0], np.cumsum([c.count(" ") + 1 for c in chunks])))
    mine = _held(own, first[:-1], first[1:])
    hit = np.flatnonzero((mine > 0) | (_held(asked, first[:-1], first[1:]) > 0))
    los, his = first[np.maximum(hit - BEFORE, 0)], first[np.minimum(hit + AFTER + 1, len(chunks))]

    size = lambda s, e: char[e] - 1 - char[s]
    start = np.arange(len(char) - 1)
    end = np.maximum(np.searchsorted(char, char[:-1] + most + 1, "right") - 1, start + 1)
    held, near = _held(own, start, end), np.abs(size(start, end) - most)
    rank = np.empty(len(start), np.int64)
    rank[np.lexsort((-start, -near, end - start, held))] = start
    cut = los + -(-np.maximum(np.searchsorted(end, his, "right") - los, 0) // stride) * stride
    found = np.array([lo + stride * int(rank[lo:c:stride].argmax()) if c > lo else lo for lo, c in zip(los, cut, strict=True)])
    worth = lambda s, e: np.stack((_held(own, s, e), e - s, -np.abs(size(s, e) - most)))
    ends, clipped = np.minimum(end[found], his), np.minimum(cut, his - 1)
    a, b = worth(found, ends), worth(clipped, his)
    more = (b[0] > a[0]) | ((b[0] == a[0]) & ((b[1] > a[1]) | ((b[1] == a[1]) & (b[2] > a[2]))))
    other = (cut < his) & more
    fits = size(los, his) <= most
    s, e = np.where(fits, los, np.where(other, clipped, found)), np.where(fits | other, his, ends)
    near = np.abs(np.where(his - los == 1, np.minimum(size(s, e), most), size(s, e)) - most)
    best = np.lexsort((-hit, -near, mine[hit], _held(asked, s, e), _held(own, s, e)))[-1]
    window = text[char[s[best]] : char[e[best]] - 1]
    return window[:most] if his[best] - los[best] == 1 else window


def _fitting(most: int):
    """fitting_window as a function of (chunks, one a line, terms, focus); null chunks give null."""

    @F.pandas_udf(T.StringType())
    def fitting(chunks: pd.Series, terms: pd.Series, focus: pd.Series) -> pd.Series:
        own = lambda x: set() if x is None else set(x)
        return pd.Series([fitting_window(c.split("\n"), own(t), own(f), most) if c else None for c, t, f in zip(chunks, terms, focus, strict=True)], dtype=object)

    return fitting.asNondeterministic()  # so that it is no part of a later expression, which would compute it again


def _aligned(pages: DataFrame, name: str, html: Column, terms: str, focus: str, most: int) -> DataFrame:
    """pages with an excerpt under a name; null where html is null."""
    x = pages.withColumn("_nodes", text_nodes(html))
    x = x.withColumn("_found", _fitting(most)(F.array_join("_nodes", "\n"), F.col(terms), F.col(focus)))
    whole = F.when(F.col("_found") != "", F.col("_found")).otherwise(page_excerpt(F.array_join("_nodes", " "), F.col(terms), most))
    return x.withColumn(name, F.when(F.col("_nodes").isNotNull(), whole)).drop("_nodes", "_found")


def aligned_excerpts(pages: DataFrame, key: str, html: Column, terms: str, focus: str, most: int = 260) -> DataFrame:
    """(key, excerpt): the window that fits a query best around the texts of a page that are hit; without hits, page_excerpt() of the page.

    terms and focus: the query's terms, and those that the hit's title and snippet lack. Pages are read whole, in one pass and without
    an exchange; around a hit, eight chunks before it and 17 behind it count. Best: focus terms, terms, focus terms of the hit itself, nearness to the limit, the first.
    """
    return _aligned(pages, "excerpt", F.coalesce(html, F.lit("")), terms, focus, most).select(key, "excerpt")


def two_depths(pages: DataFrame, key: str, html: str, terms: str, focus: str, first: int = 650_000, deep: int | None = None, most: int = 260, enough: int = 2) -> DataFrame:
    """(key, excerpt, depth): from a page's first characters if that excerpt has enough focus terms, else from deep characters (None: all) if that has no fewer.

    The second depth is read only for pages that the first doesn't settle and that go on behind it.
    """
    x = pages.select(key, terms, *([focus] if focus != terms else []), F.coalesce(F.col(html), F.lit("")).alias("_html"))
    x = _aligned(x, "_a", F.substring("_html", 1, first), terms, focus, most).withColumn("_ha", hits(F.col("_a"), F.col(focus)))
    again = F.when((F.col("_ha") < enough) & (F.length("_html") > first), F.col("_html") if deep is None else F.substring("_html", 1, deep))
    x = _aligned(x, "_b", again, terms, focus, most)
    x = x.withColumn("_deeper", F.coalesce((F.col("_b") != "") & (hits(F.col("_b"), F.col(focus)) >= F.col("_ha")), F.lit(False)) | (F.col("_b").isNotNull() & (F.col("_a") == "")))
    return x.select(key, F.when(F.col("_deeper"), F.col("_b")).otherwise(F.col("_a")).alias("excerpt"), F.when(F.col("_deeper"), 2).otherwise(1).alias("depth"))
