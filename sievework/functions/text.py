"""Text expressions: normal forms, tokens, dates, addresses. All but normalize_unicode are native."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.vocabulary import PUNCTUATION

TOKEN = r"[a-z0-9]+|[一-鿿]"
_HAN = re.compile("[一-鿿]")
_ASCII = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))  # other bytes part tokens
_FOLD = str.maketrans(PUNCTUATION)
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")  # what (?U)\s is in Java


@F.pandas_udf(T.StringType())
def normalize_unicode(text: pd.Series) -> pd.Series:
    """NFKC, for which there is no built-in function."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def normalize_query(text: Column, unicode: bool = False) -> Column:
    """Lower case, punctuation folded, white space collapsed; with unicode after NFKC (needless for ASCII)."""
    folded = F.translate(normalize_unicode(text) if unicode else text, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(folded, r"^(?U)\s+|(?U)\s+$", ""))), r"(?U)\s+", " ")


def tokens(normal: Column) -> Column:
    """Runs of ASCII letters and digits, and single CJK characters, of a normal text."""
    return F.regexp_extract_all(normal, F.lit(TOKEN), F.lit(0))


def tokens_of(text: Column) -> Column:
    """tokens(normalize_query(text)) without the passes over white space, of which tokens have none."""
    return tokens(F.lower(F.translate(text, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))))


def token_set(low: str) -> set[str]:
    """The distinct tokens_of() a text in lower case, in Python."""
    said = {*low.encode().translate(_ASCII).decode("ascii").split()}
    return said if low.isascii() else said.union(_HAN.findall(low))


def normalized(low: str) -> str:
    """normalize_query() of a text in lower case, in Python."""
    return _SPACE.sub(" ", low.translate(_FOLD)).strip(" ")


def let(value: Column, f) -> Column:
    """f(value), with value computed once: lambdas within f would compute an expression again for each element."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def token_estimate(text: Column) -> Column:
    """Words between white space; 0 for an empty text."""
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def content_terms(words: Column, stopwords: tuple[str, ...] = (), least: int = 4, digits: bool = False, short: tuple[str, ...] = ()) -> Column:
    """Distinct tokens that carry meaning: CJK ones, and ASCII ones of some length (or named short ones) that are no stop words; years only with digits."""

    def keep(t: Column) -> Column:
        long = (F.length(t) >= least) & (F.lit(digits) | ~t.rlike("^[0-9]{4}$"))
        kept = (long | t.rlike(r"^[一-鿿]")) & (~t.isin(*stopwords) if stopwords else F.lit(True))
        return kept | t.isin(*short) if short else kept

    return F.array_distinct(F.filter(words, keep))


def join_series(items: Column, han: Column | None = None) -> Column:
    """series() of the filled items, in Chinese where han holds."""
    items = F.filter(items, lambda i: F.coalesce(i, F.lit("")) != "")
    if han is None:
        return series(items)
    n = F.size(items)
    head, last = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), "、"), F.get(items, n - 1)
    chinese = F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit("和"), last)).otherwise(F.concat(head, F.lit("，以及"), last))
    return F.when(han, chinese).otherwise(series(items))


def policy_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, r"(?i)\bmirror\b", "")), r"[^a-z0-9一-鿿]+", " "))


def academic_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(title, r"(?i)\bworking paper\b|\bpreprint\b", "")), "[^a-z0-9]+", " "))


def industry_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "))


def slug(title: Column) -> Column:
    return F.replace(policy_title(title), F.lit(" "), F.lit("-"))


def record_id(source: Column, url: Column, snippet: Column) -> Column:
    """source:hash of the address and the text."""
    return F.concat(source, F.lit(":"), F.substring(F.sha1(F.concat(url, F.lit("|"), snippet).cast("binary")), 1, 12))


def canonical_url(url: Column) -> Column:
    """Scheme and authority in lower case, path without its last slashes; no query, no fragment."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)", i)
    return F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""))).otherwise(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""))


def host(url: Column) -> Column:
    """Lower case, without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def recency(text: Column) -> Column:
    """Days since 0001-01-01 (that day is 1) of the first 20YY-MM-DD; 0 without a date or with an impossible one."""
    at = lambda i: F.regexp_extract(text, r"(20[0-9]{2})[-_/]([0-9]{2})[-_/]([0-9]{2})", i)
    day = F.try_to_date(F.nullif(F.concat_ws("-", at(1), at(2), at(3)), F.lit("--")), "yyyy-MM-dd")
    return F.coalesce(F.datediff(day, F.lit("1970-01-01").cast("date")) + 719163, F.lit(0))


def iso_date(text: Column) -> Column:
    """The first ISO date, else the first Chinese one, as YYYY-MM-DD; null without."""
    iso = lambda i: F.regexp_extract(text, r"((?:19|20)[0-9]{2})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", i)
    han = lambda i: F.regexp_extract(text, r"((?:19|20)[0-9]{2})\s*年\s*([0-9]{1,2})\s*月\s*([0-9]{1,2})\s*日", i)
    made = lambda p: F.concat_ws("-", p(1), F.lpad(p(2), 2, "0"), F.lpad(p(3), 2, "0"))
    return F.when(iso(1) != "", made(iso)).when(han(1) != "", made(han))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def series(items: Column) -> Column:
    """"a", "a and b" or "a, b, and c"."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", ")
    last = F.get(items, n - 1)
    return F.when(n == 0, "").when(n == 1, last).when(n == 2, F.concat(head, F.lit(" and "), last)).otherwise(F.concat(head, F.lit(", and "), last))


def html_text(html: Column, most: int | None = None) -> Column:
    """What a page shows: scripts, styles and tags dropped, common entities decoded, white space collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(name), F.lit(char))
    x = F.trim(F.regexp_replace(x, r"\s+", " "))
    return F.substring(x, 1, most) if most else x


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: what lies between the first and the last brace, code fences or not."""
    return F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))


def inverted_index(texts: Column) -> Column:
    """A map of the words of an array of texts, arrays of words, to their places, in order. One sort and no exchange of words."""
    at = F.array_sort(F.flatten(F.transform(texts, lambda ws: F.transform(ws, lambda w, i: F.struct(w.alias("word"), i.alias("at"))))))

    def entries(at: Column) -> Column:
        begins = F.filter(F.transform(at, lambda x, i: F.when((i == 0) | (F.get(at, i - 1)["word"] != x["word"]), i)), lambda i: i.isNotNull())
        ends = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(at))
        return let(begins, lambda b: F.transform(b, lambda i, k: F.struct(F.get(at, i)["word"].alias("word"), F.transform(F.slice(at, i + 1, ends(b, k) - i), lambda x: x["at"]).alias("places"))))

    return F.map_from_entries(let(at, entries))


def abstract_text(index: Column) -> Column:
    """A text from its inverted index, a map of words to their places."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("at"), e["key"].alias("word")))))
    return F.array_join(F.transform(F.array_sort(places), lambda p: p["word"]), " ")
