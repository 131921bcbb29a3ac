"""What a query is after, and which further queries that leads to. Markers are parameters with the true ones as defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.markers import contains_any
from sievework.functions.text import content_terms
from sievework.operators.classify import sum_when

HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}]"
RFC = r"(?<![a-z0-9])rfc[\s:-]*([0-9]{3,5})(?![a-z0-9])"


def mentions(words: Column, normal: Column, markers: tuple[str, ...]) -> Column:
    """ASCII markers as whole tokens, others anywhere in the normal text."""
    own = [m for m in markers if m.isascii()]
    there = F.arrays_overlap(words, F.array(*map(F.lit, own))) if own else F.lit(False)
    return F.coalesce(there, F.lit(False)) | contains_any(normal, [m for m in markers if not m.isascii()])


def other_than_ascii(query: Column) -> Column:
    return query.rlike(r"[^\x00-\x7f]")


def academic_terms(words: Column) -> Column:
    """Content terms without the words that any academic query has."""
    return content_terms(words, (*V.RELEVANCE_STOPWORDS, *V.ACADEMIC_GENERIC), digits=True, short=tuple(t for t in V.SHORT_CONTENT))


def lookups(df: DataFrame, words: str = "words", normal: str = "normal", academic=(V.ACADEMIC_LOOKUP, V.ACADEMIC_LOOKUP_PHRASES, V.ACADEMIC_EXPLAIN), policy=(V.POLICY_LOOKUP, V.PLAIN_EXPLAIN), industry=(V.INDUSTRY_LOOKUP, V.INDUSTRY_LOOKUP_PHRASES, V.PLAIN_EXPLAIN), effect=V.CROSS_EFFECT, many=V.ACADEMIC_LIST) -> DataFrame:
    """df, which has the query's traits, with academic_lookup, policy_lookup, industry_lookup, cross_effect and many_items."""
    w, n = F.col(words), F.col(normal)
    said = lambda markers: mentions(w, n, markers)
    year = F.col("has_year") & (F.size(academic_terms(w)) >= 3)
    return df.withColumns({
        "academic_lookup": ~said(academic[2]) & (said(academic[0]) | contains_any(n, academic[1]) | said(("openalex",)) | year),
        "policy_lookup": (said(policy[0]) | F.col("has_version_intent") | F.col("has_effective_date_intent") | F.col("is_policy_change")) & ~said(policy[1]),
        "industry_lookup": (said(industry[0]) | contains_any(n, industry[1]) | F.col("has_trend_intent")) & ~said(industry[2]),
        "cross_effect": contains_any(n, effect) | F.col("is_cross_domain_impact"),
        "many_items": said(many),
    })


def source_intents(df: DataFrame, query: str = "query", words: str = "words", normal: str = "normal", forms=V.FILING_FORMS, phrases=V.FILING_PHRASES, sec: str = "sec", disclosure=V.DISCLOSURE_WORDS, us=V.US_POLICY, direct=V.DIRECT_POLICY) -> DataFrame:
    """df with filings, detailed_disclosure, us_policy, direct_policy and han_news_only: which sources a query is for."""
    n, low = F.col(normal), F.lower(query)
    letters = F.exists(content_terms(F.col(words), digits=True), lambda t: t.rlike("^[a-z0-9]*[a-z][a-z0-9]*$"))
    return df.withColumns({
        "filings": contains_any(n, forms) | contains_any(n, phrases) | F.array_contains(words, sec),
        "detailed_disclosure": contains_any(n, disclosure),
        "us_policy": contains_any(low, us),
        "direct_policy": contains_any(low, direct),
        "han_news_only": F.col(query).rlike(HAN) & ~letters,
    })


def upstream_query(query: Column, normal: Column, words: Column) -> Column:
    """What academic sources are asked: the distinct ASCII tokens where a query has more than those, else its normal form."""
    own = F.array_distinct(F.filter(words, lambda t: ~t.rlike(r"[^\x00-\x7f]")))
    noisy = other_than_ascii(query) | normal.rlike(r"[^a-z0-9\s-]")
    return F.when(F.trim(normal) == "", F.trim(query)).when((F.size(own) > 0) & noisy, F.array_join(own, " ")).otherwise(F.trim(normal))


def prioritized(variants: Column, order: dict[str, int], triggers: tuple[str, ...]) -> Column:
    """Variants (an array of structs with reason and query) by their reasons' places, if one of them is a trigger; else as they came."""
    place = F.transform(variants, lambda v, i: F.struct(F.coalesce(sum_when(v["reason"], order), F.lit(99)).alias("o"), i.alias("i"), v.alias("v")))
    sorted_ = F.transform(F.array_sort(place), lambda p: p["v"])
    return F.when(F.exists(variants, lambda v: v["reason"].isin(*triggers)), sorted_).otherwise(variants)


def first_of_each(variants: Column, key) -> Column:
    """Variants without those whose key an earlier one has."""
    keyed = F.transform(variants, lambda v, i: F.struct(key(v).alias("k"), i.alias("i"), v.alias("v")))
    return F.transform(F.filter(keyed, lambda x: ~F.exists(keyed, lambda y: (y["k"] == x["k"]) & (y["i"] < x["i"]))), lambda x: x["v"])


def chosen_variant(variants: Column, order: dict[str, int], original: bool = True) -> Column:
    """The variant of the foremost reason, then the shortest, then the first by its letters; without the original query if that is left out."""
    some = variants if original else F.filter(variants, lambda v: v["reason"] != "original")
    return F.array_min(F.transform(some, lambda v: F.struct(F.coalesce(sum_when(v["reason"], order), F.lit(99)).alias("o"), F.length(v["query"]).alias("n"), v["query"].alias("query"), v["reason"].alias("reason"))))


def enrichment_variant(variants: Column, route: str, many: Column, han: Column) -> Column:
    """The variant for a second search on the same route."""
    if route != "academic":
        return chosen_variant(variants, V.ENRICHMENT_INDUSTRY_ORDER)
    pick = {name: chosen_variant(variants, order) for name, order in V.ENRICHMENT_ACADEMIC_ORDER.items()}
    core = F.exists(variants, lambda v: v["reason"] == "academic_ascii_core")
    return F.when(many & han & core, pick["many_ascii"]).when(many, pick["many"]).otherwise(pick["one"])


# Pages that a query leads to at once (title, address, what is said of them), and sites that are searched.
_PAGES = {
    "webauthn": ("WebAuthn Level {}", "https://www.w3.org/TR/webauthn-{}/", "Official W3C WebAuthn Level {} specification."),
    "rfc": ("RFC {}", "https://datatracker.ietf.org/doc/html/rfc{}", "Official RFC {} specification document."),
    "chips": ("CHIPS", "https://developer.chrome.com/blog/chrome-114-beta/", "Official Chromium documentation for CHIPS and partitioned cookies."),
    "signatures": ("HTTP Message Signatures", "https://datatracker.ietf.org/doc/html/rfc9421", "Official HTTP Message Signatures specification."),
}


def direct_pages(normal: Column) -> Column:
    """Official pages (title, url, snippet) that a query names: standards by number or name."""

    def page(name: str, when: Column, value: Column | None = None) -> Column:
        fill = lambda t: F.lit(t) if value is None else F.replace(F.lit(t), F.lit("{}"), value)
        return F.when(when, F.struct(*(fill(t).alias(f) for f, t in zip(("title", "url", "snippet"), _PAGES[name], strict=True))))

    number = F.regexp_extract(normal, RFC, 1)
    return F.array_compact(F.array(
        page("rfc", number != "", number),
        page("webauthn", normal.contains("webauthn"), F.when(normal.contains("level 3"), "3").otherwise("2")),
        page("chips", normal.contains("chips") & (normal.contains("chromium") | normal.contains("cookie"))),
        page("signatures", normal.contains("http message signatures")),
    ))


def site_queries(query: Column) -> Column:
    """Searches of official sites, each once."""
    low = F.lower(query)
    on = lambda when, site: F.when(when, F.concat(query, F.lit(f" site:{site}")))
    packaging = contains_any(low, V.PACKAGING)
    return F.array_distinct(F.array_compact(F.array(
        on((F.regexp_extract(low, RFC, 1) != "") | contains_any(low, ("ietf", "http message signatures")), "rfc-editor.org"),
        on(contains_any(low, ("w3c", "webauthn")), "w3.org"),
        on(low.contains("chromium") | (low.contains("chips") & low.contains("cookie")), "developer.chrome.com"),
        on(low.contains("iata") | (low.contains("rpk") & low.contains("aviation")), "iata.org"),
        on(packaging, "semi.org"),
        F.when(packaging, F.concat(F.lit("SEMI "), query)),
    )))


def backup_queries(query: Column, normal: Column) -> dict[str, Column]:
    """news, outlook (null for most queries) and feed: what backup searches are asked."""
    capacity = normal.contains("advanced packaging") & normal.contains("capacity")
    year = F.nullif(F.regexp_extract(normal, "(?<![0-9])(20[0-9]{2})(?![0-9])", 1), F.lit(""))
    outlook = capacity & normal.contains("outlook")
    return {
        "news": F.when(capacity & ~normal.contains("semiconductor"), F.concat(F.lit("semiconductor "), query)).otherwise(query),
        "outlook": F.when(outlook, F.concat_ws(" ", year, F.lit("semiconductor industry outlook"))),
        "feed": F.when(outlook, F.concat_ws(" ", F.lit("CoWoS capacity"), year)),
    }


def stop_rules(route: Column, label: Column, primary: Column, source: Column, supplemental: Column, normal: Column, markers: tuple[str, ...] = V.PACKAGING) -> dict[str, Column]:
    """after_success, after_no_hits: whether a source's further variants are left out once one succeeds, or finds nothing."""
    early = (label == "industry") & (primary == "industry") & (route == "industry") & ~supplemental & contains_any(normal, markers)
    return {
        "after_success": (route == "academic") | (early & (source == "industry_web_discovery")),
        "after_no_hits": early & source.isin("industry_web_discovery", "industry_news_rss", "industry_official_or_filings"),
    }


def probes_europe_pmc(normal: Column, n_records: Column, doi: Column, level: Column) -> Column:
    """Whether a second academic index is asked, by the best record so far."""
    return normal.contains("europe pmc") & (n_records > 0) & doi.isNull() & (F.coalesce(level, F.lit("")) != "peer_reviewed")
