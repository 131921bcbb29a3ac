"""Captured candidates of live searches: which are taken, in what order, with what text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.text import content_terms, host, let, normalize_query, tokens
from sievework.operators.classify import sum_when

# Hosts of Chinese official sources.
CHINESE_POLICY_HOSTS = (
    "gov.cn", "www.gov.cn", "flk.npc.gov.cn", "wb.flk.npc.gov.cn", "npc.gov.cn", "www.npc.gov.cn", "cac.gov.cn", "www.cac.gov.cn", "mee.gov.cn", "www.mee.gov.cn", "mofcom.gov.cn", "www.mofcom.gov.cn", "miit.gov.cn",
    "www.miit.gov.cn", "samr.gov.cn", "www.samr.gov.cn",
)


def _filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def focus_terms(text: Column, generic: tuple[str, ...] = V.ACADEMIC_LIVE_GENERIC) -> Column:
    """What a text is about: its tokens of four letters or more, and CJK ones, without generic words."""
    return content_terms(tokens(normalize_query(text)), generic, digits=True)


def title_focus_terms(text: Column) -> Column:
    """Long words, and CJK ones, without generic words and numbers."""
    return F.filter(content_terms(tokens(normalize_query(text)), V.ACADEMIC_FOCUS_STOPWORDS, least=8, digits=True), lambda t: ~t.rlike("^[0-9]+$"))


def shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def has_focus(query: Column, title: Column, record: Column) -> Column:
    """Enough of the query's focus terms occur, some of them in the title: three of four and more, two of two or three."""
    n, in_title = F.size(query), shared(query, title)
    need = F.when(n >= 4, 3).when(n >= 2, 2).otherwise(0)
    return (need == 0) | ((in_title > 0) & ~((n >= 3) & (in_title < 2)) & (shared(query, record) >= need))


def shortcut_allowed(alignment: Column, query: Column, record: Column, least: int = 5) -> Column:
    """Whether a catalog's record will do without a live search."""
    n = F.size(query)
    return (alignment >= least) & F.when(n == 0, alignment >= least + 2).otherwise(shared(query, record) >= F.least(n, F.lit(2)))


def trimmed(snippet: Column, terms: Column, width: int = 40, of=focus_terms) -> Column:
    """At most `width` words of a text: the window that holds most of the terms, the first of equals, with dots where it was cut.

    Words' terms are taken once, of words that have one within; a window's are the union of its words'. The first of the
    best windows is the text's first one, or ends with a word that has a term, so only those are counted.
    """
    words = F.split(F.trim(F.regexp_replace(snippet, r"(?U)\s+", " ")), " ")

    def held(w: Column) -> Column:
        none = F.slice(terms, 1, 0)
        return let(F.lower(w), lambda low: F.when(F.exists(terms, lambda t: low.contains(t)), F.array_intersect(of(w), terms)).otherwise(none))

    def best_start(own: Column) -> Column:
        ends = F.filter(F.transform(own, lambda t, i: F.when((F.size(t) > 0) & (i >= width), i)), lambda i: i.isNotNull())
        starts = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i - (width - 1)))
        counted = F.transform(starts, lambda s: F.struct(F.size(F.array_distinct(F.flatten(F.slice(own, s + 1, width)))).alias("hits"), (-s).alias("back")))
        return -F.array_max(counted)["back"]

    def cut(ws: Column) -> Column:
        start = F.when(F.size(terms) > 0, let(F.transform(ws, held), best_start)).otherwise(0)
        return let(start, lambda at: F.concat(F.when(at > 0, "...").otherwise(""), F.array_join(F.slice(ws, at + 1, width), " "), F.when((at + width < F.size(ws)) & (F.size(terms) > 0), "...").otherwise("")))

    return let(words, lambda ws: F.when(F.size(ws) <= width, snippet).otherwise(cut(ws)))


def rank_academic(records: DataFrame, by: list[str], k: int = 5, least: int = 5, generic: tuple[str, ...] = V.ACADEMIC_LIVE_GENERIC) -> DataFrame:
    """Each query's best records, with rank and their texts cut to 40 words.

    records: title, url, snippet, year, evidence_level, alignment, and terms, the query's focus terms. Those without a
    title or address, with too little alignment or focus are left out; then by alignment, level, year and address.
    """
    x = records.where(_filled("title") & _filled("url") & (F.col("alignment") >= least)).withColumn("snippet", F.when(_filled("snippet"), F.col("snippet")).otherwise(F.col("title")))
    of = lambda c: focus_terms(c, generic)
    x = x.where(has_focus(F.col("terms"), of(F.col("title")), of(F.concat_ws(" ", "title", "snippet"))))
    level = F.coalesce(sum_when(F.col("evidence_level"), V.LEVEL_RANK), F.lit(0))
    order = Window.partitionBy(*by).orderBy(F.desc("alignment"), level.desc(), F.coalesce("year", F.lit(0)).desc(), F.desc("url"))
    x = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(1, k))
    return x.withColumn("snippet", trimmed(F.col("snippet"), F.col("terms"), of=of))


def rank_structured(records: DataFrame, by: list[str], least: int, k: int = 5) -> DataFrame:
    """Records with a title and an address by score, date and address, the later ones first."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.coalesce("publication_date", F.lit("")).desc(), F.desc("url"))
    return records.where(_filled("title") & _filled("url") & (F.col("score") >= least)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_policy_pages(pages: DataFrame, by: list[str], least: int = 3, k: int = 5) -> DataFrame:
    """Official pages with an authority and a date (or a higher score), by page_score, how much is known of them, and address.

    score is the alignment of a page's title and snippet, page_score that with the page's text.
    """
    known = lambda name: F.col(name).isNotNull().cast("int")
    x = pages.where(F.col("authority").isNotNull() & (F.col("publication_date").isNotNull() | F.col("effective_date").isNotNull() | (F.col("score") >= least + 1)) & (F.col("page_score") >= least))
    x = x.withColumn("metadata_bonus", known("version") + known("effective_date") + known("publication_date"))
    order = Window.partitionBy(*by).orderBy(F.desc("page_score"), F.desc("metadata_bonus"), F.desc("url"))
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def catalog_will_do(query: Column, first_domain: Column) -> Column:
    """Chinese queries, and those whose first preferred domain is a Chinese source's, need no live search."""
    return query.rlike("[一-鿿]") | F.coalesce(first_domain.isin(*CHINESE_POLICY_HOSTS), F.lit(False))


def strong_academic(title_overlap: Column, alignment: Column, level: Column) -> Column:
    return (title_overlap >= 2) | ((title_overlap > 0) & (alignment >= 12) & (F.coalesce(level, F.lit("")) != "metadata_only"))


def needs_fallback(hits: DataFrame, by: list[str]) -> DataFrame:
    """by, needs_fallback: queries with two focus terms or more of whose hits none is strong. hits: terms, title, alignment, evidence_level."""
    strong = strong_academic(shared(F.col("terms"), title_focus_terms(F.col("title"))), F.col("alignment"), F.col("evidence_level"))
    g = hits.groupBy(*by).agg(F.bool_or(strong).alias("strong"), F.max(F.size("terms")).alias("n"))
    return g.select(*by, ((F.col("n") >= 2) & ~F.col("strong")).alias("needs_fallback"))


def worth_fetching(tier: Column, score: Column, overlap: Column, density: Column) -> Column:
    """A candidate's page is read unless its title and snippet say enough."""
    return (tier == "general_web") | ~((score >= 10) & (overlap >= 4) & ((density >= 4.0) | (overlap >= 6)))


def low_value_feed_item(engine: Column, title: Column, path: Column) -> Column:
    return (engine == "bing_rss") & (normalize_query(title).startswith("news posts matching") | F.lower(path).contains("/news-tags/"))


def source_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_home_page(url: Column) -> Column:
    return url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/*(?:[?#].*)?$")


def news_search_title(title: Column) -> Column:
    """A headline without its publisher, a year before it and signs; ten words."""
    parts = F.filter(F.transform(F.split(title, " - "), lambda p: F.trim(p)), lambda p: p != "")
    kept = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1))), " - ")).otherwise(title)
    plain = F.trim(F.regexp_replace(F.regexp_replace(kept, r"^20[0-9]{2}\s+", ""), r"[^\p{L}\p{N}]+", " "))
    return F.array_join(F.slice(F.split(plain, " "), 1, 10), " ")


def publisher_query(source_url: Column, title: Column) -> Column:
    """A search of the publisher's site for a headline; null without either."""
    at, said = source_host(source_url), news_search_title(title)
    return F.when((at != "") & (said != ""), F.concat(F.lit("site:"), at, F.lit(' "'), said, F.lit('"')))


def candidate_payloads(candidates: DataFrame) -> DataFrame:
    """Candidates (engine, title, url, snippet, source_url) that are complete, with the publisher's address for news, and tier_url."""
    x = candidates.where(_filled("title") & _filled("url") & _filled("snippet"))
    x = x.withColumn("url", F.when((F.col("engine") == "google_news_rss") & _filled("source_url"), F.col("source_url")).otherwise(F.col("url")))
    return x.withColumn("tier_url", F.when(_filled("source_url"), F.col("source_url")).otherwise(F.col("url")))


def resolved_news(candidates: DataFrame, resolved: DataFrame, found: DataFrame) -> DataFrame:
    """News candidates (pos, engine, title, url, snippet, source_url) with an article's address: the resolved one (url, article_url), else the publisher's
    first result on the same host (pos, ord, url), else the source's own; home pages are none. Others stay as they are."""
    same = found.withColumnRenamed("url", "found_url").join(candidates.select("pos", "source_url"), "pos")
    at = source_host(F.col("source_url"))
    own = F.col("found_host")
    same = same.withColumn("found_host", source_host(F.col("found_url"))).where((at != "") & ((own == at) | F.endswith(own, F.concat(F.lit("."), at))))
    best = same.groupBy("pos").agg(F.min(F.struct("ord", "found_url"))["found_url"].alias("found_url"))
    x = candidates.join(resolved.groupBy("url").agg(F.min("article_url").alias("article_url")), "url", "left").join(best, "pos", "left")
    direct = F.when(_filled("source_url") & ~is_home_page(F.col("source_url")), F.col("source_url"))
    to = F.when(F.col("engine") == "google_news_rss", F.coalesce("article_url", "found_url", direct)).otherwise(F.col("url"))
    return x.withColumn("url", to).where("url is not null").drop("article_url", "found_url")
