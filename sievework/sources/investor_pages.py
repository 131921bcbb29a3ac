"""Companies' own pages for a query: from a company's home page over its links to the pages that fit best.

Pages are captured (url, html); a walk is two hops over their link graph, set-at-a-time for all queries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import host, normalize_query, tokens, tokens_of
from sievework.operators.alignment import overlap_score
from sievework.operators.excerpts import query_terms, snippets, text_nodes
from sievework.sources.serp import links

LINKS, PAGES = 3, 1


def on_allowed(of: Column, allowed: Column) -> Column:
    """Whether a host is one of the allowed ones, with or without www., or lies under one."""
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return F.exists(allowed, lambda h: (of == F.lower(h)) | (of == bare(h)) | of.endswith(F.concat(F.lit("."), bare(h))))


def link_candidates(asked: DataFrame, found: DataFrame, score=overlap_score, k: int = LINKS) -> DataFrame:
    """Each query's k best links: by score, shared terms, brevity of the address, address (the later first), with rank.

    asked: qid, query, page (a key of the home page), allowed (hosts) and markers (one of which the address's path must
    hold; empty: any). found: page, text, url. Links that share nothing with the query are none; an address counts once.
    """
    x = asked.join(found, "page").withColumn("_host", host(F.col("url"))).where(on_allowed(F.col("_host"), F.col("allowed")))
    path = F.lower(F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1))
    x = x.withColumn("_path", path).where((F.size("markers") == 0) | F.exists("markers", lambda m: F.contains(F.col("_path"), F.lower(m))))
    said = F.concat_ws(" ", "text", "url")
    x = x.withColumn("score", score(tokens(normalize_query(F.col("query"))), F.array_distinct(tokens_of(said)))).withColumn("overlap", F.size(F.array_intersect(query_terms(F.col("query")), tokens_of(said))))
    x = x.where("score > 0 or overlap > 0")
    once = Window.partitionBy("qid", "url").orderBy(F.desc("score"), F.desc("overlap"), "text")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("overlap"), F.length("url"), F.desc("url"))
    x = x.withColumn("_n", F.row_number().over(once)).where("_n = 1").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return x.select("qid", "query", "text", "url", "score", "overlap", "rank")


def investor_pages(asked: DataFrame, pages: DataFrame, k: int = PAGES, most: int = 320) -> DataFrame:
    """(qid, title, url, snippet): each query's k best linked pages, with what they say about it.

    asked: qid, query, homepage_url, allowed, markers; pages: url and html, an address once. A link whose page was not captured is taken
    with its own text for a snippet. Pages that a walk has seen (the home page) are not visited again.
    """
    homes = asked.join(pages.select(F.col("url").alias("homepage_url"), "html"), "homepage_url")
    found = links(homes.select("homepage_url", "html").distinct().withColumn("_at", F.col("homepage_url")), "homepage_url", "html", "_at").withColumnRenamed("homepage_url", "page")
    best = link_candidates(asked.withColumn("page", F.col("homepage_url")), found).join(asked.select("qid", F.col("homepage_url").alias("url")), ["qid", "url"], "left_anti")
    second = best.join(pages.select("url", "html"), "url", "left").withColumn("key", F.struct("qid", "url"))
    title = F.coalesce(F.nullif("text", F.lit("")), F.col("url"))
    second = second.withColumn("title", title).withColumn("key", F.to_json("key"))
    body = second.select("key", F.array_join(text_nodes(F.coalesce("html", F.lit(""))), " ").alias("text"), F.col("title").alias("candidate"), query_terms(F.col("query")).alias("terms"))
    x = second.join(snippets(body, "key", most=most), "key")
    x = x.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where(F.col("turn") <= k)
    return x.select("qid", "title", "url", F.coalesce(F.nullif("snippet", F.lit("")), F.col("title")).alias("snippet"))
