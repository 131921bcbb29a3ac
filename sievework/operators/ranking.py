"""Orders of hits by route, mixed blocks, and selections of a bounded number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.text import recency
from sievework.operators.classify import sum_when


def route_of(source: Column) -> Column:
    return F.when(source.startswith("policy_"), "policy").when(source.startswith("academic_"), "academic").when(source.startswith("industry_"), "industry")


def hit_order(route: str, score: Column, source_priority: dict[str, int] | None = None) -> list[Column]:
    """What hits (source_id, credibility_tier, title, snippet, url, pos) of a route are sorted by."""
    tail = [F.desc(recency(F.concat_ws(" ", "url", "title", "snippet"))), F.desc(F.length("title") + F.length("snippet")), F.asc("pos")]
    if route == "industry":
        return [score.desc(), F.coalesce(sum_when(F.coalesce(F.col("credibility_tier"), F.lit("")), V.TIER_PRIORITY | {"": 4}), F.lit(99)).asc(), *tail]
    return [F.coalesce(sum_when(F.col("source_id"), source_priority or {"": 9}), F.lit(9)).asc(), score.desc(), *tail]


def rank(df: DataFrame, by: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def mixed_blocks(df: DataFrame, by: list[str], role: str, order: list[Column]) -> DataFrame:
    """Primary rows first, then supplemental ones, each in order, then others as they came (pos): column rank."""
    block = F.when(F.col(role) == "primary", 0).when(F.col(role) == "supplemental", 1).otherwise(2)
    x = df.withColumn("_block", block)
    own = Window.partitionBy(*by, "_block")
    x = x.withColumn("_place", F.when(F.col("_block") < 2, F.row_number().over(own.orderBy(*order))).otherwise(F.row_number().over(own.orderBy("pos"))))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_block", "_place"))).drop("_block", "_place")


def interleaved(df: DataFrame, by: list[str], role: str, order: list[Column]) -> DataFrame:
    """The first primary row, the first supplemental one, the other primary ones, the other supplemental ones, others."""
    own = Window.partitionBy(*by, role)
    x = df.withColumn("_place", F.row_number().over(own.orderBy(*order)))
    slot = F.when(F.col(role) == "primary", F.when(F.col("_place") == 1, 0).otherwise(2)).when(F.col(role) == "supplemental", F.when(F.col("_place") == 1, 1).otherwise(3)).otherwise(4)
    return x.withColumn("_slot", slot).withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("_slot", "_place"))).drop("_slot", "_place")


def reserved_top_k(df: DataFrame, by: list[str], role: str, order: list[Column], k: int, reserve: int) -> DataFrame:
    """k rows a group: primary ones up to k less the reserve, supplemental ones up to the reserve, the rest in order."""
    group = Window.partitionBy(*by)
    x = df.withColumn("_p", F.sum((F.col(role) == "primary").cast("int")).over(group)).withColumn("_s", F.sum((F.col(role) == "supplemental").cast("int")).over(group))
    x = x.withColumn("_keep", F.when((F.col("_p") > 0) & (F.col("_s") > 0) & F.lit(k > 1 and reserve > 0), F.least(F.lit(reserve), F.col("_s"), F.lit(k - 1))).otherwise(0))
    x = x.withColumn("_all", F.row_number().over(group.orderBy(*order))).withColumn("_own", F.row_number().over(Window.partitionBy(*by, role).orderBy("_all")))
    sure = ((F.col(role) == "primary") & (F.col("_own") <= F.lit(k) - F.col("_keep"))) | ((F.col(role) == "supplemental") & (F.col("_own") <= F.col("_keep")))
    x = x.withColumn("_turn", F.row_number().over(group.orderBy(F.when(sure, 0).otherwise(1), "_all")))
    x = x.where(F.col("_turn") <= k)
    return x.withColumn("rank", F.row_number().over(group.orderBy("_all"))).drop("_p", "_s", "_keep", "_all", "_own", "_turn")


def forced_top_k(df: DataFrame, by: list[str], order: list[Column], k: int, forced: Column) -> DataFrame:
    """The k best rows; if none of them is forced but another row is, the best forced one takes the last place."""
    group = Window.partitionBy(*by)
    x = df.withColumn("_all", F.row_number().over(group.orderBy(*order))).withColumn("_f", F.coalesce(forced, F.lit(False)))
    x = x.withColumn("_best", F.min(F.when(F.col("_f"), F.col("_all"))).over(group))
    x = x.withColumn("rank", F.when(F.col("_best") > k, F.when(F.col("_all") < k, F.col("_all")).when(F.col("_all") == F.col("_best"), k)).when(F.col("_all") <= k, F.col("_all")))
    return x.where("rank is not null").drop("_all", "_f", "_best")


def one_of_each_then_best(df: DataFrame, by: list[str], role: str, order: list[Column], k: int) -> DataFrame:
    """The best primary and the best supplemental row, then the best of all others; nothing for a group without both."""
    group = Window.partitionBy(*by)
    x = df.where(F.col(role).isin("primary", "supplemental"))
    x = x.withColumn("_all", F.row_number().over(group.orderBy(*order))).withColumn("_own", F.row_number().over(Window.partitionBy(*by, role).orderBy("_all")))
    x = x.withColumn("_roles", F.size(F.collect_set(role).over(group))).where("_roles = 2")
    first = F.when((F.col("_own") == 1) & (F.col(role) == "primary"), 0).when(F.col("_own") == 1, 1).otherwise(2)
    x = x.withColumn("rank", F.row_number().over(group.orderBy(first, "_all")))
    return x.where(F.col("rank") <= max(2, k)).drop("_all", "_own", "_roles")


def first_non_empty(df: DataFrame, by: list[str], priority: str) -> DataFrame:
    """Each group's rows of the first source that has any."""
    least = df.groupBy(*by).agg(F.min(priority).alias("_least"))
    return df.join(least, by).where(F.col(priority) == F.col("_least")).drop("_least")


def live_hits(df: DataFrame, by: list[str], k: int = 3, official: str = "company_official", score: str = "score", tier: str = "tier", url: str = "url") -> DataFrame:
    """A query's k best captured candidates: by score, tier and address (the later one first), with column rank.

    Candidates with a score come alone if there are any. An official candidate with a score is among the k, in the last
    place if no better one is there.
    """
    group = Window.partitionBy(*by)
    place = F.coalesce(sum_when(F.col(tier), V.TIER_PRIORITY), F.lit(99))
    x = df.withColumn("_pos", (F.col(score) > 0).cast("int")).withColumn("_any", F.max("_pos").over(group))
    x = x.withColumn("_n", F.when(F.col("_pos") == F.col("_any"), F.row_number().over(group.orderBy(F.desc("_pos"), F.desc(score), place, F.desc(url)))))
    good = (F.col(tier) == official) & (F.col(score) > 0)
    x = x.withColumn("_held", F.max(((F.col("_n") <= k) & (F.col(tier) == official)).cast("int")).over(group)).withColumn("_best", F.min(F.when(good, F.col("_n"))).over(group)).withColumn("_size", F.count("_n").over(group))
    last = F.least(F.col("_size"), F.lit(k))
    forced = F.when((F.coalesce("_held", F.lit(0)) == 0) & F.col("_best").isNotNull(), F.when(F.col("_n") == F.col("_best"), last).when(F.col("_n") < last, F.col("_n")))
    rank_ = F.when((F.coalesce("_held", F.lit(0)) == 0) & F.col("_best").isNotNull(), forced).when(F.col("_n") <= k, F.col("_n"))
    return x.withColumn("rank", rank_).where("rank is not null").drop("_pos", "_any", "_n", "_held", "_best", "_size")
