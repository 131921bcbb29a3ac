"""Retrieval as tables: tiers and roles of sources, fallbacks, deadlines, anti-joins against what is held."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.operators.classify import sum_when
from sievework.operators.components import join_bounded


def with_tier(df: DataFrame, source: str = "source_id", tier: str = "credibility_tier") -> DataFrame:
    """A given tier, else the source's."""
    own = F.col(tier) if tier in df.columns else F.lit(None).cast("string")
    return df.withColumn(tier, F.coalesce(own, sum_when(F.col(source), V.SOURCE_TIERS)))


def with_role(df: DataFrame, by_source: DataFrame, by_route: DataFrame, source: str = "source_id", route: str = "target_route") -> DataFrame:
    """The role of the source, else of the target route, else primary."""
    x = join_bounded(df, by_source.select(F.col("source_id").alias(source), F.col("role").alias("_s")), source, "left")
    x = join_bounded(x, by_route.select(F.col("route").alias(route), F.col("role").alias("_r")), route, "left")
    return x.withColumn("role", F.coalesce("_s", "_r", F.lit("primary"))).drop("_s", "_r")


def backup_chain(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(V.BACKUP_CHAIN, "source_id string, failure_reason string, next_source string")


def next_source(source: Column, reason: Column) -> Column:
    """The source that takes over; null where none does (an adapter's error has no successor)."""
    chain = F.create_map(*(F.lit(x) for s, r, n in V.BACKUP_CHAIN for x in (f"{s}|{r}", n)))
    return F.try_element_at(chain, F.concat_ws("|", source, reason))


def fallback_path(source: Column, reasons: list[Column]) -> Column:
    """The sources that are tried, as long as each fails for the next given reason; one that was tried ends the path."""

    def step(state: Column, reason: Column) -> Column:
        follow = next_source(F.element_at(state["path"], -1), reason)
        on = ~state["done"] & follow.isNotNull() & ~F.coalesce(F.array_contains(state["path"], follow), F.lit(False))
        return F.struct(F.when(on, F.array_append(state["path"], follow)).otherwise(state["path"]).alias("path"), (~on).alias("done"))

    start = F.struct(F.array(source).alias("path"), F.lit(False).alias("done"))
    return F.aggregate(F.array(*reasons), start, step, lambda state: state["path"])


def failure_reason(timed_out: Column, status_code: Column) -> Column:
    return F.when(timed_out, "timeout").when(status_code == 429, "rate_limited").otherwise("adapter_error")


def within_deadline(attempts: DataFrame, by: list[str], pos: str, elapsed: str, per_source: float, overall: float) -> DataFrame:
    """Replays attempts one after the other: started, finished, timed_out (its own limit), cancelled (the overall one)."""
    before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    used = F.least(F.col(elapsed), F.lit(per_source))
    x = attempts.withColumn("started", F.coalesce(F.sum(used).over(before), F.lit(0.0)))
    x = x.withColumn("finished", F.col("started") + used)
    return x.withColumn("timed_out", F.col(elapsed) > per_source).withColumn("cancelled", F.col("finished") > overall)


def until_first_success(attempts: DataFrame, by: list[str], pos: str, success: Column) -> DataFrame:
    """Attempts up to the first that succeeds, which is the last one made."""
    before = Window.partitionBy(*by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return attempts.withColumn("_done", F.coalesce(F.max(success.cast("int")).over(before), F.lit(0))).where("_done = 0").drop("_done")


def not_held(hits: DataFrame, held: DataFrame, keys: list[str], normal=lambda c: F.lower(F.trim(c))) -> DataFrame:
    """hits that share none of the keys with any held record: one equi anti-join a key; null and empty keys match nothing."""

    def minus(x: DataFrame, key: str) -> DataFrame:
        there = held.select(normal(F.col(key)).alias("_k")).where("_k <> ''").distinct()
        return x.withColumn("_k", normal(F.col(key))).join(there, "_k", "left_anti").drop("_k")

    return reduce(minus, keys, hits)


def host_suffixes(host: Column) -> Column:
    """A host and the domains above it, to join hosts that equal or lie under another one."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def url_tier(host: Column, path: Column, official: tuple[str, ...], news: tuple[str, ...], associations: tuple[str, ...] = ()) -> Column:
    """Investor pages and official hosts, then associations, then news, else the general web."""
    under = lambda hosts: reduce(lambda a, b: a | b, ((host == h) | host.endswith(f".{h}") for h in hosts), F.lit(False))
    return F.when(under(official) | host.startswith("ir.") | host.startswith("investor.") | path.contains("/investor"), "company_official").when(under(associations), "industry_association").when(under(news), "trusted_news").otherwise("general_web")
