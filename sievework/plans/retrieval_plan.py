"""Retrieval plans: which sources a route asks first, and which take over when they fail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.markers import contains_any

# Deadlines in seconds, variants and sources at once, by kind of plan.
LIMITS = {
    "default": {"per_source": 3.0, "overall": 6.0, "variants": 3, "at_once": 6},
    "industry": {"per_source": 8.0, "overall": 9.0, "variants": 5, "at_once": 3},
    "mixed": {"per_source": 3.0, "overall": 8.0, "variants": 5, "at_once": 6},
}
MIXED_DISCOVERY_SECONDS = 2.5


def first_wave(route: Column, normal: Column, trend: Column, official_first: tuple[str, ...] = V.OFFICIAL_FIRST) -> Column:
    """The sources of a route's first wave, in order."""
    ids = lambda *s: F.array(*map(F.lit, s))
    official, web, news = V.FIRST_WAVE["industry"]
    industry = F.when(contains_any(normal, official_first), ids(official, web, news)).when(trend, ids(web)).otherwise(ids(web, news, official))
    return F.when(route == "industry", industry).when(route == "academic", ids(*V.FIRST_WAVE["academic"])).otherwise(ids(*V.FIRST_WAVE["policy"]))


def fallback_steps(start: list[str]) -> list[tuple[str, str, list[str]]]:
    """(from, to, failures) of every fallback that can be reached from the sources that start; a dozen rows at most."""
    steps: dict[tuple[str, str], list[str]] = {}
    todo, seen = list(start), set()
    while todo:
        source = todo.pop(0)
        if source in seen:
            continue
        seen.add(source)
        for s, reason, target in V.BACKUP_CHAIN:
            if s == source and target not in start:
                steps.setdefault((s, target), []).append(reason)
                todo.append(target)
    return [(a, b, reasons) for (a, b), reasons in steps.items()]


def fallback_table(spark: SparkSession) -> DataFrame:
    """The fallbacks of each route's first wave."""
    rows = [(route, i, *step) for route in V.ROUTES for i, step in enumerate(fallback_steps(list(V.FIRST_WAVE[route])))]
    return spark.createDataFrame(rows, "route string, ord int, source_id string, next_source string, failures array<string>")


def plan(classified: DataFrame, official_first: tuple[str, ...] = V.OFFICIAL_FIRST) -> DataFrame:
    """classified (with traits) and first_wave, an array of (source_id, role), and the plan's limits."""
    tag = lambda ids, role: F.transform(ids, lambda s: F.struct(s.alias("source_id"), F.lit(role).alias("role")))
    n, trend = F.col("normal"), F.col("has_trend_intent")
    primary = F.when((F.col("route_label") == "academic") & (F.col("primary_route") == "academic"), F.array(F.when(contains_any(n, V.ARXIV_FIRST), "academic_arxiv").otherwise("academic_semantic_scholar"))).otherwise(first_wave(F.col("primary_route"), n, trend, official_first))
    other = F.col("supplemental_route")
    strongest = F.when(other == "industry", first_wave(other, n, trend, official_first)).when(other == "academic", F.array(F.lit(V.STRONGEST_SOURCE["academic"]))).when(other == "policy", F.array(F.lit(V.STRONGEST_SOURCE["policy"])))
    mixed = F.col("route_label") == "mixed"
    wave = F.concat(tag(primary, "primary"), F.when(mixed & other.isNotNull(), tag(strongest, "supplemental")).otherwise(F.array().cast("array<struct<source_id:string,role:string>>")))
    kind = F.when((F.col("route_label") == "industry") & (F.col("primary_route") == "industry"), "industry").when(mixed, "mixed").otherwise("default")
    limit = lambda name: F.when(kind == "industry", LIMITS["industry"][name]).when(kind == "mixed", LIMITS["mixed"][name]).otherwise(LIMITS["default"][name])
    return classified.withColumn("first_wave", wave).withColumns({name: limit(name) for name in LIMITS["default"]})
