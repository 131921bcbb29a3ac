"""Route classification of queries, their traits, source families and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.markers import has_any, marker_score
from sievework.functions.text import normalize_query, tokens


def route_scores(df: DataFrame, normal: str = "normal", markers: dict[str, tuple[str, ...]] = V.ROUTE_MARKERS) -> DataFrame:
    """df with <route>_score for each route."""
    return df.withColumns({f"{r}_score": marker_score(F.col(normal), markers[r]) for r in V.ROUTES})


def ranked_routes(df: DataFrame) -> DataFrame:
    """df with first, second, first_score and second_score: by score, then by precedence."""
    order = F.array_sort(F.array(*(F.struct((-F.col(f"{r}_score")).alias("s"), F.lit(i).alias("i"), F.lit(r).alias("r")) for i, r in enumerate(V.ROUTES))))
    x = df.withColumn("_order", order)
    return x.withColumns({"first": F.col("_order")[0]["r"], "second": F.col("_order")[1]["r"], "first_score": -F.col("_order")[0]["s"], "second_score": -F.col("_order")[1]["s"]}).drop("_order")


def label(df: DataFrame, normal: str = "normal", cross_domain: tuple[str, ...] = V.CROSS_DOMAIN_MARKERS, research_path: tuple[str, ...] = V.RESEARCH_PATH_MARKERS) -> DataFrame:
    """df with route_label, primary_route, supplemental_route and reason_code; the first rule that holds decides."""
    n, first, second = F.col(normal), F.col("first"), F.col("second")
    s1, s2 = F.col("first_score"), F.col("second_score")
    active = sum(((F.col(f"{r}_score") > 0).cast("int") for r in V.ROUTES), F.lit(0))
    short = (F.length(F.replace(n, F.lit(" "), F.lit(""))) < V.SHORT_CHARS) | (F.size(tokens(n)) < V.SHORT_TOKENS)
    path = F.lit(False)
    for m in research_path:
        path = path | n.contains(m)
    path = path & (first == "policy") & (second == "academic") & (F.col("policy_score") > 0) & (F.col("academic_score") > 0)
    reason = (
        F.when(has_any(n, cross_domain) & (active >= 2), "explicit_cross_domain")
        .when(short, "short_query")
        .when((s1 <= V.LOW_SIGNAL) & (s1 > 0) & (s2 == 0), F.concat(first, F.lit("_weak_hit")))
        .when(s1 <= V.LOW_SIGNAL, "low_signal")
        .when(path, "policy_academic_research_path")
        .when((s1 - s2 <= 1) & (s2 > 0), "score_tie")
        .otherwise(F.concat(first, F.lit("_hit")))
    )
    x = df.withColumn("reason_code", reason)
    mixed = ~F.col("reason_code").rlike("_hit$")
    other = F.when(F.col("reason_code") == "explicit_cross_domain", second).when(mixed & (s2 > 0), second)
    return x.withColumns({"route_label": F.when(mixed, "mixed").otherwise(first), "primary_route": first, "supplemental_route": other})


def classify(queries: DataFrame, query: str = "query", unicode: bool = True, markers: dict[str, tuple[str, ...]] = V.ROUTE_MARKERS, cross_domain: tuple[str, ...] = V.CROSS_DOMAIN_MARKERS) -> DataFrame:
    """queries with scores, label, routes and reason. A null query is an empty one."""
    x = queries.withColumn("normal", normalize_query(F.coalesce(F.col(query), F.lit("")), unicode))
    return label(ranked_routes(route_scores(x, markers=markers)), cross_domain=cross_domain).drop("first", "second", "first_score", "second_score")


def trait_columns(n: Column, markers: dict[str, tuple[str, ...]] = V.ROUTE_MARKERS, change: tuple[str, ...] = V.CHANGE_MARKERS, version: tuple[str, ...] = V.VERSION_MARKERS, effective: tuple[str, ...] = V.EFFECTIVE_MARKERS, trend: tuple[str, ...] = V.TREND_MARKERS, impact: tuple[str, ...] = V.IMPACT_QUERY_MARKERS) -> dict[str, Column]:
    """The six traits of a normal query."""
    signals = sum((has_any(n, markers[r]).cast("int") for r in V.ROUTES), F.lit(0))
    return {
        "has_year": n.rlike("(?<![0-9])20[0-9]{2}(?![0-9])"),
        "has_version_intent": has_any(n, version),
        "has_effective_date_intent": has_any(n, effective),
        "has_trend_intent": has_any(n, trend),
        "is_policy_change": has_any(n, change),
        "is_cross_domain_impact": has_any(n, impact) | (n.contains("与") & (signals >= 2)),
    }


def traits(df: DataFrame, normal: str = "normal", **markers) -> DataFrame:
    """df with the six traits of a query. markers: as in trait_columns."""
    return df.withColumns(trait_columns(F.col(normal), **markers))


def source_families(primary: Column, supplemental: Column) -> Column:
    """The families of both routes, in order and once each."""
    of = lambda route: sum_when(route, {r: F.array(*map(F.lit, f)) for r, f in V.SOURCE_FAMILIES.items()})
    return F.array_distinct(F.concat(of(primary), F.coalesce(of(supplemental), F.array().cast("array<string>"))))


def sum_when(key: Column, values: dict) -> Column:
    """values[key], null where there is none."""
    out = None
    for k, v in values.items():
        v = v if isinstance(v, Column) else F.lit(v)
        out = F.when(key == k, v) if out is None else out.when(key == k, v)
    return out


def valid_request(query: Column, most: int = 2000) -> Column:
    """Something is left after trimming, and not too much."""
    return F.coalesce(F.length(F.trim(query)).between(1, most), F.lit(False))
