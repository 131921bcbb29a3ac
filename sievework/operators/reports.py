"""Reports over run logs and judged scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.operators.classify import sum_when


def two_decimals(x: Column) -> Column:
    """Half to even on the scaled value, which is how binary halves like 0.575 (a little less) come out in most languages."""
    return F.bround(x * 100.0) / 100.0


def rate(cond: Column) -> Column:
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def breakdown(value: Column) -> Column:
    """A map of values to counts, without nulls, by value. Use with a group's histogram: see counted()."""
    return F.map_from_entries(F.array_sort(value))


def run_summary(runs: DataFrame, by: list[str], success: Column, elapsed: str, budget: Column) -> DataFrame:
    """Runs, successes, rates, and nearest-rank p50 and p95 of the latency."""
    disc = lambda p: F.expr(f"percentile_disc({p}) within group (order by {elapsed})")
    return runs.groupBy(*by).agg(F.count(F.lit(1)).alias("total_runs"), F.count_if(success).alias("successful_runs"), rate(success).alias("success_rate"), disc(0.5).alias("p50"), disc(0.95).alias("p95"), rate(budget).alias("budget_pass_rate"))


def counted(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, breakdown: a map of each value to its count; counts are made before values are gathered."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias("breakdown"))


def repeatability(runs: DataFrame, case: str, status: str, route: str, elapsed: str, budget: Column, expected_runs: int = 5, most_spread: float = 250) -> DataFrame:
    """A row for each case, with its verdict."""
    x = runs.groupBy(case).agg(F.count(F.lit(1)).alias("run_count"), F.count_distinct(status).alias("statuses"), F.count_distinct(route).alias("routes"), (F.max(elapsed) - F.min(elapsed)).alias("spread"), rate(budget).alias("budget_rate"))
    return x.withColumn("repeatable", (F.col("run_count") == expected_runs) & (F.col("statuses") == 1) & (F.col("routes") == 1) & (F.col("budget_rate") == 1.0) & (F.col("spread") <= most_spread))


def dimension_id(name: Column) -> Column:
    """The dimension that a judge means; null for a name that none has."""
    key = F.lower(F.trim(name))
    return sum_when(key, {alias: d for d, other, _ in V.DIMENSIONS for alias in (d, other)})


def dimension_summary(scores: DataFrame, dimension: str = "dimension", score: str = "score") -> DataFrame:
    """Count, average and share of the most points of each dimension. An unknown dimension is an error."""
    known = F.coalesce(dimension_id(F.col(dimension)), F.raise_error(F.concat(F.lit("unsupported judge dimension: "), F.col(dimension))).cast("string"))
    most = sum_when(F.col("id"), {d: n for d, _, n in V.DIMENSIONS})
    x = scores.withColumn("id", known).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(score).alias("total"))
    return x.select(F.col("id").alias("dimension"), "n", two_decimals(F.col("total") / F.col("n")).alias("average_score"), two_decimals(F.col("total") / (F.col("n") * most)).alias("average_ratio"))


def case_summary(scores: DataFrame, case: str, dimension: str = "dimension", score: str = "score") -> DataFrame:
    most = sum_when(dimension_id(F.col(dimension)), {d: n for d, _, n in V.DIMENSIONS})
    x = scores.groupBy(case).agg(F.sum(score).alias("total"), F.sum(most).alias("total_max"))
    return x.select(case, two_decimals(F.col("total")).alias("total_score"), F.col("total_max").alias("total_max_score"), two_decimals(F.col("total") / F.col("total_max")).alias("ratio"))


def comparison(runs: DataFrame, implementation: str, right: Column, comparable: Column, success: Column, elapsed: str) -> DataFrame:
    """For each implementation: accuracy over comparable runs, mean and p95 latency, success rate."""
    return runs.groupBy(implementation).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(comparable, F.when(right, 1.0).otherwise(0.0))).alias("accuracy"), F.avg(elapsed).alias("avg_latency"), F.expr(f"percentile_disc(0.95) within group (order by {elapsed})").alias("p95_latency"), rate(success).alias("success_rate"))


def status_rollup(attempts: DataFrame, by: list[str], pos: str, hits: str, reason: str, source: str) -> DataFrame:
    """For each query: success, partial or failure_gaps, the first failure's reason, and the failed sources in order."""
    failed = F.col(reason).isNotNull()
    first = F.min(F.when(failed, F.struct(pos, reason)))[reason]
    gaps = F.array_sort(F.collect_list(F.when(failed, F.struct(pos, source))))
    x = attempts.groupBy(*by).agg(F.sum(hits).alias("hits"), F.count_if(failed).alias("failures"), first.alias("failure_reason"), F.array_distinct(F.transform(gaps, lambda g: g[source])).alias("gaps"))
    return x.withColumn("status", F.when(F.col("failures") == 0, "success").when(F.col("hits") > 0, "partial").otherwise("failure_gaps"))


def expected_terms(terms: Column) -> Column:
    """Terms trimmed, filled and once each, in order; none for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(t)), lambda t: t != "")), F.array().cast("array<string>"))


def keyword_coverage(terms: Column, text: Column) -> Column:
    """The share of terms that a text holds, whatever their case; null without terms."""
    low = F.lower(text)
    return F.when(F.size(terms) > 0, F.size(F.filter(terms, lambda t: F.contains(low, F.lower(t)))) / F.size(terms))


def failed_checks(n_sources: Column, min_sources: Column, elapsed_ms: Column, max_latency_ms: Column, coverage: Column, min_coverage: Column, strict: Column, n_notes: Column, expected_intent: Column, route_label: Column, error: Column) -> Column:
    """The names of an answer's checks that fail, in their order."""
    off = F.when(expected_intent.isNotNull(), ~F.coalesce(route_label == expected_intent, F.lit(False))).otherwise(False)
    named = (("sources", n_sources < min_sources), ("latency", elapsed_ms > max_latency_ms), ("keywords", F.coalesce(coverage < min_coverage, F.lit(False))), ("uncertainty", strict & (n_notes > 0)), ("intent", off), ("error", F.coalesce(error, F.lit("")) != ""))
    return F.array_compact(F.array(*(F.when(c, n) for n, c in named)))


def evaluation_summary(cases: DataFrame, by: list[str], ndigits: int = 4) -> DataFrame:
    """cases (passed, elapsed_ms, n_sources, n_notes, intent_match, coverage) in one row a group; rates of what is known only."""
    mean = lambda c, n=ndigits: F.bround(F.avg(c), n)
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed_cases"), mean(F.col("passed").cast("int")).alias("pass_rate"), mean("elapsed_ms", 2).alias("avg_latency_ms"),
        F.bround(F.expr("percentile_disc(0.95) within group (order by elapsed_ms)"), 2).alias("p95_latency_ms"), mean("n_sources", 2).alias("avg_sources"), mean((F.col("n_notes") > 0).cast("int")).alias("uncertainty_rate"),
        mean(F.col("intent_match").cast("int")).alias("intent_accuracy"), mean("coverage").alias("avg_keyword_coverage"),
    )


def provider_usage(usage: Column) -> dict[str, Column]:
    """Token counts of a model's usage (JSON); what is absent, negative or no whole number is null."""

    def count(name: str) -> Column:
        raw = F.get_json_object(usage, f"$.{name}")
        return F.when(raw.rlike("^[0-9]+$"), raw.cast("long"))

    return {f"provider_{n}": count(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")}


def runtime_trace(retrieval_s: Column, synthesis_s: Column, evidence_tokens: Column, answer_tokens: Column, exhausted: Column, retrieval_deadline: float = 10.0, request_deadline: float = 10.0, evidence_budget: int = 8000, answer_budget: int = 2000) -> dict[str, Column]:
    """Milliseconds, and whether a run kept its deadlines and its budgets of tokens."""
    ms = lambda s: F.bround(s * 1000, 0).cast("long")
    whole = retrieval_s + synthesis_s
    return {
        "elapsed_ms": ms(whole),
        "retrieval_elapsed_ms": ms(retrieval_s),
        "synthesis_elapsed_ms": ms(synthesis_s),
        "latency_budget_ok": (retrieval_s <= retrieval_deadline) & (whole <= request_deadline) & (F.coalesce(exhausted, F.lit("")) != "synthesis"),
        "token_budget_ok": (evidence_tokens <= evidence_budget) & F.coalesce(answer_tokens <= answer_budget, F.lit(True)),
    }
