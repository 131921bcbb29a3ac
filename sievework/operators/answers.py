"""Answers: citation checks, status, notes."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions import vocabulary as V
from sievework.operators.classify import sum_when


@F.pandas_udf(T.StringType())
def quote_key(text: pd.Series) -> pd.Series:
    """NFKC, case folded, punctuation and symbols as spaces, white space collapsed."""

    def normal(t: str) -> str:
        t = unicodedata.normalize("NFKC", t).casefold()
        t = "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in t)
        return re.sub(r"\s+", " ", t).strip()

    return text.map(normal, na_action="ignore")


def quote_key_ascii(text: Column) -> Column:
    """The same for ASCII texts, natively."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def check_citations(citations: DataFrame, evidence: DataFrame, key=quote_key) -> DataFrame:
    """citations with issue: null, missing evidence_id, missing source_record_id or quote_text mismatch.

    citations: point_id, evidence_id, source_record_id, quote_text; evidence: a row for each slice, evidence_id,
    source_record_id, slice_text. A quote may be empty; else the slice has to hold it, as it is or by its key.
    """
    known = evidence.select("evidence_id").distinct().withColumn("_known", F.lit(True))
    x = citations.join(known, "evidence_id", "left").join(evidence.select("evidence_id", "source_record_id", "slice_text"), ["evidence_id", "source_record_id"], "left")
    quote, text = F.coalesce(F.col("quote_text"), F.lit("")), F.col("slice_text")
    holds = F.contains(text, quote) | F.contains(key(text), key(quote))
    issue = F.when(F.col("_known").isNull(), "missing evidence_id").when(text.isNull(), "missing source_record_id").when((F.trim(quote) != "") & ~holds, "quote_text mismatch")
    return x.withColumn("issue", issue).drop("_known")


def grounded_points(checked: DataFrame, by: list[str]) -> DataFrame:
    """by, grounded, points: a point is grounded if it has citations and none of them has an issue."""
    points = checked.groupBy(*by, "point_id").agg(F.bool_and(F.col("issue").isNull()).alias("ok"))
    return points.groupBy(*by).agg(F.count_if("ok").alias("grounded"), F.count(F.lit(1)).alias("points"))


def answer_status(retrieval: Column, evidence: Column, grounded: Column, points: Column) -> Column:
    return F.when((evidence == 0) & (retrieval == "failure_gaps"), "retrieval_failure").when((evidence == 0) | (points == 0) | (grounded < points), "insufficient_evidence").otherwise("grounded_success")


def uncertainty_notes(retrieval: Column, gaps: Column, clipped: Column, pruned: Column, policy_incomplete: Column, heuristic: Column, has_academic: Column, has_industry: Column, issues: Column, strong: Column) -> Column:
    """Notes in their fixed order; gaps and issues are arrays."""
    label = lambda g: F.coalesce(sum_when(g, V.GAP_LABELS), F.replace(g, F.lit("_"), F.lit(" ")))
    weak = ~strong & ((retrieval != "success") | clipped | pruned | (F.size(issues) > 0))
    cut = F.array_join(F.array_compact(F.array(F.when(clipped, "bounded evidence was clipped"), F.when(pruned, "bounded evidence was pruned"))), ", ")
    return F.array_compact(F.array(
        F.when((clipped | pruned) & ~strong, F.concat(F.lit("Evidence clipped: "), cut, F.lit("."))),
        F.when((retrieval != "success") & (F.size(gaps) > 0), F.concat(F.lit("Retrieval gaps: "), F.array_join(F.transform(gaps, label), "; "))),
        F.when(policy_incomplete, "Policy metadata incomplete: at least one policy record is missing version or observed jurisdiction metadata."),
        F.when(heuristic, "Academic match heuristic: at least one academic merge relied on heuristic citation matching."),
        F.when(weak & has_academic, "Academic coverage gap: retained academic evidence may miss corroborating papers, benchmarks, or reviewed versions."),
        F.when(weak & has_industry, "Industry coverage gap: retained industry evidence may miss corroborating filings, official disclosures, or full article-body context."),
        F.when(F.size(issues) > 0, F.concat(F.lit("Citation validation: "), F.array_join(issues, "; "))),
    ))
