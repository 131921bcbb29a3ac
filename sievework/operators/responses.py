"""Answers that fall short, prompts and budgets, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievework.operators.classify import sum_when

# What is said when an answer falls short, by cause; notes in English and in Chinese.
CONCLUSIONS = {
    "retrieval_failure": "Retrieval failed before a grounded answer could be produced.",
    "academic_no_support": "Available evidence was insufficient to verify the requested academic lookup.",
    "budget": "Available runtime budget was insufficient to complete grounded synthesis.",
    "frontier": "Available evidence was insufficient to fully support the requested answer.",
    "relevance": "Available evidence was insufficient to fully support the requested answer.",
    "backend": "Available evidence was insufficient to fully support the requested answer.",
}
ACADEMIC_CONCLUSION_HAN = "目前可得证据不足以验证这个学术检索请求。"
NOTES = {
    "academic_no_support": ("Academic lookup: available scholarly sources did not surface a directly supportable match for this query.", "学术检索：可用的学术来源未能提供这个查询的直接可支撑匹配。"),
    "academic_timeout": ("Academic lookup: available scholarly sources did not surface a directly supportable match before the search budget was exhausted.", "学术检索：可用的学术来源在检索预算耗尽前，仍未返回这个查询的直接可支撑匹配。"),
    "relevance": ("Answer scope: current sources are not specific enough to ground this exact query.", "回答范围：当前保留来源还不足以直接支撑这个问题的精确表述。"),
    "backend": ("Answer assembly: the full source-backed synthesis did not complete, so this response is limited to directly supported evidence.", "回答生成：本次完整的来源综合未能完成，因此以下内容仅限于当前可直接支撑的证据。"),
}
PROMPT = (
    "You are a grounded answer generator.",
    "Return JSON only with fields conclusion, key_points, sources, uncertainty_notes.",
    "Each key_points item must contain key_point_id, statement, citations.",
    "Each citation must contain evidence_id and source_record_id.",
    "source_url and quote_text are optional and will be backfilled from evidence.",
    "Preserve concrete entities, years, versions, publication dates, and effective dates when evidence provides them.",
    "Do not replace specific titles or grounded dates with generic summaries.",
    "For mixed-route evidence, keep both primary and supplemental route coverage when both are supported by evidence.",
    "Do not drop a stronger local evidence-backed candidate in favor of a weaker paraphrase.",
)


def academic_no_support(evidence: Column, status: Column, label: Column, primary: Column, supplemental: Column, failure: Column, gaps: Column, lookup: Column) -> Column:
    """A failed academic lookup counts as too little evidence if only academic sources failed, for want of hits or time."""
    own = F.forall(gaps, lambda g: g.startswith("academic_"))
    return (evidence == 0) & (status == "failure_gaps") & (label == "academic") & (primary == "academic") & supplemental.isNull() & F.coalesce(failure.isin("no_hits", "timeout"), F.lit(False)) & lookup & own


def short_answer(cause: Column, failure: Column, han: Column, detail: Column, notes: Column) -> dict[str, Column]:
    """status, conclusion and notes for answers without evidence. detail is the reason that budget and frontier notes give; han: the query has other characters than ASCII."""
    said = lambda key: F.when(han, NOTES[key][1]).otherwise(NOTES[key][0])
    lead = (
        F.when((cause == "academic_no_support") & (failure == "timeout"), said("academic_timeout"))
        .when(cause == "academic_no_support", said("academic_no_support"))
        .when(cause == "relevance", said("relevance"))
        .when(cause == "backend", said("backend"))
        .when(cause == "budget", F.concat(F.lit("Budget enforcement: "), detail))
        .when(cause == "frontier", F.concat(F.lit("Coverage frontier: "), detail))
    )
    return {
        "answer_status": F.when(cause == "retrieval_failure", cause).otherwise("insufficient_evidence"),
        "conclusion": F.when((cause == "academic_no_support") & han, ACADEMIC_CONCLUSION_HAN).otherwise(sum_when(cause, CONCLUSIONS)),
        "uncertainty_notes": F.concat(F.array_compact(F.array(lead)), notes),
    }


def remaining_request_seconds(deadline: Column, elapsed: Column) -> Column:
    return F.bround(F.greatest(F.lit(0.0), deadline - F.greatest(F.lit(0.0), elapsed)), 6)


def remaining_synthesis_seconds(synthesis: Column, deadline: Column, retrieval_elapsed: Column) -> Column:
    return F.least(synthesis, remaining_request_seconds(deadline, retrieval_elapsed))


def prompt(query: Column, evidence: Column, clipped: Column, pruned: Column, gaps: Column) -> Column:
    """The text for a model: instructions, the query's state, and its evidence as JSON (characters are not escaped to ASCII)."""
    flag = lambda c: F.when(c, "true").otherwise("false")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    return F.concat_ws("\n", F.lit("\n".join(PROMPT)), line("query", query), line("evidence_clipped", flag(clipped)), line("evidence_pruned", flag(pruned)), line("retrieval_gaps", F.to_json(gaps)), F.lit("canonical_evidence:"), F.to_json(evidence), F.lit(""))
