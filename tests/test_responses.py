from pyspark.sql import functions as F

from sievework.operators import reports, responses
from sievework.plans.benchmark import run_suite


def test_short_answers(spark):
    rows = [("academic_no_support", "timeout", False), ("academic_no_support", "no_hits", True), ("budget", None, False), ("retrieval_failure", "timeout", False), ("relevance", None, True)]
    df = spark.createDataFrame(rows, "cause string, failure string, han boolean")
    x = df.select("cause", *(c.alias(n) for n, c in responses.short_answer(F.col("cause"), F.col("failure"), F.col("han"), F.lit("too late"), F.array(F.lit("n"))).items())).collect()
    assert [r["answer_status"] for r in x] == ["insufficient_evidence"] * 3 + ["retrieval_failure", "insufficient_evidence"]
    assert x[0]["uncertainty_notes"][0].endswith("before the search budget was exhausted.")
    assert x[1]["conclusion"].startswith("目前")
    assert x[2]["uncertainty_notes"] == ["Budget enforcement: too late", "n"]
    assert x[3]["uncertainty_notes"] == ["n"]
    assert x[4]["uncertainty_notes"][0].startswith("回答范围")


def test_no_support(spark):
    def asked(**changes):
        v = {"n": 0, "status": "failure_gaps", "label": "academic", "primary": "academic", "supplemental": None, "failure": "no_hits", "gaps": ["academic_arxiv"], "lookup": True} | changes
        df = spark.createDataFrame([tuple(v.values())], "n int, status string, label string, primary string, supplemental string, failure string, gaps array<string>, lookup boolean")
        return df.select(responses.academic_no_support(*(F.col(c) for c in v)).alias("v")).first()["v"]

    assert asked()
    assert not any(asked(**c) for c in ({"n": 1}, {"gaps": ["policy_x"]}, {"failure": None}, {"supplemental": "policy"}, {"lookup": False}))


def test_budgets_and_prompt(spark):
    df = spark.createDataFrame([(10.0, 3.0, 8.25, [{"id": "a"}], ["g"])], "d double, s double, e double, ev array<map<string,string>>, gaps array<string>")
    r = df.select(responses.remaining_request_seconds(F.col("d"), F.col("e")).alias("r"), responses.remaining_synthesis_seconds(F.col("s"), F.col("d"), F.col("e")).alias("s"), responses.prompt(F.lit("q"), F.col("ev"), F.lit(True), F.lit(False), F.col("gaps")).alias("p")).first()
    assert (r["r"], r["s"]) == (1.75, 1.75)
    assert r["p"].endswith('query: q\nevidence_clipped: true\nevidence_pruned: false\nretrieval_gaps: ["g"]\ncanonical_evidence:\n[{"id":"a"}]\n')


def test_suite_runs_into_reports(spark):
    runs = run_suite(spark, [("good", lambda: spark.range(3)), ("bad", lambda: spark.range(1).select("nope"))], 2)
    s = {r["case_id"]: r for r in reports.run_summary(runs, ["case_id"], F.col("success"), "elapsed_ms", F.lit(True)).collect()}
    assert (s["good"]["success_rate"], s["bad"]["success_rate"]) == (1.0, 0.0)
