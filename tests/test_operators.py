"""Unit cases: vocabularies, order-dependent rules, loops that became windows."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions import vocabulary as V
from sievework.operators import answers, classify, dedupe, evidence, paragraphs, ranking, retrieval
from sievework.plans import retrieval_plan, variants


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values()) or (1,)], list(columns) or ["x"])
    return df.select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("query", "label", "primary", "supplemental", "reason"),
    [
        ("latest climate policy regulation guidance text", "policy", "policy", None, "policy_hit"),
        ("retrieval evaluation dataset paper 2025", "academic", "academic", None, "academic_hit"),
        ("smartphone market share forecast 2026", "industry", "industry", None, "industry_hit"),
        ("battery", "mixed", "industry", "policy", "short_query"),
        ("impact of export controls policy on semiconductor market", "mixed", "policy", "industry", "explicit_cross_domain"),
        ("数据出境监管政策的最新变化和实施时间说明", "policy", "policy", None, "policy_hit"),
        ("what did they say about wonderful things yesterday", "mixed", "policy", None, "low_signal"),
        ("tell me something about an inspection in transposition", "policy", "policy", None, "policy_weak_hit"),
    ],
)
def test_labels(spark, query, label, primary, supplemental, reason):
    r = classify.classify(spark.createDataFrame([(query,)], ["query"])).first()
    got = (r["route_label"], r["primary_route"], r["supplemental_route"], r["reason_code"])
    if reason == "short_query":
        assert got[0] == label and got[1] == primary and got[3] == reason
    else:
        assert got == (label, primary, supplemental, reason)


def test_a_marker_in_both_lists_counts_twice(spark):
    r = classify.classify(spark.createDataFrame([("a survey of gpu things and so on",)], ["query"])).first()
    assert (r["academic_score"], r["industry_score"]) == (4, 4)


def test_normal_form(spark):
    assert one(spark, X.normalize_query(F.col("x"), unicode=True), x="  Ｈello，　World！ ﬁn ") == "hello,world! fin" or one(spark, X.normalize_query(F.col("x"), unicode=True), x="  Ｈello，　World！ ﬁn ") == "hello, world! fin"
    assert one(spark, X.tokens(F.col("x")), x="ab-3 数据x") == ["ab", "3", "数", "据", "x"]
    assert one(spark, X.token_estimate(F.col("x")), x="") == 0
    assert one(spark, answers.quote_key(F.col("x")), x="“Straße”,  ＡＢ ") == "strasse ab"


@pytest.mark.parametrize(("text", "want"), [("on 2024-02-29 x", 738945), ("2026-13-40 2024-01-01", 0), ("none", 0), ("2025/01_02", 739253)])
def test_recency(spark, text, want):
    assert one(spark, X.recency(F.col("x")), x=text) == want


def test_dates_and_addresses(spark):
    assert one(spark, X.iso_date(F.col("x")), x="于2024年3月5日 2023-1-2") == "2023-01-02"
    assert one(spark, X.iso_date(F.col("x")), x="于2024年3月5日") == "2024-03-05"
    assert one(spark, X.canonical_url(F.col("x")), x="HTTPS://Ab.Example:80/A/b//?q#f") == "https://ab.example:80/A/b"
    assert one(spark, X.host(F.col("x")), x="https://u@WWW.Ab.example:80/A") == "www.ab.example"
    assert one(spark, X.json_object(F.col("x")), x='```json\n{"a": {"b": 1}}\n```') == '{"a": {"b": 1}}'


def test_budget_equals_the_loop(spark):
    r = random.Random(3)
    rows = [(q, rec, r.randint(0, 9) / 10, r.randint(1, 30), f"t{q}-{rec}-{i}") for q in range(30) for rec in range(r.randint(1, 5)) for i in range(r.randint(1, 4))]
    df = spark.createDataFrame(rows, "q int, record_id int, score double, tokens int, text string")
    got = {(x["q"], x["text"]) for x in evidence.trim_slices(df, ["q"], 60).collect()}
    want = set()
    for q in range(30):
        held = [x for x in rows if x[0] == q]
        while sum(x[3] for x in held) > 60:
            able = [x for x in held if sum(y[1] == x[1] for y in held) > 1]
            if not able:
                break
            lowest = {rec: min((x for x in able if x[1] == rec), key=lambda x: (x[2], x[3], x[4])) for rec in {x[1] for x in able}}
            held.remove(min(lowest.values(), key=lambda x: (x[2], x[3], x[1])))
        want |= {(q, x[4]) for x in held}
    assert got == want


def test_record_drop_equals_the_loop(spark):
    r = random.Random(4)
    rows = [(q, i, r.choice(["primary", "supplemental"]), r.randint(0, 9), r.randint(1, 50)) for q in range(60) for i in range(r.randint(1, 8))]
    df = spark.createDataFrame(rows, "q int, record_id int, role string, score int, tokens int")
    for reserve in (0, 1, 2):
        got = {(x["q"], x["record_id"]) for x in evidence.drop_records(df, ["q"], 80, reserve).collect()}
        want = set()
        for q in range(60):
            held = [x for x in rows if x[0] == q]
            while held and sum(x[4] for x in held) > 80:
                s, p = (sum(x[2] == k for x in held) for k in ("supplemental", "primary"))
                able = [x for x in held if not (x[2] == "supplemental" and s <= reserve and p)] or held
                held.remove(min(able, key=lambda x: (x[3], x[4], x[1])))
            want |= {(x[0], x[1]) for x in held}
        assert got == want


def test_academic_components(spark):
    rows = [(0, "A paper", "X", 2020, "10.1", None, "s", "u0"), (1, "B", "Y", 2021, None, "1234", "s", "u1"), (2, "a PAPER preprint", "x", 2020, None, "1234", "s", "u2"), (3, None, None, None, None, None, "s", "u3"), (4, None, None, None, None, None, "s", "u3"), (5, "C", None, None, "", None, "s", "u5")]
    df = spark.createDataFrame(rows, "pos int, title string, first_author string, year int, doi string, arxiv_id string, source_id string, url string")
    got = {r["pos"]: r["component"] for r in dedupe.alias_components(df, "pos", dedupe.academic_aliases()).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}


def test_policy_groups_compare_with_the_first_record(spark):
    rows = [(0, "Ministry", "Rule Mirror", "v1", "2024-01-01", None), (1, "ministry ", "rule", "v1", "2024-02-02", None), (2, "Ministry", "Rule", None, "2024-02-02", None), (3, "Ministry", "Rule", None, None, None), (4, None, "Rule", "v1", "2024-01-01", None)]
    df = spark.createDataFrame(rows, "pos long, authority string, title string, version string, publication_date string, effective_date string")
    assert {r["pos"]: r["group_pos"] for r in dedupe.policy_groups(df).collect()} == {0: 0, 1: 0, 2: 2}


def test_similar_groups(spark):
    rows = [(0, "h", "annual results of the company", "profit rose by ten percent this year"), (1, "h", "annual results of the company!", "profit rose by ten percent this year."), (2, "g", "annual results of the company", "profit rose by ten percent this year"), (3, "h", "other news", "profit rose by ten percent this year")]
    df = spark.createDataFrame(rows, "pos long, host string, title string, snippet string")
    assert {r["pos"]: r["group_pos"] for r in dedupe.similar_groups(df, F.col("host")).collect()} == {0: 0, 1: 0, 2: 2, 3: 3}
    for a, b in (("tide", "diet"), ("diet", "tide"), ("abcd", "abce")):
        for least in (0.25, 0.5, 0.75):
            assert dedupe.similarity(a, b, least) == (SequenceMatcher(a=a, b=b).ratio() >= least)


def test_fallback_paths(spark):
    def path(source, *reasons):
        return one(spark, retrieval.fallback_path(F.col("s"), [F.lit(r) for r in reasons]), s=source)

    assert path("policy_official_registry", "no_hits", "timeout") == ["policy_official_registry", "policy_official_web_allowlist_fallback"]
    assert path("industry_ddgs", "timeout", "rate_limited", "timeout") == ["industry_ddgs", "industry_news_rss", "industry_web_discovery"]
    assert path("industry_ddgs", "adapter_error", "timeout") == ["industry_ddgs"]


def test_plans(spark):
    steps = {(a, b): r for a, b, r in retrieval_plan.fallback_steps(["policy_official_registry"])}
    assert steps == {("policy_official_registry", "policy_official_web_allowlist_fallback"): ["no_hits", "timeout", "rate_limited"]}
    assert retrieval_plan.fallback_table(spark).count() == 2
    df = classify.traits(classify.classify(spark.createDataFrame([("smartphone market share forecast 2026",), ("acme annual report revenue market share",), ("impact of export controls policy on semiconductor market",)], ["query"])))
    waves = [[(s["source_id"], s["role"]) for s in r["first_wave"]] for r in retrieval_plan.plan(df).collect()]
    assert waves[0] == [("industry_web_discovery", "primary")]
    assert [s for s, _ in waves[1]] == list(V.FIRST_WAVE["industry"])
    assert waves[2][0] == ("policy_official_registry", "primary") and waves[2][1][1] == "supplemental"


@pytest.mark.parametrize(
    ("query", "target", "want"),
    [
        ("latest methane rule revision 2025", "policy", {"original": "latest methane rule revision 2025", "core_focus": "methane rule revision", "policy_change": "latest methane rule revision 2025 amendment"}),
        ("半导体市场份额预测", "industry", {"industry_cjk_gloss": "semiconductor market share forecast"}),
        ("acme 2024 annual report segment revenue", "industry", {"document_focus": "acme annual report segment revenue", "document_concept_focus": "acme segment revenue"}),
        ("arxiv research paper on grounded retrieval", "academic", {"academic_topic_focus": "on grounded retrieval", "academic_lookup": "on grounded retrieval paper research"}),
    ],
)
def test_variants(spark, query, target, want):
    df = classify.traits(classify.classify(spark.createDataFrame([(query,)], ["query"])))
    got = {v["reason"]: v["query"] for v in variants.variants(df, target, 6).first()["variants"]}
    assert want.items() <= got.items()
    assert len(set(got.values())) == len(got)


def test_fragments(spark):
    df = classify.classify(spark.createDataFrame([(1, "new export controls policy impact on semiconductor market share")], "id int, query string"))
    assert variants.best_fragment(df, "id", "industry").first()["fragment"] == "semiconductor market share"


def test_paragraphs():
    text = "Short.\n\nAlso short.\n\n" + "A long sentence of words here. " * 30 + "\n\nshort tail"
    out = paragraphs.paragraphs_of(text)
    assert all(40 <= len(p) <= 480 for p in out)
    assert out[0].startswith("Short. Also short. A long")
    assert len(set(out)) == len(out)
    assert paragraphs.paragraphs_of("") == []
    assert paragraphs.paragraphs_of("x" * 1000) == ["x" * 480, "x" * 40] or len(paragraphs.paragraphs_of("x" * 1000)[0]) == 480


def test_fact_density(spark):
    text = "The Ministry published Article 5 on 2024-03-01, version 2.1, raising fees by 10% to $5 in FY2024."
    points = 3.2 + 2.0 + 2.6 + 3 * 1.2 + 0.8  # a date, a version, a clause, three figures, an authority
    assert one(spark, paragraphs.fact_density(F.col("x")), x=text) == pytest.approx(points * (0.55 + 0.45 * len(text) / 220))
    assert one(spark, paragraphs.fact_density(F.col("x")), x="") == 0


def test_ranking_does_not_depend_on_partitions(spark):
    rows = [(i % 3, i, ["primary", "supplemental", "other"][i % 7 % 3], i * 7919 % 100) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, pos int, role string, score int")
    order = [F.desc("score"), F.asc("pos")]
    for f in (lambda d: ranking.reserved_top_k(d, ["g"], "role", order, 6, 2), lambda d: ranking.mixed_blocks(d, ["g"], "role", order), lambda d: ranking.interleaved(d, ["g"], "role", order), lambda d: ranking.one_of_each_then_best(d, ["g"], "role", order, 4)):
        a, b = (sorted(map(tuple, f(df.repartition(n)).collect())) for n in (1, 7))
        assert a == b


@pytest.mark.parametrize(("evidence_n", "grounded", "points", "retrieval_status", "want"), [(0, 0, 0, "failure_gaps", "retrieval_failure"), (0, 0, 0, "success", "insufficient_evidence"), (2, 1, 2, "success", "insufficient_evidence"), (2, 0, 0, "success", "insufficient_evidence"), (2, 2, 2, "failure_gaps", "grounded_success")])
def test_answer_status(spark, evidence_n, grounded, points, retrieval_status, want):
    assert one(spark, answers.answer_status(F.lit(retrieval_status), F.lit(evidence_n), F.lit(grounded), F.lit(points))) == want


def test_abstract(spark):
    df = spark.createDataFrame([({"world": [1, 3], "hello": [0], "new": [2]},)], "m map<string,array<int>>")
    assert df.select(X.abstract_text(F.col("m")).alias("v")).first()["v"] == "hello world new world"


@pytest.mark.parametrize("seed", range(3))
def test_live_hits(spark, seed):
    r = random.Random(seed)
    tiers = ["company_official", "industry_association", "trusted_news", "general_web"]
    rows = [(g, f"u{g}-{i}", r.choice(tiers[seed % 2 :]), r.choice([0, 0, 1, 2, 5])) for g in range(40) for i in range(r.randint(1, 7))]
    rows += [(g, f"u{g}-x", "company_official", 1) for g in range(0, 40, 3)]
    got = {}
    for x in ranking.live_hits(spark.createDataFrame(rows, "g int, url string, tier string, score int"), ["g"]).orderBy("g", "rank").collect():
        got.setdefault(x["g"], []).append(x["url"])
    for g in range(40):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[3], -tiers.index(x[2]), x[1]), reverse=True)
        top = [x for x in own if x[3] > 0][:3] or own[:3]
        best = next((x for x in own if x[2] == "company_official" and x[3] > 0), None)
        if best and not any(x[2] == "company_official" for x in top):
            top = top[:2] + [best] if len(top) >= 3 else top + [best]
        assert got[g] == [x[1] for x in top]


def test_excerpts(spark):
    text = " ".join(f"word{i}" for i in range(100)) + " gold silver " + " ".join(f"tail{i}" for i in range(60))
    for most in (40, 90, 200):
        got = paragraphs.excerpt_of(text, {"gold", "silver"}, most, 4)
        assert len(got) <= most and got in text
        assert "gold silver" in got
    assert paragraphs.excerpt_of("a  b", {"b"}, 10) == "a b"
    assert paragraphs.excerpt_of("x" * 50, set(), 10) == "x" * 10
    df = spark.createDataFrame([(text, ["gold"]), (None, None)], "t string, w array<string>")
    assert [r["e"] for r in df.select(paragraphs.best_excerpt(90)(F.col("t"), F.col("w")).alias("e")).collect()] == [paragraphs.excerpt_of(text, {"gold"}, 90), None]
