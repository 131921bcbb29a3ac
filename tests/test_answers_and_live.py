from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.operators import classify, intents, live, local_answers
from sievework.operators.paragraphs import paragraphs_of
from sievework.sources import registries


def asked(spark, texts):
    x = spark.createDataFrame(list(enumerate(texts)), "i int, query string").withColumn("normal", X.normalize_query(F.col("query"), True))
    return classify.traits(x.withColumn("words", X.tokens(F.col("normal"))))


def one(df, column):
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_lookups_with_the_real_markers(spark):
    x = intents.lookups(asked(spark, ["latest version of the methane rule", "what is the impact on battery prices", "arxiv paper on grounding", "battery recycling market share forecast 2025", "列出相关论文有哪些", "AI Act 对开源模型产业落地影响"]))
    rows = x.orderBy("i").select("academic_lookup", "policy_lookup", "industry_lookup", "cross_effect", "many_items").collect()
    assert [tuple(r) for r in rows] == [
        (False, True, False, False, False), (False, False, False, True, False), (True, False, False, False, False), (True, False, True, False, False), (True, False, False, False, True), (False, False, False, True, False),
    ]


def test_source_intents_with_the_real_markers(spark):
    x = intents.source_intents(asked(spark, ["Tesla 10-K segment revenue", "FCC cyber trust mark", "新能源汽车 趋势", "GPU 份额预测 market", "sec enforcement"]))
    rows = x.orderBy("i").select("filings", "detailed_disclosure", "us_policy", "direct_policy", "han_news_only").collect()
    assert [tuple(r) for r in rows] == [(True, True, False, False, False), (False, False, True, True, False), (False, False, False, False, True), (False, False, False, False, False), (True, False, False, False, False)]


def test_upstream_queries(spark):
    x = asked(spark, ["Grounded  RAG survey", "RAG 综述 rag", "论文 综述", "what's new?", ""])
    assert one(x.withColumn("u", intents.upstream_query(F.col("query"), F.col("normal"), F.col("words"))), "u") == ["grounded rag survey", "rag", "论文 综述", "what s new", ""]


def test_series_in_both_languages(spark):
    x = spark.createDataFrame([(0, [], True), (1, ["a"], True), (2, ["a", "", "b"], True), (3, ["a", "b", "c"], True), (4, ["a", "b", "c"], False)], "i int, s array<string>, han boolean")
    assert one(x.withColumn("t", X.join_series(F.col("s"), F.col("han"))), "t") == ["", "a", "a和b", "a、b，以及c", "a, b, and c"]


MATCH = "struct<evidence_id:string,domain:string,title:string,url:string,text:string,source_record_id:string,overlap:int,authority:string,version:string,effective_date:string,publication_date:string,first_author:string,year:int>"


def match(n, domain="policy", **more):
    row = {"evidence_id": f"e{n}", "domain": domain, "title": f"T{n}", "url": f"u{n}", "text": f"Text {n}.", "source_record_id": f"s{n}", "overlap": 2, "authority": None, "version": None, "effective_date": None, "publication_date": None, "first_author": None, "year": None} | more
    return tuple(row.values())


def test_conclusions_in_chinese(spark):
    m = [match(1, authority="CAC", version="v2", effective_date="2024-03-22"), match(2, "academic", first_author="Li", year=2024), match(3, "industry")]
    df = spark.createDataFrame([(m,)], f"m array<{MATCH}>")
    p, a, i = (F.get("m", F.lit(k)) for k in range(3))
    yes, no, none = F.lit(True), F.lit(False), F.slice("m", 1, 0)
    r = df.select(
        local_answers.policy_conclusion(p, F.slice("m", 3, 1), yes, no, yes).alias("policy"), local_answers.academic_conclusion(F.slice("m", 2, 1), yes, yes, no, yes).alias("academic"), local_answers.industry_conclusion(i, none, F.lit(None).cast(MATCH), yes, no).alias("industry"),
        local_answers.mixed_conclusion(p, a, yes).alias("mixed"),
    ).first()
    assert r["policy"] == '最相关的官方政策变化文件是 "T1" (发布机构 CAC；版本 v2；自 2024-03-22 起生效). 补充官方依据还包括 "T3".'
    assert r["academic"] == '一篇直接相关的学术基准论文是 "T2" (Li, 2024). 更广的文献覆盖仍不完整.'
    assert r["industry"] == '当前最直接的行业来源是 "T3"。'
    assert r["mixed"] == '现有来源显示的影响线索是："T1" 表明 Text 1；"T2" 表明 Text 2。 这表明政策要求可能改变研究条件，但现有来源并未量化这种影响。'


def test_assembled_answers_drop_points_with_bad_citations(spark):
    m = [match(1), match(2), match(2)]
    df = spark.createDataFrame([("q", "success", 2, "Said.", m), ("r", "success", 0, "Said.", []), ("t", "failure_gaps", 0, "Said.", [])], f"qid string, retrieval_status string, n_evidence int, conclusion string, m array<{MATCH}>")
    df = df.withColumns({"key_points": local_answers.key_points(F.col("m")), "draft_sources": local_answers.sources(F.col("m"))}).drop("m")
    slices = spark.createDataFrame([("q", "e1", "s1", "So: text 1!", "R1", "v1"), ("q", "e1", "s1", "So: text 1!", "R1", "v1"), ("q", "e2", "s2", "something else", "R2", "v2"), ("r", "e1", "s1", "x", "R", "v")], "qid string, evidence_id string, source_record_id string, slice_text string, title string, url string")
    rows = {r["qid"]: r for r in local_answers.assembled(df, slices).collect()}
    q = rows["q"]
    assert (q["answer_status"], q["grounded"], q["points"]) == ("insufficient_evidence", 1, 3)
    assert [p["key_point_id"] for p in q["key_points"]] == ["kp-1"]
    assert q["key_points"][0]["citations"][0]["quote_text"] == "So: text 1!"
    assert [tuple(s) for s in q["sources"]] == [("e1", "T1", "u1")]
    assert q["issues"] == ["kp-2: quote_text mismatch", "kp-3: quote_text mismatch"]
    assert (rows["r"]["answer_status"], rows["r"]["key_points"], rows["t"]["answer_status"]) == ("insufficient_evidence", [], "retrieval_failure")


def test_partial_conclusions(spark):
    df = spark.createDataFrame([([match(1, "industry")],)], f"m array<{MATCH}>").withColumn("p", local_answers.key_points(F.col("m")))
    both, none, no = F.array(F.lit("policy"), F.lit("industry")), F.array().cast("array<string>"), F.lit(False)
    titles = F.create_map(F.lit("e1"), F.lit("T1"))
    said = lambda points, label, han: local_answers.partial_conclusion(points, titles, F.lit(label), both, none, none, no, F.lit(han))
    r = df.select(said(F.col("p"), "mixed", False).alias("a"), said(F.slice("p", 1, 0), "industry", False).alias("b"), said(F.col("p"), "industry", True).alias("c")).first()
    assert r["a"].startswith('Taken together, current sources show these parallel signals: "T1" indicates Text 1. Current evidence provides a policy-side signal')
    assert r["b"] == "Current sources are relevant but incomplete. A complete answer would still need more industry corroboration or original-source detail."
    assert r["c"] == '目前可以确认的是："T1" 显示 Text 1。完整回答这个问题仍需要更多行业佐证或原始来源细节.'


def test_local_answer_replaces_one_that_leaves_out_what_was_asked(spark):
    part = "struct<answer_status:string,conclusion:string,key_points:array<struct<statement:string>>,sources:array<struct<title:string>>>"
    good = lambda text, status="grounded_success": (status, text, [("p",)], [("T",)])
    own = good("Effective 2024-03-22, version 2.1 of T")
    rows = [(0, good("T is effective 2024-03-22, version 2.1 indeed"), own), (1, good("T is effective, version 2.1 of 2024"), own), (2, good("T 2024-03-22 has a version"), own), (3, good("x", "insufficient_evidence"), own), (4, good("x"), good("y", "insufficient_evidence")), (5, good("x"), None)]
    df = spark.createDataFrame(rows, f"i int, generated {part}, local {part}").withColumns({c: F.lit(True) for c in ("has_effective_date_intent", "has_version_intent")} | {c: F.lit(False) for c in ("has_year", "is_policy_change")})
    assert one(df.withColumn("o", local_answers.local_overrides(df)), "o") == [False, True, True, True, False, False]


def test_trimmed_texts(spark):
    words = [f"w{i}" for i in range(60)]
    words[50] = "foo-grounding"
    df = spark.createDataFrame([(0, " ".join(words), ["grounding"]), (1, " ".join(words), []), (2, "a  b", ["grounding"])], "i int, t string, terms array<string>")
    got = one(df.withColumn("s", live.trimmed(F.col("t"), F.col("terms"))), "s")
    assert got == ["..." + " ".join(words[11:51]) + "...", " ".join(words[:40]), "a  b"]


def test_news_titles(spark):
    df = spark.createDataFrame([(0, "2026 GPUs: what's next? - Part 1 - The Paper"), (1, "Alone"), (2, " - ")], "i int, t string")
    assert one(df.withColumn("s", live.news_search_title(F.col("t"))), "s")[:2] == ["GPUs what s next Part 1", "Alone"]


def test_settings():
    assert registries.settings("# x\nA = 'b c'\nB=2\nC\n=3\nA=9\nD=\"", {"B": "1"}) == {"B": "1", "A": "b c", "D": '"'}


def test_paragraphs_as_described():
    long = "One two three four five six seven eight nine ten. "
    assert paragraphs_of(None) == paragraphs_of("short") == []
    assert paragraphs_of("a short line\n\nand another that is long enough to be kept by itself\n\nend") == ["a short line and another that is long enough to be kept by itself"]
    assert paragraphs_of(long * 20) == [(long * 9).strip(), (long * 2).strip()]
    assert [len(p) for p in paragraphs_of("".join(chr(97 + i % 26) for i in range(1000)))] == [480, 480, 40]
    assert paragraphs_of("x" * 1000) == ["x" * 480, "x" * 40]
    assert paragraphs_of(f"{'y' * 50}\n{'y' * 50}") == ["y" * 50]
    mixed = paragraphs_of("z" * 600 + ". " + "Tail sentence that is long enough to stay here.")
    assert [len(p) for p in mixed] == [480, 121, 47]
