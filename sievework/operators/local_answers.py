"""Answers from the evidence alone, without a model: texts, points and sources, and when one replaces a model's answer.

A match is a struct: evidence_id, domain, title, url, text, source_record_id, overlap, authority, version, effective_date,
publication_date, first_author and year. Queries carry their matches as arrays of at most a handful.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.markers import contains_any
from sievework.functions.text import join_series, normalize_query
from sievework.operators.answers import answer_status, check_citations, quote_key
from sievework.operators.components import checkpoint
from sievework.operators.matches import truncated


def quoted(titles: Column) -> Column:
    return join_series(F.transform(F.filter(titles, lambda t: F.coalesce(t, F.lit("")) != ""), lambda t: F.concat(F.lit('"'), t, F.lit('"'))))


def key_points(matches: Column, first: int = 1) -> Column:
    """A point for each match, which says the match's text and cites it."""
    cite = lambda m: F.struct(m["evidence_id"].alias("evidence_id"), m["source_record_id"].alias("source_record_id"), m["url"].alias("source_url"), m["text"].alias("quote_text"))
    return F.transform(matches, lambda m, i: F.struct(F.concat(F.lit("kp-"), (i + first).cast("string")).alias("key_point_id"), m["text"].alias("statement"), F.array(cite(m)).alias("citations")))


def sources(matches: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["evidence_id"].alias("evidence_id"), m["title"].alias("title"), m["url"].alias("url")))


def _say(han: Column, chinese: Column, english: Column) -> Column:
    return F.when(han, chinese).otherwise(english)


def _text(*parts) -> Column:
    """Texts and columns one after the other."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


# Fixed values in the functions below: what the answers say, in Chinese and in English.
def academic_conclusion(matches: Column, han: Column, benchmark: Column, research: Column, many: Column) -> Column:
    best = F.get(matches, F.lit(0))
    one = F.when(benchmark, _say(han, F.lit("学术基准论文"), F.lit("benchmark paper"))).when(research, _say(han, F.lit("研究"), F.lit("research work"))).otherwise(_say(han, F.lit("学术论文"), F.lit("paper")))
    several = F.when(benchmark, _say(han, F.lit("相关学术基准论文"), F.lit("benchmark papers"))).when(research, _say(han, F.lit("相关研究"), F.lit("research works"))).otherwise(_say(han, F.lit("相关学术论文"), F.lit("papers")))
    known = F.array_compact(F.array(F.nullif(best["first_author"], F.lit("")), best["year"].cast("string")))
    suffix = F.when(F.size(known) > 0, _text(" (", F.array_join(known, ", "), ")")).otherwise("")
    titles = quoted(F.transform(matches, lambda m: m["title"]))
    return (
        F.when(F.size(matches) > 1, _say(han, _text(several, "包括 ", titles, "."), _text("Relevant academic ", several, " include ", titles, ".")))
        .when(many, _say(han, _text("一篇直接相关的", one, '是 "', best["title"], '"', suffix, ". 更广的文献覆盖仍不完整."), _text("One directly relevant academic ", one, ' is "', best["title"], '"', suffix, ". Broader literature coverage remains incomplete.")))
        .otherwise(_say(han, _text("一篇直接相关的", one, '是 "', best["title"], '"', suffix, "."), _text("A directly relevant academic ", one, ' is "', best["title"], '"', suffix, ".")))
    )


def policy_conclusion(record: Column, supporting: Column, han: Column, exemption: Column, change: Column) -> Column:
    lead = F.when(exemption, _say(han, F.lit("最相关的官方豁免指引是"), F.lit("The most relevant official exemption guidance is"))).when(change, _say(han, F.lit("最相关的官方政策变化文件是"), F.lit("The most relevant official policy change is"))).otherwise(_say(han, F.lit("最相关的官方政策是"), F.lit("The most relevant official policy is")))
    given = lambda c, chinese, english: F.when(c.isNotNull(), _say(han, chinese, english))
    authority = F.nullif(record["authority"], F.lit(""))
    dated = F.coalesce(
        given(record["effective_date"], _text("自 ", record["effective_date"], " 起生效"), _text("effective ", record["effective_date"])),
        given(record["publication_date"], _text("发布时间 ", record["publication_date"]), _text("published ", record["publication_date"])),
    )
    known = F.array_compact(F.array(given(authority, _text("发布机构 ", authority), authority), given(record["version"], _text("版本 ", record["version"]), _text("version ", record["version"])), dated))
    said = _text(lead, ' "', record["title"], '"', F.when(F.size(known) > 0, _text(" (", _say(han, F.array_join(known, "；"), F.array_join(known, "; ")), ")")).otherwise(""), ".")
    more = quoted(F.transform(supporting, lambda m: m["title"]))
    return F.when(F.size(supporting) > 0, _text(said, _say(han, _text(" 补充官方依据还包括 ", more, "."), _text(" Supporting official evidence also includes ", more, ".")))).otherwise(said)


def industry_conclusion(record: Column, direct: Column, context: Column, han: Column, trend: Column) -> Column:
    """direct: matches that answer the query as well; context: one that does not, or null."""
    alone = (F.size(direct) == 0) & context.isNull() & trend
    lead = F.when(alone, _say(han, _text('目前可以确认的是，"', record["title"], '" 是这类 2026 年行业展望的直接来源之一，但当前片段还没有给出实际预测数值、细分拆分或第二个交叉来源。'), _text('What can be confirmed so far is that "', record["title"], '" is a direct source on this 2026 outlook, but the retained snippet does not expose the actual forecast figures, segment split, or a second corroborating source.')))
    lead = F.coalesce(lead, _say(han, _text('当前最直接的行业来源是 "', record["title"], '"。'), _text('The strongest direct industry source is "', record["title"], '".')))
    titles = quoted(F.transform(direct, lambda m: m["title"]))
    beside = F.when(F.size(direct) > 0, _say(han, _text(" 补充行业佐证还包括 ", titles, "。"), _text(" Additional industry evidence also includes ", titles, "."))).when(context.isNotNull(), _say(han, _text(' 相关市场背景还包括 "', context["title"], '"，但它仍不是直接回答这个问题的证据。'), _text(' Related market context also includes "', context["title"], '", but it is not direct evidence for the requested answer.'))).otherwise("")
    return _text(lead, beside)


def _without_stop(text: Column) -> Column:
    return F.regexp_replace(text, r"\.+$", "")


def mixed_conclusion(primary: Column, supplemental: Column, han: Column) -> Column:
    first, second = _without_stop(primary["text"]), _without_stop(supplemental["text"])
    said = _say(han, _text('现有来源显示的影响线索是："', primary["title"], '" 表明 ', first, '；"', supplemental["title"], '" 表明 ', second, "。"), _text('Current sources surface cross-domain evidence relevant to the impact question: "', primary["title"], '" shows ', first, ', and "', supplemental["title"], '" shows ', second, "."))
    licensed = contains_any(normalize_query(F.concat_ws(" ", primary["title"], primary["text"], primary["version"])), V.LICENSING)
    research = ((primary["domain"] == "policy") & (supplemental["domain"] == "academic")) | ((primary["domain"] == "academic") & (supplemental["domain"] == "policy"))
    what = F.when(licensed, _say(han, F.lit("许可要求"), F.lit("licensing requirements"))).otherwise(_say(han, F.lit("政策要求"), F.lit("policy requirements")))
    beside = _say(han, _text(" 这表明", what, "可能改变研究条件，但现有来源并未量化这种影响。"), _text(" Taken together, these sources point to a possible link between ", what, " and research conditions, but the cited sources do not quantify the size of that effect."))
    return F.when(research, _text(said, beside)).otherwise(said)


def bridged(primary: Column, supplemental: Column, policy: tuple[str, ...] = V.BRIDGE_POLICY, industry: tuple[str, ...] = V.BRIDGE_INDUSTRY, academic: tuple[str, ...] = V.BRIDGE_ACADEMIC) -> Column:
    """Whether the texts tie a policy match to an industry or an academic one: the first speaks of the other's matter, or the second of policy."""
    text = lambda m: normalize_query(F.concat_ws(" ", m["title"], m["text"], F.coalesce(m["version"], F.lit("")), F.coalesce(m["authority"], F.lit(""))))
    pair = lambda d: ((primary["domain"] == "policy") & (supplemental["domain"] == d)) | ((primary["domain"] == d) & (supplemental["domain"] == "policy"))
    by_policy = contains_any(text(supplemental), policy)
    return F.when(pair("industry"), contains_any(text(primary), industry) | by_policy).when(pair("academic"), contains_any(text(primary), academic) | by_policy).otherwise(False)


def local_kind(df: DataFrame, clean: bool = True, **bridge) -> Column:
    """Which local answer a query gets: mixed, relevance (its routes are not tied), policy, industry, or null.

    df: retrieval_status, route_label, primary_route, supplemental_route, gaps, evidence_pruned, evidence_clipped, n_terms, the
    query's lookups, and arrays of matches: primary, supplemental, policy_support, industry, and the struct policy_record.
    """
    c = F.col
    mixed, partial = c("route_label") == "mixed", c("retrieval_status") == "partial"
    industry_part = partial & ~mixed & (c("primary_route") == "industry") & c("industry_lookup")
    mixed_part = partial & mixed & c("supplemental_route").isNotNull() & c("cross_effect")
    no_gaps = F.size("gaps") == 0
    open_ = (c("retrieval_status") == "success") | industry_part | mixed_part
    if clean:
        open_ = open_ & ~c("evidence_pruned") & (no_gaps | industry_part | mixed_part)
    need = F.least(F.lit(2), c("n_terms"))
    best = lambda name: F.coalesce(F.get(c(name), F.lit(0))["overlap"] >= need, F.lit(False))
    dual = c("supplemental_route").isNotNull() & c("cross_effect") & (mixed | (c("primary_route") == "policy")) & best("primary") & best("supplemental") & (F.lit(not clean) | no_gaps | mixed_part)
    tied = F.coalesce(bridged(F.get("primary", F.lit(0)), F.get("supplemental", F.lit(0)), **bridge), F.lit(False))
    policy = ~mixed & (c("primary_route") == "policy") & c("policy_lookup") & c("policy_record").isNotNull() & (F.lit(not clean) | (no_gaps & (~c("evidence_clipped") | (F.size("policy_support") > 0))))
    industry = ~mixed & (c("primary_route") == "industry") & c("industry_lookup") & best("industry") & (F.lit(not clean) | no_gaps | industry_part)
    return F.when(open_, F.when(dual & tied, "mixed").when(dual, "relevance").when(policy, "policy").when(industry, "industry"))


def draft(df: DataFrame, kind: str = "kind") -> DataFrame:
    """df with conclusion, key_points and draft_sources of its kind of local answer; null and empty without one.

    df also has han, exemption, change, has_trend_intent, and direct and context, the industry matches beside the best one.
    """
    c, k, none = F.col, F.col(kind), F.filter("primary", lambda m: F.lit(False))
    first = lambda name: F.slice(c(name), 1, 1)
    whole = F.when(k == "mixed", F.concat(first("primary"), first("supplemental"))).when(k == "policy", F.concat(F.array("policy_record"), "policy_support")).when(k == "industry", F.concat(first("industry"), "direct")).otherwise(none)
    context = F.when((k == "industry") & c("context").isNotNull(), F.array("context")).otherwise(none)
    said = F.transform(context, lambda m: m.withField("text", F.concat(F.lit("Related market context: "), m["text"])))
    best = lambda name: F.get(c(name), F.lit(0))
    text = F.when(k == "mixed", mixed_conclusion(best("primary"), best("supplemental"), c("han"))).when(k == "policy", policy_conclusion(c("policy_record"), c("policy_support"), c("han"), c("exemption"), c("change"))).when(k == "industry", industry_conclusion(best("industry"), c("direct"), c("context"), c("han"), c("has_trend_intent")))
    # the statement about context says more than its citation, which is the match's own text
    points = F.concat(key_points(whole), F.zip_with(key_points(context), said, lambda p, m: p.withField("statement", m["text"]).withField("key_point_id", F.concat(F.lit("kp-"), (F.size(whole) + 1).cast("string")))))
    return df.withColumns({"conclusion": text, "key_points": points, "draft_sources": sources(F.concat(whole, context))})


def assembled(drafts: DataFrame, slices: DataFrame, key=quote_key, qid: str = "qid") -> DataFrame:
    """Answers: drafts (qid, retrieval_status, n_evidence, conclusion, key_points, draft_sources) checked against the evidence's slices.

    slices: qid, evidence_id, source_record_id, slice_text, title, url. A point stays if all its citations hold; then they quote the
    slice. Adds answer_status, grounded, points, key_points (those that stay), sources (cited ones, once each, named as the draft
    does, else as the record is) and issues. A conclusion that is not grounded gives way to the standard one.
    """
    drafts = checkpoint(drafts)
    points = drafts.select(qid, F.posexplode("key_points").alias("at", "p"))
    cites = points.select(qid, "at", F.posexplode("p.citations").alias("n", "c")).select(qid, F.col("at").alias("point_id"), "n", F.concat_ws("\u0001", F.col(qid).cast("string"), "c.evidence_id").alias("evidence_id"), "c.source_record_id", "c.source_url", "c.quote_text", F.col("c.evidence_id").alias("own_id"))
    known = slices.select(F.concat_ws("\u0001", F.col(qid).cast("string"), "evidence_id").alias("evidence_id"), "source_record_id", "slice_text").groupBy("evidence_id", "source_record_id").agg(F.min("slice_text").alias("slice_text"))
    checked = check_citations(cites, known, key)
    cite = F.struct("n", F.struct(F.col("own_id").alias("evidence_id"), "source_record_id", "source_url", F.col("slice_text").alias("quote_text")).alias("c"))
    by_point = checked.groupBy(qid, F.col("point_id").alias("at")).agg(F.bool_and(F.col("issue").isNull()).alias("ok"), F.transform(F.array_sort(F.collect_list(cite)), lambda x: x["c"]).alias("cites"), F.array_sort(F.array_compact(F.collect_list(F.when(F.col("issue").isNotNull(), F.struct("n", "issue"))))).alias("wrong"))
    x = checkpoint(points.join(by_point, [qid, "at"], "left").withColumn("ok", F.coalesce("ok", F.lit(False))))
    good = F.struct("at", F.col("p").withField("citations", F.col("cites")).alias("p"))
    wrong = F.when(F.size("wrong") > 0, F.struct("at", F.transform("wrong", lambda w: F.concat(F.col("p.key_point_id"), F.lit(": "), w["issue"])).alias("w")))
    g = x.groupBy(qid).agg(F.count_if("ok").alias("grounded"), F.count(F.lit(1)).alias("points"), F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), good))), lambda v: v["p"]).alias("_points"), F.flatten(F.transform(F.array_sort(F.array_compact(F.collect_list(wrong))), lambda v: v["w"])).alias("issues"))
    cited = x.where("ok").select(qid, "at", F.explode("cites").alias("c")).groupBy(qid, F.col("c.evidence_id").alias("evidence_id")).agg(F.min("at").alias("at"))
    named = drafts.select(qid, F.explode("draft_sources").alias("s")).groupBy(qid, F.col("s.evidence_id").alias("evidence_id")).agg(F.max(F.struct("s.title", "s.url")).alias("d"))
    own = slices.groupBy(qid, "evidence_id").agg(F.min(F.struct("title", "url")).alias("r"))
    cited = cited.join(named, [qid, "evidence_id"], "left").join(own, [qid, "evidence_id"], "left")
    cited = cited.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "evidence_id", F.coalesce("d", "r").alias("s")))), lambda v: F.struct(v["evidence_id"].alias("evidence_id"), v["s"]["title"].alias("title"), v["s"]["url"].alias("url"))).alias("sources"))
    out = drafts.drop("sources", "issues").join(g, qid, "left").join(cited, qid, "left")
    status = answer_status(F.col("retrieval_status"), F.col("n_evidence"), F.coalesce("grounded", F.lit(0)), F.coalesce("points", F.lit(0)))
    out = out.withColumn("answer_status", status).withColumn("key_points", F.coalesce("_points", F.slice("key_points", 1, 0))).withColumn("sources", F.coalesce("sources", F.slice("draft_sources", 1, 0)))
    said = F.when(F.col("answer_status") == "grounded_success", F.col("conclusion")).otherwise("Available evidence was insufficient to fully support the requested answer.")
    return out.withColumn("conclusion", said).withColumn("issues", F.coalesce("issues", F.array().cast("array<string>"))).withColumn("grounded", F.coalesce("grounded", F.lit(0))).withColumn("points", F.coalesce("points", F.lit(0))).drop("_points", "draft_sources")


def response_text(conclusion: Column, points: Column, named: Column) -> Column:
    return F.array_join(F.concat(F.array(conclusion), F.transform(points, lambda p: p["statement"]), F.transform(named, lambda s: s["title"])), "\n")


def local_overrides(df: DataFrame, generated: str = "generated", local: str = "local") -> Column:
    """Whether the local answer replaces the generated one: it is grounded, and the other is not, has less, or leaves out its dates, years, versions or titles.

    Both are structs (answer_status, conclusion, key_points, sources); df has the query's traits.
    """
    g, o = F.col(generated), F.col(local)
    text = lambda a: response_text(a["conclusion"], a["key_points"], a["sources"])
    said, own = text(g), text(o)
    low, own_low = normalize_query(said), normalize_query(own)
    found = lambda t, p: F.array_distinct(F.regexp_extract_all(t, F.lit(p), F.lit(0)))
    lacks = lambda p: F.size(F.array_except(found(own, p), found(said, p))) > 0
    versions = F.transform(found(own, r"(?i)version [^.;,)]+"), lambda v: normalize_query(v))
    better = (
        (F.size(g["sources"]) < F.size(o["sources"]))
        | (F.size(g["key_points"]) < F.size(o["key_points"]))
        | (F.col("has_effective_date_intent") & lacks(r"20[0-9]{2}-[0-9]{2}-[0-9]{2}"))
        | (F.col("has_year") & lacks("20[0-9]{2}"))
        | ((F.col("has_version_intent") | F.col("is_policy_change")) & F.exists(versions, lambda v: ~F.contains(low, v)))
        | F.exists(o["sources"], lambda s: ~F.contains(low, normalize_query(s["title"])))
        | (F.length(low) < F.floor(F.length(own_low) / 2))
    )
    return F.when(o.isNull() | (F.coalesce(o["answer_status"], F.lit("")) != "grounded_success"), False).when(g["answer_status"] != "grounded_success", True).otherwise(better)


def requirements(label: Column, words: Column, normal: Column, domains: Column, trend: Column, benchmark: Column, many: Column, dated: Column, han: Column) -> Column:
    """What a query of its kind still wants, as an array; domains are those of the evidence."""
    has = lambda d: F.array_contains(domains, d)
    say = lambda chinese, english: _say(han, F.array(*map(F.lit, chinese)), F.array(*map(F.lit, english)))
    share = F.array_contains(words, "share") | contains_any(normal, ("market share", "份额", "市占率"))
    return (
        F.when(label == "mixed", say(("政策变化如何传导到供应链投资、支出类别或时间节奏",), ("how the policy signal changes suppliers, spending categories, or timelines",)))
        .when(has("industry") & share, say(("玩家层面的份额或情景", "对齐的预测时间范围", "细分市场或地区覆盖"), ("player-level shares or scenarios", "an aligned forecast horizon", "segment or regional coverage")))
        .when(has("industry") & trend, say(("量化预测或区间", "细分市场或地区拆分", "支撑该展望的假设或瓶颈"), ("a numeric forecast or range", "segment or regional breakdown", "the assumptions or bottlenecks behind the outlook")))
        .when(has("academic") & benchmark, say(("基准任务或数据集", "指标或基线", "可对比的更多 benchmark 论文"), ("benchmark tasks or datasets", "metrics or baselines", "additional benchmark papers for comparison")))
        .when(has("academic") & many, say(("更多高度相关的论文", "期刊/会议或标识信息", "每篇论文为何相关的简短说明"), ("more closely related papers", "venue or identifier details", "brief notes on why each paper matters")))
        .when(has("policy") & dated, say(("关键条款或适用范围", "影响对象", "实际合规步骤"), ("the key clauses or scope", "who is affected", "practical compliance steps")))
        .otherwise(F.array().cast("array<string>"))
    )


def missing_summary(label: Column, domains: Column, issues: Column, han: Column) -> Column:
    """What evidence is missing, as a series."""
    has = lambda d: F.array_contains(domains, d)
    first = F.when(label == "mixed", _say(han, F.lit("能把政策信号和产业信号直接连接起来的更多证据"), F.lit("more evidence showing how the retained policy and industry signals connect"))).when(has("academic"), _say(han, F.lit("更多学术佐证或 benchmark 细节"), F.lit("more academic corroboration or benchmark detail"))).when(has("industry"), _say(han, F.lit("更多行业佐证或原始来源细节"), F.lit("more industry corroboration or original-source detail"))).otherwise(_say(han, F.lit("更多交叉佐证"), F.lit("more corroborating evidence")))
    cited = F.when(F.size(issues) > 0, _say(han, F.lit("每个结论都能直接对应来源原文"), F.lit("direct source support for every claim")))
    x = F.array_compact(F.array(first, cited))
    return F.when(F.size(x) == 1, F.get(x, F.lit(0))).otherwise(_text(F.get(x, F.lit(0)), _say(han, F.lit("，以及"), F.lit(", and ")), F.get(x, F.lit(1))))


def bridge_note(domains: Column, han: Column) -> Column:
    """What a partial answer across routes does not show."""
    has = lambda d: F.array_contains(domains, d)
    return (
        F.when(has("policy") & has("industry"), _say(han, F.lit("当前证据只能说明已经观察到政策侧信号和同主题的产业侧信号，但还不能直接说明后者就是由前者触发，也不足以确认完整的影响传导路径。"), F.lit("Current evidence provides a policy-side signal and a same-topic industry-side signal, but it does not directly show whether the observed industry-side signal was caused by the policy-side signal or how that transmission works.")))
        .when(has("policy") & has("academic"), _say(han, F.lit("当前证据只能说明已经观察到政策侧信号和同主题的研究侧信号，但还不能直接分离出影响机制或范围。"), F.lit("Current evidence provides a policy-side signal and a same-topic research-side signal, but it does not directly isolate the mechanism or scope of the effect.")))
        .otherwise(_say(han, F.lit("当前证据只能说明已经观察到同题跨域信号，但还不足以直接完成完整的影响分析。"), F.lit("Current evidence provides same-topic cross-domain signals, but not enough to directly complete a full impact estimate.")))
    )


def partial_conclusion(points: Column, titles: Column, label: Column, domains: Column, needs: Column, issues: Column, trend: Column, han: Column) -> Column:
    """What can be said from the first two points, and what is missing. titles: a map from evidence_id to title."""
    title = lambda p: F.coalesce(F.try_element_at(titles, F.get(p["citations"], F.lit(0))["evidence_id"]), F.lit("retained evidence"))
    context = lambda p: p["statement"].startswith("Related market context:")
    some = F.filter(F.slice(points, 1, 2), lambda p: F.size(p["citations"]) > 0)
    said = F.transform(F.filter(some, lambda p: ~context(p) & (F.trim(p["statement"]) != "")), lambda p: _text('"', title(p), '" ', _say(han, F.lit("显示 "), F.lit("indicates ")), _without_stop(truncated(p["statement"], 22))))
    beside = F.transform(F.filter(some, context), title)
    summary, missing = F.array_join(said, "; "), missing_summary(label, domains, issues, han)
    need = F.when(F.size(needs) > 0, _say(han, _text(" 这个问题还缺少：", join_series(needs, han), "。"), _text(" What is still missing for this query: ", join_series(needs, han), "."))).otherwise("")
    more = F.when(F.size(beside) > 0, _say(han, _text(" 来自", quoted(beside), "的相关市场背景可以作为补充，但仍属间接证据。"), _text(" Related market context from ", quoted(beside), " is available, but it remains indirect."))).otherwise("")
    end = F.concat(need, more)
    directional = F.array_contains(domains, "industry") & trend
    return (
        F.when(F.size(said) == 0, _say(han, _text("当前来源仍然不足以完整回答这个问题。要继续补全答案，还需要", missing, ".", end), _text("Current sources are relevant but incomplete. A complete answer would still need ", missing, ".", end)))
        .when(label == "mixed", _say(han, _text("综合当前来源，可以先做一个谨慎的阶段性判断：", summary, "。", bridge_note(domains, han), "这能支持一个部分答案，但完整回答这个问题仍需要", missing, ".", end), _text("Taken together, current sources show these parallel signals: ", summary, ". ", bridge_note(domains, han), " This supports a cautious partial answer, but a complete answer would still need ", missing, ".", end)))
        .when(directional, _say(han, _text("目前可以确认的是：", summary, "。这还只能作为方向性市场信号，完整回答这个问题仍需要", missing, ".", end), _text("What can be confirmed so far is: ", summary, ". This supports only a directional market signal, and a complete answer would still need ", missing, ".", end)))
        .otherwise(_say(han, _text("目前可以确认的是：", summary, "。完整回答这个问题仍需要", missing, ".", end), _text("What can be confirmed so far is: ", summary, ". A complete answer would still need ", missing, ".", end)))
    )


def combined_matches(matches: DataFrame, by: list[str], limit: int = 2) -> DataFrame:
    """Matches of several groups (group_no, rank) in one order, each record once, at most `limit`."""
    order = Window.partitionBy(*by).orderBy("group_no", "rank")
    x = matches.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "evidence_id").orderBy("group_no", "rank"))).where("_n = 1").drop("_n")
    return x.withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= limit)


def surfaces_beside(best_alignment: Column, alignment: Column, focus_overlap: Column, n_terms: Column, domain: Column, thematic_overlap: Column) -> Column:
    """Whether a further match is shown beside the best one."""
    threshold = F.greatest(F.lit(8), F.floor(best_alignment * 0.65 + 0.999).cast("int"))
    return (best_alignment > 0) & ~((domain == "industry") & (thematic_overlap <= 0)) & (focus_overlap >= F.least(F.lit(2), n_terms)) & (alignment >= threshold)


def academic_match_allowed(n_terms: Column, slice_overlap: Column, whole_overlap: Column, alignment: Column) -> Column:
    """Whether an academic match may answer a lookup: enough terms in its slice, or in title and slice with a good alignment."""
    need = F.least(F.lit(2), n_terms)
    return (need <= 0) | (slice_overlap >= need) | ((whole_overlap >= need) & (alignment >= F.greatest(F.lit(5), need * 3)))


def enrichment_due(df: DataFrame) -> Column:
    """Whether a second search on the same route is made for a query with a short local answer."""
    c = F.col
    wanted = F.when((c("primary_route") == "academic") & c("academic_lookup") & c("many_items"), 3).otherwise(2)
    short = (F.size("sources") < wanted) & (F.size("key_points") < wanted)
    whole = (c("retrieval_status") == "success") & c("failure_reason").isNull() & (F.size("gaps") == 0) & (c("n_evidence") > 0) & c("supplemental_route").isNull()
    asked = F.when(c("primary_route") == "industry", c("industry_lookup") & c("has_trend_intent")).when(c("primary_route") == "academic", c("academic_lookup") & c("many_items")).otherwise(False)
    return whole & (F.coalesce(c("answer_status"), F.lit("")) == "grounded_success") & short & asked


def frontier_due(df: DataFrame) -> Column:
    """Whether a policy query about effects is also searched on another route."""
    c = F.col
    whole = (c("route_label") != "mixed") & (c("primary_route") == "policy") & c("supplemental_route").isNull() & (c("retrieval_status") == "success") & c("failure_reason").isNull() & (F.size("gaps") == 0) & (c("n_evidence") > 0)
    return whole & c("cross_effect") & F.coalesce(F.get("primary", F.lit(0))["overlap"] >= F.least(F.lit(2), c("n_terms")), F.lit(False))
