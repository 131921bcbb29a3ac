"""Queries over the shared tables, one or more for each operator, with the SQL that checks them.

The tables hold invented prose, in which the real vocabularies hardly occur; the queries use words that do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as X
from sievework.functions import vocabulary as V
from sievework.operators import alignment, answers, classify, dedupe, evidence, excerpts, frontier, matches, paragraphs, ranking, reports, retrieval

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

MARKS = {"policy": ("the", "of", "der", "que"), "academic": ("and", "und", "la", "the"), "industry": ("in", "die", "los", "est")}
CROSS = ("with", "mit", "con", "avec")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_FROM, _TO = "".join(V.PUNCTUATION), "".join(V.PUNCTUATION.values()).replace("'", "''")


def _normal_sql(c: str) -> str:
    return rf"regexp_replace(lower(trim(translate({c}, '{_FROM}', '{_TO}'), ' ' || chr(9) || chr(10) || chr(13))), '\s+', ' ', 'g')"


def _mark_sql(c: str, m: str) -> str:
    return f"regexp_matches({c}, '(^|[^a-z0-9]){m}([^a-z0-9]|$)')"


def _any_sql(c: str, ms) -> str:
    return "(" + " or ".join(_mark_sql(c, m) for m in ms) + ")"


_SCORED = "q as (select conv_id, turn, " + _normal_sql("text") + " as n from conversations where role = 'user'), s as (select *, " + ", ".join("(" + " + ".join(f"2 * {_mark_sql('n', m)}::int" for m in MARKS[r]) + f") as {r}_score" for r in V.ROUTES) + " from q)"


def _user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), X.normalize_query(F.col("text")).alias("normal"))


@query(f"with {_SCORED} select conv_id, turn, policy_score, academic_score, industry_score from s")
def route_marker_score(spark, sf_dir):
    return classify.route_scores(_user_turns(spark, sf_dir), markers=MARKS).drop("query", "normal")


_TOKENS_SQL = "len(regexp_extract_all(n, '[a-z0-9]+'))"
_LABEL_SQL = f"""
with {_SCORED}, l as (
  select conv_id, turn, route, score, row_number() over (partition by conv_id, turn order by score desc, p) as k from (
    select conv_id, turn, 'policy' as route, policy_score as score, 0 as p from s union all select conv_id, turn, 'academic', academic_score, 1 from s union all select conv_id, turn, 'industry', industry_score, 2 from s)
), t as (
  select s.conv_id, s.turn, n, policy_score, academic_score, industry_score, a.route as f, b.route as g, a.score as s1, b.score as s2
  from s join l a on a.conv_id = s.conv_id and a.turn = s.turn and a.k = 1 join l b on b.conv_id = s.conv_id and b.turn = s.turn and b.k = 2
), r as (
  select *, case when {_any_sql("n", CROSS)} and (policy_score > 0)::int + (academic_score > 0)::int + (industry_score > 0)::int >= 2 then 'explicit_cross_domain'
    when length(replace(n, ' ', '')) < 12 or {_TOKENS_SQL} < 3 then 'short_query'
    when s1 <= 2 and s1 > 0 and s2 = 0 then f || '_weak_hit' when s1 <= 2 then 'low_signal'
    when s1 - s2 <= 1 and s2 > 0 then 'score_tie' else f || '_hit' end as reason_code from t
)
select conv_id, turn, reason_code, case when reason_code like '%\\_hit' escape '\\' then f else 'mixed' end as route_label, f as primary_route,
  case when reason_code = 'explicit_cross_domain' then g when reason_code not like '%\\_hit' escape '\\' and s2 > 0 then g end as supplemental_route from r
"""


@query(_LABEL_SQL)
def route_label_cascade(spark, sf_dir):
    x = classify.route_scores(_user_turns(spark, sf_dir), markers=MARKS)
    return classify.label(classify.ranked_routes(x), cross_domain=CROSS).select("conv_id", "turn", "reason_code", "route_label", "primary_route", "supplemental_route")


_FAMILY = {r: "[" + ", ".join(f"'{f}'" for f in fs) + "]" for r, fs in V.SOURCE_FAMILIES.items()}
_FAMILY_SQL = lambda c: "case " + c + " " + " ".join(f"when '{r}' then {a}" for r, a in _FAMILY.items()) + " else [] end"


@query(f"""select conv_id, turn, array_to_string(list_concat({_FAMILY_SQL('primary_route')}, {_FAMILY_SQL("coalesce(supplemental_route, '')")}), ',') as families from ({_LABEL_SQL})""")
def source_families(spark, sf_dir):
    x = route_label_cascade(spark, sf_dir)
    return x.select("conv_id", "turn", F.array_join(classify.source_families(F.col("primary_route"), F.col("supplemental_route")), ",").alias("families"))


@query(f"""with {_SCORED} select conv_id, turn, regexp_matches(n, '(^|[^0-9])20[0-9][0-9]([^0-9]|$)') as has_year, {_any_sql("n", ("that", "als"))} as has_version_intent, {_any_sql("n", ("was", "sich"))} as has_effective_date_intent,
  {_any_sql("n", ("for", "para"))} as has_trend_intent, {_any_sql("n", ("this", "dem"))} as is_policy_change, {_any_sql("n", CROSS)} as is_cross_domain_impact from s""")
def query_traits(spark, sf_dir):
    x = classify.traits(_user_turns(spark, sf_dir), markers=MARKS, version=("that", "als"), effective=("was", "sich"), trend=("for", "para"), change=("this", "dem"), impact=CROSS)
    return x.drop("query", "normal")


@query("select conv_id, turn, length(trim(text)) between 1 and 2000 as valid, length(trim(text)) as n_trimmed from conversations")
def request_validation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", classify.valid_request(F.col("text")).alias("valid"), F.length(F.trim("text")).cast("long").alias("n_trimmed"))


@query(rf"select doc_id, len(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+'))::bigint as n_tokens, len(list_distinct(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+')))::bigint as n_distinct, len(regexp_extract_all(text, '[^ \t\n\r]+'))::bigint as n_words from documents")
def token_stats(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", X.tokens(X.normalize_query(F.col("text"))).alias("t"), X.token_estimate(F.col("text")).cast("long").alias("n_words"))
    return x.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), "n_words")


_URL = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)'"
_HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"


@query(f"select page_id, lower(regexp_extract(url, {_URL}, 1)) || '://' || lower(regexp_extract(url, {_URL}, 2)) || regexp_replace(regexp_extract(url, {_URL}, 3), '/+$', '') as url_key, {_HOST_SQL} as host from pages")
def url_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url_key"), X.host(F.col("url")).alias("host"))


_OFFICIAL, _NEWS = ("site1.example", "site2.example"), ("site3.example",)


@query(rf"""with p as (select page_id, {_HOST_SQL} as host, regexp_extract(url, {_URL}, 3) as path from pages)
select page_id, host, case when host = 'site1.example' or host like '%.site1.example' or host = 'site2.example' or host like '%.site2.example' or host like 'ir.%' or host like 'investor.%' or contains(path, '/investor') then 'company_official'
  when host = 'site3.example' or host like '%.site3.example' then 'trusted_news' else 'general_web' end as tier from p""")
def host_tier(spark, sf_dir):
    x = table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2).alias("path"))
    return x.select("page_id", "host", retrieval.url_tier(F.col("host"), F.col("path"), _OFFICIAL, _NEWS).alias("tier"))


@query(f"with p as (select page_id, {_HOST_SQL} as host from pages), a as (select distinct host from p order by host limit 5) select page_id, host from p where host in (select host from a)")
def host_allowlist(spark, sf_dir):
    """Pages on an allowlist: the first five hosts by name."""
    from sievework.sources.catalogs import on_hosts

    p = table(spark, sf_dir, "pages").select("page_id", "url", X.host(F.col("url")).alias("host"))
    allowed = tuple(r["host"] for r in p.select("host").distinct().orderBy("host").limit(5).collect())
    return on_hosts(p, "url", allowed).select("page_id", "host")


@query(f"""with p as (select page_id, {_HOST_SQL} as host from pages), s as (select page_id, host, unnest(range(1, len(string_split(host, '.')) + 1)) as i from p),
x as (select page_id, host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') as domain from s)
select domain, count(*) as pages, count(distinct host) as hosts from x group by domain""")
def host_suffix_counts(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", X.host(F.col("url")).alias("host"))
    return p.select("page_id", "host", F.explode(retrieval.host_suffixes(F.col("host"))).alias("domain")).groupBy("domain").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("host").alias("hosts"))


_STRIP = "html"
for _a in ("script", "style", "noscript"):
    _STRIP = f"regexp_replace({_STRIP}, '<{_a}\\b[^>]*>.*?</{_a}\\s*>', ' ', 'gis')"
_STRIP = f"regexp_replace(regexp_replace({_STRIP}, '<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'gs')"
for _e, _c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _STRIP = f"replace({_STRIP}, '{_e}', '{_c}')"


@query(f"select page_id, trim(regexp_replace({_STRIP}, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')) as shown, trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\\s+', ' ', 'g')) as title from pages")
def html_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("shown"), X.page_title(F.col("html")).alias("title"))


_ALIGN_SQL = f"""
with q as (select distinct item_id, unnest(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+')) as token from benchmark),
d as (select distinct doc_id, unnest(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+')) as token from documents),
h as (select item_id, doc_id, regexp_matches(token, '^[0-9]{{4}}$') as year, case when length(token) >= 4 then 2 else 1 end as w from q join d using (token)),
s as (select item_id, doc_id, sum(case when year then 0 else w end) as plain, sum(case when year then 4 else 0 end) as years from h group by all),
c as (select item_id, doc_id, (case when plain > 0 then plain + years else 0 end)::bigint as score from s),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id)::int as rank from c)
select item_id, doc_id, score, rank from r where rank <= 6
"""


@query(_ALIGN_SQL)
def alignment_topk(spark, sf_dir):
    """Each benchmark item's six best documents: the flagship."""
    own = lambda name: table(spark, sf_dir, name).withColumn("tokens", X.tokens_of(F.col("text")))
    return alignment.top_records(own("benchmark").select("item_id", "tokens"), own("documents").select("doc_id", "tokens"), "item_id", "doc_id", 6)


_FRONTIER_SQL = f"""
with recursive q as (select item_id, list_distinct(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+')) as tokens from benchmark),
d as (select doc_id, list_distinct(regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+')) as tokens from documents),
rounds as (
  select item_id, 0 as round, null::bigint as doc_id, 0::bigint as gain, tokens from q where len(tokens) > 0
  union all
  select item_id, round + 1, best[2], best[1], list_filter(tokens, lambda t: not list_contains(found, t))
  from (
    select top.item_id, top.round, top.tokens, top.best, d.tokens as found from (
      select item_id, round, any_value(tokens) as tokens, [max(gain), -max((gain, -doc_id))[2]] as best from (
        select r.item_id, r.round, r.tokens, d.doc_id, list_sum(list_transform(list_intersect(r.tokens, d.tokens), lambda t: case when regexp_matches(t, '^[0-9]{{4}}$') then 4 when length(t) >= 4 then 2 else 1 end))::bigint as gain
        from rounds r, d where len(r.tokens) > 0
      ) where gain > 0 group by item_id, round
    ) as top join d on d.doc_id = best[2]
  )
)
select item_id, round, doc_id, gain, len(tokens)::int as "left" from rounds where round > 0
"""


@query(_FRONTIER_SQL)
def coverage_frontier(spark, sf_dir):
    """Each benchmark item takes documents, one a round, until none of them covers more of its tokens."""
    own = lambda name, key: table(spark, sf_dir, name).select(key, X.tokens_of(F.col("text")).alias("tokens"))
    return frontier.greedy_cover(own("benchmark", "item_id"), own("documents", "doc_id"), "item_id", "doc_id")


_CLEAN = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))"
_WORDS_IN = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_TAIL_SQL = rf"""t as (select doc_id, {_CLEAN.format("text")} as x, list_filter(list_distinct(regexp_extract_all({_normal_sql("array_to_string(list_slice(string_split(" + _CLEAN.format("text") + ", ' '), -12, -1), ' ')")}, '[a-z0-9]+|[一-鿿]')), lambda w: length(w) >= 4 or regexp_matches(w, '^[一-鿿]')) as terms from documents)"""


@query(rf"""with {_TAIL_SQL},
s as (select doc_id, unnest(list_filter(string_split_regex(regexp_replace(x, '([.!?。！？；;]) ', '\1' || chr(1), 'g'), chr(1)), lambda v: v <> '')) as sentence, unnest(range(0, len(string_split_regex(regexp_replace(x, '([.!?。！？；;]) ', '\1' || chr(1), 'g'), chr(1))))) as pos, x, terms from t where length(x) > 320),
b as (select doc_id, arg_max(sentence, (hits, -abs(length(sentence) - 320), -pos)) as sentence, max(hits) as hits, any_value(x) as x, any_value(terms) as terms from (select *, len(list_intersect(terms, {_WORDS_IN.format("sentence")})) as hits from s) group by doc_id),
c as (select doc_id, terms, case when hits > 0 then sentence else x end as y from b),
w as (select doc_id, y, terms, unnest(string_split(y, ' ')) as word, generate_subscripts(string_split(y, ' '), 1) as i from c where length(y) > 320 and contains(y, ' ')),
e as (select *, sum(length(word) + 1) over (partition by doc_id order by i) as until from w), z as (select *, until - length(word) - 1 as start from e),
v as (select a.doc_id, a.i, any_value(a.terms) as terms, string_agg(b.word, ' ' order by b.i) as win, count(*) as n from z a join z b on a.doc_id = b.doc_id and b.i >= a.i and b.i <= a.i + 320 and (b.i = a.i or b.until - 1 - a.start <= 320) where (a.i - 1) % 12 = 0 group by a.doc_id, a.i),
r as (select doc_id, arg_max(win, (len(list_intersect(terms, {_WORDS_IN.format("win")})), n, -abs(length(win) - 320), -i)) as win from v group by doc_id)
select t.doc_id, md5(case when length(t.x) <= 320 then t.x when length(c.y) <= 320 then c.y when not contains(c.y, ' ') then left(c.y, 320) else r.win end) as excerpt
from t left join c using (doc_id) left join r using (doc_id)""")
def page_excerpts(spark, sf_dir):
    """Each document's excerpt for a query of its own last twelve words."""
    x = table(spark, sf_dir, "documents").select("doc_id", "text", _closing_terms())
    return x.select("doc_id", F.md5(excerpts.page_excerpt(F.col("text"), F.col("terms"), 320)).alias("excerpt"))


def _closing_terms():
    return excerpts.query_terms(F.array_join(F.slice(F.split(excerpts.clean(F.col("text")), " "), -12, 12), " ")).alias("terms")


@query()
def chosen_snippets(spark, sf_dir):
    """Each document's snippet for its last twelve words: its first line, its best sentence or its densest paragraph."""
    x = table(spark, sf_dir, "documents").select("doc_id", "text", F.split("text", "\n", 2)[0].alias("candidate"), _closing_terms())
    return excerpts.snippets(x, "doc_id")


@query()
def aligned_page_excerpts(spark, sf_dir):
    """What each page says of the last words of its address and of its title, from its first 20,000 characters or from all."""
    x = table(spark, sf_dir, "pages").select("page_id", "html", excerpts.query_terms(F.concat_ws(" ", F.element_at(F.split("url", "/"), -1), X.page_title(F.col("html")))).alias("terms"))
    x = x.withColumn("focus", F.col("terms"))
    return excerpts.two_depths(x, "page_id", "html", "terms", "focus", first=20_000)


_ROLE = "case when quality = 1 then 'primary' when toxic = 1 then 'supplemental' else 'other' end"
_HITS_SQL = f"h as (select d.doc_id, source, lang, n_chars, {_ROLE} as role, doc_id as pos from documents d join labels using (doc_id))"


def _role_hits(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "n_chars", F.expr(_ROLE).alias("role"), F.col("doc_id").alias("pos"))


@query(f"with {_HITS_SQL}, b as (select *, case role when 'primary' then 0 when 'supplemental' then 1 else 2 end as k from h) select source, doc_id, role, row_number() over (partition by source order by k, case when k < 2 then -n_chars else pos end, pos)::int as rank from b")
def mixed_blocks(spark, sf_dir):
    return ranking.mixed_blocks(_role_hits(spark, sf_dir), ["source"], "role", [F.desc("n_chars"), F.asc("pos")]).select("source", "doc_id", "role", "rank")


@query(f"with {_HITS_SQL}, o as (select *, row_number() over (partition by source, role order by n_chars desc, pos) as k from h), s as (select *, case role when 'primary' then (case when k = 1 then 0 else 2 end) when 'supplemental' then (case when k = 1 then 1 else 3 end) else 4 end as slot from o) select source, doc_id, role, row_number() over (partition by source order by slot, k)::int as rank from s")
def interleaved_roles(spark, sf_dir):
    return ranking.interleaved(_role_hits(spark, sf_dir), ["source"], "role", [F.desc("n_chars"), F.asc("pos")]).select("source", "doc_id", "role", "rank")


@query(f"""with {_HITS_SQL}, g as (select *, count(*) filter (where role = 'primary') over (partition by source) as p, count(*) filter (where role = 'supplemental') over (partition by source) as s, row_number() over (partition by source order by n_chars desc, pos) as a from h),
k as (select *, case when p > 0 and s > 0 then least(2, s, 5) else 0 end as r, row_number() over (partition by source, role order by a) as o from g),
t as (select *, row_number() over (partition by source order by case when (role = 'primary' and o <= 6 - r) or (role = 'supplemental' and o <= r) then 0 else 1 end, a) as turn from k)
select source, doc_id, role, row_number() over (partition by source order by a)::int as rank from t where turn <= 6""")
def reserved_topk(spark, sf_dir):
    return ranking.reserved_top_k(_role_hits(spark, sf_dir), ["source"], "role", [F.desc("n_chars"), F.asc("pos")], 6, 2).select("source", "doc_id", "role", "rank")


@query(f"""with {_HITS_SQL}, a as (select *, row_number() over (partition by source order by n_chars desc, pos) as k from h), b as (select *, min(case when role = 'supplemental' then k end) over (partition by source) as f from a),
c as (select *, case when f > 3 then (case when k < 3 then k when k = f then 3 end) when k <= 3 then k end as rank from b) select source, doc_id, role, rank::int as rank from c where rank is not null""")
def forced_member_top3(spark, sf_dir):
    return ranking.forced_top_k(_role_hits(spark, sf_dir), ["source"], [F.desc("n_chars"), F.asc("pos")], 3, F.col("role") == "supplemental").select("source", "doc_id", "role", "rank")


@query(f"""with {_HITS_SQL}, a as (select *, row_number() over (partition by source order by n_chars desc, pos) as k from h where role in ('primary', 'supplemental')), b as (select *, row_number() over (partition by source, role order by k) as o, count(distinct role) over (partition by source) as n from a),
c as (select *, row_number() over (partition by source order by case when o = 1 and role = 'primary' then 0 when o = 1 then 1 else 2 end, k)::int as rank from b where n = 2) select source, doc_id, role, rank from c where rank <= 4""")
def mixed_shortlist(spark, sf_dir):
    return ranking.one_of_each_then_best(_role_hits(spark, sf_dir), ["source"], "role", [F.desc("n_chars"), F.asc("pos")], 4).select("source", "doc_id", "role", "rank")


@query("with d as (select *, row_number() over (partition by source, lower(trim(text)) order by doc_id) as k from documents) select doc_id, source, n_chars from d where k = 1")
def hit_dedupe_first_wins(spark, sf_dir):
    x = table(spark, sf_dir, "documents")
    return dedupe.first_wins(x, [F.col("source"), F.lower(F.trim(F.col("text")))], "doc_id").select("doc_id", "source", "n_chars")


@query("""with v as (select md5(lower(trim(text))) as k, source || ':' || lang as v, min(doc_id) as first from documents group by 1, 2)
select k, min(first) as doc_id, string_agg(v, ',' order by first, v) as variants from v group by k""")
def hit_provenance(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.md5(F.lower(F.trim("text"))).alias("k"), F.concat_ws(":", "source", "lang").alias("variant"))
    m = dedupe.merge_hits(x, [F.col("k")], pos="doc_id")
    return m.select("k", "doc_id", F.array_join("variants", ",").alias("variants"))


_SOURCE_IDS = list(V.SOURCE_TIERS)
_SRC = "case o_orderkey % 10 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SOURCE_IDS)) + " else 'unknown' end"


@query(f"""with o as (select o_orderkey, {_SRC} as source_id, case when o_orderstatus = 'F' then 'policy' else 'industry' end as target_route from orders)
select o_orderkey, source_id, case source_id {" ".join(f"when '{s}' then '{t}'" for s, t in V.SOURCE_TIERS.items())} end as credibility_tier,
  case when source_id = 'academic_arxiv' then 'supplemental' when source_id = 'policy_official_registry' then 'primary' when target_route = 'industry' then 'supplemental' else 'primary' end as role from o""")
def tier_role_lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_SRC).alias("source_id"), F.expr("case when o_orderstatus = 'F' then 'policy' else 'industry' end").alias("target_route"))
    by_source = spark.createDataFrame([("academic_arxiv", "supplemental"), ("policy_official_registry", "primary")], "source_id string, role string")
    by_route = spark.createDataFrame([("industry", "supplemental")], "route string, role string")
    return retrieval.with_role(retrieval.with_tier(o), by_source, by_route).select("o_orderkey", "source_id", "credibility_tier", "role")


_CHAIN = "c(source_id, failure_reason, next_source) as (values " + ", ".join(str(x) for x in V.BACKUP_CHAIN) + ")"
_REASON = "case {} % 4 when 0 then 'no_hits' when 1 then 'timeout' when 2 then 'rate_limited' else 'adapter_error' end"
_EV_SRC = "case event_id % 9 " + " ".join(f"when {i} then '{s}'" for i, s in enumerate(_SOURCE_IDS)) + " end"


@query(f"""with {_CHAIN}, e as (select event_id, {_EV_SRC} as s0, {_REASON.format('user_id')} as r1, {_REASON.format('(user_id // 4)')} as r2, {_REASON.format('(user_id // 16)')} as r3 from events),
a as (select e.*, c.next_source as s1 from e left join c on c.source_id = s0 and c.failure_reason = r1),
b as (select a.*, case when c.next_source not in (s0, coalesce(s1, '')) then c.next_source end as s2 from a left join c on c.source_id = s1 and c.failure_reason = r2),
d as (select b.*, case when c.next_source not in (s0, coalesce(s1, ''), coalesce(s2, '')) then c.next_source end as s3 from b left join c on c.source_id = s2 and c.failure_reason = r3)
select event_id, concat_ws('>', s0, s1, s2, s3) as path from d""")
def fallback_chain(spark, sf_dir):
    reasons = [F.expr(_REASON.format(c)) for c in ("user_id", "(user_id div 4)", "(user_id div 16)")]
    return table(spark, sf_dir, "events").select("event_id", F.array_join(retrieval.fallback_path(F.expr(_EV_SRC), reasons), ">").alias("path"))


_TIERS = "case doc_id % 7 when 0 then 'official_government' when 1 then 'company_official' when 2 then 'trusted_news' when 3 then 'peer_reviewed' else 'general_web' end"
_LEVELS = "case doc_id % 5 when 0 then 'peer_reviewed' when 1 then 'survey_or_review' when 2 then 'preprint' when 3 then 'metadata_only' end"


@query(f"""with d as (select doc_id, {_TIERS} as t, {_LEVELS} as l, quality, toxic, n_chars % 100 / 100.0::double as s1, n_chars % 7 / 10.0::double as s2 from documents join labels using (doc_id))
select doc_id, round_even((case when quality = 1 then 8.0 else 3.5 end + case when doc_id % 3 = 0 then 2.5 else 0 end + case when doc_id % 4 = 0 then 1.5 else 0 end + case when doc_id % 6 = 0 then 1.0 else 0 end
  + case when toxic = 1 then 1.5 else 0.25 end + case when doc_id % 2 = 0 then 1.0 else 0.5 end + case when doc_id % 8 = 0 then 0.5 else 0 end
  + case t when 'official_government' then 7.0 when 'peer_reviewed' then 6.0 when 'company_official' then 4.0 when 'trusted_news' then 3.5 else 0 end
  + case l when 'peer_reviewed' then 3.0 when 'survey_or_review' then 2.5 when 'preprint' then 1.5 when 'metadata_only' then 0.5 else 0 end + case when doc_id % 9 = 0 then 1.0 else 0.25 end)::double + (s1 * 4.0 + s2 * 4.0), 6) as score from d""")
def evidence_score(spark, sf_dir):
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    pick = lambda n, a, b=None: F.when(F.col("doc_id") % n == 0, a).otherwise(F.lit(b).cast("string") if b is None else F.lit(b))
    score = evidence.record_score(
        role=F.when(F.col("quality") == 1, "primary").otherwise("supplemental"), tier_score=evidence.tier_score(F.expr(_TIERS)), level=F.expr(_LEVELS), confidence=pick(9, "strong_id", "heuristic"),
        slice_scores=F.array((F.col("n_chars") % 100) / 100.0, (F.col("n_chars") % 7) / 10.0), authority=pick(3, "a"), publication_date=pick(4, "2024-01-01"), effective_date=pick(6, "2024-01-01"),
        version_status=F.when(F.col("toxic") == 1, "observed").otherwise("version_missing"), jurisdiction_status=pick(2, "observed", "jurisdiction_inferred"), has_variants=F.col("doc_id") % 8 == 0,
    )
    return x.select("doc_id", score.alias("score"))


_SLICES_SQL = "s as (select lang as qid, doc_id // 4 as record_id, doc_id as slice_id, (n_chars % 1000) / 1000.0::double as score, n_chars // 5 as tokens, text || doc_id as text from documents)"


def _slices(spark, sf_dir):
    x = table(spark, sf_dir, "documents")
    return x.select(F.col("lang").alias("qid"), F.expr("doc_id div 4").alias("record_id"), F.col("doc_id").alias("slice_id"), ((F.col("n_chars") % 1000) / 1000.0).alias("score"), F.expr("n_chars div 5").alias("tokens"), F.concat("text", F.col("doc_id").cast("string")).alias("text"))


@query(f"""with {_SLICES_SQL}, a as (select *, row_number() over (partition by qid, record_id order by score desc, tokens desc, text desc) = 1 as safe, sum(tokens) over (partition by qid) as total from s),
b as (select *, coalesce(sum(tokens) over (partition by qid, safe order by score, tokens, record_id, text rows between unbounded preceding and 1 preceding), 0) as gone from a)
select qid, slice_id, tokens from b where safe or total - gone <= 20000""")
def budget_pack_slices(spark, sf_dir):
    return evidence.trim_slices(_slices(spark, sf_dir), ["qid"], 20000).select("qid", "slice_id", "tokens")


@query(f"""with {_HITS_SQL}, r as (select source, doc_id, role, n_chars % 97 as score, n_chars // 5 as tokens from h), a as (select *, sum(tokens) over (partition by source) as total, max((role = 'primary')::int) over (partition by source) as p, row_number() over (partition by source, role order by score desc, tokens desc, doc_id desc) as o from r),
b as (select *, (role = 'supplemental' and p = 1 and o <= 2)::int as safe from a), c as (select *, coalesce(sum(tokens) over (partition by source order by safe, score, tokens, doc_id rows between unbounded preceding and 1 preceding), 0) as gone from b)
select source, doc_id, role, tokens from c where total - gone <= 2000""")
def budget_pack_records(spark, sf_dir):
    x = _role_hits(spark, sf_dir).select("source", "doc_id", "role", (F.col("n_chars") % 97).alias("score"), F.expr("n_chars div 5").alias("tokens"))
    return evidence.drop_records(x, ["source"], 2000, 2, record="doc_id").select("source", "doc_id", "role", "tokens")


_MERGE = "case when o_orderkey % 3 = 0 then o_orderpriority end as priority, case when o_orderkey % 5 = 0 then o_orderstatus else '' end as status"


@query(f"with o as (select o_custkey, o_orderkey, {_MERGE} from orders) select o_custkey, min_by(priority, o_orderkey) filter (where priority is not null) as priority, min_by(status, o_orderkey) filter (where status <> '') as status from o group by o_custkey")
def first_non_null_merge(spark, sf_dir):
    x = table(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", *_MERGE.split(", "))
    return x.groupBy("o_custkey").agg(*dedupe.first_filled(["priority", "status"], ["o_orderkey"]))


@query("""with recursive a as (select doc_id, 't' || md5(text) as alias from documents union all select doc_id, 'p' || split_part(text, chr(10), 1) || source from documents),
e as (select distinct x.doc_id as i, y.doc_id as j from a x join a y using (alias)), r(i, j) as (select i, j from e union select r.i, e.j from r join e on e.i = r.j)
select i as doc_id, min(j) as component from r group by i""")
def alias_components(spark, sf_dir):
    x = table(spark, sf_dir, "documents")
    return dedupe.alias_components(x, "doc_id", [F.concat(F.lit("t"), F.md5("text")), F.concat(F.lit("p"), F.split("text", "\n", 2)[0], "source")])


@query()
def similarity_collapse(spark, sf_dir):
    """Documents of a source whose first lines and whole texts are alike; a group's head is its first document."""
    x = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "source", F.split("text", "\n", 2)[0].alias("title"), "text")
    return dedupe.similar_groups(x, F.col("source"), "title", "text").select(F.col("pos").alias("doc_id"), F.col("group_pos").alias("group_id"))


@query("""with recursive o as (select o_orderkey as pos, o_custkey || '|' || o_orderpriority as b, o_orderstatus as v, strftime(o_orderdate, '%Y-%m') as m, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as i from orders),
s(b, i, pos, heads, grp) as (select b, i, pos, [{'pos': pos, 'v': v, 'm': m}], pos from o where i = 1
  union all select o.b, o.i, o.pos, case when len(list_filter(s.heads, lambda h: h.v = o.v or h.m = o.m)) > 0 then s.heads else list_append(s.heads, {'pos': o.pos, 'v': o.v, 'm': o.m}) end, coalesce(list_filter(s.heads, lambda h: h.v = o.v or h.m = o.m)[1].pos, o.pos) from s join o on o.b = s.b and o.i = s.i + 1)
select pos, grp as group_pos from s""")
def policy_group_members(spark, sf_dir):
    """Every record with its group, later groups of a block too; the SQL replays the rule record by record."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("authority"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("version"), F.date_format("o_orderdate", "yyyy-MM").alias("publication_date"), F.lit(None).cast("string").alias("effective_date"))
    return dedupe.policy_groups(o)


_LINES = "l as (select doc_id, i - 1 as line_no, line from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents))"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


@query("""with d as (select doc_id, text, len(regexp_extract_all(text, '[0-9]{4}')) as y, len(regexp_extract_all(text, '[0-9]+ ?%')) as f, len(regexp_extract_all(lower(text), 'licens|copyright')) as v,
  len(regexp_extract_all(lower(text), 'section [0-9]+')) as c, """ + " + ".join(f"contains(lower(text), '{a}')::int" for a in V.AUTHORITIES) + """ as a from documents)
select doc_id, round_even((0.4 * y + 2.0 * v + 2.6 * c + 1.2 * f + 0.8 * a)::double * (0.55 + 0.45 * least(1.0, length(text) / 220.0))::double, 6) as score from d""")
def fact_density_weights(spark, sf_dir):
    """The weights over patterns that both dialects read alike."""
    t = F.col("text")
    n = lambda p, c=t: F.regexp_count(c, F.lit(p))
    score = paragraphs.weighted_density(F.lit(0), n("[0-9]{4}"), n("licens|copyright", F.lower(t)), n("section [0-9]+", F.lower(t)), n("[0-9]+ ?%"), paragraphs.marker_count(F.lower(t), V.AUTHORITIES), F.length(t))
    return table(spark, sf_dir, "documents").select("doc_id", F.bround(score, 6).alias("score"))


def _count_sql(pattern: str) -> str:
    plain = pattern.replace("(?Ui)", "(?i)").replace("(?U)", "").replace("'", "''")
    return f"len(regexp_extract_all(text, '{plain}'))"


_DATES_SQL = f"({_count_sql(paragraphs.ISO_DATE)} + {_count_sql(paragraphs.US_DATE)} + {_count_sql(paragraphs.HAN_DATE)})"


@query(f"""with d as (select doc_id, text, {_DATES_SQL} as d, {_count_sql(paragraphs.YEAR)} as y, {_count_sql(paragraphs.VERSION)} as v, {_count_sql(paragraphs.CLAUSE)} as c, {_count_sql(paragraphs.FIGURE)} as f, """ + " + ".join(f"contains(lower(text), '{a}')::int" for a in V.AUTHORITIES) + """ as a from documents)
select doc_id, round_even((3.2 * d + greatest(y - d, 0) * 0.4 + 2.0 * v + 2.6 * c + 1.2 * f + 0.8 * a)::double * (0.55 + 0.45 * least(1.0, length(text) / 220.0))::double, 6) as score from d""")
def fact_density(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.bround(paragraphs.fact_density(F.col("text")), 6).alias("score"))


@query()
def fact_paragraphs(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("und"), F.lit("license"))
    x = paragraphs.rank_paragraphs(paragraphs.split_paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", terms)
    return x.select("doc_id", "at", F.bround("score", 6).alias("score"), "rank", "paragraph")


@query(f"""with {_LINES}, e as (select doc_id, line_no, line, string_agg(line, ' ') over (partition by doc_id order by line_no rows between 8 preceding and 17 following) as excerpt from l)
select doc_id, line_no, md5(excerpt) as excerpt from e where contains(line, 'the')""")
def chunk_window_excerpt(spark, sf_dir):
    x = paragraphs.hit_excerpts(_lines(spark, sf_dir), "doc_id", "line_no", "line", F.contains(F.col("line"), F.lit("the")))
    return x.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.md5("excerpt").alias("excerpt"))


_TERMS = ("the", "of", "and", "with", "und", "der", "que", "la")


@query(f"""with w as (select doc_id, string_split(text, ' ') as ws from documents), s as (select doc_id, ws, unnest(range(0, greatest(len(ws) - 24, 0) + 1, 4)) as start from w),
h as (select doc_id, start, len(list_distinct(list_filter(list_slice(ws, start + 1, start + 24), lambda x: x in {_TERMS}))) as hits from s)
select doc_id, max(hits)::bigint as hits, arg_max(start, hits * 1000000 - start)::bigint as start from h group by doc_id""")
def best_window(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("ws"))
    best = paragraphs.best_window(F.col("ws"), F.array(*map(F.lit, _TERMS)), 24)
    return x.select("doc_id", best.alias("b")).select("doc_id", F.col("b.hits").cast("long").alias("hits"), F.col("b.start").cast("long").alias("start"))


_CITES = """m as (select coalesce(max(conv_id), 0) + 1 as n from conversations), p as (select conv_id, turn, c.text, length(c.text) as n, doc_id, d.text as t from conversations c left join (select documents.*, doc_id % m.n as k from documents, m) d on d.k = conv_id),
c as (select conv_id as answer_id, turn || ':' || coalesce(doc_id::varchar, '') as point_id, case when n % 7 = 0 or doc_id is null then 'missing' else 'd' || doc_id end as evidence_id, case when n % 5 = 0 or doc_id is null then 's-' else 's' || doc_id end as source_record_id,
  case when n % 11 = 0 or doc_id is null then '' when n % 3 = 2 then text else replace(substr(t, (1 + (turn * 7919 + doc_id * 31 + n) % greatest(length(t) - 29, 1))::bigint, 30), ' ', case when n % 3 = 1 then ' - ' else ' ' end) end as quote_text from p),
e as (select 'd' || doc_id as evidence_id, 's' || doc_id as source_record_id, text as slice_text from documents),
k as (select *, trim(regexp_replace(lower(quote_text), '[^a-z0-9]+', ' ', 'g')) as q from c),
x as (select answer_id, point_id, case when n.evidence_id is null then 'missing evidence_id' when e.slice_text is null then 'missing source_record_id'
  when trim(quote_text) <> '' and not contains(slice_text, quote_text) and not contains(trim(regexp_replace(lower(slice_text), '[^a-z0-9]+', ' ', 'g')), q) then 'quote_text mismatch' end as issue
  from k left join (select distinct evidence_id from e) n on n.evidence_id = k.evidence_id left join e on e.evidence_id = k.evidence_id and e.source_record_id = k.source_record_id)"""


def _checked(spark, sf_dir):
    """Every document as evidence, cited by the turns of one conversation with quotes from anywhere in its text; turns without a document cite none."""
    d, c, n = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations"), F.length("text")
    answers_n = (c.agg(F.max("conv_id")).first()[0] or 0) + 1
    c = c.join(d.select("doc_id", F.col("text").alias("t"), (F.col("doc_id") % answers_n).alias("conv_id")), "conv_id", "left")
    key, none = F.col("doc_id").cast("string"), F.col("doc_id").isNull()
    at = (1 + (F.col("turn") * 7919 + F.col("doc_id") * 31 + n) % F.greatest(F.length("t") - 29, F.lit(1))).cast("int")
    quote = F.when((n % 11 == 0) | none, "").when(n % 3 == 2, F.col("text")).otherwise(F.replace(F.substr("t", at, F.lit(30)), F.lit(" "), F.when(n % 3 == 1, " - ").otherwise(" ")))
    c = c.select(F.col("conv_id").alias("answer_id"), F.concat(F.col("turn").cast("string"), F.lit(":"), F.coalesce(key, F.lit(""))).alias("point_id"), F.when((n % 7 == 0) | none, "missing").otherwise(F.concat(F.lit("d"), key)).alias("evidence_id"), F.when((n % 5 == 0) | none, "s-").otherwise(F.concat(F.lit("s"), key)).alias("source_record_id"), quote.alias("quote_text"))
    e = d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("evidence_id"), F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("source_record_id"), F.col("text").alias("slice_text"))
    return answers.check_citations(c, e, key=answers.quote_key_ascii)


@query(f"with {_CITES} select answer_id, point_id, issue from x")
def citation_validation(spark, sf_dir):
    return _checked(spark, sf_dir).select("answer_id", "point_id", "issue")


@query(f"""with {_CITES}, p2 as (select answer_id, point_id, bool_and(issue is null) as ok from x group by all), g as (select answer_id, count(*) filter (where ok) as grounded, count(*) as points from p2 group by answer_id)
select answer_id, grounded, points, case when answer_id % 5 = 0 and answer_id % 3 = 0 then 'retrieval_failure' when answer_id % 5 = 0 or points = 0 or grounded < points then 'insufficient_evidence' else 'grounded_success' end as status from g""")
def answer_status(spark, sf_dir):
    g = answers.grounded_points(_checked(spark, sf_dir), ["answer_id"])
    n = F.when(F.col("answer_id") % 5 == 0, 0).otherwise(1)
    return g.withColumn("status", answers.answer_status(F.when(F.col("answer_id") % 3 == 0, "failure_gaps").otherwise("success"), n, F.col("grounded"), F.col("points")))


@query("""with o as (select lower(trim(text)) as b from documents join labels using (doc_id) where text is not null)
select doc_id from documents where trim(text) = '' or text is null or lower(trim(text)) not in (select b from o)""")
def frontier_anti_dedupe(spark, sf_dir):
    """All documents whose text no labelled document has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.not_held(d, d.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), ["text"]).select("doc_id")


@query("""select event_type, count(*) as total_runs, count(*) filter (where value >= 20) as successful_runs, avg((value >= 20)::int)::double as success_rate, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, avg((value < 90)::int)::double as budget_pass_rate from events group by event_type""")
def run_summary(spark, sf_dir):
    return reports.run_summary(table(spark, sf_dir, "events"), ["event_type"], F.col("value") >= 20, "value", F.col("value") < 90)


@query("with c as (select user_id % 10 as g, event_type, count(*) as n from events group by all) select g, string_agg(event_type || '=' || n, ',' order by event_type) as breakdown from c group by g")
def status_breakdown(spark, sf_dir):
    b = reports.counted(table(spark, sf_dir, "events").withColumn("g", F.col("user_id") % 10), ["g"], "event_type")
    return b.select("g", F.array_join(F.transform(F.map_entries("breakdown"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("breakdown"))


@query("""with c as (select user_id, count(*) as run_count, count(distinct event_type) as statuses, count(distinct day(ts) % 3) as routes, max(value) - min(value) as spread, avg((value < 90)::int)::double as budget_rate from events group by user_id)
select *, run_count = 5 and statuses = 1 and routes = 1 and budget_rate = 1.0 and spread <= 250 as repeatable from c""")
def repeatability(spark, sf_dir):
    x = table(spark, sf_dir, "events").withColumn("route", F.dayofmonth("ts") % 3)
    return reports.repeatability(x, "user_id", "event_type", "route", "value", F.col("value") < 90)


@query("""select event_type as implementation, count(*) as n, avg(case when user_id % 3 <> 0 then (event_id % 2 = 0)::int end)::double as accuracy, round(avg(value), 6) as avg_latency, quantile_disc(value, 0.95) as p95_latency, avg((value >= 20)::int)::double as success_rate from events group by event_type""")
def comparison_summary(spark, sf_dir):
    x = reports.comparison(table(spark, sf_dir, "events").withColumnRenamed("event_type", "implementation"), "implementation", F.col("event_id") % 2 == 0, F.col("user_id") % 3 != 0, F.col("value") >= 20, "value")
    return x.withColumn("avg_latency", F.round("avg_latency", 6))


_DIM = "case doc_id % 6 when 0 then 'completeness' when 1 then ' Accuracy' when 2 then 'usability' when 3 then '信息全面度' when 4 then '信息准确度' else '易用性' end"
_DIM_ID = "case doc_id % 3 when 0 then 'completeness' when 1 then 'accuracy' else 'usability' end"
_MOST = "case doc_id % 3 when 2 then 10 else 20 end"
_POINTS = "(quality * 6 + toxic * 3 + doc_id % 2)"


def _judged(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", F.expr("doc_id div 6").alias("case_id"), F.expr(_DIM).alias("dimension"), F.expr(_POINTS).cast("double").alias("score"))


@query(f"select {_DIM_ID} as dimension, count(*) as n, round_even(sum({_POINTS}) / count(*)::double * 100, 0) / 100 as average_score, round_even(sum({_POINTS}) / sum({_MOST})::double * 100, 0) / 100 as average_ratio from labels group by 1")
def judge_score_summary(spark, sf_dir):
    return reports.dimension_summary(_judged(spark, sf_dir))


@query(f"select doc_id // 6 as case_id, round_even(sum({_POINTS})::double * 100, 0) / 100 as total_score, sum({_MOST})::bigint as total_max_score, round_even(sum({_POINTS}) / sum({_MOST})::double * 100, 0) / 100 as ratio from labels group by 1")
def judge_case_summary(spark, sf_dir):
    return reports.case_summary(_judged(spark, sf_dir), "case_id")


@query("""with e as (select user_id, event_id, value, coalesce(sum(least(value, 60.0)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as s from events)
select user_id, event_id, round(s, 6) as started, round(s + least(value, 60.0), 6) as finished, value > 60 as timed_out, s + least(value, 60.0) > 500 as cancelled from e""")
def deadline_replay(spark, sf_dir):
    x = retrieval.within_deadline(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 60.0, 500.0)
    return x.select("user_id", "event_id", F.round("started", 6).alias("started"), F.round("finished", 6).alias("finished"), "timed_out", "cancelled")


@query("""with e as (select user_id, event_id, event_type, coalesce(max((event_type = 'purchase')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0) as done from events) select user_id, event_id, event_type from e where done = 0""")
def until_first_success(spark, sf_dir):
    return retrieval.until_first_success(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "purchase").select("user_id", "event_id", "event_type")


@query(f"""with a as (select user_id, event_id, (value < 50)::int * 3 as hits, case when value >= 50 then event_type end as reason, {_EV_SRC} as source from events),
f as (select user_id, source, min(event_id) as first from a where reason is not null group by all), g as (select user_id, string_agg(source, ',' order by first) as gaps from f group by user_id)
select a.user_id, sum(hits)::bigint as hits, count(reason) as failures, arg_min(reason, event_id) filter (where reason is not null) as failure_reason, coalesce(any_value(g.gaps), '') as gaps,
  case when count(reason) = 0 then 'success' when sum(hits) > 0 then 'partial' else 'failure_gaps' end as status from a left join g using (user_id) group by a.user_id""")
def status_rollup(spark, sf_dir):
    a = table(spark, sf_dir, "events").select("user_id", "event_id", ((F.col("value") < 50).cast("int") * 3).alias("hits"), F.when(F.col("value") >= 50, F.col("event_type")).alias("reason"), F.expr(_EV_SRC).alias("source"))
    return reports.status_rollup(a, ["user_id"], "event_id", "hits", "reason", "source").withColumn("gaps", F.array_join("gaps", ","))


@query("""with p as (select p_partkey, p_brand, p_size, p_retailprice from part), m as (select p_brand, min(p_size % 4) as least from p group by p_brand) select p_brand, p_partkey, p_size % 4 as priority from p join m using (p_brand) where p_size % 4 = least""")
def first_non_empty_source(spark, sf_dir):
    x = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") % 4).alias("priority"))
    return ranking.first_non_empty(x, ["p_brand"], "priority")


@query("""with p as (select page_id, url || ' 2024-0' || (page_id % 12) || '/' || lpad((page_id % 32)::varchar, 2, '0') || ' 20' || (page_id % 90 + 10) || '-' || lpad((page_id % 14)::varchar, 2, '0') || '_' || lpad((page_id % 33)::varchar, 2, '0') as t from pages),
d as (select page_id, t, regexp_extract(t, '(20[0-9]{2})[-_/]([0-9]{2})[-_/]([0-9]{2})', ['y', 'm', 'd']) as x from p)
select page_id, coalesce(datediff('day', date '1970-01-01', try_cast(nullif(x.y || '-' || x.m || '-' || x.d, '--') as date)) + 719163, 0)::int as day_number from d""")
def recency_ordinal(spark, sf_dir):
    i = F.col("page_id")
    pad = lambda n: F.lpad((i % n).cast("string"), 2, "0")
    t = F.concat("url", F.lit(" 2024-0"), (i % 12).cast("string"), F.lit("/"), pad(32), F.lit(" 20"), (i % 90 + 10).cast("string"), F.lit("-"), pad(14), F.lit("_"), pad(33))
    return table(spark, sf_dir, "pages").select("page_id", X.recency(t).alias("day_number"))


_TITLE = "regexp_replace(text, '^[^ ]+', 'Mirror')"


@query(f"""with d as (select doc_id, source, text, {_TITLE} as t from documents) select doc_id, trim(regexp_replace(lower(regexp_replace(t, '\\bmirror\\b', '', 'gi')), '[^a-z0-9一-鿿]+', ' ', 'g')) as policy_title,
  replace(trim(regexp_replace(lower(regexp_replace(t, '\\bmirror\\b', '', 'gi')), '[^a-z0-9一-鿿]+', ' ', 'g')), ' ', '-') as slug, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) as industry_title,
  source || ':' || left(sha1(source || '|' || text), 12) as record_id from d""")
def titles_and_ids(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.regexp_replace("text", "^[^ ]+", "Mirror"))
    return d.select("doc_id", X.policy_title(F.col("t")).alias("policy_title"), X.slug(F.col("t")).alias("slug"), X.industry_title(F.col("t")).alias("industry_title"), X.record_id(F.col("source"), F.col("source"), F.col("text")).alias("record_id"))


@query("""with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as i from documents) select doc_id, md5(string_agg(word, ' ' order by i, word)) as abstract from w group by doc_id""")
def abstract_from_inverted_index(spark, sf_dir):
    """Texts rebuilt from maps of their words to places."""
    texts = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return texts.select("doc_id", F.md5(X.abstract_text(X.inverted_index(F.transform("texts", lambda t: F.split(t, " "))))).alias("abstract"))


@query(rf"""with d as (select doc_id, string_split_regex(trim(text), '[ \t\n\x0b\f\r]+') as ws, regexp_extract_all({_normal_sql('text')}, '[a-z0-9]+') as ts from documents)
select doc_id, array_to_string(list_slice(ws, 1, 12), ' ') as head, len(list_distinct(list_filter(ts, lambda t: t not in ('with', 'that') and length(t) >= 4 and not regexp_matches(t, '^[0-9]{{4}}$'))))::bigint as n_terms from d""")
def terms_and_heads(spark, sf_dir):
    terms = X.content_terms(X.tokens(X.normalize_query(F.col("text"))), ("with", "that"))
    return table(spark, sf_dir, "documents").select("doc_id", X.first_words(F.col("text"), 12).alias("head"), F.size(terms).cast("long").alias("n_terms"))


@query("""with s as (select n_regionkey, list(n_name order by n_name) as ns from nation where n_nationkey % 3 <> 1 or n_regionkey = 0 group by n_regionkey)
select n_regionkey, case len(ns) when 0 then '' when 1 then ns[1] when 2 then ns[1] || ' and ' || ns[2] else array_to_string(list_slice(ns, 1, len(ns) - 1), ', ') || ', and ' || ns[len(ns)] end as names from s""")
def series_format(spark, sf_dir):
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 <> 1 or n_regionkey = 0").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("ns"))
    return n.select("n_regionkey", X.series(F.col("ns")).alias("names"))


@query("""select event_id, json_extract_string(regexp_extract('```json ' || props || ' ```', '\\{.*\\}', 0, 's'), '$.k')::int as k from events""")
def model_json(spark, sf_dir):
    x = table(spark, sf_dir, "events").select("event_id", X.json_object(F.concat(F.lit("```json "), "props", F.lit(" ```"))).alias("j"))
    return x.select("event_id", F.get_json_object("j", "$.k").cast("int").alias("k"))


@query("""select doc_id, array_to_string(list_filter([
  case when (c or p) and not g then 'Evidence clipped: ' || concat_ws(', ', case when c then 'bounded evidence was clipped' end, case when p then 'bounded evidence was pruned' end) || '.' end,
  case when r <> 'success' then 'Retrieval gaps: arXiv coverage; own gap' end,
  case when doc_id % 7 = 0 then 'Policy metadata incomplete: at least one policy record is missing version or observed jurisdiction metadata.' end,
  case when doc_id % 11 = 0 then 'Academic match heuristic: at least one academic merge relied on heuristic citation matching.' end,
  case when not g and a and (r <> 'success' or c or p) then 'Academic coverage gap: retained academic evidence may miss corroborating papers, benchmarks, or reviewed versions.' end,
  case when not g and i and (r <> 'success' or c or p) then 'Industry coverage gap: retained industry evidence may miss corroborating filings, official disclosures, or full article-body context.' end], lambda x: x is not null), '|') as notes
from (select doc_id, doc_id % 2 = 0 as c, doc_id % 3 = 0 as p, doc_id % 5 = 0 as g, doc_id % 4 = 1 as a, doc_id % 4 = 2 as i, case when doc_id % 6 = 0 then 'partial' else 'success' end as r from documents)""")
def uncertainty_notes(spark, sf_dir):
    m = lambda n, k=0: F.col("doc_id") % n == k
    notes = answers.uncertainty_notes(F.when(m(6), "partial").otherwise("success"), F.array(F.lit("academic_arxiv"), F.lit("own_gap")), m(2), m(3), m(7), m(11), m(4, 1), m(4, 2), F.array().cast("array<string>"), m(5))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(notes, "|").alias("notes"))


@query("""select epoch(time_bucket(interval '1 hour', ts))::bigint as hour, event_type, count(*) as n, round(sum(value), 4) as total from events group by all""")
def event_hours(spark, sf_dir):
    """The batch form of streaming.windows.hourly."""
    from sievework.streaming.windows import hourly

    return hourly(table(spark, sf_dir, "events")).select(F.unix_timestamp(F.col("hour").cast("timestamp")).alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


def _variant_input(spark, sf_dir):
    x = classify.traits(_user_turns(spark, sf_dir), markers=MARKS)
    return x.withColumn("route_label", F.lit("mixed"))


@query(f"""with q as (select conv_id, turn, trim(text) as t, {_normal_sql("text")} as n from conversations where role = 'user'),
c as (select conv_id, turn, [t, t || case when contains(n, 'policy') then '' else ' policy' end || case when contains(n, 'regulation') then '' else ' regulation' end] as o from q)
select conv_id, turn, o[2] as focused from c""")
def variant_focus(spark, sf_dir):
    from sievework.plans import variants

    x = _variant_input(spark, sf_dir)
    return x.select("conv_id", "turn", variants.append_terms(F.col("query"), F.col("normal"), ("policy", "regulation")).alias("focused"))


@query()
def variant_expansion(spark, sf_dir):
    from sievework.plans import variants

    x = _variant_input(spark, sf_dir)
    out = None
    for target in V.ROUTES:
        v = variants.variants(x, target, 5).select("conv_id", "turn", F.lit(target).alias("target"), F.posexplode("variants").alias("ord", "v"))
        v = v.select("conv_id", "turn", "target", "ord", "v.reason", "v.query")
        out = v if out is None else out.union(v)
    return out


def _has_sql(c: str, markers) -> str:
    return "(" + " or ".join(_mark_sql(c, m) if m.isascii() else f"contains({c}, '{m}')" for m in markers) + ")"


def _wave_sql(route: str, role: str) -> str:
    official, web, news = (f"'{role}:{s}'" for s in V.FIRST_WAVE["industry"])
    ids = lambda *s: "[" + ", ".join(s) + "]"
    return f"case {route} when 'industry' then (case when official then {ids(official, web, news)} when trend then {ids(web)} else {ids(web, news, official)} end)"


_PLAN_SQL = f"""with l as (select conv_id, turn, route_label, primary_route as p, supplemental_route as o from ({_LABEL_SQL})), q as (select conv_id, turn, {_normal_sql("text")} as n from conversations where role = 'user'),
x as (select l.*, {" or ".join(f"contains(n, '{m}')" for m in V.OFFICIAL_FIRST)} as official, {_has_sql("n", V.TREND_MARKERS)} as trend, contains(n, '{V.ARXIV_FIRST[0]}') as arxiv from l join q using (conv_id, turn))
select conv_id, turn, route_label, list_concat(case when route_label = 'academic' and p = 'academic' then [case when arxiv then 'primary:academic_arxiv' else 'primary:academic_semantic_scholar' end] else {_wave_sql("p", "primary")} when 'academic' then ['primary:academic_semantic_scholar', 'primary:academic_arxiv'] else ['primary:policy_official_registry'] end end,
  case when route_label = 'mixed' and o is not null then {_wave_sql("o", "supplemental")} when 'academic' then ['supplemental:academic_semantic_scholar'] else ['supplemental:policy_official_registry'] end else [] end) as first_wave,
  case when route_label = 'industry' and p = 'industry' then 8.0 else 3.0 end::double as per_source, case when route_label = 'industry' and p = 'industry' then 9.0 when route_label = 'mixed' then 8.0 else 6.0 end::double as overall, case when route_label in ('industry', 'mixed') then 5 else 3 end as variants, case when route_label = 'industry' and p = 'industry' then 3 else 6 end as at_once from x"""


@query(_PLAN_SQL)
def retrieval_plan(spark, sf_dir):
    from sievework.plans import retrieval_plan as plans

    x = classify.label(classify.ranked_routes(classify.route_scores(classify.traits(_user_turns(spark, sf_dir), markers=MARKS), markers=MARKS)), cross_domain=CROSS)
    p = plans.plan(x)
    return p.select("conv_id", "turn", "route_label", F.transform("first_wave", lambda s: F.concat_ws(":", s["role"], s["source_id"])).alias("first_wave"), "per_source", "overall", "variants", "at_once")


_CATALOG = [
    {"title": "A", "url": "u/a", "publication_date": "2024-01-01", "markers": ("the", "und", "que")},
    {"title": "B", "url": "u/b", "publication_date": "2024-03-01", "markers": ("of", "der")},
    {"title": "C", "url": "u/c", "publication_date": "2024-03-01", "markers": ("and", "la")},
    {"title": "D", "url": "u/d", "markers": ("zzzz",)},
]
_ENTRIES = " union all ".join(f"select {i} as entry, '{e['title']}' as title, '{e['url']}' as url, '{e.get('publication_date', '')}' as date, conv_id, turn, {' + '.join(f"contains(n, '{m}')::int" for m in e['markers'])} as score from q" for i, e in enumerate(_CATALOG))


@query(f"""with q as (select conv_id, turn, {_normal_sql('text')} as n from conversations where role = 'user'), e as ({_ENTRIES}), r as (select *, row_number() over (partition by conv_id, turn order by score desc, date desc, url desc)::int as rank from e where score > 0) select conv_id, turn, title, score, rank from r where rank <= 2""")
def catalog_search(spark, sf_dir):
    from sievework.sources.catalogs import search_catalog

    q = _user_turns(spark, sf_dir).withColumn("qid", F.struct("conv_id", "turn"))
    return search_catalog(q, _CATALOG, "qid", k=2).select("qid.conv_id", "qid.turn", "title", "score", "rank")


_SCORED_HITS = f"h as (select d.doc_id as evidence_id, source, case lang when 'en' then 'mixed' when 'fr' then 'policy' else 'industry' end as label, {_ROLE} as route_role, d.n_chars % 5 as focus_score, d.n_chars % 7 as query_score, (d.n_chars % 11)::double as total_score, d.n_chars % 4 as tier_priority from documents d join labels using (doc_id))"


def _scored_hits(spark, sf_dir):
    n = F.col("n_chars")
    x = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return x.select(F.col("doc_id").alias("evidence_id"), "source", F.expr("case lang when 'en' then 'mixed' when 'fr' then 'policy' else 'industry' end").alias("label"), F.expr(_ROLE).alias("route_role"), (n % 5).alias("focus_score"), (n % 7).alias("query_score"), (n % 11).cast("double").alias("total_score"), (n % 4).alias("tier_priority"))


@query(f"""with {_SCORED_HITS}, k as (select *, case when label = 'mixed' then (case route_role when 'primary' then 0 when 'supplemental' then 1 else 2 end) else 0 end as r from h),
o as (select *, row_number() over (partition by source, label, r order by case when label = 'mixed' then -focus_score else 0 end, -query_score, case when label = 'industry' then tier_priority else -total_score end, evidence_id) as n from k),
s as (select *, case when label <> 'mixed' then 0 when r = 2 then 4 when n = 1 then r else r + 2 end as slot from o) select source, label, evidence_id, row_number() over (partition by source, label order by slot, n)::int as rank from s""")
def response_order(spark, sf_dir):
    from sievework.operators.canonical import response_order as order

    return order(_scored_hits(spark, sf_dir), ["source", "label"]).select("source", "label", "evidence_id", "rank")


@query(f"""with {_SCORED_HITS}, o as (select *, row_number() over (partition by source, route_role order by focus_score desc, query_score desc, total_score desc, evidence_id) as n from h),
g as (select *, n = 1 and route_role in ('primary', 'supplemental') and (focus_score > 0 or query_score > 0) as good from o), b as (select *, sum(good::int) over (partition by source) = 2 as pair from g),
t as (select *, row_number() over (partition by source order by case when pair and good then (case route_role when 'primary' then 0 else 1 end) else 2 end, total_score desc, route_role <> 'primary', evidence_id) as turn from b) select source, evidence_id from t where turn <= 6""")
def mixed_seeding(spark, sf_dir):
    from sievework.operators.canonical import seeded_top

    return seeded_top(_scored_hits(spark, sf_dir), ["source"], 6).select("source", "evidence_id")


@query("""with p as (select user_id as hit, event_type as reason, floor(value / 10)::int as alignment from events), s as (select *, alignment + case reason when 'view' then 0 when 'click' then 2 else (reason <> 'original')::int end as total from p),
r as (select *, row_number() over (partition by hit order by total desc, alignment desc) as k from s) select hit, total, 1 as focused, alignment, true as viable from r where k = 1""")
def mixed_hit_score(spark, sf_dir):
    """Users as hits and events as variants."""
    from sievework.operators.canonical import mixed_hit_scores, viable

    p = table(spark, sf_dir, "events").select(F.col("user_id").alias("hit"), F.col("event_type").alias("reason"), F.floor(F.col("value") / 10).cast("int").alias("alignment"))
    x = mixed_hit_scores(p, ["hit"], {"view": 0, "click": 2})
    return x.withColumn("viable", viable(F.col("total"), F.col("focused"), F.col("alignment")))


def _records(spark, sf_dir):
    """Documents as raw records of three domains: first lines as titles, whole texts as snippets."""
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id")
    none = F.lit(None).cast("string")
    some = lambda k, v: F.when(n % k == 0, v)
    return d.select(
        n.alias("pos"), F.concat_ws("_", F.element_at(F.array(F.lit("policy"), F.lit("academic"), F.lit("industry")), (n % 3 + 1).cast("int")), "source").alias("source_id"), F.concat(F.lit("https://"), "source", F.lit(".gov/"), n.cast("string")).alias("url"),
        F.split("text", "\n", 2)[0].alias("title"), F.col("text").alias("snippet"), F.lit("official_government").alias("credibility_tier"), F.when(n % 2 == 0, "primary").otherwise("supplemental").alias("route_role"), X.token_estimate(F.col("text")).alias("token_estimate"),
        some(1, F.col("lang")).alias("authority"), some(5, F.lit("US")).alias("jurisdiction"), some(2, F.lit("2024-01-01")).alias("publication_date"), some(7, F.lit("2024-02-01")).alias("effective_date"), some(4, F.col("source")).alias("version"), none.alias("version_status"),
        some(9, F.md5(F.lower(F.trim("text")))).alias("doi"), none.alias("arxiv_id"), some(6, F.col("source")).alias("first_author"), some(6, F.lit(2020)).alias("year"), some(6, F.lit("preprint")).alias("evidence_level"),
    )


@query()
def canonical_records(spark, sf_dir):
    from sievework.operators.canonical import collapse

    x = collapse(_records(spark, sf_dir))
    return x.select("evidence_id", "domain", "canonical_title", "canonical_url", "route_role", "tier_score", "records", F.size("slices").alias("n_slices"))


@query("""with p as (select page_id, 'Authority: ' || page_id || chr(10) || 'Version: v' || page_id % 7 || chr(10) || 'on 2024-01-0' || (page_id % 9 + 1) || ' and 2024.02.1' || page_id % 10 as t from pages)
select page_id, page_id::varchar as authority, '2024-01-0' || (page_id % 9 + 1) as publication_date, '2024-02-1' || page_id % 10 as effective_date, 'v' || page_id % 7 as version from p""")
def policy_metadata(spark, sf_dir):
    from sievework.sources.catalogs import policy_metadata as metadata

    i = F.col("page_id")
    t = F.concat(F.lit("Authority: "), i.cast("string"), F.lit("\nVersion: v"), (i % 7).cast("string"), F.lit("\non 2024-01-0"), (i % 9 + 1).cast("string"), F.lit(" and 2024.02.1"), (i % 10).cast("string"))
    m = metadata(F.col("t"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "pages").withColumn("t", t).select("page_id", *(c.alias(n) for n, c in m.items()))


@query("with s as (select user_id, ts, (ts - lag(ts) over (partition by user_id order by ts) > interval '6 hours')::int as cut from events), g as (select *, sum(coalesce(cut, 0)) over (partition by user_id order by ts rows unbounded preceding) as k from s) select user_id, floor(epoch(min(ts)))::bigint as started, count(*) as n from g group by user_id, k")
def event_sessions(spark, sf_dir):
    """The batch form of streaming.windows.sessions."""
    from sievework.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", F.unix_timestamp("started").alias("started"), "n")


def _evidence(spark, sf_dir):
    """Benchmark items as queries, with all their terms; all documents as evidence, with their whole texts in slices."""
    b, i, n = table(spark, sf_dir, "benchmark"), F.col("item_id"), F.col("doc_id")
    q = b.select(i.alias("qid"), F.array_distinct(X.tokens(X.normalize_query(F.col("text")))).alias("terms"), F.when(i % 2 == 0, "academic").otherwise("policy").alias("primary_route"), F.lit(True).alias("has_version_intent"), (i % 3 == 0).alias("has_effective_date_intent"), F.lit(False).alias("is_policy_change"))
    e = table(spark, sf_dir, "documents").select(
        n.alias("evidence_id"), F.when(n % 2 == 0, "policy").otherwise("academic").alias("domain"), F.when(n % 3 == 0, "supplemental").otherwise("primary").alias("route_role"), F.split("text", "\n", 2)[0].alias("title"), matches.whole_slices(F.col("text"), n).alias("slices"),
        (F.col("n_chars") % 13).alias("total_score"), (F.col("n_chars") % 3).alias("alignment"), F.when(n % 5 == 0, F.concat(F.lit("v"), n.cast("string"))).alias("version"), F.when(n % 5 == 0, "observed").alias("version_status"), F.lit(None).cast("string").alias("publication_date"), F.when(n % 7 < 3, F.concat(F.lit("2024-01-0"), (n % 7 + 1).cast("string"))).alias("effective_date"),
    )
    return q, e


@query()
def route_slice_matches(spark, sf_dir):
    q, e = _evidence(spark, sf_dir)
    return matches.route_matches_of_all(e, q)


@query()
def relevance_gate(spark, sf_dir):
    q, e = _evidence(spark, sf_dir)
    return matches.relevance_gate_of_all(e, q)


@query("""with e as (select item_id as qid, doc_id as evidence_id, doc_id % 5 = 0 as v, case when doc_id % 7 < 3 then '2024-01-0' || (doc_id % 7 + 1) end as d, n_chars % 3 as alignment from benchmark, documents where doc_id % 2 = 0 and length(documents.text) > 0),
k as (select *, row_number() over (partition by qid order by v desc, qid % 3 <> 0 or d is not null desc, alignment desc, coalesce(d, '') desc, evidence_id desc) as r from e) select qid, evidence_id from k where r = 1 and v and (qid % 3 <> 0 or d is not null)""")
def best_policy_lookup(spark, sf_dir):
    q, e = _evidence(spark, sf_dir)
    return matches.best_policy_record_of_all(e, q)


@query(r"""with l as (select page_id, url as base, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"[^>]*>[^<]*</a>', 1)) as href, unnest(regexp_extract_all(html, '<a\s[^>]*href="[^"]+"[^>]*>([^<]*)</a>', 1)) as text, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*href="([^"]+)"[^>]*>[^<]*</a>', 1), 1) as i from pages),
w as (select page_id, i, trim(text) as text, case when href like '/%' then regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*') || href else href end as url from l), f as (select *, row_number() over (partition by page_id, url order by i) as k from w where url like 'http%')
select page_id, (row_number() over (partition by page_id order by i) - 1)::int as pos, text, url from f where k = 1""")
def page_links(spark, sf_dir):
    from sievework.sources.serp import links

    return links(table(spark, sf_dir, "pages"), "page_id", "html", "url")


@query("select o_orderstatus, o_orderpriority, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by cube (o_orderstatus, o_orderpriority)")
def order_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


from sievework import answer_queries, source_queries  # noqa: E402, F401  (they add theirs)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
