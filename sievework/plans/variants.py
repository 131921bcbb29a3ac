"""Query variants: rewrites of a query for one route, in order, once each, up to a limit. All native."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions import vocabulary as V
from sievework.functions.markers import contains_any
from sievework.functions.text import let, normalize_query
from sievework.operators.classify import classify

CJK = "[一-鿿]"
WORD = r"[a-z0-9-]+|[一-鿿]"


def words(normal: Column) -> Column:
    return F.regexp_extract_all(normal, F.lit(WORD), F.lit(0))


def compact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^[ -]+|[ -]+$", "")


def append_terms(query: Column, normal: Column, terms: tuple[str, ...]) -> Column:
    """The query and those of the terms that it lacks."""
    missing = F.array_compact(F.array(*(F.when(~normal.contains(t), t) for t in terms)))
    return F.array_join(F.concat(F.array(F.trim(query)), missing), " ")


def pruned(normal: Column, removable: tuple[str, ...]) -> Column:
    """Content words without the removable ones and without years."""
    return compact(F.array_join(F.filter(words(normal), lambda w: ~w.isin(*removable) & ~w.rlike("^(fy)?20[0-9]{2}$")), " "))


def _if_new(candidate: Column, normal: Column) -> Column:
    return F.when((candidate != "") & (candidate != normal), candidate)


def core_focus(normal: Column, kept: Column | None = None) -> Column:
    """Without words that say little; null if that changes nothing, or if only single CJK characters are left."""
    kept = pruned(normal, V.LOW_INFORMATION) if kept is None else kept
    bare = normal.rlike(CJK) & ~normal.rlike("[a-z0-9]") & kept.rlike(f"^({CJK}( |$))+$")
    return F.when(~bare, _if_new(kept, normal))


def ascii_core(normal: Column) -> Column:
    """The ASCII words of a query that also has other characters; null with fewer than three."""
    own = F.array_distinct(F.filter(words(normal), lambda w: w.rlike("[a-z0-9]") & ~w.rlike("^20[0-9]{2}$") & ~w.isin(*V.CORE_STOPWORDS)))
    return F.when((F.size(own) >= 3) & normal.rlike(r"[^a-z0-9\s-]"), _if_new(compact(F.array_join(own, " ")), normal))


def topic_focus(normal: Column, keep_hint: bool = False) -> Column:
    """Without years, words for papers and, unless kept, hints at sources."""
    gone = V.LOOKUP_WORDS + (() if keep_hint else V.SOURCE_HINTS)
    x = F.regexp_replace(normal, "(?<![0-9])20[0-9]{2}(?![0-9])", " ")
    for marker in gone:
        x = F.regexp_replace(x, rf"(?<![a-z0-9]){re.escape(marker)}(?![a-z0-9])", " ")
    return compact(x)


def gloss(normal: Column, glossary: tuple[tuple[str, str], ...] = V.GLOSSARY) -> Column:
    """English words for a CJK query, by the glossary in its order; null with fewer than three."""
    x = reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(f" {pair[1]} ")), glossary, normal)
    own = F.array_distinct(F.filter(F.split(compact(x), " "), lambda w: w.rlike(r"^[\x00-\x7f]*[a-z0-9][\x00-\x7f]*$")))
    return F.when(normal.rlike(CJK) & (F.size(own) >= 3), _if_new(F.array_join(own, " "), normal))


def document_parts(normal: Column) -> dict[str, Column]:
    """What stands before and after the first document marker, pruned, and the marker; empty without one."""
    markers = "|".join(re.escape(m) for m in sorted(V.DOCUMENT_MARKERS, key=len, reverse=True))
    pattern = rf"^(.*?)(?<![a-z0-9])({markers})(?![a-z0-9])(.*)$"
    part = lambda i: F.regexp_extract(normal, pattern, i)
    return {"_entity": pruned(part(1), V.DOCUMENT_NOISE), "_marker": part(2), "_concept": pruned(part(3), V.DOCUMENT_NOISE)}


def document_focus(normal: Column, entity: Column, marker: Column, concept: Column) -> tuple[Column, Column]:
    """(entity marker concept, entity concept); null without all three."""
    whole = (marker != "") & (entity != "") & (concept != "")
    join = lambda *c: F.when(whole, _if_new(F.concat_ws(" ", *c), normal))
    return join(entity, marker, concept), join(entity, concept)


def fragments(normal: Column) -> Column:
    """The two sides of the first marker in the list that splits the query into parts of three words and more; else empty."""
    out = F.array().cast("array<string>")
    for marker in reversed(V.FRAGMENT_MARKERS):
        at = F.locate(marker, normal)
        left, right = compact(F.substring(normal, F.lit(1), at - 1)), compact(F.substring(normal, at + len(marker), F.length(normal)))
        enough = (F.size(F.split(left, " ")) >= 3) & (F.size(F.split(right, " ")) >= 3)
        out = F.when((at > 0) & enough, F.array(left, right)).otherwise(out)
    return out


def candidates(target: str, mixed: Column) -> list[tuple[str, Column]]:
    """(reason, variant or null) in order, for rows with query, normal and traits; without cross-domain fragments.

    What several variants use are columns of the rows: _kept, _entity, _marker, _concept, _topic and _locked.
    """
    q, n = F.col("query"), F.col("normal")
    cjk = n.rlike(CJK)
    add = lambda base, base_n, han, latin: F.when(cjk, append_terms(base, base_n, han)).otherwise(append_terms(base, base_n, latin))
    trend, year = F.col("has_trend_intent"), F.col("has_year")
    if target == "policy":
        return [
            ("core_focus", core_focus(n, F.col("_kept"))),
            ("policy_focus", F.when(mixed, add(q, n, ("政策", "监管"), ("policy", "regulation")))),
            ("policy_change", F.when(F.col("is_policy_change") | F.col("has_version_intent"), add(q, n, ("修订", "变化"), ("revision", "amendment")))),
            ("policy_effective_date", F.when(F.col("has_effective_date_intent") | year, add(q, n, ("生效", "时间"), ("effective date",)))),
        ]
    if target == "industry":
        share, forecast = contains_any(n, V.SHARE_MARKERS), contains_any(n, V.FORECAST_MARKERS)
        document, concept = document_focus(n, F.col("_entity"), F.col("_marker"), F.col("_concept"))
        return [
            ("document_focus", document),
            ("document_concept_focus", concept),
            ("core_focus", core_focus(n, F.col("_kept"))),
            ("industry_cjk_gloss", gloss(n)),
            ("industry_focus", F.when(mixed, add(q, n, ("产业", "市场"), ("industry", "market")))),
            ("industry_trend", F.when((trend | year) & ~share & ~forecast, add(q, n, ("趋势", "预测"), ("trend", "forecast")))),
            ("industry_share", F.when(trend & ~share, add(q, n, ("市场", "份额"), ("market", "share")))),
        ]
    topic, locked = F.col("_topic"), F.col("_locked")
    base = F.when(topic != "", topic).otherwise(q)
    base_n = F.when(topic != "", topic).otherwise(n)
    return [
        ("academic_ascii_core", ascii_core(n)),
        ("academic_source_hint", F.when(contains_any(n, V.SOURCE_HINTS), topic_focus(n, keep_hint=True))),
        ("academic_phrase_locked", locked),
        ("academic_topic_focus", _if_new(topic, n)),
        ("academic_focus", F.when(mixed, add(q, n, ("论文", "研究"), ("paper", "research")))),
        ("academic_lookup", add(base, base_n, ("论文", "研究"), ("paper", "research"))),
        ("academic_benchmark", F.when(year, add(base, base_n, ("综述", "基准"), ("survey", "benchmark")))),
        ("academic_evidence_type_focus", evidence_focus(topic, locked)),
    ]


def first_distinct(options: Column, limit: int) -> Column:
    """Of (reason, query, key) structs: those whose key is not empty and did not occur before, up to limit."""
    held = F.filter(options, lambda o: F.coalesce(o["key"], F.lit("")) != "")
    new = lambda held, keys: F.filter(held, lambda o, i: F.array_position(keys, o["key"]) == i + 1)
    first = let(held, lambda h: let(F.transform(h, lambda o: o["key"]), lambda keys: new(h, keys)))
    return F.transform(F.slice(first, 1, limit), lambda o: F.struct(o["reason"].alias("reason"), o["query"].alias("query")))


def variants(df: DataFrame, target: str, limit: int = 3) -> DataFrame:
    """df (query, normal, route_label, traits, and fragment where there is one) with variants, an array of (reason, query)."""
    mixed = F.col("route_label") == "mixed"
    x = df
    if target != "academic":
        x = x.withColumn("_kept", pruned(F.col("normal"), V.LOW_INFORMATION))
    if target == "industry":
        x = x.withColumns(document_parts(F.col("normal")))
    if target == "academic":
        x = x.withColumn("_topic", topic_focus(F.col("normal"))).withColumn("_locked", phrase_locked(F.col("_topic")))
    options = [("original", F.trim(F.col("query")))]
    if "fragment" in df.columns:
        options.append(("cross_domain_fragment_focus", F.when(mixed, F.col("fragment"))))
    options += candidates(target, mixed)
    x = x.withColumn("_raw", F.array(*(F.struct(F.lit(r).alias("reason"), c.alias("query")) for r, c in options)))
    keyed = F.transform("_raw", lambda o: F.struct(o["reason"].alias("reason"), o["query"].alias("query"), normalize_query(o["query"]).alias("key")))
    return x.withColumn("_options", keyed).withColumn("variants", first_distinct(F.col("_options"), limit)).select(*df.columns, "variants")


def best_fragment(df: DataFrame, query_id: str, target: str) -> DataFrame:
    """df with fragment: the side of a cross-domain query that scores best for the target route; null without sides."""
    parts = df.select(query_id, "primary_route", "normal", F.posexplode(fragments(F.col("normal"))).alias("at", "part"))
    scored = classify(parts.select(query_id, "at", F.col("primary_route").alias("first_route"), F.col("normal").alias("whole"), F.col("part").alias("query")), unicode=False)
    place = F.when((F.col("first_route") == target) & (F.col("at") == 0), 1).when((F.col("first_route") != target) & (F.col("at") == 1), 1).otherwise(0)
    best = scored.groupBy(query_id).agg(F.max(F.struct(F.col(f"{target}_score"), place.alias("place"), F.size(F.split("query", " ")).alias("n"), F.col("query").alias("part"), "whole")).alias("b"))
    return df.join(best.select(query_id, _if_new(F.col("b.part"), F.col("b.whole")).alias("fragment")), query_id, "left")


def phrase_locked(topic: Column) -> Column:
    """The topic with its two most hyphenated phrases in quotes; null with fewer than two such phrases.

    A phrase is a word with a hyphen and the next one, and a third where that ends a term.
    """

    def found(w: Column) -> Column:
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 2, F.lit(0))), lambda i: F.get(w, i).contains("-") & ~F.coalesce(F.get(w, i + 1), F.lit("2000")).rlike("^20[0-9]{2}$"))
        tail = lambda i: F.when(F.get(w, i + 2).isin(*V.PHRASE_TAILS), F.get(w, i + 2))
        phrase = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), tail(i))
        return F.transform(places, lambda i: F.struct((-F.regexp_count(F.get(w, i), F.lit("-"))).alias("hyphens"), i.alias("i"), phrase(i).alias("phrase")))

    first = lambda f: let(F.transform(f, lambda y: y["phrase"]), lambda ps: F.filter(f, lambda x, i: F.array_position(ps, x["phrase"]) == i + 1))
    once = let(let(F.split(topic, " "), found), first)
    best = F.transform(F.slice(F.array_sort(once), 1, 2), lambda x: x["phrase"])
    at = lambda text, p: F.position(p, text)
    mark = lambda text, p: F.concat(F.substring(text, F.lit(1), at(text, p) - 1), F.lit('"'), p, F.lit('"'), F.substring(text, at(text, p) + F.length(p), F.length(text)))
    quoted = F.aggregate(best, topic, lambda text, p: F.when(F.contains(text, p), mark(text, p)).otherwise(text))
    return F.when(F.size(best) >= 2, compact(quoted))


def evidence_focus(topic: Column, locked: Column) -> Column:
    """Two words of the topic, those of its first phrases where it has any, and the kinds of evidence it names; null with fewer than two kinds."""
    kinds = F.array_distinct(F.filter(F.split(topic, " "), lambda w: w.isin(*V.EVIDENCE_TERMS)))
    other = lambda text: F.filter(F.split(text, " "), lambda w: (w != "") & ~w.isin(*V.EVIDENCE_TERMS))
    lead = F.when(locked.isNotNull() & (F.size(other(F.replace(locked, F.lit('"'), F.lit(" ")))) > 0), other(F.replace(locked, F.lit('"'), F.lit(" ")))).otherwise(other(topic))
    out = F.array_join(F.concat(F.slice(lead, 1, 2), F.slice(kinds, 1, 4)), " ")
    return F.when((F.size(kinds) >= 2) & (out != "") & (out != topic), out)
