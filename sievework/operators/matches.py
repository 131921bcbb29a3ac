"""Which evidence answers a query: slice matches, relevance, best records, cited sources.

Evidence has a row for each query and record: qid, evidence_id, domain, route_role, title, slices (an array of structs
with text, source_record_id, score and tokens), total_score, alignment; queries have qid and terms, their content terms.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.functions.text import TOKEN, normalize_query, tokens
from sievework.operators.paragraphs import pieces

Terms = Callable[[Column], Column]
SLICE = r"(?s).{1,200}(?!\S)|\S+"
QUERIES, CELLS = 2_000, 4_000_000  # of a pass over the records; of slices and queries that are counted at once


def words_of(text: Column) -> Column:
    return tokens(normalize_query(text))


def overlap(terms: Column, text: Column, of: Terms = words_of) -> Column:
    return F.size(F.array_intersect(terms, of(text)))


def best_slice(terms: Column, slices: Column, of: Terms = words_of) -> Column:
    """(hits, score, text, source_record_id) of the slice with most query terms; then score, brevity, name."""
    ranked = F.transform(slices, lambda s: F.struct(overlap(terms, s["text"], of).alias("hits"), s["score"].alias("score"), (-s["tokens"]).alias("brevity"), s["source_record_id"].alias("source_record_id"), s["text"].alias("text")))
    return F.array_max(ranked)


def route_matches(evidence: DataFrame, queries: DataFrame, limit: int = 2, of: Terms = words_of) -> DataFrame:
    """Each query's best records by domain and role, with their best slice; those without any overlap or alignment are none."""
    x = evidence.join(queries.select("qid", "terms"), "qid").where(F.size("slices") > 0)
    x = x.withColumn("best", best_slice(F.col("terms"), F.col("slices"), of)).where((F.col("best.hits") > 0) | (F.col("alignment") > 0))
    order = Window.partitionBy("qid", "domain", "route_role").orderBy(F.desc("best.hits"), F.desc("alignment"), F.desc("total_score"), "evidence_id")
    x = x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return x.select("qid", "domain", "route_role", "evidence_id", F.col("best.hits").alias("overlap"), F.col("best.source_record_id").alias("source_record_id"), F.col("best.text").alias("text"), "rank")


def whole_slices(text: Column, record: Column) -> Column:
    """A whole text as slices of 200 characters at most, cut between words only; a longer word is a slice of its own. The first scores 1.5, the others 0.5."""

    def part(s: Column, i: Column) -> Column:
        name = F.concat(record.cast("string"), F.lit(":"), F.lpad(i.cast("string"), 7, "0"))
        return F.struct(s.alias("text"), name.alias("source_record_id"), F.when(i == 0, 1.5).otherwise(0.5).alias("score"), F.regexp_count(s, F.lit(r"\S+")).alias("tokens"))

    return F.transform(F.regexp_extract_all(text, F.lit(SLICE), F.lit(0)), part)


def _best_of_all(block: list[tuple], limit: int, schema: pa.Schema):
    """Each query's limit best records by domain and role in each part of a batch; nothing that could be among the best of all is lost."""
    words = {t: i for i, t in enumerate({t for _, terms in block for t in terms})}
    held = sorted({(words[t], q) for q, (_, terms) in enumerate(block) for t in terms})
    term, asks = np.array([t for t, _ in held], np.int64), np.array([q for _, q in held], np.int64)
    many = np.bincount(term, minlength=len(words))
    first, n = np.cumsum(many) - many, len(block)
    token = re.compile(TOKEN)

    def parts(rows: list[dict]) -> Iterator[list[dict]]:
        held, size = [], 0
        for r in rows:
            held.append(r)
            size += len(r["slices"])
            if size * n >= CELLS:
                yield held
                held, size = [], 0
        if held:
            yield held

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            out: dict[str, list] = {f.name: [] for f in schema}
            for docs in parts(batch.to_pylist()):
                found = [[words[t] for t in {*token.findall(s)} if t in words] for d in docs for s in d["normal"]]
                size = len(found)
                t = np.array([x for f in found for x in f], np.int64)
                at = np.repeat(np.arange(size), [len(f) for f in found])
                times = many[t]
                place = np.repeat(first[t] - (np.cumsum(times) - times), times) + np.arange(times.sum())
                hits = np.bincount(np.repeat(at, times) * n + asks[place], minlength=size * n).reshape(size, n)
                begin = np.cumsum([0, *(len(d["slices"]) for d in docs)])[:-1]
                order = [sorted(range(len(d["slices"])), key=lambda i, s=d["slices"]: (s[i]["score"], -s[i]["tokens"], s[i]["source_record_id"])) for d in docs]
                hits *= size
                for b, o in zip(begin, order, strict=True):
                    hits[b + np.array(o)] += np.arange(len(o))[:, None]
                top = np.maximum.reduceat(hits, begin, axis=0)
                rank = np.zeros(len(docs), np.int64)
                by_id = sorted(range(len(docs)), key=lambda i: docs[i]["evidence_id"], reverse=True)
                rank[sorted(by_id, key=lambda i: (docs[i]["alignment"], docs[i]["total_score"]))] = np.arange(len(docs))
                worth = (top // size) * len(docs) + rank[:, None]
                worth[(top < size) & (np.array([d["alignment"] for d in docs]) <= 0)[:, None]] = -1
                groups: dict[tuple, list[int]] = {}
                for i, d in enumerate(docs):
                    groups.setdefault((d["domain"], d["route_role"]), []).append(i)
                for members in groups.values():
                    own = worth[members]
                    few = np.argpartition(-own, limit - 1, axis=0)[:limit] if len(members) > limit else np.repeat(np.arange(len(members))[:, None], n, axis=1)
                    for k, q in zip(*(x.tolist() for x in np.nonzero(np.take_along_axis(own, few, 0) >= 0)), strict=True):
                        i = members[few[k, q]]
                        d, (overlap, at_slice) = docs[i], divmod(int(top[i, q]), size)
                        s = d["slices"][order[i][at_slice]]
                        row = (block[q][0], d["domain"], d["route_role"], d["evidence_id"], overlap, s["source_record_id"], s["text"], d["alignment"], d["total_score"])
                        for c, v in zip(out, row, strict=True):
                            out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, schema.field(c).type) for c, v in out.items()], schema=schema)

    return best


def route_matches_of_all(records: DataFrame, queries: DataFrame, limit: int = 2) -> DataFrame:
    """route_matches with every record as evidence of every query: records are evidence without qid, a row each.

    Queries' terms are collected and become an index by token, with which records are met where they lie, QUERIES
    queries in a pass; only the best of each batch are exchanged. Terms are words_of the queries' texts.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    own = T.StructType([queries.schema["qid"], *(records.schema[c] for c in ("domain", "route_role", "evidence_id")), *T._parse_datatype_string("overlap int, source_record_id string, text string").fields, *(records.schema[c] for c in ("alignment", "total_score"))])
    x = records.where(F.size("slices") > 0).select("evidence_id", "domain", "route_role", "alignment", "total_score", "slices", F.transform("slices", lambda s: normalize_query(s["text"])).alias("normal"))
    asked = [(r["qid"], r["terms"]) for r in queries.select("qid", F.array_distinct("terms").alias("terms")).collect()]
    out = None
    for block in batched(asked, QUERIES):
        some = x.mapInArrow(_best_of_all([*block], limit, to_arrow_schema(own)), own)
        out = some if out is None else out.union(some)
    out = records.sparkSession.createDataFrame([], own) if out is None else out
    order = Window.partitionBy("qid", "domain", "route_role").orderBy(F.desc("overlap"), F.desc("alignment"), F.desc("total_score"), "evidence_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).drop("alignment", "total_score")


def relevance_gate_of_all(records: DataFrame, queries: DataFrame, of: Terms = words_of) -> DataFrame:
    """relevance_gate with every record as evidence of every query."""
    best = route_matches_of_all(records, queries, 1).groupBy("qid").agg(F.max("overlap").alias("most"))
    text = F.concat(F.array("title"), F.transform("slices", lambda s: s["text"]))
    there = records.select(F.explode(F.array_distinct(F.flatten(F.transform(text, of)))).alias("term")).distinct()
    held = queries.select("qid", F.explode(F.array_distinct("terms")).alias("term")).join(there, "term", "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("held"))
    n = F.size(F.array_distinct("terms"))
    x = queries.join(best, "qid", "left").join(held, "qid", "left")
    got = F.coalesce(F.when(F.col("primary_route") == "academic", F.col("most")).otherwise(F.col("held")), F.lit(0))
    return x.select("qid", ((n == 0) | (got >= F.least(F.lit(2), n))).alias("relevant"))


def best_policy_record_of_all(records: DataFrame, queries: DataFrame) -> DataFrame:
    """best_policy_record with every record as evidence of every query: the best depends on the query's traits alone, so it is found once for each of their combinations."""
    traits = ["has_version_intent", "has_effective_date_intent", "is_policy_change"]
    kinds = queries.select(*traits).distinct().withColumn("qid", F.concat_ws(" ", *(F.col(t).cast("string") for t in traits)))
    best = best_policy_record(records.crossJoin(F.broadcast(kinds.select("qid"))), kinds).withColumnRenamed("qid", "kind")
    return queries.withColumn("kind", F.concat_ws(" ", *(F.col(t).cast("string") for t in traits))).join(best, "kind").select("qid", "evidence_id")


def relevance_gate(evidence: DataFrame, queries: DataFrame, of: Terms = words_of) -> DataFrame:
    """(qid, relevant): enough query terms (two, or all of fewer) occur in the evidence, for academic queries in one slice."""
    text = lambda: F.concat(F.array("title"), F.transform("slices", lambda s: s["text"]))
    x = queries.join(evidence.select("qid", "title", "slices"), "qid", "left")
    x = x.withColumn("_in", F.transform("slices", lambda s: overlap(F.col("terms"), s["text"], of)))
    held = F.array_intersect("terms", F.flatten(F.transform(text(), of)))
    hits = x.select("qid", "primary_route", "terms", F.coalesce(F.array_max("_in"), F.lit(0)).alias("most"), F.explode_outer(held).alias("term"))
    g = hits.groupBy("qid").agg(F.first("primary_route").alias("route"), F.first(F.size("terms")).alias("n"), F.max("most").alias("most"), F.count_distinct("term").alias("held"))
    need = F.least(F.lit(2), F.col("n"))
    return g.select("qid", ((F.col("n") == 0) | (F.when(F.col("route") == "academic", F.col("most")).otherwise(F.col("held")) >= need)).alias("relevant"))


def best_policy_record(evidence: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, evidence_id): the policy record that has what the query asks for; none if the best one lacks it.

    evidence also has version, version_status, publication_date and effective_date; queries have their traits.
    """
    x = evidence.where("domain = 'policy'").where(F.size("slices") > 0).join(queries.select("qid", "has_version_intent", "has_effective_date_intent", "is_policy_change"), "qid")
    has = lambda asked, got: F.when(F.col(asked), got.cast("int")).otherwise(1)
    need = [has("has_version_intent", (F.coalesce("version_status", F.lit("")) == "observed") & F.col("version").isNotNull()), has("has_effective_date_intent", F.col("effective_date").isNotNull()), has("is_policy_change", F.col("alignment") > 0)]
    key = F.struct(*(n.alias(f"n{i}") for i, n in enumerate(need)), "alignment", F.coalesce("publication_date", F.lit("")).alias("p"), F.coalesce("effective_date", F.lit("")).alias("e"), "evidence_id")
    best = x.groupBy("qid").agg(F.max(key).alias("b"))
    return best.where("b.n0 = 1 and b.n1 = 1 and b.n2 = 1").select("qid", "b.evidence_id")


def cited_sources(cited: DataFrame, drafts: DataFrame, records: DataFrame) -> DataFrame:
    """(qid, evidence_id, title, url, ord): each cited record once, in order, named as the draft does, else as the record is."""
    first = cited.groupBy("qid", "evidence_id").agg(F.min("pos").alias("ord"))
    named = drafts.select("qid", "evidence_id", F.struct("title", "url").alias("d")).groupBy("qid", "evidence_id").agg(F.max("d").alias("d"))
    x = first.join(named, ["qid", "evidence_id"], "left").join(records.select("qid", "evidence_id", F.struct("title", "url").alias("r")), ["qid", "evidence_id"], "left")
    return x.select("qid", "evidence_id", F.coalesce("d", "r")["title"].alias("title"), F.coalesce("d", "r")["url"].alias("url"), "ord")


def extra_threshold(best: Column) -> Column:
    """The alignment that another partial match needs beside the best one."""
    return F.when(best <= 0, 0).otherwise(F.greatest(F.lit(8), F.floor(best * 0.65 + 0.999).cast("int")))


def cacheable(answer: Column, retrieval: Column, failure: Column, gaps: Column, notes: Column) -> Column:
    return (answer == "grounded_success") & (retrieval == "success") & failure.isNull() & (F.size(gaps) == 0) & (F.size(notes) == 0)


def truncated(text: Column, most: int = 18) -> Column:
    """At most so many words; what is cut ends in three dots."""
    words = F.split(F.trim(text), r"\s+")
    cut = F.regexp_replace(F.array_join(F.slice(words, 1, most), " "), "[,.;:]+$", "")
    return F.when(F.size(words) <= most, F.trim(text)).otherwise(F.concat(cut, F.lit("...")))


def evidence_tokens(slices: Column, title: Column) -> Column:
    """Tokens of a record: at least 1 a slice, the title's words where there are none."""
    own = F.aggregate(slices, F.lit(0), lambda a, s: a + F.greatest(F.lit(1), s["tokens"].cast("int")))
    return F.when(F.size(slices) > 0, own).otherwise(F.greatest(F.lit(1), F.regexp_count(title, F.lit(r"\S+"))))


def rehydrated(items: DataFrame) -> DataFrame:
    """Records as answers see them: slices lose their scores, tokens are counted anew, tiers and total scores are gone."""
    slices = F.transform("slices", lambda s: F.struct(s["text"].alias("text"), s["source_record_id"].alias("source_record_id"), F.lit(0.0).alias("score"), F.regexp_count(s["text"], F.lit(r"\S+")).alias("tokens")))
    return items.withColumns({"slices": slices, "credibility_tier": F.lit(None).cast("string"), "total_score": F.lit(0.0)})
