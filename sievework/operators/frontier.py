"""A second search: what the held evidence leaves uncovered, which hits cover it, and how they join the evidence.

Two forms. The bounded one asks a few sources on another route with one rewritten query: of each source's hits the best
new one is chosen, of these the winner, and both are merged into the evidence and packed anew. The greedy one goes on
until nothing is gained: in each round every query takes the record that covers most of what is still uncovered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import normalize_query
from sievework.operators import evidence, ranking
from sievework.operators.alignment import best_records, known_tokens
from sievework.operators.components import written

LEAST_ALIGNMENT = 6
MAX_PROBES = 2


def greedy_cover(queries: DataFrame, records: DataFrame, query_id: str, record_id: str, held: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(query id, round, record id, gain, left): the records that each query takes, one a round, until none of them covers more.

    queries and records have `tokens`; held (query id, tokens) is evidence that a query has already, whose tokens need no more
    cover. gain: the weights of the tokens that the round's record covers first; ties go to the smaller record id. left: how many
    of the query's tokens are still uncovered after the round. A record that is held or taken gains nothing, so it is never
    taken again, and the same goes for its copies. State is a row for each query that still gains, a table of its own every round.
    """
    state = queries.select(query_id, F.array_distinct(F.filter("tokens", lambda t: t.isNotNull())).alias("tokens"))
    if held is not None:
        own = held.groupBy(query_id).agg(F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("_held"))
        state = state.join(own, query_id, "left").select(query_id, F.array_except("tokens", F.coalesce("_held", F.array().cast("array<string>"))).alias("tokens"))
    state = written(state.where(F.size("tokens") > 0))
    known, taken, turn = known_tokens(state, records, record_id), [], 0
    while not state.isEmpty() and (max_rounds is None or turn < max_rounds):
        turn += 1
        best = best_records(state, known, query_id, record_id, 1, years_alone=True)
        step = best.join(state.withColumnRenamed("tokens", "asked"), query_id).join(known, record_id)
        step = written(step.select(query_id, F.lit(turn).alias("round"), record_id, F.col("score").alias("gain"), F.array_except("asked", "tokens").alias("tokens")))
        taken.append(step.withColumn("left", F.size("tokens")).drop("tokens"))
        state = step.where(F.size("tokens") > 0).select(query_id, "tokens")
    none = known.join(state, F.lit(False)).select(query_id, F.lit(0).alias("round"), record_id, F.lit(0).cast("long").alias("gain"), F.lit(0).alias("left"))
    return reduce(DataFrame.union, taken, none)


def _same(c: str) -> Column:
    """A name as duplicates are told by."""
    return normalize_query(F.col(c))


def new_hits(hits: DataFrame, held: DataFrame, by: list[str]) -> DataFrame:
    """hits without those that a query's evidence has already, by address, title, DOI or arXiv id; empty names match nothing."""
    names = {"url": lambda c: F.lower(F.trim(F.col(c))), "title": _same, "doi": _same, "arxiv_id": _same}
    for c, normal in names.items():
        if c in hits.columns and c in held.columns:
            there = held.select(*by, normal(c).alias("_name")).where("_name <> ''").distinct()
            hits = hits.withColumn("_name", normal(c)).join(there, [*by, "_name"], "left_anti").drop("_name")
    return hits


def identity(source: Column, title: Column, url: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"\s+"), lambda w: w != "")
    return F.concat(source, F.lit(":"), F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("untitled"), F.lit(":"), url)


def chosen_hits(hits: DataFrame, by: list[str], probe: list[str] | None = None) -> DataFrame:
    """Each probe's best hit, if it is aligned at all: by, probe, source_id, evidence_id, title, url, alignment, hits.

    hits (new ones) has source_id, title, url, and the alignment with the query and with the probe's rewriting of it, of which
    the better counts. Of equals, the last by evidence_id, title and address. hits: how many there were.
    """
    probe = probe or ["source_id"]
    best = F.max(F.struct(F.greatest("query_alignment", "probe_alignment").alias("alignment"), identity(F.col("source_id"), F.col("title"), F.col("url")).alias("evidence_id"), "title", "url", F.col("source_id").alias("source"))).alias("b")
    x = hits.groupBy(*by, *probe).agg(best, F.count(F.lit(1)).alias("hits"))
    return x.where("b.alignment > 0").select(*by, *probe, "b.alignment", "b.evidence_id", "b.title", "b.url", "hits")


def winner(chosen: DataFrame, by: list[str], least: int = LEAST_ALIGNMENT) -> DataFrame:
    """by and the best chosen hit of all probes that is aligned well enough, with ambiguous: whether there was any choice."""
    x = chosen.groupBy(*by).agg(F.max(F.when(F.col("alignment") >= least, F.struct("alignment", "evidence_id", "title", "url", "source_id"))).alias("w"), F.count(F.lit(1)).alias("probes"), F.sum("hits").alias("hits"))
    return x.where("w is not null").select(*by, "w.*", ((F.col("probes") > 1) | (F.col("hits") > F.col("probes"))).alias("ambiguous"))


def decision(grounded: Column, supplemental: Column, alignment: Column, least: int = LEAST_ALIGNMENT) -> Column:
    """What a second search has led to: an answer stands, the best branch is looked at more closely, or evidence lacks. alignment: the winner's, or null."""
    good = F.coalesce(alignment >= least, F.lit(False))
    return F.when(grounded | ((supplemental > 0) & good), "grounded_success").when(good, "deepen").otherwise("insufficient_evidence")


def merged(held: DataFrame, added: DataFrame, by: list[str], k: int, budget: int, reserve: int = 1) -> DataFrame:
    """The evidence of both searches, packed anew: the k best records, supplemental ones with places of their own, within a budget of tokens.

    Records have by, evidence_id, route_role, total_score and tokens; what was added is supplemental. Of a record that both have,
    the held one counts. Queries with nothing added keep what they have.
    """
    x = added.join(held.select(*by, "evidence_id"), [*by, "evidence_id"], "left_anti").withColumn("route_role", F.lit("supplemental"))
    both = held.unionByName(x, allowMissingColumns=True)
    top = ranking.reserved_top_k(both, by, "route_role", [F.desc("total_score"), F.asc("evidence_id")], k, reserve).drop("rank")
    packed = evidence.drop_records(top, by, budget, reserve, "evidence_id", "route_role", "total_score", "tokens")
    again = x.select(*by).distinct().withColumn("_again", F.lit(True))
    whole = held.join(again, by, "left_anti")
    return packed.join(again, by, "left_semi").unionByName(whole, allowMissingColumns=True).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("total_score"), "evidence_id")))
