import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.operators import alignment, frontier


def weight(t):
    return 4 if re.fullmatch("[0-9]{4}", t) else 2 if len(t) >= 4 else 1


def tables(seed, n_queries=25, n_records=120):
    """Tokens of very different frequency, years among them; nulls, empty arrays, repeated tokens and copies."""
    r = random.Random(seed)
    pool = [f"w{i}" if i % 2 else f"word{i}" for i in range(60)] + ["2019", "2024"]
    some = lambda most: [pool[min(len(pool) - 1, int(r.expovariate(0.06)))] for _ in range(r.randrange(most))]
    queries = [(i, some(25)) for i in range(n_queries)] + [(100, None), (101, []), (102, ["nowhere"]), (103, ["2024"]), (104, ["word0", None, "word0"])]
    records = [(i, some(40)) for i in range(n_records)] + [(900, None), (901, []), (902, ["2024"])]
    return queries, records + [(700 + i, records[i][1]) for i in range(5)]


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("k", [1, 3])
def test_top_records_against_all_pairs(spark, seed, k):
    queries, records = tables(seed)
    got = alignment.top_records(spark.createDataFrame(queries, "q int, tokens array<string>"), spark.createDataFrame(records, "d int, tokens array<string>"), "q", "d", k)
    want = []
    for q, ts in queries:
        rows = []
        for d, ws in records:
            shared = {t for t in ts or [] if t} & set(ws or [])
            plain = sum(weight(t) for t in shared if not re.fullmatch("[0-9]{4}", t))
            if shared:
                rows.append((-(plain + sum(4 for t in shared if re.fullmatch("[0-9]{4}", t)) if plain else 0), d))
        want += [(q, d, -s, i) for i, (s, d) in enumerate(sorted(rows)[:k], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_cover_against_a_loop(spark, seed):
    queries, records = tables(seed)
    held = [(i, [w for w in (records[i][1] or [])[:2]]) for i in range(5)]
    want = []
    for q, ts in queries:
        left = {t for t in ts or [] if t} - {w for h, ws in held if h == q for w in ws}
        turn = 0
        while left:
            gain, d = max(((sum(weight(t) for t in left & set(ws or [])), -d) for d, ws in records), default=(0, 0))
            if not gain:
                break
            turn, left = turn + 1, left - set(next(ws for e, ws in records if e == -d))
            want.append((q, turn, -d, gain, len(left)))
    df = [spark.createDataFrame(x, f"{k} int, tokens array<string>") for x, k in ((queries, "q"), (records, "d"), (held, "q"))]
    got = frontier.greedy_cover(df[0], df[1], "q", "d", df[2])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    some = frontier.greedy_cover(df[0], df[1], "q", "d", df[2], max_rounds=1)
    assert sorted(map(tuple, some.collect())) == sorted(w for w in want if w[1] == 1)


def test_cover_of_nothing(spark):
    none = spark.createDataFrame([], "q int, tokens array<string>")
    some = spark.createDataFrame([(1, ["a"])], "d int, tokens array<string>")
    assert frontier.greedy_cover(none, some, "q", "d").count() == 0
    assert frontier.greedy_cover(some.withColumnRenamed("d", "q"), some.limit(0), "q", "d").count() == 0


HITS = "q int, source_id string, title string, url string, doi string, query_alignment int, probe_alignment int"


def test_second_search(spark):
    hits = [
        (1, "s1", "Held  Title", "http://x/1", None, 30, 1), (1, "s1", "New", "http://x/2", None, 3, 9), (1, "s1", "Other", "HTTP://held/ ", None, 40, 1),
        (1, "s2", "Best", "http://x/3", None, 9, 2), (1, "s2", "Known", "http://x/4", "10.1/A", 50, 0), (2, "s1", "", "http://x/5", None, 5, 0), (3, "s1", "Zero", "http://x/6", None, 0, 0), (4, "s1", "Only", "http://x/7", "", 7, 7),
    ]
    held = spark.createDataFrame([(1, "held title", "http://held/", "10.1/a"), (4, "x", "", "")], "q int, title string, url string, doi string")
    new = frontier.new_hits(spark.createDataFrame(hits, HITS), held, ["q"])
    assert sorted(r["title"] for r in new.collect()) == ["", "Best", "New", "Only", "Zero"]
    chosen = frontier.chosen_hits(new, ["q"])
    assert sorted((r["q"], r["source_id"], r["evidence_id"], r["alignment"], r["hits"]) for r in chosen.collect()) == [
        (1, "s1", "s1:new:http://x/2", 9, 1), (1, "s2", "s2:best:http://x/3", 9, 1), (2, "s1", "s1:untitled:http://x/5", 5, 1), (4, "s1", "s1:only:http://x/7", 7, 1),
    ]
    won = frontier.winner(chosen, ["q"])
    assert sorted((r["q"], r["evidence_id"], r["ambiguous"]) for r in won.collect()) == [(1, "s2:best:http://x/3", True), (4, "s1:only:http://x/7", False)]
    cases = spark.createDataFrame([(True, 0, None), (False, 1, 6), (False, 1, 5), (False, 0, 6), (False, 0, None)], "g boolean, n int, a int")
    assert [r[0] for r in cases.select(frontier.decision(F.col("g"), F.col("n"), F.col("a"))).collect()] == ["grounded_success", "grounded_success", "insufficient_evidence", "deepen", "insufficient_evidence"]


def test_merged_evidence(spark):
    schema = "q int, evidence_id string, route_role string, total_score double, tokens int"
    held = [(1, f"p{i}", "primary", 10.0 - i, 10) for i in range(5)] + [(2, "a", "primary", 1.0, 500)]
    added = [(1, "s1", "primary", 0.5, 10), (1, "p0", "primary", 99.0, 10)]
    got = frontier.merged(spark.createDataFrame(held, schema), spark.createDataFrame(added, schema), ["q"], k=4, budget=30)
    assert sorted((r["q"], r["evidence_id"], r["route_role"], r["place"]) for r in got.collect()) == [(1, "p0", "primary", 1), (1, "p1", "primary", 2), (1, "s1", "supplemental", 3), (2, "a", "primary", 1)]
