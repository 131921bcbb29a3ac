import re
from itertools import groupby

import pytest

from sievework import queries as Q


def words(text):
    return {*re.findall("[a-z0-9]+", text.lower())}


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return [[r.asDict() for r in spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()] for n in ("benchmark", "documents")]


def slices(text):
    return re.findall(r"(?as).{1,200}(?!\S)|\S+", text)


def test_slices_hold_whole_texts(spark, sf_dir, tables):
    _, e = Q._evidence(spark, sf_dir)
    got = {r["evidence_id"]: [s["text"] for s in r["slices"]] for r in e.collect()}
    for d in tables[1]:
        assert [w for s in got[d["doc_id"]] for w in s.split()] == d["text"].split()
        assert got[d["doc_id"]] == slices(d["text"])


def test_matches_against_all_pairs(spark, sf_dir, tables):
    items, docs = tables
    cut = {d["doc_id"]: [(words(s), 1.5 if not i else 0.5, -len(re.findall(r"(?a)\S+", s)), f"{d['doc_id']}:{i:07}", s) for i, s in enumerate(slices(d["text"]))] for d in docs}
    want = []
    for b in items:
        terms, rows = words(b["text"]), []
        for d in docs:
            if cut[d["doc_id"]]:
                hits, *_, name, text = max((len(terms & w), score, brevity, name, text) for w, score, brevity, name, text in cut[d["doc_id"]])
                if hits or d["n_chars"] % 3:
                    rows.append((("academic" if d["doc_id"] % 2 else "policy"), ("primary" if d["doc_id"] % 3 else "supplemental"), -hits, -(d["n_chars"] % 3), -(d["n_chars"] % 13), d["doc_id"], name, text))
        for key, group in groupby(sorted(rows), key=lambda r: r[:2]):
            want += [(b["item_id"], *key, r[5], -r[2], r[6], r[7], i) for i, r in enumerate([*group][:2], 1)]
    got = sorted(tuple(r) for r in Q.route_slice_matches(spark, sf_dir).select("qid", "domain", "route_role", "evidence_id", "overlap", "source_record_id", "text", "rank").collect())
    assert got == sorted(want)
    assert any(e % 50 != q % 50 for q, _, _, e, *_ in got) and any(int(r[5].split(":")[1]) > 2 for r in got)


def test_gate_and_lookup_against_all_pairs(spark, sf_dir, tables):
    items, docs = tables
    corpus = {w for d in docs for w in words(d["text"])}
    sets = [words(s) for d in docs for s in slices(d["text"])]
    need = lambda t: min(2, len(t))
    want = {b["item_id"]: (max(len(t & s) for s in sets) if b["item_id"] % 2 == 0 else len(t & corpus)) >= need(t) for b in items for t in [words(b["text"])]}
    assert {r["qid"]: r["relevant"] for r in Q.relevance_gate(spark, sf_dir).collect()} == want
    policy = [d for d in docs if d["doc_id"] % 2 == 0 and d["text"]]
    key = lambda d, q: (d["doc_id"] % 5 == 0, d["doc_id"] % 7 < 3 if q % 3 == 0 else True, d["n_chars"] % 3, f"2024-01-0{d['doc_id'] % 7 + 1}" if d["doc_id"] % 7 < 3 else "", d["doc_id"])
    best = {b["item_id"]: max(key(d, b["item_id"]) for d in policy) for b in items}
    got = {r["qid"]: r["evidence_id"] for r in Q.best_policy_lookup(spark, sf_dir).collect()}
    assert got == {q: k[-1] for q, k in best.items() if k[0] and k[1]} and got
