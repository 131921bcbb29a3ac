from collections import Counter

import numpy as np
import pytest
from sievework.llm import dart_minhash as dm

SCHEMA = "doc_id long, text string, keep string, digest int"


def bag(text):
    w = text.lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(x, y):
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute_classes(rows):
    bags = [bag(t or "") for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    size, sets = [sum(b.values()) for b in bags], [set(b) for b in bags]
    for i in range(len(rows)):
        for j in range(i):
            if not size[i] or not size[j] or min(size[i], size[j]) < 0.8 * max(size[i], size[j]) or sets[i].isdisjoint(sets[j]):
                continue
            if jaccard(bags[i], bags[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    return {rows[i][0]: min(ids[find(i)]) for i in range(len(rows))}


def test_estimates_weighted_similarity():
    rng = np.random.default_rng(1)
    for n, common in ((40, 30), (400, 300), (3, 1)):
        x = {i: float(rng.integers(1, 9)) for i in range(n)}
        y = {(i if i < common else i + 10**6): w * float(rng.choice([1.0, 2.0])) for i, w in x.items()}
        true = sum(min(x.get(i, 0), y.get(i, 0)) for i in {*x, *y}) / sum(max(x.get(i, 0), y.get(i, 0)) for i in {*x, *y})
        doc = np.repeat([0, 1], [len(x), len(y)])
        element = dm.mix(np.array([*x, *y], np.uint64) + np.uint64(77))
        s = dm.dart_signatures(doc, element, np.array([*x.values(), *y.values()]), 2, 4096)
        assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_edge_cases(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(5, body, "x", 1), (3, body.upper() + " ", None, 2), (9, body.replace("w30", "zz"), "y", 3), (9, body.replace("w30", "zz"), "y", 3), (1, None, None, None), (2, "", None, None), (4, "   ", None, None), (6, "one two", "a", 1), (7, "One  two", "a", 1), (8, "one three", "a", 1), (None, body, "n", 1), (11, "Ω " * 30000, "n", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["class_size"], r["keep"]) for r in dm.near_duplicates(df).collect())
    kept = [x for x in got if x[3]]
    assert [x[:3] for x in got] == [(0, 3, 5), (1, 1, 1), (2, 2, 1), (3, 3, 5), (4, 4, 1), (5, 3, 5), (6, 6, 2), (7, 6, 2), (8, 8, 1), (9, 3, 5), (9, 3, 5), (11, 11, 1)]
    assert [x[0] for x in kept] == [1, 2, 3, 4, 6, 8, 11]
    assert dm.near_duplicates(df.limit(0)).count() == 0
    assert dm.deduplicate(df.limit(0)).columns == df.columns


@pytest.mark.parametrize("dense", [12, 1])
def test_against_brute_force(spark, sf_dir_2, dense, monkeypatch):
    monkeypatch.setattr(dm, "CELL", 5 if dense == 1 else 2048)
    df = spark.read.parquet(f"{sf_dir_2}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(df, dense=dense).collect()}
    want = brute_classes(rows)
    assert got == want
    assert len({*want.values()}) < len(want)


def test_deduplicate_keeps_one_row_of_a_class(spark, sf_dir, tmp_path):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    df.union(df.limit(20)).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    out = dm.deduplicate(docs)
    classes = dm.near_duplicates(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(r["class_id"] for r in classes.where("keep").collect())


@pytest.mark.parametrize("n", [0, 1, 4])
def test_short_texts_have_one_shingle(n):
    doc, h = dm.shingles([" ".join("abcd"[:n]), "a b c d e f"])
    assert (doc == 0).sum() == min(n, 1)
    assert (doc == 1).sum() == 2
