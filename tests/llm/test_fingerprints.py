import hashlib

import pytest
from sievework.llm import fingerprints, queries


def jaccard(a, b):
    def sets(t):
        w = t.lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def edited(rows):
    """(doc_id, text, next text, edited text) by descending doc_id, then text; null ids last."""
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]), reverse=True)
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        m = len(t) // 2
        yield d, t, following, t[: len(t) - m] + following[:m]


def check(got, rows, tolerance):
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), jaccard(t, e), jaccard(t, n)) for d, t, n, e in edited(rows)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    got = sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["near_edited"], r["near_next"]) for r in got), key=key)
    want.sort(key=key)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    error = [abs(g - w) for x, y in zip(got, want, strict=True) for g, w in zip(x[3:], y[3:], strict=True)]
    assert max(error) < tolerance
    assert sum(error) / len(error) < 0.03


@pytest.mark.parametrize("partitions", ["1", "4"])
def test_odd_rows(spark, partitions):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long), (5, long), (5, "é漢🙂 b c d e f g"), (None, "null id"), (None, None), (9, None), (9, ""), (3, " \n "), (2, "one two"), (1, long + " x"), (7, "a " * 30000)]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, fingerprint string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = fingerprints.edited_fingerprints(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check(got, rows, 0.15)
    prints = {r["fingerprint"] for r in got if r["doc_id"] == 5}
    assert len(prints) == 2
    assert {len(p) for p in prints} == {512}
    assert {r["fingerprint"] for r in got if not r["n_chars"]} == {""}
    assert fingerprints.edited_fingerprints(df.limit(0)).count() == 0
    one = fingerprints.edited_fingerprints(df.where("doc_id = 2")).collect()
    assert [r["near_next"] for r in one] == [1.0]


def test_whole_table(spark, sf_dir_2):
    docs = spark.read.parquet(f"{sf_dir_2}/documents.parquet")
    check(queries.op2_one_permutation_fingerprints(spark, sf_dir_2).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], 0.15)


def test_runs_no_python(spark, sf_dir):
    plan = queries.op2_one_permutation_fingerprints(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_estimates_similarity(spark):
    words = [f"w{i}" for i in range(1000)]
    rows = [(n, " ".join(words[:n])) for n in (6, 20, 60, 200, 1000)]
    df = fingerprints._bins(spark.createDataFrame(rows, "n int, text string"), "text", "b")
    pairs = df.crossJoin(df.select(df.n.alias("m"), df.b.alias("c"))).select("n", "m", fingerprints.likeness(df.b, df["b"]).alias("self"), fingerprints.likeness(fingerprints.F.col("b"), fingerprints.F.col("c")).alias("x")).collect()
    for r in pairs:
        assert r["self"] == 1.0
        assert abs(r["x"] - (min(r["n"], r["m"]) - 4) / (max(r["n"], r["m"]) - 4)) < 0.12
