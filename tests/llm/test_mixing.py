import sys
from pathlib import Path

from pyspark.sql import functions as F
from sievework.llm import mixing, queries

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import agree

SCHEMA = "doc_id long, text string, lang string, source string, domain string"


def test_sql(spark, sf_dir_2):
    rows = agree(queries.op3_hierarchical_mixing(spark, sf_dir_2), queries.OP3_SQL, sf_dir_2)
    assert len(rows) > 500


def divide(children, target):
    """Water filling by hand: {name: (weight, cap)}."""
    given, left = {}, dict(children)
    while left:
        w = sum(x[0] for x in left.values())
        full = [n for n, (a, cap) in left.items() if cap * w <= a * target]
        if not full:
            return given | {n: a * target // w for n, (a, _) in left.items()}
        n = min(full, key=lambda n: (left[n][1] / left[n][0], n))
        given[n] = left[n][1]
        target -= left.pop(n)[1]
    return given


def test_shortage_goes_to_siblings_first(spark):
    docs = [(i, "w " * 10, "en", "a", "x") for i in range(10)]  # 100 tokens
    docs += [(100 + i, "w " * 10, "en", "b", "x") for i in range(100)]  # 1000
    docs += [(300 + i, "w " * 10, "fr", "c", "x") for i in range(100)]  # 1000
    docs += [(500 + i, "w " * 10, "en", "d", "y") for i in range(1)]  # 10
    df = spark.createDataFrame([(*d[:4], d[4]) for d in docs], SCHEMA)
    got = {(r["domain"], r["lang"], r["source"]): r["n"] for r in mixing.mix(df, F.col("domain"), {}, 0.5, 1).groupBy("domain", "lang", "source").agg(F.sum("taken").alias("n")).collect()}
    total = 2110 // 2
    top = divide({"x": (1, 2100), "y": (1, 10)}, total)
    langs = divide({"en": (1, 1100), "fr": (1, 1000)}, top["x"])
    sources = divide({"a": (1, 100), "b": (1, 1000)}, langs["en"])
    assert got == {("x", "en", "a"): sources["a"], ("x", "en", "b"): sources["b"], ("x", "fr", "c"): langs["fr"], ("y", "en", "d"): 10}
    assert sources["a"] == 100


def test_epochs_and_odd_rows(spark):
    docs = [(1, "a b c", "en", None, None), (1, "a b c", "en", None, None), (None, "x y", "en", None, None), (3, None, "en", None, None), (4, "", "de", "s", "q")]
    df = spark.createDataFrame(docs, SCHEMA)
    got = mixing.mix(df, F.col("domain"), {}, 2.0, 3).collect()
    assert sum(r["taken"] for r in got) == 16
    assert {r["epoch"] for r in got} == {0, 1}
    assert mixing.mix(df.limit(0), F.col("domain"), {}, 1.0).count() == 0
    assert mixing.select_documents(df.limit(0), F.col("domain"), {}, 1.0).count() == 0
    assert sorted(r["doc_id"] or 0 for r in mixing.select_documents(df, F.col("domain"), {}, 1.0).collect()) == [0, 1, 1, 3]


def test_equal_rows_fill_the_budget_and_no_more(spark):
    """A prefix that ends among rows without ids, or among copies, takes as many as the budget holds."""
    docs = [(None, "w " * 10, "en", "a", "x")] * 20 + [(None, "w " * 7, "en", "a", "x")] * 20 + [(5, "w " * 6, "fr", "b", "x")] * 30
    df = spark.createDataFrame(docs, SCHEMA)
    for budget, epochs in ((0.31, 1), (0.87, 1), (1.6, 3)):
        got = mixing.mix(df, F.col("domain"), {}, budget, epochs).collect()
        plan = mixing.leaf_plan(mixing.leaf_rows(df, F.col("domain")), {}, budget, epochs, 7).collect()
        for leaf in plan:
            assert sum(r["taken"] for r in got if r["lang"] == leaf["lang"]) == leaf["given"]
        assert int(520 * budget) - 1 <= sum(leaf["given"] for leaf in plan) <= int(520 * budget)
        assert all(0 < r["taken"] <= r["n_tokens"] for r in got)
    got = mixing.mix(df, F.col("domain"), {}, 0.31, 1)
    assert mixing.select_documents(df, F.col("domain"), {}, 0.31).count() == got.count()


def test_selected_documents_are_those_of_one_epoch(spark, sf_dir_2):
    docs = spark.read.parquet(f"{sf_dir_2}/documents.parquet")
    args = (F.expr(queries.DOMAIN_SQL), queries.MIX_WEIGHTS, 0.6)
    want = sorted(r["doc_id"] for r in mixing.mix(docs, *args, max_epochs=1).collect())
    out = mixing.select_documents(docs, *args)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == want
    assert 0 < len(want) < docs.count()


def test_runs_no_python(spark, sf_dir):
    plan = queries.op3_hierarchical_mixing(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
