import sys
from pathlib import Path

import numpy as np
import pytest
from sievework.llm import queries, topk_search

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import agree

SCHEMA = "vec_id long, embedding array<float>, rank int"


def test_sql(spark, sf_dir_2):
    assert len(agree(queries.op10_segment_topk(spark, sf_dir_2), queries.OP10_SQL, sf_dir_2)) == 50


@pytest.mark.parametrize("seed", [0, 1])
def test_against_brute_force_in_blocks(spark, seed, monkeypatch):
    monkeypatch.setattr(topk_search, "CELL", 60)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 3)
    r = np.random.default_rng(seed)
    x = (r.normal(size=(300, 24)) * r.choice([0.1, 3], size=(300, 1))).astype(np.float32)
    x[50:120] = x[50]  # ties
    df = spark.createDataFrame([(i, [float(v) for v in row], 0) for i, row in enumerate(x)], SCHEMA)
    got = sorted((q["query_id"], q["rank"], q["vec_id"], q["score"]) for q in topk_search.top_k(df, 30).collect())
    y = np.floor(x.astype(float) * 1024).astype(np.int64)
    want = []
    for q in range(0, 300, 30):
        s = y @ y[q]
        best = [i for i in sorted(range(300), key=lambda i: (-s[i], i)) if i != q][:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert got == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan], 1), (4, [inf], 1), (5, [], 1), (6, [-1.0], 1), (7, [2.0, 0.0, 5.0], 1), (7, [2.0, 0.0, 5.0], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk_search.top_k(df).collect())
    assert got == [(0, 1, 7, 2 * 1024**2), (0, 2, 7, 2 * 1024**2), (0, 3, 5, 0), (0, 4, 6, -(1024**2))]
    assert topk_search.top_k(df.limit(0)).count() == 0


def test_bounds_hold():
    r = np.random.default_rng(3)
    x, y = r.integers(-3000, 3000, (40, 37)), r.integers(-3000, 3000, (50, 37))
    exact, last = x @ y.T, None
    for s in (1, 4, 16):
        bound = topk_search.statistics(x, s) @ topk_search.statistics(y, s).T
        assert (bound >= exact - 1e-3).all()
        assert last is None or bound.sum() < last
        last = bound.sum()
