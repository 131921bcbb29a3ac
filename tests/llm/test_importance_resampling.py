import hashlib
import math
import random
import re
import sys
import zlib
from pathlib import Path

import pytest
from sievework.llm import importance_resampling as ir
from sievework.llm import queries

sys.path.insert(0, str(Path(__file__).parent))
from llm_oracle import agree

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_sql(spark, sf_dir_2):
    assert len(agree(queries.op12_importance_resampling(spark, sf_dir_2), queries.OP12_SQL, sf_dir_2)) == 1000


def features(text):
    words = WORD.findall(bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def texts(seed):
    r = random.Random(seed)
    words = ["a", "bb", "Straße", "ÉTÉ", "x9", "日本", "q-q", " ", "\n", "z" * 40]
    return [None, "", " .,\x00", "One", "a b", "n" * 80_000 + " t u v", "A" * 70_000] + [" ".join(r.choice(words) for _ in range(r.randrange(60))) for _ in range(60)]


@pytest.mark.parametrize("block", [1, 7, 64, 5000, 1 << 20])
def test_tries_against_hashing_each_run(block):
    """Whatever the block, also when texts are cut into pieces."""
    every = texts(block)
    got = [[] for _ in every]
    for owner, trie in ir.tries([memoryview((t or "").encode()) for t in every], 3, block):
        for place, node, state in trie.levels:
            for o, c in zip(owner[place], state[node], strict=True):
                got[o].append(int(c))
    assert [sorted(g) for g in got] == [sorted(features(t)[1]) for t in every]


def resampled(rows, target, per_hundred, least):
    corpus, goal = [0] * ir.N_BUCKETS, [0] * ir.N_BUCKETS
    for counts, side in ((corpus, [t for _, t in rows]), (goal, target)):
        for t in side:
            for c in features(t)[1]:
                counts[c % ir.N_BUCKETS] += 1
    s_all, t_all = sum(corpus), sum(goal)
    gain = [math.floor(1000 * math.log((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) for s, t in zip(corpus, goal, strict=True)]
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        weight = sum(gain[c % ir.N_BUCKETS] for c in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    order = sorted((x for x in out if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    return [x[:4] for x in order], len(order) * per_hundred // 100, [x[:4] for x in out if not x[4]]


def test_against_brute_force_with_odd_rows(spark):
    """Nulls in both columns, ties, many equal rows, empty and very long texts, and columns that are named like outputs."""
    rows = list(enumerate(texts(3))) + [(None, t) for t in texts(4)[7:20]] + [(500, "k l m " * 9)] * 40
    target = [None, "", *texts(5)[7:15]]
    docs = spark.createDataFrame([(d, t, 0, 0) for d, t in rows], "doc_id long, text string, rank int, score int").repartition(5)
    order, n, rest = resampled(rows, target, 40, 5)
    got = ir.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), 40, 5).collect()
    ranked = sorted((x for x in got if x["rank"] is not None), key=lambda x: x["rank"])
    assert [x["rank"] for x in ranked] == list(range(1, n + 1))
    assert [tuple(x)[:4] for x in ranked] == order[:n]
    key = lambda x: tuple(map(str, x))
    assert sorted((tuple(x)[:4] for x in got if x["rank"] is None), key=key) == sorted(order[n:] + rest, key=key)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ir.resample(none, none).count() == 0
    some = spark.createDataFrame([(1, "w " * 30)], "doc_id long, text string")
    assert [x["rank"] for x in ir.resample(some, none, 100).collect()] == [1]
