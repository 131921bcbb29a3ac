import zlib

import numpy as np
import zstandard
from sievework.llm import quality, queries


def auc(y, s):
    y, s = np.array(y), np.array(s)
    good, bad = s[y == 1], s[y == 0]
    return np.mean([(g > bad).mean() + (g == bad).mean() / 2 for g in good])


def test_held_out_accuracy(spark, sf_dir_2):
    got = {r["doc_id"]: r for r in queries.op9_compression_quality(spark, sf_dir_2).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir_2}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf_dir_2}/documents.parquet").count()
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.5)
    test = [d for d in labels if got[d]["held_out"]]
    assert auc([labels[d] for d in test], [got[d]["score"] for d in test]) > 0.95
    assert np.mean([got[d]["predicted"] == labels[d] for d in test]) > 0.95


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", quality.F.when(quality.held_out(quality.F.col("doc_id")), 1 - quality.F.col("quality")).otherwise(quality.F.col("quality")))
    score = lambda lab: sorted((r["doc_id"], r["score"]) for r in quality.classify(docs, lab).collect())
    assert score(labels) == score(flipped)


def test_scores_are_those_of_whole_texts(spark, sf_dir):
    """Each text compressed chunk by chunk with either dictionary, by a compressor of its own."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    tools = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d)) for d in (model.good, model.bad)]
    for r in docs.collect():
        data = (r["text"] or "").encode()
        good, bad = (sum(len(t.compress(data[i : i + 512])) for i in range(0, len(data), 512)) for t in tools)
        difference, short = (bad - good) / max(1, bad + good), 1 / (1 + len(data) / 128)
        x = float(np.dot(model.weights, [1, 10 * difference, short, 10 * difference * short]))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-np.clip(x, -30, 30)))) < 1e-12


def test_labelled_texts_are_read_whole(spark):
    """What tells the classes apart stands at the end of long texts, in one chunk of many."""
    body = " ".join(f"w{i * 7919 % 1000}" for i in range(4000))
    tail = {1: "the end of a very good text " * 20, 0: "zq xj kv wq pz " * 40}
    rows = [(i, f"{body[i:]} {tail[i % 2]}", i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = quality.train(df.drop("quality"), df.drop("text"))
    assert b"very good" in model.good and b"zq xj" in model.bad


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 5.0), (1, "", 6.0), (None, "abc " * 50000, 7.0), (2, "x", None)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (7, 1), (0, 1)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 4
    assert all(0 < r["score"] < 1 for r in got)
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0
    kept = quality.keep_good(docs, labels, 0.0)
    assert kept.columns == docs.columns
    assert sorted(r["score"] or 0 for r in kept.collect()) == [0, 5, 6, 7]


def test_weights_stand_for_the_whole_class():
    rows = [([b"good words here " * 20], 1)] * 20 + [([b"bad ### signs $$$ " * 20], 0)] * 20
    even, many = quality.fit(rows), quality.fit(rows, {0: 20, 1: 2000})
    assert even.score(b"good words here ") > 0.5 > even.score(b"bad ### signs $$$ " * 9)
    assert many.score(b"") > even.score(b"")
