"""Each stage on its own input against brute force, over whole small tables."""

import sys
from pathlib import Path

import corpus_pipeline as cp
from sievework.llm import dart_minhash, mixing, quality, queries

sys.path.insert(0, str(Path(__file__).parent))
from test_dart_minhash import brute_classes
from test_repeats import brute_words
from test_tokens import check_pieces
from tokenizers import Tokenizer
from sievework.llm import tokens


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, inputs = docs.columns, [docs]
    for i, (_, stage) in enumerate(cp.STAGES):
        stage(spark, inputs[-1], sf_dir).write.parquet(str(tmp_path / str(i)))
        inputs.append(spark.read.parquet(str(tmp_path / str(i))))
    start, good, single, plain, mixed, packed = inputs
    assert all(x.columns == columns for x in inputs[:-1])
    bad = {r["doc_id"] for r in quality.classify(start, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 0").collect()}
    assert rows(good) == rows(start.where(~start.doc_id.isin(bad)))
    classes = brute_classes([(r["doc_id"], r["text"]) for r in good.collect()])
    assert rows(single) == rows(good.where(good.doc_id.isin({*classes.values()})))
    texts = single.collect()
    want = brute_words([r["text"] for r in texts], 51)
    got = {r["doc_id"]: r for r in plain.collect()}
    for r, (kept, _, n_removed) in zip(texts, want, strict=True):
        new = got[r["doc_id"]]
        assert new["text"].encode() == kept
        assert new["n_chars"] == len(new["text"])
        assert n_removed or new == r
    assert sum(x[2] for x in want) > 0
    taken = {r["doc_id"] for r in mixing.mix(plain, mixing.F.expr(queries.DOMAIN_SQL), queries.MIX_WEIGHTS, cp.BUDGET, 1).collect()}
    assert rows(mixed) == rows(plain.where(plain.doc_id.isin(taken)))
    check_pieces(packed.collect(), {r["doc_id"]: r["text"] for r in mixed.collect()}, Tokenizer.from_file(tokens.default_vocabulary()), 1024)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in cp.run(spark, sf_dir).select("doc_id").collect()}


def test_columns_and_odd_rows(spark, tmp_path, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept string, score int, domain string, digest string"
    odd = [(1, None, None, None, None, "k", 1, "d", "x"), (1, "", "en", "src0", 0, "k", 1, "d", "x"), (2, "word " * 40000, "en", "src1", 200000, None, None, None, None), (None, "This is some text.", "xx", "src2", 18, "k", 1, "d", "x"), (None, "This is some text.", "xx", "src2", 18, "k", 1, "d", "x")]
    for name, data in (("odd", odd), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        for i, (_, stage) in enumerate(cp.STAGES):
            out = stage(spark, docs, sf_dir)
            if i < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{name}{i}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{i}"))


def test_what_stages_make_of_odd_rows(spark, tmp_path, sf_dir):
    """Nulls, empty and very long texts, repeated rows, an empty table, and columns that are named like the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score int, class_id int, rid int, taken int"
    odd = [(1, None, None, None, None), (1, "", "en", "src0", 0), (2, "word " * 40000, "en", "src1", 200000), (None, "This is some text.", "xx", "src2", 18), (None, "This is some text.", "xx", "src2", 18), (3, "THIS is  some text.", "xx", "src2", 19)]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    spark.createDataFrame([(*r, 1, 2, 3, 4) for r in odd], schema).write.parquet(str(tmp_path / "odd"))
    docs = spark.read.parquet(str(tmp_path / "odd"))
    assert rows(quality.keep_good(docs, labels, least=0.0)) == rows(docs)
    assert quality.keep_good(docs, labels.limit(0), least=0.6).count() == 0
    assert rows(dart_minhash.deduplicate(docs)) == rows(docs.where("doc_id is not null"))
    some = mixing.select_documents(docs, mixing.F.expr(queries.DOMAIN_SQL), queries.MIX_WEIGHTS, 1.0)
    assert rows(some) == rows(docs.where("trim(text) <> ''"))
    none = docs.limit(0)
    none.write.parquet(str(tmp_path / "none"))
    none = spark.read.parquet(str(tmp_path / "none"))
    for out in (quality.keep_good(none, labels), dart_minhash.deduplicate(none), mixing.select_documents(none, mixing.F.expr(queries.DOMAIN_SQL), queries.MIX_WEIGHTS, 1.0)):
        assert out.columns == docs.columns and out.count() == 0
