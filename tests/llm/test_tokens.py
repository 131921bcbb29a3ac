import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sievework.llm import packing, queries, token_counts, token_output, tokens
from tokenizers import Tokenizer, models, pre_tokenizers

SCHEMA = "doc_id long, text string, sequence_id string"
ODD = ["", None, "a", "  x  ", "\n\n\t", "é漢字🙂" * 50, "<|endoftext|> b", "don't 'tis we'll", "x" * 5000, " ".join(map(str, range(4000)))]


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(tokens.default_vocabulary())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_the_tokenizers(text):
    assert tokens.encoder(tokens.default_vocabulary()).ids(text).tolist() == Tokenizer.from_file(tokens.default_vocabulary()).encode(text, add_special_tokens=False).ids


def ids_of(exact, text):
    return np.array([*exact.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)


def check_pieces(rows, texts, exact, size):
    """Every id in one piece, pieces in order in their sequences, little padding."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for d, text in texts.items():
        ids, at = ids_of(exact, text), 0
        for r in sorted(by_doc[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].astype("<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    used = []
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
        used.append(at)
    return used


def test_packs_every_id_once(spark, exact):
    texts = dict(enumerate(ODD))
    rows = packing.pack(spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA).coalesce(1)).collect()
    used = check_pieces(rows, texts, exact, 1024)
    assert sum(u < 1024 for u in used) <= 1
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["doc_tokens"]) for r in twice) == [(0, 3), (0, 3), (1, 1)]


def test_packs_the_table(spark, sf_dir, exact):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = queries.op5_sum_of_squares_packing(spark, sf_dir).collect()
    used = check_pieces(rows, {r["doc_id"]: r["text"] for r in docs.collect()}, exact, 1024)
    assert sum(used) / (1024 * len(used)) > 0.99


@pytest.mark.parametrize("most_open", [4, 1000])
def test_sum_of_squares(most_open):
    r = random.Random(5)
    done = []
    p = packing.SumOfSquares(16, done.append, most_open)
    docs = [np.arange(r.choice([3, 5, 7, 11, 20, 40, 16])) + 100 * i for i in range(300)]
    for i, d in enumerate(docs):
        before, n = p.count.copy(), len(d) % 16
        if n:  # the chosen level is the best of all
            h = p.level_for(n)

            def cost(h, n=n, before=before):
                c = before.copy()
                c[h] -= h > 0
                c[h + n] += h + n < 16
                return int((c[1:] ** 2).sum())

            assert cost(h) == min(cost(k) for k in range(16 - n + 1) if not k or before[k])
        p.add(i, d)
        assert p.open == sum(map(len, p.windows)) == p.count.sum()
        assert p.open <= most_open
    p.close()
    sizes = [sum(len(x[2]) for x in w) for w in done]
    assert sum(s < 16 for s in sizes) <= 1
    back = {}
    for w in done:
        for doc, start, ids, _ in w:
            back.setdefault(doc, []).append((start, ids))
    for i, d in enumerate(docs):
        assert np.array_equal(np.concatenate([x for _, x in sorted(back[i], key=lambda x: x[0])]), d)


def test_few_pieces_are_refilled():
    """Of many documents of one task; what is open at the end does not grow with them."""
    share = []
    for n in (4_000, 40_000):
        r, done = random.Random(6), []
        p = packing.SumOfSquares(1024, done.append)
        for i in range(n):
            p.add(i, np.zeros(int(r.lognormvariate(6, 1)) + 1, np.uint32))
            assert p.open < packing.OPEN
        p.close()
        how = [x[3] for w in done for x in w if x[3] != "whole"]
        share.append(how.count("refill") / len(how))
    assert share[1] < 0.1
    assert share[1] < share[0] / 2


def test_the_matrix_query(spark, sf_dir, exact):
    """Every id of the whole table from its rows' checksums, places and resets."""
    texts = {r["doc_id"]: ids_of(exact, r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = {}
    for r in queries.op4_packed_matrices(spark, sf_dir).collect():
        ends = r["cu_seqlens"]
        assert (ends[0], ends[-1], len(ends) - 1) == (0, r["n_ids"], r["n_segments"])
        assert r["n_ids"] <= 2048
        assert r["resets"] == ends[:-1]
        held = [texts[d][s : s + b - a] for d, s, a, b in zip(r["doc_ids"], r["starts"], ends, ends[1:], strict=False)]
        assert [len(h) for h in held] == [b - a for a, b in zip(ends, ends[1:], strict=False)]
        assert r["ids_crc32"] == zlib.crc32(np.concatenate(held).astype("<u4").tobytes())
        for d, s, h in zip(r["doc_ids"], r["starts"], held, strict=True):
            pieces.setdefault(d, []).append((s, len(h)))
    assert set(pieces) == set(texts)
    for d, own in pieces.items():
        at = 0
        for s, n in sorted(own):
            assert s == at
            at += n
        assert at == len(texts[d])


def test_best_fit_decreasing():
    r = random.Random(2)
    lengths = [r.randint(1, 50) for _ in range(400)]
    rows = token_output.best_fit_decreasing(lengths, 50)
    assert sorted(i for row in rows for i in row) == [*range(400)]
    assert all(sum(lengths[i] for i in row) <= 50 for row in rows)
    want: list[int] = []  # the same rule by looking at every row
    for n in sorted(lengths, reverse=True):
        fit = [k for k, used in enumerate(want) if 50 - used >= n]
        if fit:
            want[max(fit, key=lambda k: want[k])] += n
        else:
            want.append(n)
    assert sorted(want) == sorted(sum(lengths[i] for i in row) for row in rows)


def test_matrices_round_trip(spark, exact, tmp_path):
    texts = dict(enumerate(ODD))
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], SCHEMA)
    token_output.write_matrices(df, str(tmp_path / "m"), size=64)
    rebuilt = {}
    for x in spark.read.parquet(str(tmp_path / "m")).collect():
        ids = token_output.matrix(x)
        for r, (ends, docs, starts) in enumerate(zip(x["cu_seqlens"], x["doc_ids"], x["starts"], strict=True)):
            assert ends[-1] <= 64
            p = token_output.positions(ends, 64)
            for k, d in enumerate(docs):
                part = ids[r, ends[k] : ends[k + 1]]
                assert p[ends[k] : ends[k + 1]].tolist() == [*range(len(part))]
                rebuilt.setdefault(d, []).append((starts[k], part))
    for d, text in texts.items():
        assert np.array_equal(np.concatenate([p for _, p in sorted(rebuilt[d], key=lambda x: x[0])]), ids_of(exact, text))
    rows = token_output.read_rows(spark, str(tmp_path / "m")).collect()
    assert sum(r["n_ids"] for r in rows) == sum(len(ids_of(exact, t)) for t in texts.values())
    assert token_output.write_and_read(df.limit(0)).count() == 0


def unigram():
    pieces = token_counts.scored_pieces(token_counts.default_vocabulary())
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return t


UNIGRAM = unigram()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" abcdefst\n▁é漢<>0x"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_counts_are_the_unigram_tokenizers(text):
    assert token_counts.counter(token_counts.default_vocabulary()).count(text) == len(UNIGRAM.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_chars"], r["n_tokens"]) for r in queries.op7_unigram_token_counts(spark, sf_dir).collect()}
    assert got == {d["doc_id"]: (len(d["text"]), len(UNIGRAM.encode(d["text"], add_special_tokens=False).ids)) for d in docs}
    odd = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 0), (2, "x" * 100000, 0)], "doc_id long, text string, n_tokens int")
    assert token_counts.token_counts(odd.limit(0)).count() == 0
    assert sorted((r["doc_id"] or 0, r["n_tokens"] > 0) for r in token_counts.token_counts(odd).collect()) == [(0, False), (1, False), (1, False), (2, True)]
