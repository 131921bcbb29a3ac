import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from sievework.llm import queries, repeats
from sievework.llm.repeats import PASSAGES, Rule


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


def brute_words(texts, length, across=True):
    """What is left of each text, and the stretches taken out."""
    places, owners = [], defaultdict(set)
    times = Counter()
    for i, t in enumerate(texts):
        data, words, at = (t or "").encode(), [], 0
        for w in data.split():  # of bytes: at white space in ASCII
            at = data.index(w, at)
            words.append((w, at, at + len(w)))
            at += len(w)
        places.append((data, words))
        for j in range(len(words) - length + 1):
            key = tuple(w for w, _, _ in words[j : j + length])
            owners[key].add(i)
            times[key] += 1
    out = []
    for data, words in places:
        gone = bytearray(len(data))
        for j in range(len(words) - length + 1):
            key = tuple(w for w, _, _ in words[j : j + length])
            if len(owners[key]) > 1 or (times[key] > 1 and not across):
                a, b = words[j][1], words[j + length - 1][2]
                gone[a:b] = b"\1" * (b - a)
        out.append((bytes(c for c, g in zip(data, gone, strict=True) if not g), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sum(gone)))
    return out


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")


def got(spark, texts, rule, **options):
    rows = {r["doc_id"]: r for r in repeats.strip_repeats(table(spark, texts), rule, **options).collect()}
    return [(rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) for i in range(len(texts))]


def planted(seed, n, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdé", k=r.randint(1, 6)))
    prose = lambda size: " ".join(word() for _ in range(size))
    passages = [prose(r.randint(length // 6, length // 2)) for _ in range(6)]
    texts = [None, "", "abc", "x" * (3 * length), "xy" * length, "a b " * (2 * length)]
    for _ in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(prose(r.randint(1, 60)))
            if r.random() < 0.6:
                p = r.choice(passages)
                a = r.randint(0, len(p) // 3)
                parts.append(p[a : len(p) - r.randint(0, len(p) // 3)])
        texts.append(" ".join(parts))
    own = prose(length)
    return [*texts, *texts[:8], *texts[20:23], f"{own} {prose(3)} {own} {prose(3)} {own[2:]}", " \n".join(texts[21].split(" "))]


@pytest.mark.parametrize(("seed", "length", "gram", "hot"), [(1, 60, 8, 256), (2, 60, 16, 3), (3, 100, 32, 1)])
def test_bytes_against_brute_force(spark, seed, length, gram, hot):
    texts = planted(seed, 60, length)
    assert got(spark, texts, Rule(length, gram), hot=hot) == brute(texts, length)


@pytest.mark.parametrize(("seed", "length", "gram", "across", "hot"), [(4, 12, 2, True, 256), (5, 12, 4, False, 256), (6, 40, 4, True, 2), (7, 40, 8, False, 1), (8, 36, 4, True, 0)])
def test_words_against_brute_force(spark, seed, length, gram, across, hot):
    texts = planted(seed, 60, 3 * length)
    rows = {r["doc_id"]: r for r in repeats.strip_repeats(table(spark, texts), Rule(length, gram, True, across), with_kept=True, hot=hot).collect()}
    want = brute_words(texts, length, across)
    assert [(rows[i]["kept"].encode(), rows[i]["n_spans"], rows[i]["n_removed"]) for i in range(len(texts))] == want
    assert sum(x[2] for x in want) > 0


def test_whole_table(spark, sf_dir):
    found = queries.op6_suffix_array_dedup(spark, sf_dir)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    rows = {r["doc_id"]: r for r in found.collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    want = brute([d["text"] for d in docs], 400)
    assert [tuple(rows[d["doc_id"]])[1:5] for d in docs] == want
    assert sum(x[1] for x in want) > 0
    passages = brute_words([d["text"] for d in docs], 51)
    assert [tuple(rows[d["doc_id"]])[5:] for d in docs] == [x[1:] for x in passages]


def test_passages_go_from_all_documents(spark, sf_dir_2):
    """Of the windows of 51 words that two documents or more hold, none is left; documents without one are as they were."""
    docs = spark.read.parquet(f"{sf_dir_2}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    after = {r["doc_id"]: r["text"] for r in repeats.remove_repeats(docs).collect()}

    def shared(texts):
        owners = defaultdict(set)
        for i, t in texts.items():
            w = (t or "").split()
            for j in range(len(w) - 50):
                owners[hash(tuple(w[j : j + 51]))].add(i)
        return set().union(*(v for v in owners.values() if len(v) > 1), set())

    touched = shared(before)
    assert len(touched) > 50
    assert {i for i in before if after[i] != before[i]} == touched
    # what is left beside a passage may form windows anew; none of them stood in the texts as they came
    assert len(shared(after)) < len(touched) / 20


@pytest.mark.parametrize(("length", "gram", "words"), [(60, 8, False), (12, 4, True)])
def test_groups(spark, length, gram, words):
    texts = planted(9, 30, 60)
    unit = [(t or "").encode().split() if words else [(t or "").encode()[i : i + 1] for i in range(len((t or "").encode()))] for t in texts]
    groups = defaultdict(list)
    for r in repeats.repeat_groups(table(spark, texts), Rule(length, gram, words)).collect():
        groups[r["group_id"]].append((r["doc_id"], r["start"], r["size"]))
    covered = [bytearray(len(u)) for u in unit]
    for places in groups.values():
        assert len(set(places)) == len(places) > 1
        assert len({tuple(unit[d][s : s + n]) for d, s, n in places}) == 1
        for d, s, n in places:
            assert n >= length
            covered[d][s : s + n] = b"\1" * n
    seen = Counter(tuple(u[i : i + length]) for u in unit for i in range(len(u) - length + 1))
    for u, c in zip(unit, covered, strict=True):
        want = bytearray(len(u))
        for i in range(len(u) - length + 1):
            if seen[tuple(u[i : i + length])] > 1:
                want[i : i + length] = b"\1" * length
        assert c == want


def test_maximal_repeats_of_an_anchor():
    """Against all strings around the anchor: each maximal one has all its occurrences."""
    r = random.Random(1)
    for _ in range(200):
        runs = list({("".join(r.choices("ab", k=r.randint(0, 5))), "A" + "".join(r.choices("ab", k=r.randint(0, 6)))) for _ in range(r.randint(2, 9))})
        runs.sort(key=lambda x: x[1])
        rights, lefts = [x[1].encode() for x in runs], [x[0].encode() for x in runs]
        length = r.randint(2, 6)
        tree = repeats.AnchorTree(rights, lefts, length)
        want = set()
        for a in range(6):
            for b in range(1, 8):
                if a + b < length:
                    continue
                groups = defaultdict(set)
                for i in range(len(runs)):
                    if len(lefts[i]) >= a and len(rights[i]) >= b:
                        groups[lefts[i][:a], rights[i][:b]].add(i)
                for held in groups.values():
                    left = {lefts[i][a : a + 1] for i in held}
                    right = {rights[i][b : b + 1] for i in held}
                    if len(held) > 1 and (len(left) > 1 or left == {b""}) and (len(right) > 1 or right == {b""}):
                        want.add((a, b, tuple(sorted(held))))
        found = [(a, b, tuple(held)) for a, b, held in tree.maximal_repeats()]
        assert len(found) == len(set(found))
        assert set(found) == want
        # what is taken out follows from the groups
        ranges = [set() for _ in runs]
        for a, b, held in found:
            for i in held:
                ranges[i] |= {*range(max(0, length - b), a + 1)}
        assert [{w for lo, hi in x for w in range(lo, hi + 1)} for x in tree.repeated([None] * len(runs))] == ranges


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, rid int, _text int, _spans0 int")
    assert repeats.strip_repeats(empty).count() == 0
    assert repeats.remove_repeats(empty).columns == empty.columns
    assert repeats.repeat_groups(empty).count() == 0
    long = "one two three four " * 20
    rows = [(None, long, 1, 2, 3), (None, long, 1, 2, 3), (5, None, 1, 2, 3), (5, "", 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, _text int, _spans0 int")
    out = repeats.strip_repeats(df, noted=PASSAGES)
    assert out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", "passage_bytes"]
    n = len(long.encode())
    assert sorted((r["n_bytes"], r["n_removed"], r["n_passages"], r["passage_bytes"]) for r in out.collect()) == [(0, 0, 0, 0)] * 2 + [(n, 0, 1, n - 1)] * 2
    left = repeats.remove_repeats(df)
    assert left.columns == df.columns
    assert sorted(map(str, (r["text"] for r in left.collect()))) == ["", " ", " ", "None"]


def test_long_texts_come_in_segments(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SEGMENT", 50)
    t = np.arange(208) % 26
    parts = [p for _, _, held in repeats._pieces([t], 20, 1 << 20) for p in held]
    assert (parts[0] == t[:69]).all()
    assert sum(len(p) - 19 for p in parts) == len(t) - 19


def test_a_long_text_at_the_real_segment(spark):
    r = random.Random(3)
    own = "".join(chr(r.randint(97, 122)) for _ in range(5_000_000))
    texts = [own, own[3_999_700:4_000_300], own[4_999_700:] + own[:300]]
    assert [x[1] for x in got(spark, texts, repeats.BYTES)] == [600, 600, 0]
    parts = " ".join(own[i : i + 5] for i in range(0, 3_000_000, 5))
    data = parts.encode()
    h, start, end = repeats.text_words(memoryview(data))
    assert len(h) == 600_000 and (end - start == 5).all()
    assert (h[:1000] == repeats.words_of(np.frombuffer(data[:5999], np.uint8))[0]).all()
    assert (h[-1000:] == repeats.words_of(np.frombuffer(data[-5999:], np.uint8))[0]).all()


def test_intervals():
    assert [*repeats.prefix_intervals([0, 2, 3, 0])] == [(3, 1, 2), (2, 0, 2), (0, 0, 3)]
