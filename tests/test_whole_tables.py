import re
from collections import Counter
from difflib import SequenceMatcher

from sievework import queries as Q


def similar_groups(rows):
    """The reference's rule on (pos, host, title, text), each record against all heads of its host."""
    normal = lambda t: re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()
    ratio = lambda a, b: SequenceMatcher(a=a, b=b).ratio()
    heads, out = {}, {}
    for pos, host, title, text in sorted(rows):
        t, s = normal(title), normal(text)
        for at, t2, s2 in heads.setdefault(host, []):
            if ratio(t, t2) >= 0.88 and ratio(s, s2) >= 0.72:
                out[pos] = at
                break
        else:
            heads[host].append((pos, t, s))
            out[pos] = pos
    return out


def policy_groups(rows):
    """The reference's rule on (pos, authority, title, (version, dates)), each record against all heads of its block."""
    heads, out = {}, {}
    for pos, authority, title, dates in sorted(rows, key=lambda r: r[0]):
        title = re.sub("[^a-z0-9\u4e00-\u9fff]+", " ", re.sub(r"(?i)\bmirror\b", "", title).lower()).strip()
        for at, own in heads.setdefault((authority.strip().lower(), title), []):
            if any(a and a == b for a, b in zip(dates, own, strict=True)):
                out[pos] = at
                break
        else:
            heads[authority.strip().lower(), title].append((pos, dates))
            out[pos] = pos
    return out


def planted(spark, tmp_path):
    """Near titles that differ at their start, equal first lines over different texts, texts that part after 120 characters."""
    long, other = "the council of the town met on monday to vote on a new plan for roads", "prices of wheat fell in every market while rain kept farmers at home"
    texts = [f"{long}\n{long} and rail", f"a {long}\n{long} and rail", f"{long}\n{other} {other}", f"{long}\n{long} and rails", f"{other}\n{long} {other}", f"x{other}\n{long} {other}"]
    texts += [f"{long} {long} {tail}" for tail in (other * 6, "zq 0123 " * 60, other * 6 + " once")]
    rows = [(i * 3 + k, t, "en", "s", len(t)) for k in range(3) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_similarity_collapse_against_all_pairs(spark, sf_dir, tmp_path):
    for folder in (sf_dir, planted(spark, tmp_path)):
        docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
        want = similar_groups((d["doc_id"], d["source"], d["text"].split("\n")[0], d["text"]) for d in docs)
        assert {r["doc_id"]: r["group_id"] for r in Q.similarity_collapse(spark, folder).collect()} == want
        assert len({*want.values()}) < len(want)


def test_every_document_is_evidence_and_cited(spark, sf_dir):
    x = Q._checked(spark, sf_dir).collect()
    texts = {f"d{r['doc_id']}": r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["point_id"].split(":")[1] for r in x} >= {k[1:] for k in texts}
    held = [r for r in x if r["evidence_id"] in texts and r["quote_text"].strip() and r["issue"] is None]
    assert any(int(r["evidence_id"][1:]) >= 100 for r in held)
    assert any(texts[r["evidence_id"]].find(r["quote_text"]) > 1000 for r in held)
    assert {r["issue"] for r in x} == {None, "missing evidence_id", "missing source_record_id", "quote_text mismatch"}


def test_canonical_records_against_all_pairs(spark, sf_dir, tmp_path):
    for folder in (sf_dir, planted(spark, tmp_path)):
        docs = sorted((d["doc_id"], d["source"], d["text"], d["lang"]) for d in spark.read.parquet(f"{folder}/documents.parquet").collect())
        policy = {n for n, *_ in docs if n % 3 == 0 or n % 2 == 0 or n % 7 == 0}
        industry = {n for n, *_ in docs if n % 3 == 2 and n not in policy and n % 9 and n % 6}
        title = lambda text: text.split("\n")[0]
        dates = lambda n, source: (source if n % 4 == 0 else "", "2024-01-01" if n % 2 == 0 else "", "2024-02-01" if n % 7 == 0 else "")
        want = similar_groups((n, source, title(text), text) for n, source, text, _ in docs if n in industry)
        got = {r["canonical_url"]: r["records"] for r in Q.canonical_records(spark, folder).where("domain = 'industry'").collect()}
        url = {n: f"https://{source}.gov/{n}" for n, source, *_ in docs}
        assert got == Counter(url[g] for g in want.values())
        versions = policy_groups((n, lang, title(text), dates(n, source)) for n, source, text, lang in docs if n in policy and any(dates(n, source)[1:]))
        records = [r["records"] for r in Q.canonical_records(spark, folder).where("domain = 'policy'").collect()]
        assert sorted(records) == sorted(Counter(versions.values()).values())
        raw = {r["pos"]: (r["snippet"], r["token_estimate"]) for r in Q._records(spark, folder).select("pos", "snippet", "token_estimate").collect()}
        assert raw == {n: (text, len(text.split())) for n, _, text, _ in docs}


def test_frontier_holds_all_documents_against_all_labelled_ones(spark, sf_dir):
    docs = {r["doc_id"]: r["text"].strip(" ").lower() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = {docs[r["doc_id"]] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r["doc_id"] in docs}
    got = {r["doc_id"] for r in Q.frontier_anti_dedupe(spark, sf_dir).collect()}
    assert got == {n for n, text in docs.items() if text not in held}
    assert {n % 6 for n in got} == {*range(6)}


def test_policy_groups_against_replay(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    want = policy_groups((o["o_orderkey"], f"c{o['o_custkey']}", o["o_orderpriority"], (o["o_orderstatus"], f"{o['o_orderdate']:%Y-%m}")) for o in orders)
    assert {r["pos"]: r["group_pos"] for r in Q.policy_group_members(spark, sf_dir).collect()} == want
    first = {}
    for o in sorted(orders, key=lambda o: o["o_orderkey"]):
        first.setdefault((o["o_custkey"], o["o_orderpriority"]), o["o_orderkey"])
    assert any(want[o["o_orderkey"]] not in (o["o_orderkey"], first[o["o_custkey"], o["o_orderpriority"]]) for o in orders)
