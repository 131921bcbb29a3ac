import random
import re

import pytest
from pyspark.sql import functions as F

from sievework.functions.text import normalize_query, tokens
from sievework.operators import alignment, classify
from sievework.sources.files import named_alias
from sievework.sources.investor_pages import investor_pages, on_allowed


def test_alignment_with_gloss(spark):
    """Base and twice the gloss's score on the industry route; elsewhere, and without enough English words, the base alone."""
    rows = [("动力电池 市场份额 预测", "industry"), ("动力电池 市场份额 预测", "policy"), ("动力电池", "industry"), ("ev battery market", "industry"), (None, "industry")]
    record = "ev battery market share forecast outlook 2030"
    x = spark.createDataFrame(rows, "query string, route string").withColumn("normal", normalize_query(F.coalesce("query", F.lit(""))))
    x = alignment.glossed(classify.traits(x))
    own = tokens(F.lit(record))
    got = x.select("gloss_normal", alignment.alignment(F.col("route"), tokens(F.col("normal")), own, F.lit(record)).alias("base"), alignment.alignment(F.col("route"), F.col("gloss_tokens"), own, F.lit(record), trait="gloss_").alias("gloss"), alignment.whole_alignment(F.col("route"), tokens(F.col("normal")), own, F.lit(record)).alias("whole")).collect()
    assert [r["gloss_normal"] is not None for r in got] == [True, True, False, False, False]
    assert got[0]["gloss"] >= 10 and got[0]["whole"] == got[0]["base"] + 2 * got[0]["gloss"]
    assert all(r["whole"] == r["base"] for r in got[1:]) and got[3]["base"] > 0


@pytest.mark.parametrize("most", [0, 100_000])
def test_aliases_against_all_pairs(spark, most):
    """In a broadcast and in an exchange."""
    r = random.Random(most)
    word = lambda: r.choice(["acme", "ac", "me.x", "group", "b2", "电池", "a+b", "global", "é", "èü", "++"])
    aliases = [(" ".join(word() for _ in range(r.randrange(1, 4))), f"c{r.randrange(9)}") for _ in range(80)] + [(None, "c1"), ("acme", None), ("++", "c2"), ("", "c3")]
    queries = [(i, r.choice([" ", "", "-"]).join(word() for _ in range(r.randrange(9)))) for i in range(60)] + [(99, None)]
    got = named_alias(spark.createDataFrame(queries, "q int, normal string"), spark.createDataFrame(aliases * 2, "alias string, cik string"), "q", "cik", most=most)
    want = {}
    for q, text in queries:
        hits = [(len(a), c, a) for a, c in aliases if a and c and re.search("[a-z0-9]|[一-鿿]", a) and text and re.search(rf"(?<![a-z0-9]){re.escape(a)}(?![a-z0-9])", text)]
        if hits:
            want[q] = max(hits)[1:]
    assert {r["q"]: (r["cik"], r["alias"]) for r in got.collect()} == want and want


def test_allowed_hosts(spark):
    rows = [("ir.acme.com", True), ("acme.com", True), ("www.acme.com", True), ("notacme.com", False), ("acme.com.evil.net", False), ("x.org", True), ("", False)]
    df = spark.createDataFrame([(h, ["www.acme.com", "X.org"]) for h, _ in rows], "h string, allowed array<string>")
    assert [r[0] for r in df.select(on_allowed(F.col("h"), F.col("allowed"))).collect()] == [x for _, x in rows]


def test_investor_pages(spark):
    home = '<body><a href="/ir/results">Segment revenue results</a><a href="/ir/results">again segment</a><a href="https://other.com/segment">segment revenue</a><a href="/about">revenue</a><a href="/ir/team">Team</a><a href="/ir/segment-note">Segment note</a><a href="https://acme.com/">revenue results segment</a></body>'
    pages = [("https://acme.com/", home), ("https://acme.com/ir/results", "<title>Results</title><body><p>Nothing here.</p><p>Segment revenue rose 12% in 2024.</p></body>"), ("https://empty.com/", None)]
    asked = [(1, "segment revenue 2024", "https://acme.com/", ["acme.com"], ["/ir"]), (2, "segment note", "https://acme.com/", ["www.acme.com"], []), (3, "tea", "https://acme.com/", ["acme.com"], []), (4, "segment", "https://empty.com/", ["empty.com"], []), (5, "segment", "https://gone.com/", ["gone.com"], [])]
    x = investor_pages(spark.createDataFrame(asked, "qid int, query string, homepage_url string, allowed array<string>, markers array<string>"), spark.createDataFrame(pages, "url string, html string"))
    got = {r["qid"]: (r["title"], r["url"], r["snippet"]) for r in x.collect()}
    assert got == {
        1: ("Segment revenue results", "https://acme.com/ir/results", "Results Nothing here. Segment revenue rose 12% in 2024."),
        2: ("Segment note", "https://acme.com/ir/segment-note", "Segment note"),
    }
