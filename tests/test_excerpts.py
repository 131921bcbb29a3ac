import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sievework import queries as Q
from sievework.operators import excerpts as E
from sievework.operators.paragraphs import excerpt_of, fact_density, paragraphs_of, query_overlap

WORDS = ["law", "2024", "section", "market", "law.", "é", "x" * 30, "notice", "12%", "a", "of", "Rule;", "2024-05-01", "data"]


def toks(t):
    return set(re.findall("[a-z0-9]+|[一-鿿]", t.lower()))


def texts(seed, n=60):
    r = random.Random(seed)
    return [None, "", "  ", "y" * 700, "z" * 400 + " law", *(r.choice([" ", "\n", "  "]).join(r.choice(WORDS) for _ in range(r.randrange(200))) for _ in range(n))]


@pytest.mark.parametrize("stride", [1, 4, 12])
def test_windows_against_a_walk_over_words(spark, stride):
    every = texts(stride)
    df = spark.createDataFrame([(i, t, ["law", "2024", "data", "notice"]) for i, t in enumerate(every)], "i int, t string, terms array<string>")
    got = {r["i"]: r["w"] for r in df.select("i", E.best_words(F.col("t"), F.col("terms"), 60, stride).alias("w")).collect()}
    assert got == {i: excerpt_of(t or "", {"law", "2024", "data", "notice"}, 60, stride) for i, t in enumerate(every)}


def best_sentence(text, terms, most):
    x = " ".join(text.split())
    if len(x) <= most:
        return x
    parts = [s for s in re.split("(?<=[.!?;]) ", x) if s]
    best = max(parts, key=lambda s: (len(terms & toks(s)), -abs(len(s) - most)))
    return excerpt_of(best if terms & toks(best) else x, terms, most)


def test_snippets_against_the_rule(spark):
    """The three candidates and their ranks, one by one; densities are the native ones, computed apart."""
    terms = ["law", "2024", "data", "notice"]
    rows = [(i, t, random.Random(i).choice([None, "", "law data", "market " * 80, "2024-05-01 notice 12%"])) for i, t in enumerate(texts(7, 40))]
    df = spark.createDataFrame([(*r, terms) for r in rows], "i int, text string, candidate string, terms array<string>")
    got = {r["i"]: r["snippet"] for r in E.snippets(df, "i", most=90).collect()}
    asked = set(terms)
    parts = [(i, at, p) for i, t, _ in rows for at, p in enumerate(paragraphs_of(t, 40, 360))]
    scored = {(r["i"], r["at"]): r["s"] for r in spark.createDataFrame(parts, "i int, at int, p string").select("i", "at", (fact_density(F.col("p")) + query_overlap(F.col("p"), F.array(*map(F.lit, terms))) * 1.5).alias("s")).collect()}
    options = {}
    for i, t, c in rows:
        own = sorted((p for p in parts if p[0] == i and scored[p[:2]] >= 1.0), key=lambda p: (-scored[p[:2]], p[1]))[:3]
        options[i] = (" ".join((c or "").split())[:90].rstrip(), best_sentence(t or "", asked, 90), [excerpt_of(p, asked, 90) for *_, p in own])
    every = sorted({x for a, b, c in options.values() for x in (a, b, *c)})
    density = {r["x"]: r["d"] for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", fact_density(F.col("x")).alias("d")).collect()}
    rank = lambda x: (density[x] + 2.0 * len(asked & toks(x)), len(asked & toks(x)), -abs(len(x) - 90))
    for i, (candidate, page, dense) in options.items():
        pages = [x for x in (page, max(dense, key=rank) if dense else "") if x]
        best = max(pages, key=rank) if pages else ""
        want = candidate if candidate and (not best or rank(candidate) >= rank(best)) else best
        assert got[i] == want


def nodes(html):
    x = re.sub(r"(?is)<(script|style|noscript)\b.*?</\1>|<!--.*?-->", " ", html)
    title = re.search(r"(?is)<title>(.*?)(?:</title>|\Z)", x)
    body = re.search(r"(?is)<main\b[^>]*>(.+?)(?:</main>|\Z)", x) or re.search(r"(?is)<body\b[^>]*>(.+?)(?:</body>|\Z)", x)
    return [n for n in (" ".join(p.split()) for p in [title[1] if title else "", *re.split("<[^>]*>", body[1] if body else x)]) if n]


def aligned(html, terms, focus, most):
    chunks, best, top = nodes(html), "", None
    for i, c in enumerate(chunks):
        if toks(c) & focus or toks(c) & terms:
            w = excerpt_of(" ".join(chunks[max(0, i - 8) : i + 18]), focus, most, 4)
            key = (len(focus & toks(w)), len(terms & toks(w)), len(focus & toks(c)), -abs(len(w) - most))
            if top is None or key > top:
                best, top = w, key
    return best or best_sentence(" ".join(chunks), terms, most)


def page(seed):
    r = random.Random(seed)
    body = "".join(f"<{r.choice(['p', 'li', 'b'])} class='x'>{' '.join(r.choice(WORDS) for _ in range(r.randrange(12)))}</p>" for _ in range(r.randrange(1, 60)))
    shell = r.choice(["<body>{}</body>", "<body><nav>law 2024</nav><main id=m>{}</main></body>", "{}"])
    return f"<html><title>Data {seed}</title><script>law 2024</script><!-- notice -->{shell.format(body)}</html>"


def test_aligned_excerpts_and_both_depths(spark):
    pages = [(i, page(i)) for i in range(50)] + [(90, ""), (91, "<body></body>"), (92, None), (93, "law 2024 " * 300)]
    terms, focus = ["law", "2024", "notice"], ["2024", "notice"]
    df = spark.createDataFrame([(*p, terms, focus) for p in pages], "i int, html string, terms array<string>, focus array<string>")
    one = {r["i"]: r["excerpt"] for r in E.aligned_excerpts(df, "i", F.coalesce("html", F.lit("")), "terms", "focus", 80).collect()}
    assert one == {i: aligned(h or "", set(terms), set(focus), 80) for i, h in pages}
    got = {r["i"]: (r["excerpt"], r["depth"]) for r in E.two_depths(df, "i", "html", "terms", "focus", first=700, most=80).collect()}
    count = lambda x: len(set(focus) & toks(x))
    for i, h in pages:
        a = aligned((h or "")[:700], set(terms), set(focus), 80)
        want = (a, 1)
        if count(a) < 2 and len(h or "") > 700:
            b = one[i]
            want = (b, 2) if (b and count(b) >= count(a)) or not a else (a, 1)
        assert got[i] == want
    assert {d for _, d in got.values()} == {1, 2}


def test_a_very_long_text_is_read_whole(spark):
    begun = time.time()
    text = "aa " * 400_000 + "law data notice."
    df = spark.createDataFrame([(1, text, ["law", "data", "notice"])], "i int, t string, terms array<string>")
    assert "law data notice" in df.select(E.page_excerpt(F.col("t"), F.col("terms"), 320).alias("x")).first()["x"]
    assert time.time() - begun < 90


def test_queries(spark, sf_dir):
    x = Q.chosen_snippets(spark, sf_dir).collect()
    assert len(x) == 200 and all(len(r["snippet"]) <= 320 for r in x)
    y = Q.aligned_page_excerpts(spark, sf_dir).collect()
    assert len(y) == spark.read.parquet(f"{sf_dir}/pages.parquet").count() and any(r["excerpt"] for r in y)
