import json

from sievework.sources import files, payloads


def table(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "q int, payload string")


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("q", "pos").collect()]


def test_semantic_scholar(spark):
    p = {"data": [{"title": "A", "url": "u", "abstract": None, "year": 2020, "externalIds": {"DOI": "10.1"}, "authors": [{"name": "X"}, {"name": "Y"}]}, {"title": "", "url": "v"}, {"title": "B"}]}
    got = rows(payloads.semantic_scholar(table(spark, json.dumps(p), "not json")), "title", "url", "snippet", "doi", "first_author", "year", "evidence_level")
    assert got == [("A", "u", "A", "10.1", "X", 2020, "peer_reviewed"), ("B", "", "B", None, None, None, "metadata_only")]


def test_scholarly_index(spark):
    items = [{"title": "A", "url": "https://arxiv.org/abs/1234.5"}, {"title": "B", "url": "u", "venue": "ACL", "tldr": {"text": "short"}}, {"title": "C", "url": "u"}, {"title": "D"}]
    got = rows(payloads.scholarly_index(table(spark, json.dumps({"structuredContent": {"result": items}}))), "title", "snippet", "arxiv_id", "evidence_level")
    assert got == [("A", "A", "1234.5", "preprint"), ("B", "short", None, "peer_reviewed"), ("C", "C", None, "metadata_only")]


def test_openalex_and_europe_pmc(spark):
    work = {"display_name": "A", "id": "w", "type": "article", "publication_year": 2021, "abstract_inverted_index": {"b": [1], "a": [0]}, "best_oa_location": {"pdf_url": "p"}, "authorships": [{"author": {"display_name": "Z"}}]}
    assert rows(payloads.openalex(table(spark, json.dumps({"results": [work]}))), "title", "url", "snippet", "first_author", "year", "evidence_level") == [("A", "p", "a b", "Z", 2021, "peer_reviewed")]
    pmc = {"resultList": {"result": [{"title": "A", "id": "7", "source": "PPR", "authorString": "Q W, E R", "pubYear": "2019"}, {"title": "B", "doi": "10.2"}, {"title": "C"}]}}
    assert rows(payloads.europe_pmc(table(spark, json.dumps(pmc))), "title", "url", "first_author", "year", "evidence_level") == [("A", "https://europepmc.org/article/PPR/7", "Q W", 2019, "preprint"), ("B", "https://doi.org/10.2", None, None, "peer_reviewed")]


def test_feeds(spark):
    atom = "<feed><entry><id>http://arxiv.org/abs/2401.1v2</id><title> A &amp; B </title><summary>S</summary><published>2024-01-01</published><author><name>N</name></author></entry><entry><title>x</title></entry></feed>"
    assert rows(payloads.arxiv_feed(table(spark, atom, "<broken")), "title", "arxiv_id", "first_author", "year") == [("A & B", "2401.1v2", "N", 2024)]
    rss = '<rss><item><title>T</title><link>http://a</link><description>&lt;b&gt;D&lt;/b&gt; d</description><pubDate>P</pubDate><source url="http://s">S</source></item><item><title>U</title></item></rss>'
    assert rows(payloads.news_feed(table(spark, rss)), "title", "url", "snippet") == [("T", "https://a", "D d")]
    assert rows(payloads.news_feed(table(spark, rss), with_source=True), "snippet", "source_url") == [("D d | Source: S | P", "http://s")]


def test_policy_and_filings(spark):
    p = {"searchVO": {"catMap": {"gongwen": {"listVO": [{"title": "<em>A</em> b", "url": "u", "summary": "s", "pubtimeStr": "2024.1.2"}]}, "x": {"listVO": [{"title": "", "url": "v"}]}}}}
    r = payloads.policy_search(table(spark, json.dumps(p), json.dumps({"code": 1001}))).collect()
    assert [(x["title"], x["snippet"], x["publication_date"], x["category_rank"]) for x in r] == [("A b", "s", "2024-01-02", 0)]
    f = {"hits": {"hits": [{"_id": "1:doc.htm", "_source": {"ciks": ["000012"], "adsh": "0-1-2", "display_names": ["ACME (CIK 12)"], "form": "10-K", "file_date": "2024-01-01"}}, {"_id": "2", "_source": {"ciks": ["1"], "adsh": "3"}}]}}
    assert rows(payloads.filing_search(table(spark, json.dumps(f))), "title", "url", "snippet") == [("ACME Form 10-K filing", "https://www.sec.gov/Archives/edgar/data/12/012/doc.htm", "Official SEC filing 10-K filed 2024-01-01")]
    s = {"cik": "0012", "name": "ACME", "filings": {"recent": {"form": ["10-K", "8-K"], "accessionNumber": ["0-1", "0-2"], "primaryDocument": ["a", "b"], "filingDate": ["x", "y"], "reportDate": ["", ""]}}}
    assert rows(payloads.submissions(table(spark, json.dumps(s))), "form", "url") == [("10-K", "https://www.sec.gov/Archives/edgar/data/12/01/a"), ("8-K", "https://www.sec.gov/Archives/edgar/data/12/02/b")]


def test_redirects(spark):
    urls = ["//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2Fx&rut=1", "https://www.bing.com/ck/a?!&u=a1aHR0cHM6Ly9iLmV4YW1wbGU&ntb=1", "https://c.example/?u=1", "https://www.bing.com/ck/a?u=a1%%%"]
    got = [r["t"] for r in table(spark, *urls).select("q", payloads.redirect_target(payloads.F.col("payload")).alias("t")).orderBy("q").collect()]
    assert got[:3] == ["https://a.example/x", "https://b.example", "https://c.example/?u=1"]


def test_files(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"case_id": "b", "query": "q", "expected_route": "policy"}, {"case_id": "a", "query": "r", "expected_route": "mixed"}]))
    assert [(r["pos"], r["case_id"]) for r in files.read_cases(spark, str(tmp_path / "cases.json")).orderBy("pos").collect()] == [(0, "b"), (1, "a")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s/1.json").write_text(json.dumps([{"case_id": "a", "dimension": "accuracy", "score": 3}, {"case_id": "b", "dimension": "usability", "score": 1}]))
    (tmp_path / "s/2.json").write_text(json.dumps({"case_id": "c", "dimension": "accuracy", "score": 2}))
    scores = files.read_scores(spark, str(tmp_path / "s"))
    assert scores.count() == 3
    files.write_runs(scores, scores.limit(1), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/runs-jsonl")).count() == spark.read.csv(str(tmp_path / "out/runs-csv"), header=True).count() == 3
    files.write_packets(scores.select("case_id", "score"), "case_id", str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p/packets")).count() == 3


def test_companies(spark):
    c = spark.createDataFrame([("1", "Acme Battery Holdings Inc", "ABH"), ("2", "Acme", "ACM")], "cik string, title string, ticker string")
    a = files.company_aliases(c)
    assert {(r["alias"], r["priority"]) for r in a.where("cik = '1'").collect()} == {("acme battery holdings", 4), ("acme battery", 3), ("abh", 2)}
    q = spark.createDataFrame([(1, "acme battery revenue"), (2, "acme news"), (3, "abh filing"), (4, "nothing")], "id int, normal string")
    assert {r["id"]: r["cik"] for r in files.detect_company(q, a, "id").collect()} == {1: "2", 2: "2", 3: "1"}  # a whole name goes before a longer part of one
