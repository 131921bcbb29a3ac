from sievework.sources import serp

DUCK = '<div class="links"><div class="x result y"><h2><a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.example%2F">A <b>b</b></a></h2><a class="result__snippet">S &amp; s</a></div><div class="result"><a class="result__a">none</a></div></div>'
BING = '<ol><li class="b_algo"><h2><a href="https://b.example">B</a></h2><div class="b_caption"><p>text<br>more</p></div></li></ol>'


def test_results(spark):
    df = spark.createDataFrame([(1, DUCK), (2, None), (3, "<div class='result'><a")], "q int, payload string")
    assert [tuple(r) for r in serp.results(df, "duckduckgo", "q").collect()] == [(1, 0, "A b", "https://a.example/", "S & s")]
    assert [tuple(r) for r in serp.results(spark.createDataFrame([(1, BING)], "q int, payload string"), "bing", "q").collect()] == [(1, 0, "B", "https://b.example", "text more")]
    assert serp.results_of('<div class="g"><a href="u">t</a></div>', "google") == [("t", "u", "")]


def test_links(spark):
    html = '<a href="/ir/report.pdf">Annual <i>report</i></a><a href="https://other.example/x">x</a><a href="mailto:a">m</a><a href="/ir/report.pdf">again</a><a href="news">News</a>'
    df = spark.createDataFrame([(1, html, "https://www.acme.example/home/")], "id int, html string, url string")
    every = [(r["text"], r["url"]) for r in serp.links(df, "id", "html", "url").orderBy("pos").collect()]
    assert every == [("Annual report", "https://www.acme.example/ir/report.pdf"), ("x", "https://other.example/x"), ("News", "https://www.acme.example/home/news")]
    assert [r["text"] for r in serp.links(df, "id", "html", "url", ("acme.example",), ("report",)).collect()] == ["Annual report"]


def test_links_of_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert serp.links(pages, "page_id", "html", "url").count() > 0
