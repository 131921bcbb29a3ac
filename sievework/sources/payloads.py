"""Captured payloads of search services as tables of records: one row of JSON or XML text in, a row for each record out.

Nothing here reaches a network: a payload column comes from files. Payloads that are malformed give no records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import abstract_text, iso_date
from sievework.operators.classify import sum_when

FIELDS = ("title", "url", "snippet", "doi", "arxiv_id", "first_author", "year", "evidence_level")


def some(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def _items(df: DataFrame, payload: str, schema: str, path: str) -> DataFrame:
    return df.withColumn("_p", F.from_json(payload, schema)).select("*", F.posexplode(f"_p.{path}").alias("pos", "x")).drop("_p", payload)


def _records(df: DataFrame, **fields: Column) -> DataFrame:
    """df's own columns and pos, and the record fields; records without a title are none."""
    own = [c for c in df.columns if c != "x"]
    made = [fields.get(f, F.lit(None).cast("int" if f == "year" else "string")).alias(f) for f in FIELDS]
    return df.select(*own, *made).where("title is not null")


def _year(c: Column) -> Column:
    return F.when(c.cast("string").rlike("^[0-9]+$"), c.cast("int"))


_PAPER = "title string, url string, abstract string, year string, venue string, externalIds struct<DOI string, ArXiv string>, authors array<struct<name string>>, tldr struct<text string>"


def semantic_scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    x = _items(df, payload, f"data array<struct<{_PAPER}>>", "data")
    doi = some(F.col("x.externalIds.DOI"))
    return _records(x, title=some(F.col("x.title")), url=F.coalesce(F.col("x.url"), F.lit("")), snippet=some(F.col("x.abstract"), F.col("x.title")), doi=doi, arxiv_id=some(F.col("x.externalIds.ArXiv")), first_author=some(F.get("x.authors.name", F.lit(0))), year=_year(F.col("x.year")), evidence_level=F.when(doi.isNotNull(), "peer_reviewed").otherwise("metadata_only"))


def scholarly_index(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Results of the index service; the level follows from identifiers and venue."""
    x = _items(df, payload, f"structuredContent struct<result array<struct<{_PAPER}>>>", "structuredContent.result")
    url, venue = F.col("x.url"), F.coalesce(F.trim("x.venue"), F.lit(""))
    doi = some(F.col("x.externalIds.DOI"))
    arxiv = some(F.col("x.externalIds.ArXiv"), F.regexp_replace(F.regexp_extract(url, r"/abs/(?:[^?#]*/)?([^/?#]+)/*(?:[?#]|$)", 1), r"\.pdf$", ""))
    preprint = arxiv.isNotNull() | F.lower(url).contains("arxiv") | F.lower(venue).contains("arxiv")
    level = F.when(doi.isNotNull(), "peer_reviewed").when(preprint, "preprint").when(venue != "", "peer_reviewed").otherwise("metadata_only")
    r = _records(x, title=some(F.col("x.title")), url=some(url), snippet=some(F.col("x.abstract"), F.col("x.tldr.text"), F.col("x.title")), doi=doi, arxiv_id=arxiv, first_author=some(F.get("x.authors.name", F.lit(0))), year=_year(F.col("x.year")), evidence_level=level)
    return r.where("url is not null")


def openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    place = "struct<landing_page_url string, pdf_url string>"
    work = f"struct<id string, display_name string, title string, doi string, type string, publication_year string, authorships array<struct<author struct<display_name string>>>, primary_location {place}, best_oa_location {place}, abstract_inverted_index map<string, array<int>>>"
    x = _items(df, payload, f"results array<{work}>", "results")
    doi = some(F.col("x.doi"))
    at = some(*(F.col(f"x.{p}.{u}") for p in ("primary_location", "best_oa_location") for u in ("landing_page_url", "pdf_url")))
    peer = doi.isNotNull() | F.lower("x.type").isin("article", "journal-article", "review", "review-article")
    title = some(F.col("x.display_name"), F.col("x.title"))
    return _records(x, title=title, url=F.coalesce(doi, at, some(F.col("x.id")), F.lit("")), snippet=F.coalesce(some(abstract_text(F.col("x.abstract_inverted_index"))), title), doi=F.regexp_replace(doi, "^https://doi.org/", ""), first_author=some(F.get("x.authorships.author.display_name", F.lit(0))), year=_year(F.col("x.publication_year")), evidence_level=F.when(peer, "peer_reviewed").otherwise("metadata_only"))


def europe_pmc(df: DataFrame, payload: str = "payload") -> DataFrame:
    fields = ("id", "pmid", "source", "title", "doi", "authorString", "journalTitle", "firstPublicationDate", "pubYear", "pubType")
    x = _items(df, payload, f"resultList struct<result array<struct<{', '.join(f'{f} string' for f in fields)}>>>", "resultList.result")
    c = {f: some(F.col(f"x.{f}")) for f in fields}
    source, record = F.coalesce(c["source"], F.lit("MED")), F.coalesce(c["id"], c["pmid"])
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), c["doi"]), F.concat(F.lit("https://europepmc.org/article/"), source, F.lit("/"), record))
    snippet = F.coalesce(some(F.concat_ws(" ", c["journalTitle"], c["authorString"], c["firstPublicationDate"])), c["title"])
    r = _records(x, title=c["title"], url=url, snippet=snippet, doi=c["doi"], first_author=some(F.trim(F.split(c["authorString"], ",", 2)[0])), year=_year(c["pubYear"]), evidence_level=F.when(source == "PPR", "preprint").otherwise("peer_reviewed"))
    return r.where("url is not null")


def arxiv_feed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Atom entries, by regular expressions over the feed (entries do not nest)."""
    x = df.select("*", F.posexplode(F.regexp_extract_all(payload, F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))).alias("pos", "x")).drop(payload)
    tag = lambda t: unescaped(F.trim(F.regexp_extract("x", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1)))
    url = some(tag("id"))
    arxiv = some(F.element_at(F.split(F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "/+$", ""), "/"), -1))
    r = _records(x, title=some(tag("title")), url=url, snippet=some(tag("summary"), tag("title")), arxiv_id=arxiv, first_author=some(tag("name")), year=_year(F.regexp_extract(tag("published"), "^([0-9]{4})", 1)), evidence_level=F.lit("preprint"))
    return r.where("url is not null")


def unescaped(c: Column) -> Column:
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain(c: Column) -> Column:
    """Text without tags, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "(?s)<[^>]*>", " "), r"\s+", " "))


def news_feed(df: DataFrame, payload: str = "payload", with_source: bool = False) -> DataFrame:
    """RSS items: title, url, snippet (and source_url, with the source and the date in the snippet); items without title or link are none."""
    x = df.select("*", F.posexplode(F.regexp_extract_all(payload, F.lit(r"(?s)<item\b[^>]*>(.*?)</item>"), F.lit(1))).alias("pos", "x")).drop(payload)
    raw = lambda t: F.regexp_replace(F.regexp_extract("x", rf"(?s)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1")
    text = lambda t: F.trim(F.regexp_replace(unescaped(raw(t)), r"\s+", " "))
    title, link, about = text("title"), text("link"), plain(unescaped(raw("description")))
    own = [c for c in x.columns if c != "x"]
    if with_source:
        parts = F.concat_ws(" | ", F.when((about != "") & (about != title), about), F.when(text("source") != "", F.concat(F.lit("Source: "), text("source"))), some(text("pubDate")))
        out = x.select(*own, title.alias("title"), link.alias("url"), parts.alias("snippet"), F.regexp_extract("x", r'<source\b[^>]*\burl="([^"]*)"', 1).alias("source_url"))
    else:
        out = x.select(*own, title.alias("title"), F.regexp_replace(link, "^http://", "https://").alias("url"), F.coalesce(some(about), title).alias("snippet"))
    return out.where("title <> '' and url <> ''")


def policy_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Results of the government search by category: category, rank within the payload, and a record's fields."""
    item = "struct<title string, url string, summary string, pcode string, puborg string, pubtimeStr string>"
    x = df.withColumn("_p", F.from_json(payload, f"code int, searchVO struct<catMap map<string, struct<listVO array<{item}>>>>")).where("_p.code is null or _p.code <> 1001")
    x = x.select("*", F.explode("_p.searchVO.catMap").alias("category", "bucket")).select("*", F.explode("bucket.listVO").alias("x")).drop("_p", "bucket", payload)
    title = plain(F.col("x.title"))
    made = {"title": title, "url": F.col("x.url"), "snippet": F.coalesce(some(F.concat_ws(" ", some(plain(F.col("x.summary"))), some(plain(F.col("x.pcode"))))), title), "authority": some(plain(F.col("x.puborg"))), "publication_date": iso_date(F.col("x.pubtimeStr"))}
    # Categories in order of standing.
    first = F.coalesce(sum_when(F.col("category"), {"gongwen": 0, "bumenfile": 1, "gongbao": 2, "otherfile": 3}), F.lit(9))
    return x.withColumns(made).drop("x").where("url <> '' and title <> ''").withColumn("category_rank", first)


def filing_url(cik: Column, accession: Column, document: Column) -> Column:
    return F.concat_ws("/", F.lit("https://www.sec.gov/Archives/edgar/data"), F.coalesce(some(F.ltrim(cik, F.lit("0"))), F.lit("0")), F.replace(accession, F.lit("-"), F.lit("")), document)


def filing_search(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Full-text filing hits; hits without company, accession or document are none."""
    source = "struct<ciks array<string>, adsh string, display_names array<string>, form string, file_type string, file_date string, file_description string>"
    x = _items(df, payload, f"hits struct<hits array<struct<_id string, _source {source}>>>", "hits.hits")
    s = lambda f: F.col(f"x._source.{f}")
    cik, document = F.get(s("ciks"), F.lit(0)), some(F.regexp_extract("x._id", "^[^:]*:(.*)$", 1))
    form = F.coalesce(some(s("form")), some(s("file_type")), F.lit("filing"))
    name = F.coalesce(F.trim(F.split(F.get(s("display_names"), F.lit(0)), r"\(CIK", 2)[0]), F.lit("SEC registrant"))
    own = [c for c in x.columns if c != "x"]
    out = x.select(*own, F.concat(name, F.lit(" Form "), form, F.lit(" filing")).alias("title"), F.when(some(s("adsh")).isNotNull() & cik.isNotNull() & document.isNotNull(), filing_url(cik, s("adsh"), document)).alias("url"), F.concat_ws(" ", F.lit("Official SEC filing"), form, F.concat(F.lit("filed "), some(s("file_date"))), some(s("file_description"))).alias("snippet"), F.lit("company_official").alias("credibility_tier"))
    return out.where("url is not null")


def submissions(df: DataFrame, payload: str = "payload") -> DataFrame:
    """A company's recent filings: columnar arrays as rows."""
    names = ("form", "accessionNumber", "primaryDocument", "filingDate", "reportDate")
    x = df.withColumn("_p", F.from_json(payload, f"cik string, name string, filings struct<recent struct<{', '.join(f'{n} array<string>' for n in names)}>>"))
    rows = F.arrays_zip(*(F.col(f"_p.filings.recent.{n}").alias(n) for n in names))
    x = x.select(*df.columns, F.col("_p.cik").alias("cik"), F.col("_p.name").alias("company"), F.posexplode(rows).alias("pos", "f")).drop(payload)
    return x.select(*[c for c in x.columns if c != "f"], *(F.col(f"f.{n}").alias(n) for n in names)).withColumn("url", filing_url(F.col("cik"), F.col("accessionNumber"), F.col("primaryDocument")))


def redirect_target(url: Column) -> Column:
    """Where a search engine's redirect leads; other addresses as they are."""
    secure = F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(url)
    duck = F.regexp_extract(secure, r"^https?://[^/]*duckduckgo\.com/l/[^#]*[?&]uddg=([^&#]+)", 1)
    bing = F.regexp_replace(F.try_url_decode(F.regexp_extract(secure, r"^https?://[^/]*bing\.com/ck/[^#]*[?&]u=([^&#]+)", 1)), "^a1", "")
    padded = F.concat(bing, F.repeat(F.lit("="), F.pmod(-F.length(bing), F.lit(4))))
    decoded = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(duck != "", F.coalesce(some(F.trim(F.try_url_decode(duck))), secure)).when(bing != "", F.coalesce(some(decoded), secure)).otherwise(secure)
