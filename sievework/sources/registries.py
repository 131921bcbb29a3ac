"""Answers of registries and news services, captured as texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_REGISTER = "struct<results:array<struct<title:string,html_url:string,abstract:string,excerpts:string,type:string,document_number:string,publication_date:string,effective_on:string,effective_date:string,agencies:array<struct<name:string,raw_name:string>>>>>"


def _plain(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", ""), r"\s+", " "))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def register_documents(payloads: DataFrame, payload: str = "payload", k: int = 5) -> DataFrame:
    """payloads' other columns with a row for each of the first k documents of a register's JSON answer that has a title and an address."""
    rest = [c for c in payloads.columns if c != payload]
    x = payloads.select(*rest, F.posexplode(F.from_json(payload, _REGISTER)["results"]).alias("ord", "r"))
    x = x.where(_filled(F.col("r.title")).isNotNull() & _filled(F.col("r.html_url")).isNotNull())
    agency = F.get(F.col("r.agencies"), F.lit(0))
    said = F.coalesce(F.nullif(_plain(F.col("r.abstract")), F.lit("")), F.nullif(_plain(F.col("r.excerpts")), F.lit("")), F.trim("r.title"))
    from pyspark.sql import Window

    x = x.withColumn("rank", F.row_number().over(Window.partitionBy(*rest).orderBy("ord"))).where(F.col("rank") <= k) if rest else x.withColumn("rank", F.col("ord") + 1).where(F.col("rank") <= k)
    return x.select(
        *rest, "rank", F.trim("r.title").alias("title"), F.trim("r.html_url").alias("url"), said.alias("snippet"), F.coalesce(_filled(agency["name"]), _filled(agency["raw_name"])).alias("authority"), F.lit("US").alias("jurisdiction"),
        _filled(F.col("r.publication_date")).alias("publication_date"), F.coalesce(_filled(F.col("r.effective_on")), _filled(F.col("r.effective_date"))).alias("effective_date"),
        _filled(F.concat_ws(" ", _filled(F.col("r.type")), _filled(F.col("r.document_number")))).alias("version"),
    )


def event_stream_data(text: Column) -> Column:
    """The data of a server-sent event: its data lines, joined."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^data: ?(.*)$"), F.lit(1)), lambda d: F.trim(d)), "\n")


def news_article_id(url: Column) -> Column:
    """The id in the address of a news service's redirect; null for others."""
    return F.nullif(F.regexp_extract(url, r"^https?://news\.google\.com/(?:[^?#]*/)?(?:articles|read)/([^/?#]+)/*(?:[?#].*)?$", 1), F.lit(""))


def legacy_article_url(article_id: Column) -> Column:
    """The address that an older id holds: base64 of a prefix, a length of one or two bytes, the address, a suffix. Null where there is none."""
    padded = F.concat(F.translate(article_id, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(article_id), F.lit(4))))
    data = F.hex(F.try_to_binary(padded, F.lit("base64")))  # two digits a byte
    data = F.regexp_replace(data, "^081322", "")
    data = F.regexp_replace(data, "D20100$", "")
    byte = lambda at: F.conv(F.substring(data, 2 * at + 1, 2), 16, 10).cast("int")
    long = byte(0) >= 128
    size = F.when(long, (byte(0) - 128) * 256 + byte(1)).otherwise(byte(0))
    begin = F.when(long, 2).otherwise(1)
    whole = F.length(data) >= 2 * (begin + size)
    url = F.trim(F.decode(F.unhex(F.substr(data, 2 * begin + 1, 2 * size)), "UTF-8"))
    return F.when(whole & url.rlike("^https?://"), url)


def batch_article_url(text: Column) -> Column:
    """The address in a batch answer, escaped or plain; null without."""
    found = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit(""))
    return F.coalesce(found(r'garturlres\\",\\"(https?://[^\\"]+)'), found(r'\["garturlres","(https?://[^"]+)'))


def decoder_inputs(html: Column) -> dict[str, Column]:
    """The timestamp and the signature that an article page carries; null unless it has both."""
    at = lambda name: F.nullif(F.trim(F.regexp_extract(html, f'{name}="([^"]+)"', 1)), F.lit(""))
    ts, sg = at("data-n-a-ts"), at("data-n-a-sg")
    return {"timestamp": F.when(sg.isNotNull(), ts), "signature": F.when(ts.isNotNull(), sg)}


def settings(text: str, given: dict[str, str] | None = None) -> dict[str, str]:
    """NAME=value lines of a settings file, beside what is given, which wins; comments and lines without a sign of equality say nothing, one pair of quotes is taken off."""
    out = dict(given or {})
    for line in map(str.strip, text.splitlines()):
        name, sign, value = line.partition("=")
        if sign and not line.startswith("#") and name.strip():
            value = value.strip()
            quoted = len(value) > 1 and value[0] == value[-1] and value[0] in "'\""
            out.setdefault(name.strip(), value[1:-1].strip() if quoted else value)
    return out
