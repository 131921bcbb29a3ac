"""Report files: case manifests and judged scores in, runs and packets out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import tokens
from sievework.operators.components import join_bounded, written

CASE = "case_id string, query string, expected_route string"
SCORE = "case_id string, dimension string, score double, rationale string, positives array<string>, negatives array<string>"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of cases, with pos, their place in it. Cases without id or query are an error."""
    x = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{CASE}>>")).alias("pos", "c")).select("pos", "c.*")
    whole = F.coalesce(F.col("case_id"), F.lit("")) != ""
    return x.withColumn("case_id", F.when(whole & (F.coalesce(F.col("query"), F.lit("")) != ""), F.col("case_id")).otherwise(F.raise_error(F.lit("a case without id or query"))))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Judged scores from files that hold an object or an array of objects each."""
    return spark.read.schema(SCORE).json(path, multiLine=True)


def write_runs(runs: DataFrame, summary: DataFrame, path: str) -> None:
    """runs as JSON lines and as CSV (nested columns as JSON text), summary as JSON."""
    runs.write.json(f"{path}/runs-jsonl")
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in runs.dtypes]
    runs.select(*flat).write.option("header", True).csv(f"{path}/runs-csv")
    summary.write.json(f"{path}/summary")


def write_packets(packets: DataFrame, case: str, path: str) -> None:
    """A JSON packet for each case in a folder of its own, and an index of all."""
    body = packets.select(case, F.to_json(F.struct(*packets.columns)).alias("packet"))
    body.write.partitionBy(case).text(f"{path}/packets")
    packets.select(case).withColumn("file", F.concat(F.lit(f"packets/{case}="), F.col(case))).write.json(f"{path}/index")


def company_aliases(companies: DataFrame, legal: tuple[str, ...] = ("inc", "corp", "corporation", "co", "company", "ltd", "plc", "sa", "ag", "nv"), descriptors: tuple[str, ...] = ("holdings", "group", "technologies", "international")) -> DataFrame:
    """companies (cik, title, ticker) with a row for each alias: alias, priority, tokens.

    The name without legal endings (4), its beginnings of two words and more, and without descriptors at its end (3),
    its initials (2) and the ticker (1); of equal aliases of a company the highest priority.
    """
    from sievework.functions.text import tokens

    def core(words, endings):
        text = F.regexp_replace(F.array_join(words, " "), rf"( ({'|'.join(endings)}))+$", "")
        return F.split(text, " ")

    x = companies.withColumn("_w", core(F.filter(tokens(F.lower("title")), lambda w: w.rlike("^[a-z0-9]")), legal)).withColumn("_d", core(F.col("_w"), descriptors))
    n = F.size("_w")
    starts = F.when(n > 2, F.transform(F.sequence(F.lit(2), n - 1), lambda i: F.array_join(F.slice("_w", F.lit(1), i), " "))).otherwise(F.array().cast("array<string>"))
    initials = F.array_join(F.transform("_w", lambda w: F.substring(w, 1, 1)), "")
    named = lambda a, p: F.transform(a, lambda t: F.struct(t.alias("alias"), F.lit(p).alias("priority")))
    every = F.concat(named(F.array(F.array_join("_w", " ")), 4), named(starts, 3), named(F.filter(F.array(F.array_join("_d", " ")), lambda t: (F.size("_d") < n) & ((F.size("_d") > 1) | (F.length(t) >= 4))), 3), named(F.filter(F.array(initials), lambda t: F.length(t).between(2, 5)), 2), named(F.array(F.lower("ticker")), 1))
    rows = x.select("cik", F.explode(every).alias("a")).select("cik", "a.*").where("alias <> ''")
    return rows.groupBy("cik", "alias").agg(F.max("priority").alias("priority")).withColumn("tokens", F.size(F.split("alias", " ")))


def detect_company(queries: DataFrame, aliases: DataFrame, query_id: str, normal: str = "normal") -> DataFrame:
    """(query id, cik): the company of the best alias that a query names: priority, tokens, length, cik.

    Word n-grams of the query are joined with the aliases by equality, so that no query meets every alias.
    """
    longest = 8
    w = F.regexp_extract_all(F.col(normal), F.lit("[a-z0-9]+"), F.lit(0))
    x = queries.select(query_id, w.alias("w")).select(query_id, "w", F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("n"))
    grams = F.when(F.size("w") >= F.col("n"), F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: F.array_join(F.slice("w", i, F.col("n")), " ")))
    x = x.select(query_id, F.explode(grams).alias("alias")).distinct().join(aliases, "alias")
    return x.groupBy(query_id).agg(F.max(F.struct("priority", "tokens", F.length("alias").alias("n"), "cik")).alias("b")).select(query_id, "b.cik")


def _runs(text: Column) -> Column:
    """Runs of ASCII letters and digits, in order."""
    return F.regexp_extract_all(text, F.lit("[a-z0-9]+"), F.lit(0))


def _pairs(runs: Column) -> Column:
    """Each run with the one behind it."""
    return F.zip_with(F.slice(runs, 1, F.greatest(F.size(runs) - 1, F.lit(0))), F.slice(runs, 2, F.size(runs)), lambda a, b: F.concat_ws(" ", a, b))


def _edges(text: Column) -> Column:
    """Runs with the two characters behind or before them, where neither is of a run."""
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ("[a-z0-9]+[^a-z0-9]{2}", "[^a-z0-9]{2}[a-z0-9]+")))


def named_alias(queries: DataFrame, aliases: DataFrame, query_id: str, target: str, normal: str = "normal", most: int = 100_000) -> DataFrame:
    """(query id, target, alias): the target of the longest alias that stands in a query by itself; of equally long ones the largest target.

    An alias stands by itself where neither an ASCII letter nor a digit touches it, so that its runs of these are
    consecutive runs of the query. Aliases (alias, target) may be millions: each is looked for, by equality, under that
    of its pairs of adjacent runs which fewest queries have; under its run and what stands next to it, if it has one
    alone; under its rarest token, if it has none. They are broadcast if counted to be few. An alias without any token, or with a key that no query
    has, is found nowhere; nulls are none. Repeated aliases count once.
    """
    own = aliases.where(F.col("alias").isNotNull() & F.col(target).isNotNull()).groupBy("alias").agg(F.max(target).alias(target))
    asked = queries.select(query_id, F.col(normal).alias("_normal")).withColumn("_w", _runs(F.col("_normal")))
    asked = asked.select(query_id, F.explode(F.array_distinct(F.concat(_pairs(F.col("_w")), _edges(F.col("_normal")), tokens(F.col("_normal"))))).alias("_key"))
    often = asked.groupBy("_key").agg(F.count(F.lit(1)).alias("_df"))
    runs = own.withColumn("_w", _runs(F.col("alias")))
    keys = F.when(F.size("_w") > 1, _pairs(F.col("_w"))).when((F.size("_w") == 1) & (F.size(_edges(F.col("alias"))) > 0), _edges(F.col("alias"))).when(F.size("_w") == 1, F.col("_w")).otherwise(tokens(F.col("alias")))
    parts = runs.select("alias", target, F.explode(F.array_distinct(keys)).alias("_key")).join(often, "_key", "left")
    rarest = parts.groupBy("alias", target).agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_key").alias("k"))).alias("_rare"))
    # written, since they are counted and joined
    own = written(rarest.where("_rare.df > 0").select("alias", target, F.col("_rare.k").alias("_key")))
    met = join_bounded(asked, own, "_key", "inner", most).select(F.col(query_id).alias("_q"), "alias", target)
    # a query's text follows its candidates, not each of its keys
    met = met.join(queries.select(query_id, F.col(normal).alias("_normal")), F.col("_q").eqNullSafe(F.col(query_id))).where(F.contains(F.col("_normal"), F.col("alias")))
    apart = F.regexp_like(F.col("_normal"), F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.col("alias"), F.lit(r"\E(?![a-z0-9])")))
    best = met.where(apart).groupBy(query_id).agg(F.max(F.struct(F.length("alias").alias("n"), target, "alias")).alias("b"))
    return best.select(query_id, f"b.{target}", "b.alias")
