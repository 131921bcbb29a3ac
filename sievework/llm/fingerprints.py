"""Document fingerprints: one-permutation MinHash with optimal densification, in DataFrame functions alone.

Each five-word shingle is hashed once. The hash's first byte deals it to one of 256 bins; a bin keeps its least hash.
An empty bin looks through the others in an order of its own, the same for all documents, and borrows from the first
filled one. The fingerprint is the low byte of each bin, packed as hexadecimal digits. Two fingerprints agree in a bin
with the shingle sets' Jaccard similarity, plus 1/256 of the rest by chance, which the estimate takes off.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORDS = 5
BINS = 256
BITS = 8
PROBES = 12  # bins that an empty one looks at, before it orders all filled ones by a hash
_SHIFT = 56
_MASK = (1 << _SHIFT) - 1


def _bins(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with out: the bins' values after densification, or null for a text without words.

    The steps are separate projections, so that lambdas read finished arrays.
    """
    w, s, d, f = (f"_{out}_{x}" for x in "wsdf")
    words = F.split(F.trim(F.regexp_replace(F.lower(F.col(text)), r"[\s\x{a0}]+", " ")), " ")
    x = df.withColumn(w, F.transform(words, lambda word: F.xxhash64(word)))
    each = F.transform(F.col(w), lambda h, i: F.xxhash64(h, *(F.get(F.col(w), i + j) for j in range(1, WORDS))))
    x = x.withColumn(s, F.slice(each, 1, F.greatest(F.size(w) - (WORDS - 1), F.lit(1))))
    # one value above all others ends each bin, so that a bin without hashes has it as its least
    ends = F.array(*(F.lit(((b - BINS // 2) << _SHIFT) | _MASK) for b in range(BINS)))
    x = x.withColumn(s, F.sort_array(F.concat(F.col(s), ends)))
    x = x.withColumn(d, F.filter(F.col(s), lambda h, i: (i == 0) | (F.shiftright(h, _SHIFT) != F.shiftright(F.get(F.col(s), i - 1), _SHIFT))))
    empty = lambda v: v.bitwiseAND(F.lit(_MASK)) == _MASK
    x = x.withColumn(f, F.filter(F.col(d), lambda v: ~empty(v)))
    looks = []
    for a in range(PROBES):  # bin j looks at bin (odd * j + shift) mod 256
        odd, shift = (2 * (a * 41 + 17) + 1) % BINS, (a * 97 + 59) % BINS
        looks.append(lambda j, odd=odd, shift=shift: F.get(F.col(d), (j * odd + shift).bitwiseAND(F.lit(BINS - 1))))

    def filled(v: Column, j: Column) -> Column:
        tried = [F.when(~empty(look(j)), look(j)) for look in looks]
        ordered = F.array_min(F.transform(F.col(f), lambda u: F.struct(F.xxhash64(j, F.shiftright(u, _SHIFT)).alias("o"), u.alias("u"))))
        return F.when(~empty(v), v).otherwise(F.coalesce(*tried, ordered["u"]))

    x = x.withColumn(out, F.when(F.trim(F.regexp_replace(F.col(text), r"[\s\x{a0}]+", " ")) != "", F.transform(F.col(d), lambda v, j: filled(v, j).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int"))))
    return x.drop(w, s, d, f)


def packed(values: Column) -> Column:
    """Bins as hexadecimal digits, two a bin; empty for a text without words."""
    digits = F.array(*(F.lit(f"{b:02x}") for b in range(1 << BITS)))
    return F.coalesce(F.array_join(F.transform(values, lambda v: F.get(digits, v)), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity, 0 to 1. Two texts without words are alike, one is like no other."""
    chance = 1 / (1 << BITS)
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e))
    estimate = F.greatest((same / F.lit(float(BINS)) - chance) / (1 - chance), F.lit(0.0))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(estimate)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a fingerprint of each text (null: empty)."""
    x = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    return _bins(x, "_text", "_bins").withColumn(out, packed(F.col("_bins"))).drop("_bins", "_text")


def _parts(spark: SparkSession, docs: DataFrame) -> list[int]:
    """Bounds that divide doc_ids into parts of about equal size: some four for each shuffle partition, 4,000 at most."""
    n = max(1, min(4000, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = docs.where("doc_id is not null").approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (8 * n)) if n > 1 else []
    return sorted({int(x) for x in found})


def edited_fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    A text's last floor(n_chars / 2) code points are replaced by the first as many (or all) of the next document, by
    descending doc_id and, where that is equal, descending text; null doc_ids come last; after the last comes the
    first, and a single row follows itself. Null texts are empty. Other columns of docs are ignored; an empty table
    gives none.

    Rows are dealt to parts by ranges of doc_id. Each part also gets the first row of the next part that has any, so
    that every row finds its successor in its own part.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = _parts(docs.sparkSession, base)
    part = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b <= F.col("doc_id"))) + 1 if bounds else F.lit(1)
    base = base.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part).cast("int"))
    # at most as many rows as parts
    heads = base.groupBy("part").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    # which part follows which is decided from their numbers; the heads' texts are joined to them afterwards
    along = Window.partitionBy(F.lit(1)).orderBy("part")
    numbers = base.select("part").distinct()
    follows = numbers.select(F.col("part").alias("to"), F.coalesce(F.lag("part").over(along), F.max("part").over(Window.partitionBy(F.lit(1)))).alias("part"))
    ghosts = heads.join(follows, "part").select("head.doc_id", "head.text", F.col("to").alias("part"), F.lit(True).alias("ghost"))
    rows = base.withColumn("ghost", F.lit(False)).union(ghosts).repartition("part")
    rows = _bins(rows, "text", "own")
    order = Window.partitionBy("part").orderBy("ghost", F.desc_nulls_last("doc_id"), F.desc("text"))
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_own", F.lead("own").over(order)).where(~F.col("ghost"))
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = rows.drop("text", "next_text")
    rows = _bins(rows, "edited", "other").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    return rows.select("doc_id", "n_chars", "edited_sha256", packed(F.col("own")).alias("fingerprint"), packed(F.col("other")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("other")).alias("near_edited"), likeness(F.col("own"), F.col("next_own")).alias("near_next"))
