"""Near-duplicate detection with DartMinHash signatures.

A document is the weighted set of its five-word shingles; a shingle's weight is how often it occurs. Darts are thrown,
by hashing, into each shingle's region (weight x rank): those under the shingle's weight hit. A hit's hash deals it to
one of k coordinates, and each coordinate keeps the hit of least rank, so that two documents agree in a coordinate
with the probability of their weighted Jaccard similarity. Only as many darts are looked at as it takes to fill the
coordinates (about k log k a document), however many shingles a document has.

Signatures are banded; documents that share a band are compared by their whole signatures first and, if these may reach
the threshold, by their exact weighted similarity. Links make classes (connected components).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import U64, arrow, arrow_map, chunks_by_bytes, cut, grouped, join_bounded, mix
from sievework.llm.repeats import text_words
from sievework.operators.components import connected_components

WORDS = 5
THRESHOLD = 0.8
ROWS = 6  # coordinates of a band
BANDS = 32  # at similarity 0.8, a pair shares no band with probability (1 - 0.8**6)**32 = 6e-5
#: Signatures of k coordinates estimate a similarity of 0.8 with a deviation of 0.029; pairs this far below the threshold go unverified.
MARGIN = 0.14
CHUNK = 600_000
DENSE = 12  # a bucket of more members is compared in place, from exact sets
CELL = 2048  # members of a part of such a bucket; larger ones are compared part by part
BROADCAST_ROWS = 500_000  # digests of 16 bytes
GOLDEN = U64(0x9E3779B97F4A7C15)


def normal_text(text: Column) -> Column:
    """Lower case, runs of white space as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s\x{a0}]+", " "))


def shingles(texts: list[str], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(document's position, shingle's hash) for each occurrence of a shingle in normal texts.

    A text of one word or more but fewer than `words` has one shingle, all its words; a text without words has none.
    """
    n_words = np.array([t.count(" ") + 1 if t else 0 for t in texts], np.int64)
    own, _, _ = text_words(memoryview(" ".join(texts).encode("utf-8", "surrogatepass")))
    if not len(own):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    sizes = np.where(n_words > 0, np.maximum(n_words, words), 0)  # short texts are filled up with zeros
    all_words = np.zeros(sizes.sum(), U64)
    all_words[np.arange(len(own)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n_words) - n_words), n_words)] = own
    n = len(all_words) - words + 1
    h = np.zeros(n, U64)
    for j in range(words):
        h = (h ^ all_words[j : j + n]) * GOLDEN
        h ^= h >> U64(29)
    doc = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    inside = np.arange(n) + words <= ends[doc[:n]]
    return doc[:n][inside], mix(h[inside])


def weighted_sets(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, weight), sorted by document and shingle; shingles are cut to 40 bits, so that both fit one number to sort by."""
    both = np.sort(doc.astype(U64) << U64(40) | h >> U64(24))
    first = np.ones(len(both), bool)
    first[1:] = both[1:] != both[:-1]
    at = np.flatnonzero(first)
    return (both[at] >> U64(40)).astype(np.int64), both[at] & U64((1 << 40) - 1), np.diff(np.append(at, len(both))).astype(float)


def _unit(h: np.ndarray) -> np.ndarray:
    """Hashes as numbers in (0, 1)."""
    return ((h >> U64(11)).astype(float) + 0.5) / float(1 << 53)


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """A row of k hashes for each document; weights are positive. Rows of documents without elements stay 0.

    An element's region is cut into strips of weight [0, 1), [1, 2), [2, 4), ... In each strip darts arrive as a Poisson
    process along the rank axis, at the strip's width as their rate; arrivals are functions of (element, strip, count)
    alone, so that documents see the same darts.
    """
    signature = np.zeros((n_docs, k), U64)
    total = np.bincount(doc, weight, n_docs)
    reach = np.divide(k * (np.log(k) + 2), total, out=np.zeros(n_docs), where=total > 0)
    todo = total > 0
    while todo.any():
        live = todo[doc]
        d0, e0, w0 = doc[live], element[live], weight[live]
        found = []
        strip, low = 0, 0.0
        while len(d0):
            width = 1.0 if strip < 2 else float(1 << (strip - 1))
            d, w, phi, rank = d0, w0, reach[d0], np.zeros(len(d0))
            seed = mix(e0 + U64(strip * 0xA0761D6478BD642F % (1 << 64)))
            j, size = 0, 1
            while len(d):  # darts are looked at in blocks of 1, 1, 2, 4, ... an element
                steps = np.array([n * int(GOLDEN) % (1 << 64) for n in range(j + 1, j + size + 1)], U64)
                dart = mix(seed[:, None] + steps)
                ranks = rank[:, None] + np.cumsum(-np.log(_unit(dart)) / width, axis=1)
                row, column = np.nonzero(ranks < phi[:, None])
                ident = mix(dart[row, column] ^ U64(0x8EBC6AF09C88C6E3))
                hit = low + _unit(mix(ident + GOLDEN)) * width < w[row]
                row, column, ident = row[hit], column[hit], ident[hit]
                found.append((d[row], ranks[row, column] / phi[row], ident))
                on = ranks[:, -1] < phi
                d, w, phi, rank, seed = d[on], w[on], phi[on], ranks[on, -1], seed[on]
                size, j = min(64, max(1, j + size)), j + size
            low += width
            strip += 1
            more = w0 > low
            d0, e0, w0 = d0[more], e0[more], w0[more]
        d, rank, ident = (np.concatenate(x) for x in zip(*found, strict=True))
        coordinate = (ident >> U64(40)) % U64(k)
        cell = d * k + coordinate.astype(np.int64)
        least = np.full(n_docs * k, np.inf)
        np.minimum.at(least, cell, rank)
        filled = least < np.inf
        values = np.zeros(n_docs * k, U64)
        at = np.flatnonzero(rank == least[cell])
        values[cell[at]] = ident[at]
        whole = todo & filled.reshape(n_docs, k).all(axis=1)
        signature[whole] = values.reshape(n_docs, k)[whole]
        todo &= ~whole
        reach[todo] *= 2
    return signature


SIGNED = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("sig", pa.binary())])


def _sign(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in chunks_by_bytes(batch.column("norm").to_pylist(), CHUNK):
                doc, element, weight = weighted_sets(*shingles(texts))
                signature = (dart_signatures(doc, element, weight, len(texts), k) & U64(0xFF)).astype(np.uint8)
                part = batch.slice(at, len(texts))
                yield arrow(SIGNED, rid=part.column("rid"), doc_id=part.column("doc_id"), digest=part.column("digest"), sig=[row.tobytes() if t else None for t, row in zip(texts, signature, strict=True)])

    return sign


PAIRED = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _pairs(rows: int, bands: int, floor: float):
    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a bucket whose signatures agree enough; a pair that shares several bands comes from the first of them."""
        k = rows * bands
        for t in grouped(batches, ["band", "bucket"]):
            t = t.combine_chunks()
            band = t.column("band").to_numpy()
            bucket, digest = t.column("bucket").to_pylist(), t.column("digest").to_pylist()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, k)
            starts = [i for i in range(len(bucket)) if not i or bucket[i] != bucket[i - 1] or band[i] != band[i - 1]]
            a, b = [], []
            for lo, hi in zip(starts, [*starts[1:], len(bucket)], strict=True):
                m = int(band[lo])
                for i in range(lo, hi - 1):
                    for at in range(i + 1, hi, 1 << 14):
                        same = sig[at : min(hi, at + (1 << 14))] == sig[i]
                        near = same.mean(axis=1) >= floor
                        if m:
                            near &= ~same[:, : m * rows].reshape(len(same), m, rows).all(axis=2).any(axis=1)
                        for j in np.flatnonzero(near):
                            x, y = digest[i], digest[at + j]
                            a.append(min(x, y))
                            b.append(max(x, y))
                if len(a) > 1 << 15:
                    yield arrow(PAIRED, a=a, b=b)
                    a, b = [], []
            if a:
                yield arrow(PAIRED, a=a, b=b)

    return pairs


SETS = pa.schema([("digest", pa.binary()), ("bag", pa.binary())])


def bag(h: np.ndarray) -> np.ndarray:
    """A multiset of hashes as a sorted set: the n-th occurrence of a hash has a hash of its own."""
    h = np.sort(h)
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    turn = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return np.sort(np.where(turn > 0, mix(h + turn.astype(U64)), h))


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, texts in chunks_by_bytes(batch.column("norm").to_pylist(), CHUNK):
            doc, h = shingles(texts)
            ends = np.cumsum(np.bincount(doc, minlength=len(texts)))
            yield arrow(SETS, digest=batch.column("digest").slice(at, len(texts)), bag=[bag(h[lo:hi]).tobytes() for lo, hi in zip([0, *ends[:-1]], ends, strict=True)])


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two bags."""
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / max(1, len(x) + len(y) - common)


LINKED = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("similarity", pa.float64())])


def _verify(threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)
            score = np.array([weighted_jaccard(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)) for x, y in bags])
            keep = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(score[score >= threshold], pa.float64())], schema=LINKED)

    return verify


def _spanning(threshold: float):
    def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each cell by exact comparison, without pairs that are joined by others of the cell already."""
        for t in grouped(batches, ["band", "bucket", "i", "j"], 1024):
            key = list(zip(*(t.column(c).to_pylist() for c in ("band", "bucket", "i", "j")), strict=True))
            digest, bags = t.column("digest").to_pylist(), [np.frombuffer(x, U64) for x in t.column("bag").to_pylist()]
            a, b, score = [], [], []
            starts = [i for i in range(len(key)) if not i or key[i] != key[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(key)], strict=True):
                size = np.array([len(x) for x in bags[lo:hi]])
                every, ends = np.concatenate(bags[lo:hi]), np.cumsum(size)
                owner = np.repeat(np.arange(hi - lo), size)
                group = np.arange(hi - lo)
                for i in range(hi - lo - 1):
                    # later ones of other groups, and of a size that can reach the threshold
                    ask = (group != group[i]) & (size >= threshold * size[i]) & (size * threshold <= size[i])
                    ask[: i + 1] = False
                    if not ask.any():
                        continue
                    own = bags[lo + i]
                    rest = every[ends[i] :]
                    place = np.minimum(np.searchsorted(own, rest), len(own) - 1)
                    common = np.bincount(owner[ends[i] :][own[place] == rest], minlength=hi - lo)
                    similar = common / (size + size[i] - common)
                    for j in np.flatnonzero(ask & (similar >= threshold)):
                        if group[j] != group[i]:
                            group[group == group[j]] = group[i]
                            a.append(min(digest[lo + i], digest[lo + j]))
                            b.append(max(digest[lo + i], digest[lo + j]))
                            score.append(float(similar[j]))
            yield arrow(LINKED, a=a, b=b, similarity=score)

    return spanning


def signatures(docs: DataFrame, rows: int = ROWS, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(rid, doc_id, digest, sig): sig is null for a text without words. rid numbers the rows of docs as they are scanned."""
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"), normal_text(F.col(text)).alias("norm"))
    base = base.select("rid", "doc_id", "norm", F.unhex(F.md5("norm")).alias("digest"))
    return base.transform(arrow_map(_sign(rows * bands), "rid long, doc_id long, digest binary, sig binary"))


def links(docs: DataFrame, signed: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, text: str = "text", dense: int = DENSE) -> DataFrame:
    """(a, b, similarity): links between different normal texts that reach the threshold; a and b are digests.

    Of the pairs that share a band, all that reach the threshold are in one component of the links; links that join
    what is joined already may be absent. signed is read several times: a checkpoint of signatures(docs).
    """
    classes = signed.where("sig is not null").groupBy("digest").agg(F.min("sig").alias("sig"))
    light = classes.select("digest", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"), "sig")
    light = light.select("digest", "band", F.expr(f"substring(sig, band * {rows} + 1, {rows})").alias("bucket"))
    shared = cut(light.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("band", "bucket"))).where("n > 1"))
    few, many = shared.where(F.col("n") <= dense).drop("n"), shared.where(F.col("n") > dense)
    full = few.join(classes, "digest").repartition("band", "bucket").sortWithinPartitions("band", "bucket", "digest")
    pairs = cut(full.transform(arrow_map(_pairs(rows, bands, threshold - MARGIN), "a binary, b binary")).distinct())
    needed = cut(pairs.select(F.col("a").alias("digest")).union(pairs.select("b")).union(many.select("digest")).distinct())
    texts = docs.select(normal_text(F.col(text)).alias("norm")).select(F.unhex(F.md5("norm")).alias("digest"), "norm")
    texts = join_bounded(texts, needed, ["digest"], "left_semi", BROADCAST_ROWS).groupBy("digest").agg(F.min("norm").alias("norm"))
    bags = cut(texts.transform(arrow_map(_bags, "digest binary, bag binary")))
    both = pairs.join(bags.select(F.col("digest").alias("a"), F.col("bag").alias("bag_a")), "a").join(bags.select(F.col("digest").alias("b"), F.col("bag").alias("bag_b")), "b")
    thin = both.select("a", "b", "bag_a", "bag_b").transform(arrow_map(_verify(threshold), "a binary, b binary, similarity double"))
    parts = many.withColumn("parts", F.ceil(F.col("n") / CELL).cast("int"))
    parts = parts.withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = parts.select("band", "bucket", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "digest")
    keys = ["band", "bucket", "i", "j"]
    thick = cells.join(bags, "digest").repartition(*keys).sortWithinPartitions(*keys, "digest").transform(arrow_map(_spanning(threshold), "a binary, b binary, similarity double"))
    return thin.union(thick)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, bands: int = BANDS, text: str = "text", doc_id: str = "doc_id", dense: int = DENSE) -> DataFrame:
    """One row for each row of docs: rid, doc_id, class_id, class_size, keep.

    class_id is the smallest doc_id of the class (null only if all are null); class_size counts its rows. keep marks one row of each class: one with the smallest doc_id, of those the
    first scanned. Texts that are equal but for case and white space are of one class. Null and empty texts, and texts
    without words, are alike nothing: each is a class of its own. Repeated rows are copies. Other columns are ignored.
    """
    signed = cut(signatures(docs, rows, bands, text, doc_id))
    found = cut(links(docs, signed, threshold, rows, bands, text, dense))
    roots = connected_components(found).withColumnRenamed("node", "digest")
    alone = signed.where("sig is null").select("rid", "doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("keep"))
    texts = signed.where("sig is not null").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("n"))
    texts = texts.join(roots, "digest", "left").select("digest", F.coalesce("root", "digest").alias("root"), "best", "n")
    groups = texts.groupBy("root").agg(F.min("best").alias("first"), F.sum("n").alias("class_size"))
    of_text = texts.join(groups, "root").select("digest", F.col("first.doc_id").alias("class_id"), F.col("first.rid").alias("kept"), "class_size")
    member = signed.where("sig is not null").select("rid", "doc_id", "digest").join(of_text, "digest")
    return member.select("rid", "doc_id", "class_id", "class_size", (F.col("rid") == F.col("kept")).alias("keep")).union(alone)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with the same columns. docs must be scanned in the same way twice (read from files).

    Of each class the row with the smallest doc_id stays, nulls last, of equal ones the first scanned. Null and empty texts, and texts without words, all
    stay. Texts of any length are compared whole. An empty table stays empty; other columns, of whatever name, come along as they are.
    """
    kept = near_duplicates(docs, **options).where("keep").select("rid")
    name = "_sievework_rid"
    return docs.withColumn(name, F.monotonically_increasing_id()).join(kept.withColumnRenamed("rid", name), name, "left_semi").drop(name)
