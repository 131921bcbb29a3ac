"""Documents drawn by how much likelier their word runs are in a target text than in the corpus.

Features are the runs of one to three consecutive words, hashed into buckets by CRC-32. A partition's texts are read in
blocks; each block makes a trie of its words: a node for every word, below it one for every word that follows it, and
again one for every word that follows those. A node holds how often its run occurs and the CRC state of the run, which
follows from its parent's state and its word alone, so that a run is hashed once however often it occurs, and longer
runs aren't hashed anew. Tries are columns: a level is a table of distinct (parent, word) pairs.

Counts of nodes are summed by bucket, within the partition first, and the buckets' totals of corpus and target give
each bucket its gain. To score, tries are built again, gains are attached to the nodes, and each document walks its
words' paths. Draws are ranked by a range-partitioned sort; no task sees all of them.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow, arrow_map, cut, utf8

N_BUCKETS = 10_000
RUN = 3
LEAST_WORDS = 20
PER_HUNDRED = 5
BLOCK = 3_000_000  # bytes of a trie's texts; longer texts are cut into pieces that overlap by two words
SEED = 42

#: A byte of a word (digits, a-z, all of UTF-8 beyond ASCII) as itself, A-Z in lower case, all others 0.
_WORD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0 for b in range(256)], np.uint8)
_BYTE_STEP = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Applies a linear map of 32 bits, given by its values on each byte."""
    return tables[0][state & 0xFF] ^ tables[1][state >> 8 & 0xFF] ^ tables[2][state >> 16 & 0xFF] ^ tables[3][state >> 24]


@lru_cache(maxsize=64)
def _doubled(k: int) -> np.ndarray:
    """What 2**k zero bytes do to a CRC state."""
    if not k:
        state = np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]
        return state >> 8 ^ _BYTE_STEP[state & 0xFF]
    half = _doubled(k - 1)
    return _through(half, half)


@lru_cache(maxsize=4096)
def _shift(n: int) -> np.ndarray:
    """What n zero bytes, n at least 1, do to a CRC state."""
    tables, k = None, 0
    while n:
        if n & 1:
            tables = _doubled(k) if tables is None else _through(_doubled(k), tables)
        n, k = n >> 1, k + 1
    return tables


def _append(states: np.ndarray, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of runs, each followed by a string of which the CRC and the length are given."""
    out = np.empty(len(states), np.uint32)
    order = np.argsort(length.astype(np.uint16) if length.max(initial=0) < 1 << 16 else length, kind="stable")  # short numbers sort in linear time
    ends = np.flatnonzero(np.diff(length[order], append=-1)) + 1
    for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=False):
        at = order[lo:hi]
        out[at] = _through(_shift(int(length[at[0]])), states[at])
    return out ^ crc


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, place of each key's value)."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Words:
    """The words of pieces of texts: for each its piece, where it begins there and which of the distinct ones it is."""

    def __init__(self, pieces: list[memoryview]):
        joined = np.frombuffer(b"\x00".join(pieces), np.uint8)
        letters = _WORD[joined]
        inside = np.concatenate([[False], letters != 0, [False]])
        turns = np.flatnonzero(inside[1:] != inside[:-1])
        begins, ends = turns[::2], turns[1::2]
        starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])]) if pieces else np.zeros(0, np.int64)
        self.piece = np.searchsorted(starts, begins, side="right") - 1
        self.begins = begins - starts[self.piece] if len(begins) else begins
        offsets = np.concatenate([[0], np.cumsum(ends - begins)]).astype(np.int64)
        column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(letters[letters != 0])])
        found = column.dictionary_encode()
        self.word, self.distinct = found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


class Trie:
    """The levels of a word trie: for each, every place's node and the nodes' CRC states; places are where a run may begin."""

    def __init__(self, words: Words, counted: np.ndarray, run: int = RUN):
        """counted: for each word, whether runs that begin there count (not those of words that belong to the next piece)."""
        alone = np.array([zlib.crc32(w) for w in words.distinct], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in words.distinct], np.uint32)
        length = np.array([len(w) + 1 for w in words.distinct], np.int64)
        place, node, state = np.flatnonzero(counted), words.word[counted], alone
        self.levels = [(place, node, state)]
        for step in range(1, run):
            on = place + step < len(words.piece)
            place, node = place[on], node[on]
            on = words.piece[place + step] == words.piece[place]
            place, node = place[on], node[on]
            pairs, node = _distinct(node * len(words.distinct) + words.word[place + step])
            parent, last = np.divmod(pairs, max(1, len(words.distinct)))
            state = _append(state[parent], spaced[last], length[last])
            self.levels.append((place, node, state))


def _pieces(text: memoryview, block: int, run: int) -> Iterator[tuple[memoryview, int]]:
    """Cuts a long text between words: (piece, where runs that are its own begin at most). The words behind that place, with
    which such runs may end, are those that the next piece begins with. A word longer than block stays whole."""
    at, n = 0, len(text)
    while n - at > block:
        end = at + block
        while end < n and _WORD[text[end]]:
            end += 1
        stop = end
        for _ in range(run - 1):
            while stop < n and not _WORD[text[stop]]:
                stop += 1
            while stop < n and _WORD[text[stop]]:
                stop += 1
        yield text[at:stop], end - at
        at = end
    yield text[at:], n - at


def tries(texts: list[memoryview], run: int = RUN, block: int = BLOCK) -> Iterator[tuple[np.ndarray, Trie]]:
    """(the text of each word, trie) by blocks of about block bytes."""

    def trie() -> tuple[np.ndarray, Trie]:
        words = Words(pieces)
        return np.array(owners, np.int64)[words.piece], Trie(words, words.begins < np.array(own, np.int64)[words.piece], run)

    owners, pieces, own, size = [], [], [], 0
    for i, text in enumerate(texts):
        for piece, until in _pieces(text, block, run):
            if size and size + len(piece) > block:
                yield trie()
                owners, pieces, own, size = [], [], [], 0
            owners.append(i)
            pieces.append(piece)
            own.append(until)
            size += len(piece)
    if size:
        yield trie()


COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])


def bucket_counts(df: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS, run: int = RUN) -> DataFrame:
    """(bucket, n): how many features of all texts are in it; buckets without any are absent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, trie in tries(utf8(batch.column("text")), run):
                for _, node, state in trie.levels:
                    np.add.at(totals, (state % n_buckets).astype(np.int64), np.bincount(node, minlength=len(state)))
        filled = np.flatnonzero(totals)
        yield arrow(COUNTED, bucket=filled.astype(np.int32), n=totals[filled])

    parts = df.select(F.col(text).cast("string").alias("text")).transform(arrow_map(count, "bucket int, n long"))
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, text: str = "text", n_buckets: int = N_BUCKETS, run: int = RUN) -> np.ndarray:
    """What a feature of each bucket adds to a weight: the thousandfold log ratio of smoothed shares, rounded down."""
    found = []
    for df in (target, corpus):
        counts = np.zeros(n_buckets, np.int64)
        for bucket, n in bucket_counts(df, text, n_buckets, run).collect():  # n_buckets rows at most
            counts[bucket] = n
        found.append(counts.tolist())
    t_all, s_all = (sum(x) for x in found)
    return np.array([math.floor(1000 * math.log((t + 1) * float(s_all + n_buckets) / ((s + 1) * float(t_all + n_buckets)))) for t, s in zip(*found, strict=True)], np.int64)


SCORED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])


def weights(docs: DataFrame, gain: np.ndarray, text: str = "text", doc_id: str = "doc_id", run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row: the gains along the paths of its words, summed."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_features, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for owner, trie in tries(utf8(batch.column("text")), run):
                for level, (place, node, state) in enumerate(trie.levels):
                    attached = gain[(state % len(gain)).astype(np.int64)]
                    row = owner[place]
                    np.add.at(weight, row, attached[node])
                    n = np.bincount(row, minlength=batch.num_rows)
                    n_features += n
                    n_words += 0 if level else n
            yield arrow(SCORED, doc_id=batch.column("doc_id"), n_words=n_words, n_features=n_features, weight=weight)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map(score, "doc_id long, n_words long, n_features long, weight long"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Seeded Gumbel noise in thousandths, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, per_hundred: int = PER_HUNDRED, least_words: int = LEAST_WORDS, seed: int = SEED, text: str = "text", doc_id: str = "doc_id", n_buckets: int = N_BUCKETS, run: int = RUN) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score, rank.

    rank (1, 2, 3, ...) is that of the per_hundred of each hundred documents with least_words words or more that have the
    highest scores, ties to the smaller doc_id, then nulls, then as they are scanned; null for all others. Null and empty texts, and texts without words,
    have no features and weight 0. A null doc_id is hashed as the empty text. Repeated rows count each time, and their
    ranks are next to each other. An empty target gives all buckets its smoothed share. Other columns are ignored.
    """
    scored = weights(docs, gains(docs, target, text, n_buckets, run), text, doc_id, run)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("short", F.col("n_words") < least_words)
    scored = scored.withColumn("turn", F.xxhash64(F.monotonically_increasing_id()))  # spreads rows that are alike over tasks
    order = [F.col("short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("turn")]
    # Tasks hold ranges in order, and a checkpoint keeps both the tasks' order and that of their rows.
    ranged = cut(scored.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn")).withColumn("place", F.monotonically_increasing_id())
    ranged = ranged.withColumn("task", F.shiftright("place", 33))
    sizes = sorted(ranged.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("short")).alias("drawable")).collect())  # a row for each task
    before, starts = 0, []
    for task, n, _ in sizes:
        starts.append((task, before))
        before += n
    drawn = per_hundred * sum(x[2] for x in sizes) // 100
    starts = docs.sparkSession.createDataFrame(starts, "task long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    out = ranged.join(F.broadcast(starts), "task", "left")
    return out.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
