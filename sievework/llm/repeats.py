"""Removal of long repeated strings with a sparse enhanced suffix array, in bytes or in words.

Which suffixes enter the array is decided by the texts: every window of `length` units picks the gram of units in it
whose hash is least (its anchor), so that equal windows pick the same anchor at the same offset. Windows in a row that
pick one anchor form a run. Runs that are equal unit for unit repeat as a whole and need no comparison; only anchors
with several different runs do. For these, the suffixes at the anchors are sorted, common prefixes of neighbours are
scanned with a stack into the tree of common-prefix intervals, and in each interval the units left of the anchors are
compared: where they differ the repeat is maximal, and an occurrence's longest agreement with any other one of the
interval says which of its windows occur elsewhere. All occurrences of an interval take part, not just neighbours.

A unit is a byte, or a word (its hash; words lie between white space, which is not compared). A rule may ask for another
document to hold the string, so that repeats within one document stay. Several rules go through one pass.

An anchor with more than HOT different runs is not gathered in one task: its runs are cut into blocks of windows that
are counted by hash, and blocks whose middle repeats into single windows, counted likewise. Equality of runs is that of
two 64-bit hashes, of the anchor and of the whole run.

Texts are scanned once for runs, which are stored, and exchanged twice, by row number: to look up the runs that are
compared, and to take out what was found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievework.llm.common import U64, arrow, arrow_map, cut, discard, grouped, mix, scratch_path, utf8

HOT = 256
BLOCK, PART_BLOCK = 32, 8
CHUNK = 600_000
SEGMENT = 4_000_000


@dataclass(frozen=True)
class Rule:
    """Strings of `length` units that start elsewhere too; gram: units of an anchor, a power of two below length.

    across: only those that another row of the table holds as well.
    """

    length: int
    gram: int
    words: bool = False
    across: bool = False

    @property
    def item(self) -> int:
        """Bytes of a unit in a run."""
        return 8 if self.words else 1


BYTES = Rule(400, 64)
PASSAGES = Rule(51, 8, words=True, across=True)  # passages of over 50 words that another document holds

RUN = pa.schema([("rid", pa.int64()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("p", pa.int64()), ("nwin", pa.int32()), ("back", pa.int32())])
RUN_SQL = "rid long, anchor long, ctx long, p long, nwin int, back int"

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=U64))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def words_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of each word of UTF-8 bytes."""
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
    if len(_powers[0]) <= len(data):
        for i, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            _powers[i] = np.concatenate([np.ones(1, U64), np.cumprod(np.full(max(1 << 20, len(data)), base, U64))])
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[data] * _powers[0][: len(data)])])
    return mix((total[end] - total[start]) * _powers[1][start] + (end - start).astype(U64)), start, end


def text_words(text: memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words_of a text of any length, a part at a time; parts end between words."""
    data, at, parts = np.frombuffer(text, np.uint8), 0, []
    while at < len(data):
        to = min(len(data), at + 2 * CHUNK)
        while to < len(data) and not (space := _SPACE[data[to : to + CHUNK]]).any():
            to = min(len(data), to + CHUNK)
        if to < len(data):
            to += int(np.argmax(space))
        h, start, end = words_of(data[at:to])
        parts.append((h, start + at, end + at))
        at = to
    if not parts:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _batched(texts: list[memoryview], limit: int) -> Iterator[list[memoryview]]:
    """Texts dealt into lists of about limit bytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def units(texts: list[memoryview], words: bool) -> Iterator[np.ndarray]:
    """Each text's units: bytes, or hashes of words."""
    if not words:
        yield from (np.frombuffer(t, np.uint8) for t in texts)
        return
    for held in _batched(texts, CHUNK):
        if len(held) == 1 or sum(map(len, held)) >= 2 * CHUNK:
            yield from (text_words(t)[0] for t in held)
        else:
            h, start, _ = words_of(np.frombuffer(b" ".join(held), np.uint8))
            ends = np.cumsum([len(t) + 1 for t in held])
            yield from np.split(h, np.searchsorted(start, ends[:-1]))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each window of gram units (a power of two), by doubling."""
    h = mix(data.astype(U64) + U64(1))
    size, odd = 1, 0xC2B2AE3D27D4EB4F
    while size < gram:
        right = h[size:]
        h = h[:-size] * U64(odd) + (right ^ (right >> U64(29)))
        size, odd = 2 * size, (odd * 0x9E3779B97F4A7C15 + 2) % (1 << 64) | 1
    return mix(h)


def find_runs(data: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of the windows of length units that lie within one text each: (start, windows, anchor's place, anchor's hash).

    data holds the units of texts one after the other, ends their ends; it must be shorter than 2**24.
    """
    nothing = (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    span = length - gram + 1
    if len(data) < length:
        return nothing
    h = gram_hashes(data, gram)
    least = (h & U64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=U64)
    n, width = len(h) - span + 1, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[:n], least[span - width : span - width + n])
    place = (least & U64(0xFFFFFF)).astype(np.int64)
    end = np.repeat(ends, np.diff(np.concatenate([[0], ends])))[:n]
    inside = np.arange(n) + length <= end
    new = inside.copy()
    new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
    start = np.flatnonzero(new)
    if not len(start):
        return nothing
    windows = np.add.reduceat(inside, start)
    return start, windows, place[start], h[place[start]]


def _pieces(texts: Iterable[np.ndarray], length: int, chunk: int) -> Iterator[tuple[list[int], list[int], list[np.ndarray]]]:
    """Deals texts into chunks of (text's position, offset there, units). Very long texts come in segments that overlap by length - 1."""
    where, offset, held, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), SEGMENT):
            part = t if len(t) <= SEGMENT else t[at : at + SEGMENT + length - 1]
            if len(part) < length:
                continue
            where.append(i)
            offset.append(at)
            held.append(part)
            size += len(part)
            if size >= chunk:
                yield where, offset, held
                where, offset, held, size = [], [], [], 0
    if held:
        yield where, offset, held


def _runs(rules: list[Rule]):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("_text"))
            rid = batch.column("rid").to_numpy()
            for number, rule in enumerate(rules):
                for where, offset, parts in _pieces(units(texts, rule.words), rule.length, CHUNK // (4 if rule.words else 1)):
                    data, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
                    start, windows, place, anchor = find_runs(data, ends, rule.length, rule.gram)
                    part = np.searchsorted(ends, start, side="right")
                    first = np.concatenate([[0], ends[:-1]])[part]
                    raw, size = memoryview(data.tobytes()), rule.item
                    ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[s:e]) for s, e in zip((start * size).tolist(), ((start + windows + rule.length - 1) * size).tolist(), strict=True)), U64, len(start))
                    anchor = anchor & ~U64(1) | U64(number)  # the last bit says which rule it is
                    yield arrow(RUN, rid=rid[np.array(where)[part]], anchor=anchor.view(np.int64), ctx=ctx.view(np.int64), p=start - first + np.array(offset)[part], nwin=windows.astype(np.int32), back=(place - start).astype(np.int32))

    return runs


CONTEXT = pa.schema([("rule", pa.int32()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("owner", pa.int64()), ("back", pa.int32()), ("nwin", pa.int32()), ("right", pa.binary()), ("left", pa.binary())])
CONTEXT_SQL = "rule int, anchor long, ctx long, owner long, back int, nwin int, right binary, left binary"


def _turned(run: bytes, item: int) -> bytes:
    """A run's units from last to first."""
    return run[::-1] if item == 1 else np.frombuffer(run, U64)[::-1].tobytes()


def _contexts(rules: list[Rule]):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The units of the runs asked for: from the anchor on, and backwards before it."""
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in CONTEXT}
            for text, asked in zip(utf8(batch.column("text")), batch.column("asked"), strict=True):
                own: dict[int, np.ndarray] = {}
                for x in asked.as_py():
                    rule = rules[x["rule"]]
                    if x["rule"] not in own:
                        own[x["rule"]] = text_words(text)[0] if rule.words else np.frombuffer(text, np.uint8)
                    run = own[x["rule"]][x["p"] : x["p"] + x["nwin"] + rule.length - 1].tobytes()
                    if _signed(xxhash.xxh3_64_intdigest(run)) != x["ctx"]:
                        raise ValueError("a run was asked for in a text that does not have it")
                    for f in ("rule", "anchor", "ctx", "owner", "back", "nwin"):
                        rows[f].append(x[f])
                    rows["right"].append(run[x["back"] * rule.item :])
                    rows["left"].append(_turned(run[: x["back"] * rule.item], rule.item))
                if len(rows["ctx"]) >= 4096:
                    yield arrow(CONTEXT, **rows)
                    rows = {f.name: [] for f in CONTEXT}
            yield arrow(CONTEXT, **rows)

    return contexts


def common_prefix(a: bytes, b: bytes, item: int = 1) -> int:
    """Of two strings of units."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high // item
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low // item


def prefix_intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """(common prefix, first, last) of each node of the interval tree over sorted suffixes, children before parents.

    lcp[i] is the common prefix of suffixes i - 1 and i; lcp[0] is not used. Nodes have two suffixes at least.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        here, first = (lcp[i] if i < len(lcp) else -1), i - 1
        while stack and stack[-1][0] > here:
            depth, first = stack.pop()
            yield depth, first, i - 1
        if not stack or stack[-1][0] < here:
            stack.append((here, first))


class AnchorTree:
    """The suffixes at one anchor, sorted by rights, with the interval tree of their common prefixes.

    lefts hold the units before the anchors, backwards.
    """

    def __init__(self, rights: list[bytes], lefts: list[bytes], length: int, item: int = 1):
        n = len(rights)
        self.length = length
        self.lcp = [0, *(common_prefix(rights[i - 1], rights[i], item) for i in range(1, n))]
        self.by_left = sorted(range(n), key=lefts.__getitem__)
        self.rank = [0] * n
        for r, i in enumerate(self.by_left):
            self.rank[i] = r
        self.lcs = [0, *(common_prefix(lefts[self.by_left[r - 1]], lefts[self.by_left[r]], item) for r in range(1, n))]

    def nodes(self) -> Iterator[tuple[int, int, list[int], list[int]]]:
        """(common units from the anchor on, units that a window needs before it, members by what is left of them, agreement there of neighbours)."""
        for depth, first, last in prefix_intervals(self.lcp):
            members = sorted(self.rank[first : last + 1])
            agree = [min(self.lcs[x + 1 : y + 1]) for x, y in zip(members, members[1:], strict=False)]
            yield depth, max(0, self.length - depth), [self.by_left[r] for r in members], agree

    def repeated(self, owners: list[int | None]) -> list[set[tuple[int, int]]]:
        """The windows of each suffix that a suffix of another owner has too; None is the owner of one that has several.

        A window is given by how many of its units lie before the anchor, as ranges (from, to).
        """
        found: list[set[tuple[int, int]]] = [set() for _ in owners]
        for _, least, members, agree in self.nodes():
            best = _longest([owners[i] for i in members], agree)
            for i, most in zip(members, best, strict=True):
                if most >= least:
                    found[i].add((least, most))
        return found

    def maximal_repeats(self) -> Iterator[tuple[int, int, list[int]]]:
        """(units before the anchor, units from it on, all occurrences) of each repeat of `length` units or more that cannot be extended.

        Its occurrences are followed by different units, being an interval, and preceded by different ones: of an interval's
        members, those that agree to the left as far as it goes are a node of the tree of common prefixes to the left, too.
        """
        for depth, least, members, agree in self.nodes():
            for left, first, last in prefix_intervals([0, *agree]):
                held = sorted(members[first : last + 1])
                if left >= least and min(self.lcp[held[0] + 1 : held[-1] + 1]) == depth:
                    yield left, depth, held


def _longest(owners: list[int | None], agree: list[int]) -> list[int]:
    """For each member its longest agreement with one of another owner, -1 if there is none; agree is that of neighbours."""
    best = [-1] * len(owners)
    for order in (range(1, len(owners)), range(len(owners) - 2, -1, -1)):
        near = -1
        for x in order:
            y = x - 1 if order.step > 0 else x + 1
            here = agree[min(x, y)]
            near = here if owners[y] is None or owners[y] != owners[x] else min(near, here)
            best[x] = max(best[x], near)
    return best


SPAN = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("w0", pa.int32()), ("w1", pa.int32())])
SPAN_SQL = "anchor long, ctx long, w0 int, w1 int"


def _trees(t: pa.Table, rules: list[Rule]) -> Iterator[tuple[AnchorTree, list[dict]]]:
    """Of a table sorted by (anchor, right), a tree and its suffixes for each anchor."""
    rows = t.to_pylist()
    starts = [i for i in range(len(rows)) if not i or rows[i]["anchor"] != rows[i - 1]["anchor"]]
    for lo, hi in zip(starts, [*starts[1:], len(rows)], strict=True):
        own, rule = rows[lo:hi], rules[rows[lo]["rule"]]
        yield AnchorTree([x["right"] for x in own], [x["left"] for x in own], rule.length, rule.item), own


def _compare(rules: list[Rule]):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of each run that other runs of its anchor have. Rows come sorted by (anchor, right)."""
        for t in grouped(batches, ["anchor"], 4096):
            rows: dict[str, list] = {f.name: [] for f in SPAN}
            for tree, own in _trees(t, rules):
                for x, ranges in zip(own, tree.repeated([x["owner"] for x in own]), strict=True):
                    for least, most in ranges:
                        a, b = max(least, x["back"] - x["nwin"] + 1), min(most, x["back"])
                        if a <= b:
                            for c, v in zip(rows, (x["anchor"], x["ctx"], x["back"] - b, x["back"] - a), strict=True):
                                rows[c].append(v)
            yield arrow(SPAN, **rows)

    return compare


GROUP = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("group_id", pa.int64()), ("w", pa.int32()), ("size", pa.int32())])
GROUP_SQL = "anchor long, ctx long, group_id long, w int, size int"


def _groups(rules: list[Rule]):
    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of each maximal repeat, with where it begins in the run. Rows come sorted by (anchor, right)."""
        for t in grouped(batches, ["anchor"], 4096):
            rows: dict[str, list] = {f.name: [] for f in GROUP}
            for tree, own in _trees(t, rules):
                for left, depth, members in tree.maximal_repeats():
                    name = _signed(xxhash.xxh3_64_intdigest(f"{own[0]['anchor']}|{left}|{depth}|{own[members[0]]['ctx']}".encode()))
                    for i in members:
                        for c, v in zip(rows, (own[i]["anchor"], own[i]["ctx"], name, own[i]["back"] - left, left + depth), strict=True):
                            rows[c].append(v)
            yield arrow(GROUP, **rows)

    return groups


PART = pa.schema([("rule", pa.int32()), ("anchor", pa.int64()), ("ctx", pa.int64()), ("owner", pa.int64()), ("w0", pa.int32()), ("w1", pa.int32()), ("core", pa.int64()), ("whole", pa.int64()), ("left", pa.binary()), ("right", pa.binary())])
PART_SQL = "rule int, anchor long, ctx long, owner long, w0 int, w1 int, core long, whole long, left binary, right binary"


def _whole(left: bytes, right: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(len(left).to_bytes(4, "little") + left + right))


def _blocks(rules: list[Rule]):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs cut into blocks of windows; a block's core are the units that all its windows share, left and right the others."""
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in PART}
            for x in batch.to_pylist():
                rule = rules[x["rule"]]
                run, size = _turned(x["left"], rule.item) + x["right"], rule.item
                w = 0
                while w < x["nwin"]:
                    number = (x["back"] - w) // BLOCK  # blocks are numbered by units before the anchor
                    until = min(x["nwin"] - 1, x["back"] - number * BLOCK)
                    core = x["back"] - number * BLOCK  # where the units begin that all windows of a whole block share
                    end = core + rule.length - BLOCK + 1
                    name = x["anchor"].to_bytes(8, "little", signed=True) + number.to_bytes(8, "little")
                    key, left, right = xxhash.xxh3_64_intdigest(name + run[core * size : end * size]), run[w * size : core * size], run[end * size : (until + rule.length) * size]
                    for c, v in zip(rows, (x["rule"], x["anchor"], x["ctx"], x["owner"], w, until, _signed(key), _whole(left, right), left, right), strict=True):
                        rows[c].append(v)
                    w = until + 1
            yield arrow(PART, **rows)

    return blocks


def _sub_blocks(rules: list[Rule]):
    def sub_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks cut into smaller ones; what is known of a block's core is its key."""
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in PART}
            for x in batch.to_pylist():
                size = rules[x["rule"]].item
                left, right, w, lefts = x["left"], x["right"], x["w0"], len(x["left"]) // size
                while w <= x["w1"]:
                    before = lefts - (w - x["w0"])  # units of the window before the block's core
                    number = before // PART_BLOCK
                    until = min(x["w1"], w + before - number * PART_BLOCK)
                    inner, outer = lefts - number * PART_BLOCK, BLOCK - (number + 1) * PART_BLOCK
                    key = xxhash.xxh3_64_intdigest(x["core"].to_bytes(8, "little", signed=True) + number.to_bytes(4, "little") + left[inner * size :] + right[: outer * size])
                    own_left, own_right = left[(w - x["w0"]) * size : inner * size], right[outer * size : (BLOCK - 1 - before + until - w) * size]
                    for c, v in zip(rows, (x["rule"], x["anchor"], x["ctx"], x["owner"], w, until, _signed(key), _whole(own_left, own_right), own_left, own_right), strict=True):
                        rows[c].append(v)
                    w = until + 1
            yield arrow(PART, **rows)

    return sub_blocks


WINDOW = pa.schema([("anchor", pa.int64()), ("ctx", pa.int64()), ("owner", pa.int64()), ("w0", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())])
WINDOW_SQL = "anchor long, ctx long, owner long, w0 int, h1 long, h2 long"


def _singles(rules: list[Rule]):
    def singles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A hash of each window of blocks: of the block's core and the window's units beside it."""
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in WINDOW}
            for x in batch.to_pylist():
                size = rules[x["rule"]].item
                core, before = x["core"].to_bytes(8, "little", signed=True), len(x["left"]) // size
                for i in range(x["w1"] - x["w0"] + 1):
                    h = xxhash.xxh3_128_intdigest(core + (before - i).to_bytes(4, "little") + x["left"][i * size :] + x["right"][: (PART_BLOCK - 1 - before + i) * size])
                    for c, v in zip(rows, (x["anchor"], x["ctx"], x["owner"], x["w0"] + i, _signed(h >> 64), _signed(h & (1 << 64) - 1)), strict=True):
                        rows[c].append(v)
            yield arrow(WINDOW, **rows)

    return singles


#: Over rows with an owner (null: several): whether there are two that are not one owner's alone, and the owner of all.
_TWO = "count(1) > 1 and (count(owner) < count(1) or min(owner) <> max(owner))"
_OWNER = "case when count(owner) = count(1) and min(owner) = max(owner) then min(owner) end"


@dataclass
class Repeats:
    """Places of runs that repeat or have to be compared; the units of the latter, by anchor and by crowded anchor."""

    places: DataFrame
    cold: DataFrame
    crowded: DataFrame
    is_crowded: bool


RULE_SQL = "cast(anchor & 1 as int)"


def _shared(runs: DataFrame, across: Column) -> DataFrame:
    """Runs whose anchor occurs elsewhere (in another row, where the rule wants that)."""
    key = F.when(across, F.col("rid")).otherwise(F.xxhash64("rid", "p"))
    anchors = runs.select("anchor", key.alias("key")).groupBy("anchor").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
    return runs.join(cut(anchors.select("anchor")), "anchor")  # cut, so that the join can split an anchor that very many runs have


def _with_kinds(runs: DataFrame, across: Column) -> DataFrame:
    """Runs that repeat or have to be compared, with how many different ones their anchor has, and whose they are."""
    kinds = runs.groupBy("anchor", "ctx").agg(F.count(F.lit(1)).alias("times"), F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    kinds = kinds.select("anchor", "ctx", F.when(across, F.col("lo") < F.col("hi")).otherwise(F.col("times") > 1).alias("repeated"), F.when(across & (F.col("lo") == F.col("hi")), F.col("lo")).alias("owner"))
    anchors = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.max("repeated").alias("any"), F.expr(_TWO).alias("two")).where("two or any").select("anchor", "kinds")
    kinds = kinds.join(anchors, "anchor").where("kinds > 1 or repeated")
    return runs.join(kinds, ["anchor", "ctx"]).withColumn("rule", F.expr(RULE_SQL))


def _places(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    spark, least = texts.sparkSession, min(2 * r.length - 1 if r.words else r.length for r in rules)
    across = F.expr(RULE_SQL).isin([i for i, r in enumerate(rules) if r.across] or [-1])
    paths = [scratch_path(spark, name) for name in ("runs", "shared-runs")]
    texts.where(F.octet_length("_text") >= least).transform(arrow_map(_runs(rules), RUN_SQL)).write.parquet(paths[0])
    read = lambda path: spark.read.schema(RUN_SQL).parquet(path)
    _shared(read(paths[0]), across).write.parquet(paths[1])
    discard(spark, paths[0])
    places = cut(_with_kinds(read(paths[1]), across))
    discard(spark, paths[1])
    return places


def _asked(places: DataFrame) -> DataFrame:
    """One place of each run that has to be compared."""
    asked = places.where("kinds > 1").groupBy("anchor", "ctx").agg(F.min(F.struct("rid", "p", "nwin", "back", "kinds", "rule", "owner")).alias("x"))
    return cut(asked.select("anchor", "ctx", "x.*"))


def _find(texts: DataFrame, rules: list[Rule], hot: int) -> Repeats:
    places = _places(texts, rules)
    asked = _asked(places)

    def contexts(of: DataFrame) -> DataFrame:
        lists = of.groupBy("rid").agg(F.collect_list(F.struct("rule", "anchor", "ctx", "owner", "p", "nwin", "back")).alias("asked"))
        return texts.join(lists, "rid").select(F.col("_text").alias("text"), "asked").transform(arrow_map(_contexts(rules), CONTEXT_SQL))

    cold = contexts(asked.where(F.col("kinds") <= hot)).repartition("anchor").sortWithinPartitions("anchor", "right", "ctx")
    crowded = asked.where(F.col("kinds") > hot)
    return Repeats(places, cold, contexts(crowded), crowded.limit(1).count() > 0)


def _block_spans(found: Repeats, rules: list[Rule]) -> list[DataFrame]:
    """Repeated windows of anchors with many runs."""
    blocks = cut(found.crowded.transform(arrow_map(_blocks(rules), PART_SQL)))

    def repeated(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Blocks that repeat as a whole, and, where a core has several wholes, those that do not and one of each that does."""
        one = F.min(F.struct("rule", "anchor", "ctx", "w0", "w1", "left", "right")).alias("one")
        wholes = cut(blocks.groupBy("core", "whole").agg(F.expr(_TWO).alias("two"), one))
        several = wholes.groupBy("core").agg(F.count(F.lit(1)).alias("wholes")).where("wholes > 1").select("core")
        whole = blocks.join(wholes.where("two").select("core", "whole"), ["core", "whole"], "left_semi")
        alone = blocks.join(wholes.where("not two").join(several, "core").select("core", "whole"), ["core", "whole"], "left_semi")
        shared = wholes.where("two").join(several, "core").select("one.rule", "one.anchor", "one.ctx", F.lit(None).cast("long").alias("owner"), "one.w0", "one.w1", "core", "whole", "one.left", "one.right")
        return whole.select("anchor", "ctx", "w0", "w1"), alone.select(*shared.columns).union(shared)

    large, rest = repeated(blocks)
    small, rest = repeated(cut(rest.transform(arrow_map(_sub_blocks(rules), PART_SQL))))
    singles = rest.transform(arrow_map(_singles(rules), WINDOW_SQL))
    twice = singles.groupBy("h1", "h2").agg(F.expr(_TWO).alias("two")).where("two").drop("two")
    return [large, small, singles.join(twice, ["h1", "h2"]).select("anchor", "ctx", "w0", F.col("w0").alias("w1"))]


def repeated_windows(texts: DataFrame, rules: list[Rule], hot: int = HOT) -> DataFrame:
    """(rid, spans0, spans1, ...): for each rule the ranges of places in a text at which a string starts that the rule takes.

    texts has rid and _text; it is scanned several times and must number its rows alike each time.
    """
    found = _find(texts, rules, hot)
    # each step is computed by itself, so that the texts that it exchanged are gone before the next one
    spans = cut(found.cold.transform(arrow_map(_compare(rules), SPAN_SQL)))
    if found.is_crowded:
        for more in _block_spans(found, rules):
            spans = spans.union(more)
    places = found.places
    compared = places.where("kinds > 1 and not repeated").select("rule", "rid", "p", "anchor", "ctx").join(spans, ["anchor", "ctx"])
    whole = places.where("repeated").select("rule", "rid", F.col("p").alias("first"), (F.col("p") + F.col("nwin") - 1).alias("last"))
    every = whole.union(compared.select("rule", "rid", F.col("p") + F.col("w0"), F.col("p") + F.col("w1")))
    return cut(every.groupBy("rid").agg(*(F.collect_list(F.when(F.col("rule") == i, F.struct("first", "last"))).alias(f"_spans{i}") for i in range(len(rules)))))


def repeat_groups(docs: DataFrame, rule: Rule = BYTES, text: str = "text", doc_id: str = "doc_id", hot: int = HOT) -> DataFrame:
    """(group_id, doc_id, row, start, size): every occurrence of each maximal repeat around an anchor, in units of the rule.

    A repeat is looked at within the windows of one anchor (up to length - 1 units to either side of the anchor's
    neighbours), so a longer one comes as several groups that overlap by length - 1 units or more. Runs that are
    equal and that nothing else of the anchor resembles are a group of their own. Anchors with more than `hot` different runs
    give groups of equal runs alone. Null texts are empty; an empty table gives none; other columns are ignored.
    `row` numbers the rows of docs. Groups nest, so a member of a deep tree is listed in each of its groups.
    """
    rule = replace(rule, across=False)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    found = _find(base, [rule], hot)
    places = found.places
    several = places.join(found.cold.transform(arrow_map(_groups([rule]), GROUP_SQL)), ["anchor", "ctx"]).select("group_id", "rid", (F.col("p") + F.col("w")).alias("start"), "size")
    equal = places.where("repeated").select(F.xxhash64("anchor", "ctx").alias("group_id"), "rid", F.col("p").alias("start"), (F.col("nwin") + (rule.length - 1)).alias("size"))
    ids = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"))
    return several.union(equal).join(ids, "rid").select("group_id", "doc_id", F.col("rid").alias("row"), "start", F.col("size").cast("int").alias("size"))


ADDED = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("n_passages", pa.int64()), ("passage_bytes", pa.int64())])
ADDED_SQL = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string, n_passages long, passage_bytes long"


def _ranges(text: memoryview, spans: pa.Scalar, rule: Rule) -> tuple[list[int], list[int]]:
    """From and to of each maximal stretch of bytes that the spans' windows cover."""
    if not spans.is_valid or not len(spans.values):
        return [], []
    lo, hi = (x.to_numpy(zero_copy_only=False) for x in spans.values.flatten())
    hi = hi + rule.length
    if rule.words:
        _, start, end = text_words(text)
        lo, hi = start[lo], end[hi - 1]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    gap = np.flatnonzero(lo[1:] > hi[:-1]) + 1
    return lo[np.concatenate([[0], gap])].tolist(), hi[np.concatenate([gap - 1, [len(hi) - 1]])].tolist()


def _strip(rules: list[Rule], columns: list[str], with_kept: bool):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[str, list] = {f.name: [] for f in ADDED}
            noted = batch.column("_spans1") if len(rules) > 1 else [None] * len(batch)
            for data, spans, more in zip(utf8(batch.column("_text")), batch.column("_spans0"), noted, strict=True):
                kept, at, removed = [], 0, 0
                first, last = _ranges(data, spans, rules[0])
                for a, b in zip(first, last, strict=True):
                    kept.append(data[at:a])
                    at, removed = b, removed + b - a
                kept.append(data[at:])
                rest = b"".join(kept)
                others = ([], []) if more is None else _ranges(data, more, rules[1])
                for c, v in zip(rows, (len(data), removed, len(first), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if with_kept else None, len(others[0]), sum(others[1]) - sum(others[0])), strict=True):
                    rows[c].append(v)
            new = arrow(ADDED, **rows)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in columns] + new.columns, names=columns + ADDED.names)

    return strip


def strip_repeats(docs: DataFrame, rule: Rule = BYTES, text: str = "text", with_kept: bool = False, noted: Rule | None = None, hot: int = HOT) -> DataFrame:
    """docs without the text, and n_bytes, n_removed, n_spans, kept_sha256 (and kept: the text left, without characters that were cut
    through) of each row's text.

    A byte goes if a string that the rule takes covers it: by default one of 400 bytes that starts anywhere else as well, in
    this text or in another. Strings are judged on the texts as they came. With `noted`, a second rule whose strings stay, there are
    n_passages (maximal stretches that its strings cover) and passage_bytes (their bytes). Null texts are empty;
    shorter texts than a string are left as they are; rows with equal texts lose all of it. A null or repeated doc_id makes no
    difference: rows count. Columns of docs that have names of the result's, or rid, _text or _spans0 and so on,
    are dropped. An empty table gives an empty table. docs is scanned several times, so it should be read from files.
    """
    rules = [rule, noted] if noted else [rule]
    own = {"rid", "_text", *(f"_spans{i}" for i in range(len(rules)))}
    rest = [c for c in docs.columns if c not in {*ADDED.names, text, *own}]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *(F.col(f"`{c}`") for c in rest))
    found = repeated_windows(base.select("rid", "_text"), rules, hot)
    joined = base.join(found, "rid", "left").drop("rid")
    schema = T.StructType([docs.schema[c] for c in rest] + T._parse_datatype_string(ADDED_SQL).fields)
    out = joined.transform(arrow_map(_strip(rules, rest, with_kept), schema))
    return out.drop(*([] if with_kept else ["kept"]), *([] if noted else ["n_passages", "passage_bytes"]))


def remove_repeats(docs: DataFrame, rule: Rule = PASSAGES, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """docs with each text's repeated passages taken out, and its characters counted anew; columns and rows as before.

    By default these are passages of over 50 words that another row holds as well, in whatever white space; all their
    occurrences go, and repeats within one row stay. Null texts stay null (0 characters); a text that is all repeated
    becomes its outer white space; equal rows lose the same. An empty table gives an empty table; columns of any names are kept.
    """
    names = {c: f"_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(f"`{c}`").alias("text" if c == text else n) for c, n in names.items()), F.col(f"`{text}`").isNull().alias("_absent"))
    out = strip_repeats(own, rule, with_kept=True)
    new = {text: F.when(~F.col("_absent"), F.col("kept"))}
    if n_chars in names:
        new[n_chars] = F.length("kept").cast(docs.schema[n_chars].dataType)
    return out.select(*(new.get(c, F.col(n)).alias(c) for c, n in names.items()))
