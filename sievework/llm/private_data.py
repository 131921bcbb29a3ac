"""Personal data in texts: fixed patterns, and boosted trees over candidates that patterns alone can't decide.

The base patterns give e-mail addresses, IP addresses, card numbers and phone numbers; their matches always stay.
Generators propose more, widely and with overlaps: addresses whose @ and dots are spelled out, IP addresses that are
defanged or in the long form, cards and phone numbers in other separators, without a plus sign, or run together with
the next number, which the base patterns drop. Each candidate is described by its format and by what stands around it;
gradient-boosted trees score it, and of candidates that overlap, the best over their kind's threshold is selected.

Nothing is labelled for this, so the trees are fitted (by Spark's own library) to a bounded sample of the corpus into
which personal data of many formats and numbers of other sorts are planted, at random places. The thresholds are
calibrated on a third of the sample that the trees don't see: the least score over which, in each kind, at least
PRECISION of the candidates are planted ones.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import arrow, arrow_map

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
CONTEXTS = 1500  # pieces of texts that the trees are fitted to, about; each has PLANTS things planted, one by one
PLANTS = 6
AROUND = 160  # characters of such a piece
TREES, DEPTH = 18, 4
PRECISION = 0.98
SEED = 13

# The base patterns, of which a match is an address, or is kept if its digits pass.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a run of digits that fails can't match from its middle
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = re.compile(r"[0-9]")


class Span(NamedTuple):
    start: int
    kind: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGITS.findall(text))


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @, so that long words take linear time."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            done = host.end()
            yield Span(start, EMAIL, done)
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[Span]:
    """The matches of the base patterns by start, then kind."""
    found = list(_emails(text))
    if _DIGITS.search(text):
        found += (Span(m.start(), IP, m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split("."))))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(Span(m.start(), CARD, m.end()))
        found += (Span(m.start(), PHONE, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15)
    return sorted(found)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


# ---- candidates

#: Characters that stand for ASCII ones, one for one, so that places stay.
_PLAIN = {0xFF10 + i: 0x30 + i for i in range(10)} | {0xFF20: 0x40, 0xFF0E: 0x2E, 0xFF0D: 0x2D, 0xFF0B: 0x2B, 0xFF08: 0x28, 0xFF09: 0x29} | dict.fromkeys((0xA0, 0x2007, 0x2009, 0x202F, 0x3000), 0x20) | dict.fromkeys((0x2010, 0x2011, 0x2012, 0x2013, 0x2014, 0x2212), 0x2D)
_AT = re.compile(r"\s{0,2}(?:@|[(\[{<]\s?(?:at|@)\s?[)\]}>]|(?<=\s)at(?=\s))\s{0,2}", re.I)
_NAME_BEFORE = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_DOT = r"(?:\s?[(\[{<]\s?(?:dot|\.)\s?[)\]}>]\s?|\sdot\s|\s\.\s|\.)"
_SPELLED_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,5}}", re.I)
_PART = re.compile(rf"{_DOT}", re.I)
_NUMBERS = re.compile(rf"(?<![0-9A-Za-z])[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3,7}}(?![0-9A-Za-z])", re.I)
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = re.compile(r"[\s().\-/_·,]{1,3}")
_CUES = {
    EMAIL: re.compile(r"mail|contact|write|reach|correo|courriel|schreib", re.I),
    IP: re.compile(r"\bip\b|host|server|address|addr|login|serveur|servidor", re.I),
    CARD: re.compile(r"card|visa|master|amex|pay|karte|carte|tarjeta|credit", re.I),
    PHONE: re.compile(r"phone|tel|call|fax|mobile|cell|whatsapp|sms|ruf|appel|llam|m[oó]vil", re.I),
}
FEATURES = 33
_LEFT_GROUP, _RIGHT_GROUP = re.compile(r"([0-9]+)[\s().\-/_,]{1,3}\Z"), re.compile(r"[\s().\-/_,]{1,3}([0-9]+)")
_GOES_ON = re.compile(rf"{_DOT}[A-Za-z0-9]", re.I)
# Frequent ends of host names.
_TOP = frozenset("com org net edu gov io dev app info biz de fr es uk us eu it nl ch at be pl pt ru cn jp br mx ar ca au in".split())
_CARD_GROUPS = ([16], [15], [4, 4, 4, 4], [4, 6, 5])
_ISSUER = re.compile("4|5[1-5]|2[2-7]|3[47]|35|6011|65")


def _number_windows(text: str) -> Iterator[Span]:
    """Cards and phone numbers among numbers that only short separators part: windows of whole groups of digits."""
    groups = [(m.start(), m.end()) for m in _GROUP.finditer(text) if m.end() - m.start() <= 19]
    at = 0
    while at < len(groups):
        end = at + 1
        while end < len(groups) and _BETWEEN.fullmatch(text, groups[end - 1][1], groups[end][0]):
            end += 1
        for i in range(at, end):
            size = 0
            for j in range(i, min(end, i + 8)):
                size += groups[j][1] - groups[j][0]
                if size > 19:
                    break
                start = groups[i][0]
                if size >= 12 and luhn(_digits(text[start : groups[j][1]])):
                    yield Span(start, CARD, groups[j][1])
                if 9 <= size <= 15:
                    before = text[max(0, start - 2) : start]
                    start -= 2 if before == "+(" else 1 if before[-1:] in ("+", "(") and before else 0
                    yield Span(start, PHONE, groups[j][1])
        at = end


def candidates(text: str) -> list[Span]:
    """What may be personal data; spans may overlap. text: with _PLAIN applied."""
    found: set[Span] = set()
    for at in _AT.finditer(text):
        name, host = _NAME_BEFORE.search(text, max(0, at.start() - 64), at.start()), _SPELLED_HOST.match(text, at.end())
        if name and host:
            ends = [m.start() for m in _PART.finditer(text, host.start(), host.end())][1:] + [host.end()]
            found.update(Span(name.start(), EMAIL, e) for e in ends)
    if _DIGITS.search(text):
        for m in _NUMBERS.finditer(text):
            parts = [(p.start(), p.end()) for p in _GROUP.finditer(text, m.start(), m.end())]
            found.update(Span(parts[i][0], IP, parts[i + 3][1]) for i in range(len(parts) - 3))
        found.update(Span(m.start(), IP, m.end()) for m in _LONG_IP.finditer(text))
        found.update(_number_windows(text))
    return sorted(found)


def _sort_of(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4


def features(text: str, span: Span) -> list[float]:
    """The format of a candidate and what stands around it; text: with _PLAIN applied."""
    start, kind, end = span
    own = text[start:end]
    groups = _GROUP.findall(own)
    sizes = [len(g) for g in groups] or [0]
    digits = "".join(groups)
    between = re.sub(r"[0-9A-Za-z]+", "\0", own).strip("\0").split("\0") if own else []
    before, after = text[max(0, start - 30) : start], text[end : end + 24]
    left, right = _LEFT_GROUP.search(before), _RIGHT_GROUP.match(after)
    try:
        long_ip = kind == IP and ":" in own and bool(ipaddress.IPv6Address(own))
    except ValueError:
        long_ip = False
    brackets = own.count("(") + own.count("[") + own.count("{") + own.count("<")
    dates = sizes in ([4, 2, 2], [2, 2, 4], [4, 2, 2, 2, 2], [2, 2, 4, 2, 2], [4, 2, 2, 2, 2, 2])
    last = re.split(r"[^A-Za-z0-9]+", own.rstrip(")]}> "))[-1]
    return [
        kind, len(own), len(digits), sum(c.isalpha() for c in own), len(groups), max(sizes), min(sizes), sizes[0], sizes[-1], len(set(between)), max((len(x) for x in between), default=0),
        luhn(digits) if 12 <= len(digits) <= 19 else -1, len(groups) == 4 and all(map(_octet, groups)), long_ip, own[:1] == "+" or digits[:2] == "00", brackets, own.count(" "),
        _sort_of(before[-1:]), _sort_of(after[:1]), bool(_CUES[kind].search(before)), len(left[1]) if left else 0, len(right[1]) if right else 0, len(set(digits)), dates, len(last) if last.isalpha() else 0, bool(re.search(r"\bdot\b|\.", own, re.I)), bool(re.search(r"@|[(\[{<]\s?at\b", own, re.I)),
        sizes in _CARD_GROUPS, sizes[-2:] == [3, 4] or sizes[-3:] == [3, 3, 4], bool(_ISSUER.match(digits)), bool(_GOES_ON.match(after)), len(set(sizes)), last.lower() in _TOP,
    ]


# ---- what is planted to fit the trees

def _card(r: random.Random) -> str:
    digits = r.choice(["4", "51", "55", "37", "6011", "35"])
    digits += "".join(r.choice("0123456789") for _ in range((15 if digits == "37" else 16) - 1 - len(digits)))
    return next(digits + c for c in "0123456789" if luhn(digits + c))


def _split(digits: str, sizes: list[int], by: str) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(digits[at : at + n])
        at += n
    return by.join(out)


def _some(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def planted(r: random.Random, words: list[str]) -> tuple[str, str, int, str]:
    """(before, thing, kind, behind): personal data in one of many formats, or (kind -1) a number or phrase of another sort."""
    word = lambda: re.sub(r"[^a-z]", "", r.choice(words).lower()) or "name"
    tld = r.choice(["com", "org", "net", "io", "de", "fr", "es", "example.com", "co.uk"])
    octets = [str(r.randint(1, 254)) for _ in range(4)]
    area, phone = str(r.randint(200, 989)), (str(r.randint(200, 999)), _some(r, 4))
    sort = r.randrange(12)
    if sort < 2:
        at = r.choice([" at ", " (at) ", "(at)", "[at]", " [at] ", " AT ", " @ ", "{at}"])
        dot = r.choice([" dot ", "(dot)", "[dot]", " [dot] ", " DOT ", "[.]", " . "]) if at.strip() != "@" else r.choice([" . ", " dot ", "[.]", "."])
        return "", word() + r.choice(["", "." + word(), str(r.randint(1, 99))]) + at + dot.join([word() + r.choice(["", str(r.randint(1, 9))]), *tld.split(".")]), EMAIL, ""
    if sort == 2:
        own = r.choice(["[.]", " . ", "(.)", "[dot]", " dot ", "(dot)"]).join(octets)
        if r.random() < 0.35:
            own = ":".join(f"{r.randrange(1 << 16):x}" for _ in range(8)) if r.random() < 0.6 else f"{r.randrange(1 << 13, 1 << 14):x}:db8::{r.randrange(1, 1 << 16):x}"
        return "", own, IP, ""
    if sort in (3, 4):
        card = _card(r)
        fives = [4, 6, 5] if len(card) == 15 else [4, 4, 4, 4]
        if r.random() < 0.5:  # beside another number, so that the base pattern's run is too long
            other = r.choice([_card(r), _some(r, r.randint(5, 16))])
            return ("", card, CARD, " " + other) if r.random() < 0.5 else (other + " ", card, CARD, "")
        return "", _split(card, fives, r.choice([".", "/", "_", "  ", " - "])), CARD, ""
    if sort in (5, 6):
        sep = r.choice(["-", ".", " ", "/"])
        own = r.choice([f"({area}) {phone[0]}-{phone[1]}", f"({area}){phone[0]}-{phone[1]}", sep.join([area, *phone]), f"1{sep}" + sep.join([area, *phone]), f"00{r.randint(1, 99)} {area} {phone[0]}{phone[1]}", f"+{r.randint(1, 99)}/{area}/{phone[0]}{phone[1]}", f"0{area}/{phone[0]}{phone[1]}"])
        if r.random() < 0.3:
            own = f"+{r.randint(1, 99)} ({area}) {phone[0]}-{phone[1]}"
            return "", own, PHONE, " " + r.choice([_card(r), _some(r, r.randint(8, 16)), ".".join(octets)])
        return r.choice(["", "", "tel ", "phone: ", "call "]), own, PHONE, ""
    kind = r.randrange(10)
    year, month, day = r.randint(1900, 2035), r.randint(1, 12), r.randint(1, 28)
    return "", [
        f"{year}-{month:02d}-{day:02d} {r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}", f"{day:02d}.{month:02d}.{year} {r.randrange(24):02d}.{r.randrange(60):02d}", f"{r.randrange(24):02d}:{r.randrange(60):02d}:{r.randrange(60):02d}",
        " ".join(_some(r, r.randint(1, 6)) for _ in range(r.randint(2, 7))), r.choice([", ", "/", "-", "  "]).join(_some(r, r.randint(1, 5)) for _ in range(r.randint(2, 8))), _some(r, r.randint(9, 19)), f"{_some(r, 3)}.{_some(r, 3)}.{_some(r, 3)},{_some(r, 2)}",
        ".".join(str(r.randint(0, 999)) for _ in range(r.randint(3, 6))) + r.choice(["", " beta"]), f"{word()} at {word()}{r.choice(['.', '. ', ' . '])}{r.choice([word(), 'It', 'In', 'At', 'De', 'Es'])} {word()}", f"{word()} @ {word()}, {word()}" if r.random() < 0.5 else f"{r.randint(1, 12)}.{r.randint(1, 40)} - {r.randint(1, 9)}.{r.randint(1, 40)}.{r.randint(1, 9)}",
    ][kind], -1, ""


def examples(piece: str, seed: str) -> Iterator[tuple[list[float], int, bool]]:
    """(features, label, whether to calibrate with it) of the candidates around what is planted into a piece."""
    piece = piece.translate(_PLAIN)
    words = piece.split() or ["text"]
    cuts = [0, *(m.end() for m in re.finditer(r"\s", piece)), len(piece)]
    for i in range(PLANTS):
        r = random.Random(f"{seed}|{i}")
        before, thing, kind, behind = planted(r, words)
        at = r.choice(cuts)
        left = piece[:at] + ("" if not at or piece[at - 1].isspace() else " ") + before
        text = left + thing + behind + r.choice([" ", " ", ". ", ", ", "\n"]) + piece[at:]
        base = base_spans(text)
        things = {(len(left), len(left) + len(thing))}
        if kind == CARD and luhn(before.strip()) and len(before.strip()) >= 12:
            things.add((len(left) - len(before), len(left) - 1))
        if kind == CARD and luhn(behind.strip()) and len(behind.strip()) >= 12:
            things.add((len(left) + len(thing) + 1, len(left) + len(thing) + len(behind)))
        for c in apart(candidates(text), base):
            near = c.end > len(left) - len(before) and c.start < len(left) + len(thing) + len(behind)
            if near or i == 0:
                yield features(text, c), int(kind == c.kind and (c.start, c.end) in things), r.random() < 1 / 3


def apart(spans: list[Span], held: list[Span]) -> list[Span]:
    """Those that overlap none of held (sorted, of which several may overlap each other)."""
    if not held:
        return spans
    starts = [h.start for h in held]
    reach = np.maximum.accumulate([h.end for h in held])
    return [s for s in spans if not (i := bisect_left(starts, s.end)) or reach[i - 1] <= s.start]


# ---- trees

class Trees(NamedTuple):
    """Trees as arrays: node 2 n + 1 or 2 n + 2 follows node n; leaves have feature -1. thresholds: by kind."""

    feature: np.ndarray
    split: np.ndarray
    value: np.ndarray
    thresholds: list[float]


def margins(trees: Trees, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for feature, split, value in zip(trees.feature, trees.split, trees.value, strict=True):
        node = np.zeros(len(x), np.int64)
        while (inner := feature[node] >= 0).any():
            left = x[rows, np.maximum(feature[node], 0)] <= split[node]
            node = np.where(inner, 2 * node + 2 - left, node)
        total += value[node]
    return total


def _as_arrays(model, thresholds: list[float]) -> Trees:
    """The trees of a fitted model; a few hundred nodes."""
    size = (2 << DEPTH) - 1
    feature, split, value = np.full((len(model.trees), size), -1), np.zeros((len(model.trees), size)), np.zeros((len(model.trees), size))
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        todo = [(0, tree._call_java("rootNode"))]
        while todo:
            n, node = todo.pop()
            value[t, n] = weight * node.prediction()
            if node.subtreeDepth():
                feature[t, n], split[t, n] = node.split().featureIndex(), node.split().threshold()
                todo += [(2 * n + 1, node.leftChild()), (2 * n + 2, node.rightChild())]
    return Trees(feature, split, value, thresholds)


EXAMPLES = pa.schema([("x", pa.list_(pa.float64())), ("label", pa.float64()), ("held", pa.bool_())])


def sampled_pieces(docs: DataFrame, text: str = "text", contexts: int = CONTEXTS, seed: int = SEED) -> DataFrame:
    """Pieces of AROUND characters of about as many rows as contexts says, from random places of their texts; bounded whatever the corpus."""
    n = docs.count()
    some = docs.select(F.col(text).cast("string").alias("text"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v")).where(F.col("u") < contexts / max(n, 1))
    place = F.floor(F.col("v") * F.greatest(F.lit(1), F.length("text") - AROUND)).cast("int") + 1
    return some.select(F.coalesce(F.col("text").substr(place, F.lit(AROUND)), F.lit("")).alias("piece")).limit(2 * contexts)


def fit(docs: DataFrame, text: str = "text", contexts: int = CONTEXTS, precision: float = PRECISION, seed: int = SEED) -> Trees | None:
    """Fits trees and thresholds to a bounded sample of docs; None if there is nothing to fit to."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for piece in batch.column("piece").to_pylist() for e in examples(piece, f"{seed}|{hashlib.md5(piece.encode('utf-8', 'surrogatepass')).hexdigest()}")]
            yield arrow(EXAMPLES, x=[e[0] for e in found], label=[e[1] for e in found], held=[e[2] for e in found])

    rows = sampled_pieces(docs, text, contexts, seed).repartition(4).transform(arrow_map(make, "x array<double>, label double, held boolean"))
    rows = rows.select(array_to_vector("x").alias("features"), "label", "held", "x").cache()
    try:
        if rows.where("not held").select("label").distinct().count() < 2:
            return None
        model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=48, minInstancesPerNode=5).fit(rows.where("not held"))
        trees = _as_arrays(model, [float("inf")] * len(KINDS))
        held = rows.where("held").select("x", "label").collect()  # a third of the bounded sample
    finally:
        rows.unpersist()
    if not held:
        return None
    x, label = np.array([h[0] for h in held]), np.array([h[1] for h in held])
    return trees._replace(thresholds=[threshold(margins(trees, x[own]), label[own], precision) for own in (x[:, 0] == k for k in range(len(KINDS)))])


def threshold(score: np.ndarray, label: np.ndarray, precision: float) -> float:
    """The least score of which, with those above it, the share of label 1 is at least precision, and which isn't below even odds; infinite if there is none."""
    order = np.argsort(-score, kind="stable")
    share = np.cumsum(label[order]) / np.arange(1, len(order) + 1)
    last = np.append(np.diff(score[order]) != 0, True) if len(order) else np.zeros(0, bool)  # of equal scores
    good = np.flatnonzero((share >= precision) & last & (score[order] > 0))
    return float(score[order[good[-1]]]) if len(good) else float("inf")


def select(found: list[Span], score: np.ndarray) -> list[Span]:
    """Spans that don't overlap, best scores first, then longer ones, then those further left."""
    chosen: list[Span] = []
    for i in sorted(range(len(found)), key=lambda i: (-score[i], found[i].start - found[i].end, found[i])):
        s, at = found[i], bisect_left(chosen, found[i])
        if (not at or chosen[at - 1].end <= s.start) and (at == len(chosen) or s.end <= chosen[at].start):
            chosen.insert(at, s)
    return chosen


def find(texts: list[str], trees: Trees | None) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, further spans) of each text."""
    base = [base_spans(t) for t in texts]
    if trees is None:
        return [(b, []) for b in base]
    plain = [t.translate(_PLAIN) if not t.isascii() else t for t in texts]
    open_ = [apart(candidates(t), b) for t, b in zip(plain, base, strict=True)]
    x = np.array([features(t, c) for t, cs in zip(plain, open_, strict=True) for c in cs], float).reshape(-1, FEATURES)
    score, at, out = margins(trees, x), 0, []
    least = np.array(trees.thresholds)
    for b, cs in zip(base, open_, strict=True):
        own = score[at : at + len(cs)]
        keep = [i for i, c in enumerate(cs) if own[i] >= least[c.kind]]
        out.append((b, select([cs[i] for i in keep], own[keep])))
        at += len(cs)
    return out


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("redacted", pa.string())])


def redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.end > at:
            out += [text[at : s.start], f"[{KINDS[s.kind]}]" if s.start >= at else ""]
            at = s.end
    return "".join([*out, text[at:]])


def private_data(docs: DataFrame, trees: Trees | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, redacted.

    The counts and base_sha256 are those of the base patterns; spans has all, as kind:start:end in code points (end exclusive), by start and then kind, joined by
    commas; redacted is the text with each span replaced by its kind in brackets, the earlier of those that overlap. Null and empty texts have none (base_sha256: of the
    empty text). Repeated rows count each time; other columns are ignored. One pass over the texts, without any exchange.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            found = find(texts, trees)
            every = [sorted(b + more) for b, more in found]
            counts = {f"n_{k}": [sum(s.kind == i for s in b) for b, _ in found] for i, k in enumerate(KINDS)}
            yield arrow(FOUND, doc_id=batch.column("doc_id"), **counts, base_sha256=[hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found], spans=[written(e) for e in every], redacted=[redacted(t, e) for t, e in zip(texts, every, strict=True)])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.transform(arrow_map(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, redacted string"))


def fit_and_find(docs: DataFrame, **options) -> DataFrame:
    """private_data() with trees that are fitted to docs themselves."""
    return private_data(docs, fit(docs, **options))
