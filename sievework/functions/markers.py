"""Marker predicates. Markers are a driver-side list, and each one becomes a native expression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_marker(normal: Column, marker: str) -> Column:
    """ASCII markers on boundaries of letters and digits, others anywhere."""
    if marker.isascii():
        return normal.rlike(rf"(?<![a-z0-9]){re.escape(marker)}(?![a-z0-9])")
    return normal.contains(marker)


def has_any(normal: Column, markers: Iterable[str]) -> Column:
    """One pattern for all ASCII markers, so that a text is read once for them."""
    ascii_ = sorted({m for m in markers if m.isascii()}, key=lambda m: (-len(m), m))
    parts = [normal.contains(m) for m in markers if not m.isascii()]
    if ascii_:
        parts.append(normal.rlike(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, ascii_))})(?![a-z0-9])"))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def contains_any(text: Column, markers: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(m) for m in markers), F.lit(False))


def marker_score(normal: Column, markers: Iterable[str], each: int = 2) -> Column:
    """Points for each marker, once for each time that it is listed."""
    return reduce(lambda a, b: a + b, (F.when(has_marker(normal, m), each).otherwise(0) for m in markers), F.lit(0))


def marker_points(markers: Iterable[str], each: int = 2) -> Callable[[set[str], Callable[[], str]], int]:
    """marker_score() in Python, of a text's tokens and its normal form, which is asked for only where a marker is no token."""
    times = Counter(markers)
    whole = {m: n * each for m, n in times.items() if re.fullmatch("[a-z0-9]+", m)}
    others = [(re.compile(rf"(?<![a-z0-9]){re.escape(m)}(?![a-z0-9])" if m.isascii() else re.escape(m)), n * each) for m, n in times.items() if m not in whole]

    def points(held: set[str], normal: Callable[[], str]) -> int:
        return sum(whole[m] for m in whole.keys() & held) + sum(n for m, n in others if m.search(normal()))

    return points


def marker_count(text: Column, markers: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(m).cast("int") for m in markers), F.lit(0))
