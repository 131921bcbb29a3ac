"""Online packing of documents into fixed-length sequences by the sum-of-squares rule.

Documents come one after the other. Whole sequences are cut from a long document; what is left goes to the fill level
whose windows, when one of them moves up by the document's length, leave the smallest sum of squared counts of partially
filled windows. The counts by level are one array. Windows that are full are written at once. When many windows are
open, and at the end, open ones are emptied into each other's gaps, which cuts documents; one at most stays unfilled.
Each piece says how it was placed. The open windows at the end are a few hundred to a thousand, however many documents
a task has, so that the share of refilled pieces falls with the size of tasks.

Each task packs its own documents, so nothing is exchanged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import tokens
from sievework.llm.common import arrow, arrow_map

LENGTH = 1024
END = 0  # the id that ends a document
OPEN = 2048  # windows that may be open at once
PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("placed", pa.string())])
PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, placed string"


class SumOfSquares:
    """Places pieces (document, start, ids, how) and calls write(pieces) for each finished window.

    how: whole for a sequence that a document fills, rule for what the rule placed, refill for what was cut off again to
    fill a gap.
    """

    def __init__(self, size: int, write, most_open: int = OPEN):
        self.size, self.write, self.most_open = size, write, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.windows: list[list[list]] = [[] for _ in range(size)]  # open windows by level
        self.open = 0

    def level_for(self, n: int) -> int:
        """The level to place n ids at, of those that have room; 0 opens a window. Of equals the fullest."""
        at = np.flatnonzero(self.count[: self.size - n + 1])
        if not len(at):
            return 0
        after = np.where(at + n < self.size, 2 * self.count[np.minimum(at + n, self.size - 1)] + 1, 0)
        change = after - 2 * self.count[at] + 1
        best = len(at) - 1 - int(np.argmin(change[::-1]))
        return int(at[best]) if change[best] <= 2 * self.count[n] + 1 else 0

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) // self.size * self.size
        for at in range(0, whole, self.size):
            self.write([(doc, at, ids[at : at + self.size], "whole")])
        n = len(ids) - whole
        if not n:
            return
        h = self.level_for(n)
        window = []
        if h:
            window = self.windows[h].pop()
            self.count[h] -= 1
            self.open -= 1
        window.append((doc, whole, ids[whole:], "rule"))
        if h + n == self.size:
            self.write(window)
            return
        self.windows[h + n].append(window)
        self.count[h + n] += 1
        self.open += 1
        if self.open > self.most_open:
            self.close(keep_last=True)

    def close(self, keep_last: bool = False) -> None:
        """Fills the fullest windows from the emptiest."""
        opened = [(h, w) for h in range(self.size - 1, 0, -1) for w in self.windows[h]]
        self.windows = [[] for _ in range(self.size)]
        self.count[:] = 0
        self.open = 0
        i, j = 0, len(opened) - 1
        while i <= j:
            h, window = opened[i]
            while h < self.size and i < j:
                less, giver = opened[j]
                doc, start, ids, how = giver.pop()
                n = min(self.size - h, len(ids))
                window.append((doc, start + len(ids) - n, ids[len(ids) - n :], "refill"))
                if n < len(ids):
                    giver.append((doc, start, ids[: len(ids) - n], how))
                h += n
                opened[j] = (less - n, giver)
                if less == n:
                    j -= 1
            if h < self.size and keep_last:
                self.windows[h].append(window)
                self.count[h] += 1
                self.open += 1
            else:
                self.write(window)
            i += 1


def _pack(path: str, size: int, end: int, most_open: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path).ids
        context = TaskContext.get()
        state = {"sequence": (context.partitionId() if context else 0) << 32}
        rows: dict[str, list] = {f.name: [] for f in PIECE}

        def write(window: list) -> None:
            offset = 0
            for (doc_id, total), start, ids, how in window:
                for c, v in zip(rows, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, state["sequence"], offset, how), strict=True):
                    rows[c].append(v)
                offset += len(ids)
            state["sequence"] += 1

        packer = SumOfSquares(size, write, most_open)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end)).astype("<u4")
                packer.add((doc_id, len(ids)), ids)
                if len(rows["start"]) >= 8192:
                    yield arrow(PIECE, **rows)
                    for c in rows.values():
                        c.clear()
        packer.close()
        yield arrow(PIECE, **rows)

    return pack


def pack(docs: DataFrame, size: int = LENGTH, vocabulary: str | None = None, end: int = END, text: str = "text", doc_id: str = "doc_id", most_open: int = OPEN) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, placed.

    A null or empty text is the end id alone. Null and repeated doc_ids are kept as they are; each row of docs is a
    document of its own. Sequences hold size ids, but for one of each task that may hold fewer. Of an empty table there
    are no pieces. Other columns of docs are ignored.
    """
    path = vocabulary or tokens.default_vocabulary()
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map(_pack(path, size, end, most_open), PIECE_SQL))
