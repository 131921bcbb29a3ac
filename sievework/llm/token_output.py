"""Packed token matrices: best-fit-decreasing packing and binary output.

Documents longer than a row are split into pieces without loss. The pieces of a block of documents are placed longest
first, each into the row with the least room that holds it; a segment tree over capacities finds that row. A block is a
bounded number of documents of one task, so nothing is exchanged and memory is bounded.

Rows are written as matrices of ids in one binary cell (little-endian, 16 bits where the vocabulary allows it), with
each row's cumulative segment lengths, the places where positions start again from 0, and the pieces it holds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import tokens
from sievework.llm.common import arrow, arrow_map, scratch_path

LENGTH = 2048
END = 0
BLOCK_IDS = 4_000_000  # ids packed together, and at most one document more
MATRIX_ROWS = 256

_LISTS = pa.list_(pa.int32())
MATRIX = pa.schema([("matrix_id", pa.int64()), ("n_rows", pa.int32()), ("row_length", pa.int32()), ("id_bytes", pa.int32()), ("ids", pa.binary()), ("cu_seqlens", pa.list_(_LISTS)), ("doc_ids", pa.list_(pa.list_(pa.int64()))), ("starts", pa.list_(pa.list_(pa.int64())))])
MATRIX_SQL = "matrix_id long, n_rows int, row_length int, id_bytes int, ids binary, cu_seqlens array<array<int>>, doc_ids array<array<long>>, starts array<array<long>>"


class CapacityTree:
    """Counts rows by their room; least(n) is the smallest room of n or more that a row has."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.tree = [0] * (2 * self.leaves)

    def add(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.tree[at] += by
            at >>= 1

    def least(self, n: int) -> int | None:
        at = self.leaves + n
        if self.tree[at]:
            return n
        while at > 1:  # up until something lies to the right, then down to its leftmost leaf
            if not at & 1 and self.tree[at + 1]:
                at += 1
                while at < self.leaves:
                    at *= 2
                    if not self.tree[at]:
                        at += 1
                return at - self.leaves
            at >>= 1
        return None


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows as lists of pieces' numbers; of equal pieces the earlier first, of rows with equal room the newest."""
    tree, room_rows, rows = CapacityTree(size), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        room = tree.least(n)
        if room is None:
            row, room = len(rows), size
            rows.append([])
        else:
            row = room_rows[room].pop()
            tree.add(room, -1)
        rows[row].append(i)
        if room > n:
            room_rows.setdefault(room - n, []).append(row)
            tree.add(room - n, 1)
    return rows


def _matrices(path: str, size: int, end: int):
    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(path)
        kind = np.dtype("<u2") if own.size <= 1 << 16 else np.dtype("<u4")
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        pieces: list[tuple[int, int, np.ndarray]] = []

        def written() -> Iterator[pa.RecordBatch]:
            nonlocal number
            rows = best_fit_decreasing([len(x[2]) for x in pieces], size)
            for at in range(0, len(rows), MATRIX_ROWS):
                part = rows[at : at + MATRIX_ROWS]
                ids = np.full((len(part), size), end, kind)
                ends, docs, starts = [], [], []
                for r, row in enumerate(part):
                    held = [pieces[i] for i in row]
                    flat = np.concatenate([x[2] for x in held])
                    ids[r, : len(flat)] = flat
                    ends.append([0, *np.cumsum([len(x[2]) for x in held]).tolist()])
                    docs.append([x[0] for x in held])
                    starts.append([x[1] for x in held])
                yield arrow(MATRIX, matrix_id=[number], n_rows=[len(part)], row_length=[size], id_bytes=[kind.itemsize], ids=[ids.tobytes()], cu_seqlens=[ends], doc_ids=[docs], starts=[starts])
                number += 1
            pieces.clear()

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(own.ids(text.as_py() or ""), np.uint32(end)).astype(kind)
                pieces += [(doc_id, at, ids[at : at + size]) for at in range(0, len(ids), size)]
                held += len(ids)
                if held >= BLOCK_IDS:
                    yield from written()
                    held = 0
        yield from written()

    return matrices


def packed_matrices(docs: DataFrame, size: int = LENGTH, vocabulary: str | None = None, end: int = END, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each matrix. Null and empty texts are the end id alone; rows with the same or no doc_id are documents of their own; an empty table gives none; other columns are ignored."""
    path = vocabulary or tokens.default_vocabulary()
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).transform(arrow_map(_matrices(path, size, end), MATRIX_SQL))


def write_matrices(docs: DataFrame, path: str, **options) -> None:
    packed_matrices(docs, **options).write.option("compression", "zstd").parquet(path)


def matrix(row) -> np.ndarray:
    """The ids of a written row."""
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}").reshape(row["n_rows"], row["row_length"])


def positions(cu_seqlens: list[int], size: int) -> np.ndarray:
    """Position ids of a row: they start again from 0 with each segment, and with the padding."""
    starts = np.zeros(size, np.int64)
    for at in cu_seqlens:
        if at < size:
            starts[at] = at
    return np.arange(size) - np.maximum.accumulate(starts)


ROW = pa.schema([("matrix_id", pa.int64()), ("row", pa.int32()), ("n_ids", pa.int32()), ("n_segments", pa.int32()), ("ids_crc32", pa.int64()), ("cu_seqlens", _LISTS), ("resets", _LISTS), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
ROW_SQL = "matrix_id long, row int, n_ids int, n_segments int, ids_crc32 long, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, starts array<long>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            ids = matrix(x)
            n = [c[-1] for c in x["cu_seqlens"]]
            crc = [zlib.crc32(ids[r, : n[r]].astype("<u4").tobytes()) for r in range(len(n))]
            yield arrow(ROW, matrix_id=[x["matrix_id"]] * len(n), row=range(len(n)), n_ids=n, n_segments=[len(c) - 1 for c in x["cu_seqlens"]], ids_crc32=crc, cu_seqlens=x["cu_seqlens"], resets=[np.flatnonzero(positions(c, x["row_length"])[: c[-1]] == 0).tolist() for c in x["cu_seqlens"]], doc_ids=x["doc_ids"], starts=x["starts"])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Written matrices read back, a row for each of theirs, with a checksum of its ids (as 32-bit numbers, without padding)."""
    return spark.read.parquet(path).transform(arrow_map(_rows, ROW_SQL))


def write_and_read(docs: DataFrame, name: str = "packed", **options) -> DataFrame:
    """Writes to a new path in the shared folder and reads back.

    A null text is an empty one, which has its end mark alone; a null doc_id stays null. Documents of any length are split, none is cut short. Repeated
    rows are packed each time; which of equally long ones comes first follows the scan. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, name)
    write_matrices(docs, path, **options)
    return read_rows(spark, path)
