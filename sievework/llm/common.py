"""What several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; where that is unset in a local session, as in tests, one of ours."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage; the rows lie in the shared folder, so that they outlive an executor.

    The driver's garbage is collected first, since Spark removes shuffle files when no plan refers to them any more.
    """
    shared_dir(df.sparkSession)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that scratch_path named."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def join_bounded(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int) -> DataFrame:
    """Joins with right broadcast if it is counted to have max_rows at most, else by a shuffle of both sides.

    right should be cheap to compute twice (read from a checkpoint, for example).
    """
    few = right.limit(max_rows + 1).count() <= max_rows
    return left.join(F.broadcast(right) if few else right, on, how)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _give_back() -> None:
    """Returns freed memory to the system: Python workers live on, beside a JVM that has its own share."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(f, schema):
    """For transform(): mapInArrow in batches that are small enough for long texts, with memory given back after each task.

    Where the session has Spark's default of 10,000 rows a batch, it is lowered to 1,000.
    """

    def tidy(batches):
        try:
            yield from f(batches)
        finally:
            _give_back()

    def run(df: DataFrame) -> DataFrame:
        conf = df.sparkSession.conf
        if conf.get(ARROW_ROWS) == "10000":
            conf.set(ARROW_ROWS, "1000")
        return df.mapInArrow(tidy, schema)

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor, shift, multiply); wraps around."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def chunks_by_bytes(texts: Iterable[str | None], limit: int) -> Iterator[tuple[int, list[str]]]:
    """Deals texts (None: empty) into lists of about limit characters; with the first one's position."""
    start, held, size = 0, [], 0
    for text in texts:
        held.append(text or "")
        size += len(held[-1])
        if size >= limit:
            yield start, held
            start, held, size = start + len(held), [], 0
    if held:
        yield start, held


def utf8(column: pa.Array) -> list[memoryview]:
    """The UTF-8 bytes of each string, without copying; nulls are empty."""
    n = len(column)
    if not n:
        return []
    wide = pa.types.is_large_string(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].tolist()
    data = memoryview(column.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def arrow(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def grouped(batches: Iterable[pa.RecordBatch], keys: list[str], at_least: int = 1 << 14) -> Iterator[pa.Table]:
    """Tables that hold whole groups, from batches sorted by keys; a table has one group at least and some at_least rows."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def tail(t: pa.Table) -> int:
        """Where the last group begins."""
        last = [t.column(k)[t.num_rows - 1].as_py() for k in keys]
        low, high = 0, t.num_rows - 1
        if [t.column(k)[0].as_py() for k in keys] == last:
            return 0
        while high - low > 1:
            mid = (low + high) // 2
            if [t.column(k)[mid].as_py() for k in keys] == last:
                high = mid
            else:
                low = mid
        return high

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= at_least:
            t = pa.Table.from_batches(held)
            if at := tail(t):
                yield t.slice(0, at)
                held, rows = t.slice(at).to_batches(), t.num_rows - at
            at_least = max(at_least, 2 * rows)
    if held:
        yield pa.Table.from_batches(held)
