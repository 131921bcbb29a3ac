"""Timed runs of named queries, as a table of run records for the reports."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

RUN = "case_id string, run_index int, success boolean, elapsed_ms int, rows bigint, failure_reason string"


def run_suite(spark: SparkSession, cases: Iterable[tuple[str, Callable[[], DataFrame]]], runs: int = 1) -> DataFrame:
    """A row for each run of each case; a case that fails is a row with the error's name."""
    records = []
    for case, build in cases:
        for i in range(runs):
            began, rows, failure = time.monotonic(), None, None
            try:
                rows = build().count()
            except Exception as e:  # a case's own failure is a result
                failure = type(e).__name__
            records.append((case, i, failure is None, int(1000 * (time.monotonic() - began)), rows, failure))
    return spark.createDataFrame(records, RUN)
