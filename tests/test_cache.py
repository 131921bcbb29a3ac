import random
from datetime import datetime, timedelta

import pytest

from sievework.streaming.cache import cached, cached_stream

START = datetime(2024, 1, 1)


def replay(rows, ttl):
    """Requests one after the other."""
    held, out = {}, {}
    for i, key, at, keep in sorted((r for r in rows if r[1] is not None and r[2] is not None), key=lambda r: (r[2], r[0])):
        entry = held.get(key)
        if entry is None or at >= entry[0] + timedelta(seconds=ttl):
            out[i] = None
            if keep:
                held[key], out[i] = (at, i), i
            elif entry is not None:
                held.pop(key)
        else:
            out[i] = entry[1]
    return out | {r[0]: None for r in rows if r[1] is None or r[2] is None}


def requests(seed, n=400):
    """Few keys, one of which has a third of all requests; ties, requests at an entry's end, nulls."""
    r = random.Random(seed)
    return [(i, r.choice(["hot", "hot", "a", "b", "c", None]), r.choice([None, *[START + timedelta(seconds=r.randrange(0, 3000, 5))] * 20]), r.choice([True, True, False, None])) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ttl", [1, 60, 900])
def test_against_a_replay(spark, seed, ttl):
    rows = requests(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, key string, ts timestamp, keep boolean, _t int").drop("_t")
    assert {r["id"]: r["served_by"] for r in cached(df, "key", "ts", "id", ttl, "keep").collect()} == replay(rows, ttl)
    assert {r["id"]: r["served_by"] for r in cached(df, "key", "ts", "id", ttl).collect()} == replay([(*r[:3], True) for r in rows], ttl)


def test_empty(spark):
    assert cached(spark.createDataFrame([], "id long, key string, ts timestamp"), "key", "ts", "id", 60).count() == 0


def test_stream(spark, tmp_path):
    """Entries that expire, requests that come late, and a key that is silent, over several batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: START + timedelta(seconds=s)
    batches = [
        [(1, "k", at(0), True), (2, "k", at(30), True), (3, "n", at(40), False)],
        [(4, "k", at(59), True), (5, "k", at(60), True), (6, "n", at(70), True)],
        [(7, "k", at(500), None), (8, "k", at(505), True), (9, "n", at(1), True)],
    ]
    schema = "id long, key string, ts timestamp, keep boolean"
    source, out = str(tmp_path / "in"), []
    spark.createDataFrame([], schema).write.parquet(source)
    query = cached_stream(spark.readStream.schema(schema).parquet(source), 60, "10 seconds").writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            query.processAllAvailable()
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(out) == [("k", 1, 1), ("k", 2, 1), ("k", 4, 1), ("k", 5, 5), ("k", 7, None), ("k", 8, 8), ("n", 3, None), ("n", 6, 6)]
