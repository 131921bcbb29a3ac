"""A cache of answers with a time to live, over tables and over streams.

Requests have a key and a time. A request is served by the entry of its key if there is one that has not expired; if
not, it is answered anew, and makes an entry if its answer may be kept. An entry lives for a fixed time, however often
it serves; a request at the moment of its end is not served.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, Row, StringType, StructField, StructType

from sievework.operators.components import written


def cached(requests: DataFrame, key: str, ts: str, request_id: str, ttl_seconds: int, keep: str | None = None) -> DataFrame:
    """requests with served_by: the id of the entry that serves a request, its own where it makes one, null where it is answered without.

    Times are timestamps; requests of one time are in the order of their ids, which are unique. keep: a column that says whether an answer
    may be kept (null: no); without it all may. Requests without a key or a time are answered without the cache. Which requests
    make entries is a chain in each key: from an entry to the first that comes when it has expired. Chains are followed by
    doubled steps, so that rounds grow with the logarithm of a key's entries; each key's requests are sorted once.
    """
    x = requests.withColumns({"_k": F.col(key), "_t": F.unix_micros(F.col(ts).cast("timestamp")), "_id": F.col(request_id)})
    usable = x.where("_k is not null and _t is not null")
    may = usable.where(F.coalesce(F.col(keep), F.lit(False))) if keep else usable
    may = written(may.select("_k", "_t", "_id"))
    own = may.select("_k", F.col("_t").alias("at"), F.lit(0).alias("probe"), F.col("_id").alias("row"), F.lit(None).cast(may.schema["_id"].dataType).alias("origin"))
    probes = may.select("_k", (F.col("_t") + ttl_seconds * 1_000_000).alias("at"), F.lit(1).alias("probe"), F.lit(None).cast(may.schema["_id"].dataType).alias("row"), F.col("_id").alias("origin"))
    later = Window.partitionBy("_k").orderBy(F.desc("at"), "probe", F.desc("row"))
    step = own.union(probes).withColumn("to", F.last("row", ignorenulls=True).over(later)).where("probe = 1 and to is not null").select(F.col("origin").alias("from"), "to")
    step = written(step)
    reached = written(may.groupBy("_k").agg(F.min(F.struct("_t", "_id"))["_id"].alias("row")).select("row"))
    while True:
        more = reached.join(step, F.col("row") == F.col("from")).select(F.col("to").alias("row")).join(reached, "row", "left_anti").distinct()
        grown = written(reached.union(more))
        if grown.count() == reached.count():
            break
        reached = grown
        step = written(step.select("from", F.col("to").alias("_mid")).join(step.select(F.col("from").alias("_mid"), "to"), "_mid").select("from", "to"))
        # what can be reached in twice as many steps is reached from all that is reached already
    entries = reached.withColumnRenamed("row", "_id").withColumn("_entry", F.lit(True))
    upto = Window.partitionBy("_k").orderBy("_t", "_id")
    y = usable.join(entries, "_id", "left").withColumn("_last", F.last(F.when(F.col("_entry"), F.struct("_t", "_id")), ignorenulls=True).over(upto))
    served = F.when(F.col("_t") < F.col("_last._t") + ttl_seconds * 1_000_000, F.col("_last._id"))
    y = y.withColumn("served_by", served).drop("_entry", "_last")
    rest = x.where("_k is null or _t is null").withColumn("served_by", F.lit(None).cast(may.schema["_id"].dataType))
    return y.select(*requests.columns, "served_by").union(rest.select(*requests.columns, "served_by"))


SERVED = StructType([StructField("key", StringType()), StructField("id", LongType()), StructField("served_by", LongType())])


class _Entry(StatefulProcessor):
    """A key's entry as state; a timer at its end drops it, so that keys that fall silent cost nothing."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", StructType([StructField("at", LongType()), StructField("id", LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803  (the interface's names)
        at, entry = self.entry.get() if self.entry.exists() else (None, None)
        for row in sorted(rows, key=lambda r: (r.at, r.id)):
            if at is None or not at <= row.at < at + self.ttl_ms:
                if not row.keep or (at is not None and row.at < at):  # what comes late, for an entry that is gone, makes none
                    yield Row(key=key[0], id=row.id, served_by=None)
                    continue
                at, entry = row.at, row.id
                self.entry.update((at, entry))
                self.handle.registerTimer(at + self.ttl_ms)
            yield Row(key=key[0], id=row.id, served_by=entry)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.entry.exists() and self.entry.get()[0] + self.ttl_ms <= expiredTimerInfo.getExpiryTimeInMs():
            self.entry.clear()
        return iter([])

    def close(self) -> None:
        pass


def cached_stream(requests: DataFrame, ttl_seconds: int, late: str) -> DataFrame:
    """(key, id, served_by) for each request of a stream (key, id, ts, keep), as cached() has it for requests that come in time.

    Those behind the watermark (late) are dropped. State is one entry for each key that has a live one; it needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    x = requests.where("key is not null").select("key", "id", "ts", F.unix_millis(F.col("ts")).alias("at"), F.coalesce("keep", F.lit(False)).alias("keep")).withWatermark("ts", late)
    return x.groupBy("key").transformWithState(statefulProcessor=_Entry(ttl_seconds * 1000), outputStructType=SERVED, outputMode="Append", timeMode="EventTime")
