import pytest

from sievework.streaming import windows


@pytest.mark.parametrize("kind", ["hourly", "first_of"])
def test_streams_agree_with_batches(spark, sf_dir, tmp_path, kind):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    if kind == "hourly":
        out, want, mode = windows.hourly(stream, "10 days"), windows.hourly(batch), "complete"
    else:
        out, want, mode = windows.first_of(stream.select("ts", "event_type"), ["event_type"], "60 days"), batch.select("event_type").distinct(), "append"
    q = out.writeStream.format("memory").queryName(f"s_{kind}").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table(f"s_{kind}").count() == want.count()


def test_sessions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = windows.sessions(events, "6 hours")
    assert s.selectExpr("sum(n)").first()[0] == events.count()
