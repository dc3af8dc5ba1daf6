"""Streaming forms against their batch results."""

import pytest
from pyspark.sql import functions as F

from skein.operators.queue import rate_limited as batch_rate_limited
from skein.streaming import rate_limit, windows


@pytest.fixture()
def stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), str(tmp_path / "state")


def run(df, name, state, mode="append"):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def test_windowed_counts_equal_batch(stream):
    events, live, state = stream
    got = run(windows.windowed_counts(live, "ts", "event_type", "1 day"), "counts", state, "complete")
    want = windows.windowed_counts(events, "ts", "event_type", "1 day")
    key = lambda df: sorted((r.window_start, r.event_type, r.events) for r in df.collect())
    assert key(got) == key(want) and got.count() > 0


def test_empty_shares_and_sessions(stream):
    events, live, state = stream
    got = run(windows.windowed_empty_shares(live, "ts", "event_type", "props", "1 day"), "shares", state + "1", "complete")
    assert got.count() > 0 and got.agg(F.max("empty_share")).first()[0] == 0.0
    sessions = windows.sessions(events, "ts", "user_id", "1 hour")
    assert sessions.agg(F.sum("events")).first()[0] == events.count()


def test_first_seen(stream):
    events, live, state = stream
    got = run(windows.first_seen(live, "ts", ["user_id"]), "firsts", state)
    assert got.count() == events.select("user_id").distinct().count()


def test_rate_limit_equals_batch(stream):
    events, live, state = stream
    seconds = F.unix_micros("ts") / 1e6
    calls = live.select(F.col("user_id").cast("string").alias("key"), seconds.alias("at"))
    got = run(rate_limit.rate_limited(calls, "key", "at", 2, 86_400.0), "limited", state)
    want = batch_rate_limited(events, "user_id", "ts", ["ts", "event_id"], 2, 86_400.0)
    count = lambda df: sorted((str(k), n) for k, n in df.collect())
    assert count(got.where("taken").groupBy("key").agg(F.count("*"))) == count(want.where("taken").groupBy("user_id").agg(F.count("*")))
