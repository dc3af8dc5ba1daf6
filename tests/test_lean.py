"""The lean learner: rules by hand, batch against stream, limits with state that ends."""

import time

import pytest
from pyspark.sql import functions as F

from skein.operators import lean
from skein.operators.queue import rate_limited
from skein.plans.work import lean_readings
from skein.streaming import stateful


def reading(field="a", value="v", full="v", shown=True, full_shown=True, paths=True):
    return {"field": field, "lean": value, "full": full, "lean_shown": shown, "full_shown": full_shown, "has_paths": paths}


def modes(items):
    state = lean.new_state()
    return [lean.take(state, item)[:2] for item in items], state


def test_two_checks_then_lean():
    assert modes([[reading()]] * 4)[0] == [("lean+full", "check")] * 2 + [("lean", None)] * 2


def test_a_disagreement_switches_the_run():
    got, _ = modes([[reading()], [reading(full="x")], [reading()]])
    assert got == [("lean+full", "check"), ("lean+full", "check"), ("full", "switched")]
    assert modes([[reading(shown=True, full_shown=False)], [reading()]])[0][1] == ("full", "switched")


def test_three_rescues_in_a_row_switch_and_a_quiet_item_resets():
    rescue, quiet = [reading(value=None)], [reading()]
    assert modes([rescue] * 4)[0][-1] == ("full", "switched")
    got, state = modes([quiet, rescue, rescue, quiet, rescue, rescue])
    assert got[3] == ("lean", None) and state["streak"] == 2 and not state["full"]


def test_confirmed_misses_are_believed_until_a_rescue():
    gone = [reading(value=None, full=None)]
    got, _ = modes([gone] * 5)
    assert got == [("lean+full", "check")] * 2 + [("lean+full", "miss")] + [("lean", None)] * 2
    state = modes([gone] * 3)[1]
    state["checks"] = 1
    lean.take(state, [reading(value=None)])
    assert state["missed"] == {}
    hidden = [reading(shown=False, full_shown=False)]
    assert modes([hidden] * 4)[0][-2:] == [("lean+full", "unshown"), ("lean", None)]
    assert modes([[reading(value=None, full=None, paths=False)]] * 3)[0][-1] == ("lean", None)


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    stateful.use_store(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)


def run(df, name, state, rows):
    """The stream's output once it has ``rows`` rows: with a time to live a stream goes on for its timers."""
    query = df.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", state).start()
    end = time.monotonic() + 90
    while query.isActive and df.sparkSession.table(name).count() < rows and time.monotonic() < end:
        time.sleep(0.5)
    query.stop()
    return df.sparkSession.table(name)


@pytest.mark.parametrize("ttl", [None, 24.0])
def test_stream_equals_batch(rocks, sf_dir, tmp_path, ttl):
    """Items in four micro-batches, each run's in order."""
    readings = lean_readings(rocks.read.parquet(f"{sf_dir}/orders.parquet"))
    order = ["o_orderdate", "o_orderkey"]
    items = lean.item_rows(readings, "run", order).orderBy(*order).collect()
    for n in range(4):
        part = items[n * len(items) // 4 : (n + 1) * len(items) // 4]
        rocks.createDataFrame(part, lean.item_rows(readings, "run", order).schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))
    live = rocks.readStream.schema(lean.item_rows(readings, "run", order).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    got = run(stateful.lean_outcomes(live, "run", order, ttl), f"lean{ttl is None}", str(tmp_path / "state"), len(items))
    want = lean.lean_outcomes(readings, "run", order)
    key = lambda df: sorted((r.run, r.o_orderkey, r.mode, r.reason or "", tuple(r.fields), tuple(r.rescued)) for r in df.collect())
    assert key(got) == key(want) and len({r.mode for r in want.collect()}) == 3


def test_limits_with_expiry_equal_batch(rocks, sf_dir, tmp_path):
    events = rocks.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    calls = rocks.readStream.schema(events.schema).parquet(str(tmp_path / "in")).select("user_id", (F.unix_micros("ts") / 1e6).alias("at"))
    got = run(stateful.limited(calls, "user_id", "at", 2, 86_400.0, ttl_hours=48.0), "limits", str(tmp_path / "state"), events.count())
    want = rate_limited(events, "user_id", "ts", ["ts", "event_id"], 2, 86_400.0)
    count = lambda df, k: sorted((r[0], r[1]) for r in df.where("taken").groupBy(k).agg(F.count("*")).collect())
    assert count(got, "key") == count(want, "user_id")
