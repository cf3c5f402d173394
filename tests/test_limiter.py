import random
import uuid

import pytest
from pyspark.sql import functions as F

from casario.streaming import limiter


def plain(events, most, seconds):
    """(key, time) pairs -> those with their admission, event by event in order of time."""
    out, times = [], {}
    for k, t in sorted(events):
        mine = [x for x in times.get(k, []) if x > t - seconds]
        out.append((k, t, len(mine) < most))
        times[k] = [*mine, t] if len(mine) < most else mine
    return sorted(out)


@pytest.fixture
def small_batches(spark):
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def streamed(spark, tmp_path, batches, most, seconds, lateness="20 seconds"):
    """The admissions of the batches, each a trigger of its own, and the rows of state at the end."""
    name, to = f"limited_{uuid.uuid4().hex}", f"{tmp_path}/{uuid.uuid4().hex}"
    for rows in batches:
        spark.createDataFrame(rows, "k string, t double").coalesce(1).write.mode("append").parquet(f"{to}/in")
        stream = spark.readStream.schema("k string, t double").parquet(f"{to}/in").withColumn("ts", F.timestamp_seconds("t"))
        query = limiter.admitted_stream(stream, "k", "ts", most, seconds, lateness).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/check").queryName(name).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = sorted((r.k, r._t / 1e6 if r._t is not None else None, r.admitido) for r in spark.read.parquet(f"{to}/out").collect() if r.k != "end")
    return got, query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_falling_times_in_small_batches(spark, tmp_path, small_batches):
    rows = [("a", float(t)) for t in range(12, 0, -1)]
    got, _ = streamed(spark, tmp_path, [rows, [("end", 500.0)], [("end", 501.0)]], 3, 100)
    assert [t for _, t, ok in got if ok] == [1.0, 2.0, 3.0]
    assert got == plain(rows, 3, 100)
    batch = limiter.admitted(spark.createDataFrame(rows, "k string, t double").withColumn("ts", F.timestamp_seconds("t")), "k", "ts", 3, 100)
    assert sorted((r.k, r.t, r.admitido) for r in batch.collect()) == got


def test_triggers_out_of_order_equal_the_batch_and_leave_no_state(spark, tmp_path, small_batches):
    rng = random.Random(6)
    events = [(rng.choice("aaab"), round(i * 2 + rng.uniform(-9, 9) + 20) + rng.randrange(8) / 8) for i in range(120)]
    parts = [events[a : a + 30] for a in range(0, 120, 30)]
    got, state = streamed(spark, tmp_path, [*parts, [("end", 900.0)], [("end", 5000.0)], [("end", 9000.0)]], 4, 15.5)
    assert got == plain(events, 4, 15.5)
    # Only the last key is left, with its event and its timer.
    assert state <= 3


def test_events_without_time_are_refused(spark, tmp_path, small_batches):
    rows = [("a", None), ("a", 1.0), ("a", None), ("a", 2.0)]
    batch = limiter.admitted(spark.createDataFrame(rows, "k string, t double").withColumn("ts", F.timestamp_seconds("t")), "k", "ts", 1, 10)
    key = lambda r: (r[1] is None, r)
    want = [("a", 1.0, True), ("a", 2.0, False), ("a", None, False), ("a", None, False)]
    assert sorted(((r.k, r.t, r.admitido) for r in batch.collect()), key=key) == want
    name, to = "limited_nulls", f"{tmp_path}/n"
    for part in ([rows], [[("end", 400.0)]], [[("end", 401.0)]]):
        spark.createDataFrame(part[0], "k string, t double").coalesce(1).write.mode("append").parquet(f"{to}/in")
        stream = spark.readStream.schema("k string, t double").parquet(f"{to}/in").withColumn("ts", F.timestamp_seconds("t"))
        limiter.admitted_stream(stream, "k", "ts", 1, 10).writeStream.format("parquet").option("path", f"{to}/out").option("checkpointLocation", f"{to}/c").queryName(name).trigger(availableNow=True).start().awaitTermination(120)
    got = [(r.k, r._t / 1e6 if r._t is not None else None, r.admitido) for r in spark.read.parquet(f"{to}/out").collect() if r.k == "a"]
    assert sorted(got, key=key) == want
