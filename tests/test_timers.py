"""Timer-driven stream operators: windows equal the batch fold over restarts, updates keep their interval."""

import random
import time
from datetime import datetime, timedelta

import pytest

from palimpsest.streaming import maintenance as mt
from palimpsest.streaming import timers


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_windows_equal_batch_over_restarts(rocks, tmp_path):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = [("a" if i % 3 else "b", i, t0 + timedelta(minutes=6 * i + rng.randint(0, 20) + (400 if i > 40 else 0))) for i in range(80)]
    df = rocks.createDataFrame(rows, "who string, id long, ts timestamp")
    flush = rocks.createDataFrame([("z", 9999, t0 + timedelta(days=9))], df.schema)  # moves the watermark past everything
    again = rocks.createDataFrame([("z", 10000, t0 + timedelta(days=9, hours=1))], df.schema)
    for part in (df.filter("id < 30"), df.filter("id >= 30 and id < 33"), df.filter("id >= 33"), flush, again):  # each in a run of its own
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = timers.stream_windows(mt.read_files(rocks, f"{tmp_path}/in", df.schema), "who", "id", "ts", 3600, "40 minutes")
        got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    want = mt.time_windows(df, "who", "id", "ts", 3600).collect()
    assert sorted(map(tuple, rocks.read.parquet(f"{tmp_path}/out").filter("who <> 'z'").select("who", "id", "window").collect())) == sorted((r.who, r.id, r.window) for r in want)


def test_updates_keep_their_interval(rocks, tmp_path):
    schema = "who string, item string, score double"
    put = lambda rows: rocks.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    put([("a", "x", 1.0), ("a", "y", 3.0), ("b", "u", 1.0)])
    got = timers.periodic_updates(mt.read_files(rocks, f"{tmp_path}/in", schema, 10), "who", "item", "score", 6)
    query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(processingTime="1 second").start()
    try:
        for i in range(4):
            time.sleep(3)
            put([("a", f"new{i}", 2.0 + i), ("a", "x", 0.5)])
        end = time.time() + 60
        while time.time() < end:
            rows = [r for r in rocks.read.schema("who string, update int, at_ms long, fresh long, items array<string>").parquet(f"{tmp_path}/out").collect()]
            if sum(r.fresh for r in rows if r.who == "a") == 10:
                break
            time.sleep(2)
    finally:
        query.stop()
    a = sorted((r.update, r.at_ms, r.fresh, r["items"]) for r in rows if r.who == "a")
    assert [u for u, *_ in a] == list(range(1, len(a) + 1)) and len(a) >= 2
    assert all(y[1] - x[1] >= 6000 for x, y in zip(a, a[1:], strict=False))  # the interval is kept
    assert sum(f for *_, f, _ in a) == 10 and a[0][3] == ["y", "x"] and a[-1][3] == ["new3", "new2", "new1", "y", "new0", "x"]
    assert [r.fresh for r in rows if r.who == "b"] == [1]
