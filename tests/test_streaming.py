"""Streams give what the batch folds give."""

from palimpsest.streaming import maintenance as mt


def test_anchored_windows_rule():
    rows = [(0, "a"), (5, "b"), (10, "c"), (12, "d"), (40, "e")]
    assert mt.anchored_windows(rows, 10) == [(0, "a"), (0, "b"), (0, "c"), (1, "d"), (2, "e")]
    assert mt.anchored_windows([], 10) == []


def test_sensory_buffer_flushes_on_users_only():
    held: list = []
    assert mt.sensory_flush([(1, 6, True), (2, 6, False), (3, 1, True)], held, 10) == [[1, 2]]
    assert held == [(3, 1)]


def _files(spark, path):
    rows = [(c, t, 10 + (c * 7 + t * 3) % 40) for c in range(5) for t in range(20)]
    df = spark.createDataFrame(rows, "conv long, turn long, n long")
    df.filter("turn < 9").coalesce(1).write.parquet(f"{path}/in")
    df.filter("turn >= 9").coalesce(1).write.mode("append").parquet(f"{path}/in")
    return df


def test_stream_buffers_equal_batch(spark, tmp_path):
    rows = [(c, t, 10 + (c * 7 + t * 3) % 40) for c in range(5) for t in range(20)]
    df = spark.createDataFrame(rows, "conv long, turn long, n long")
    out: list = []
    for part in ("turn < 9", "turn >= 9"):  # the second file comes when the first has been read; the state goes on
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = mt.read_files(spark, f"{tmp_path}/in", df.schema)
        mt.run_batches(mt.stream_token_batches(stream, "conv", "turn", "n", 90), lambda b, _: out.extend(b.collect()), f"{tmp_path}/cp")
    batches = mt.token_batches(df, "conv", "turn", "n", 90, force=False).filter("batch is not null").collect()
    assert batches and sorted((r.conv, r.batch, r.turn) for r in out) == sorted((r.conv, r.batch, r.turn) for r in batches)


def test_append_new_is_idempotent(spark, tmp_path):
    df = _files(spark, tmp_path).selectExpr("conv * 100 + turn as id")
    sink = mt.append_new(f"{tmp_path}/out", "id")
    sink(df, 0)
    sink(df, 0)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    sink(spark.sql("select cast(null as bigint) as id union all select -5L"), 1)
    sink(spark.sql("select cast(null as bigint) as id union all select null"), 2)
    sink(df.limit(0), 3)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 102


def test_incremental_index_by_stream(spark, tmp_path):
    df = _files(spark, tmp_path)
    stream = mt.read_files(spark, f"{tmp_path}/in", df.schema).selectExpr("conv * 100 + turn as id", "n")
    mt.run_batches(stream, mt.append_new(f"{tmp_path}/index", "id"), f"{tmp_path}/cp2")
    mt.run_batches(mt.read_files(spark, f"{tmp_path}/in", df.schema).selectExpr("conv * 100 + turn as id", "n"), mt.append_new(f"{tmp_path}/index", "id"), f"{tmp_path}/cp2")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 100


def test_watermarked_counts_on_a_stream(spark, tmp_path):
    spark.range(100).selectExpr("timestamp_seconds(id * 60) as ts", "cast(id % 2 as string) as kind").coalesce(1).write.parquet(f"{tmp_path}/e")
    stream = mt.read_files(spark, f"{tmp_path}/e", "ts timestamp, kind string")
    q = mt.windowed_counts(stream, "ts", "kind", "10 minutes", late="5 minutes").writeStream.format("memory").queryName("counts").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(n) s, max(n) m from counts").first()
    assert (got.m, got.s) == (5, 90)  # the watermark is at minute 94, so nine windows of both kinds are closed
