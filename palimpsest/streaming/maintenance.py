"""Memory maintenance on streams: data-anchored windows, token buffers, activity, retention, merges.

Each stateful operator is a fold over the rows of a key in time order.  Batch runs it over the whole
key with applyInPandas, streams run the same fold with applyInPandasWithState, so both agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from palimpsest.operators.ranking import ranked


def anchored_windows(rows: Sequence[tuple[float, object]], width: float) -> list[tuple[int, object]]:
    """(window, item): a window holds t .. t + width, both ends included; the next one starts at the last time of the one before,
    or, if nothing is left there, at the earliest later row.  Rows are (time, item) in time order."""
    out: list[tuple[int, object]] = []
    i, window = 0, 0
    clock = rows[0][0] if rows else 0.0
    while i < len(rows):
        if rows[i][0] > clock + width:
            clock = rows[i][0]
        first = i
        while i < len(rows) and rows[i][0] <= clock + width:
            out.append((window, rows[i][1]))
            i += 1
        if i > first:
            clock = rows[i - 1][0]
            window += 1
    return out


def time_windows(df: DataFrame, by: str, key: str, ts: str, seconds: float) -> DataFrame:
    """window of every row of each group; unlike tumbling windows they are anchored on the data."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", key])
        got = anchored_windows(list(zip(pdf["_t"], pdf[key], strict=True)), seconds)
        return pd.DataFrame({by: pdf[by].iloc[0], key: [k for _, k in got], "window": [w for w, _ in got]})

    rows = df.select(by, key, F.unix_micros(F.col(ts).cast("timestamp")).cast("double").alias("_t")).withColumn("_t", F.col("_t") / 1e6)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, {key} {kinds[key]}, window int")


def flush_before(rows: Sequence[tuple[object, int]], held: list[tuple[object, int]], most: int) -> list[list[object]]:
    """Batches to flush: a row that would overflow flushes what is held first; `held` keeps the rest."""
    out = []
    for item, n in rows:
        if held and sum(x for _, x in held) + n > most:
            out.append([i for i, _ in held])
            held.clear()
        held.append((item, n))
    return out


def sensory_flush(rows: Sequence[tuple[object, int, bool]], held: list[tuple[object, int]], most: int) -> list[list[object]]:
    """As flush_before, but only a user's message may flush; answers join what is held."""
    out = []
    for item, n, user in rows:
        if user and held and sum(x for _, x in held) + n > most:
            out.append([i for i, _ in held])
            held.clear()
        held.append((item, n))
    return out


def token_batches(df: DataFrame, by: str, order: str, tokens: str, most: int, user: Column | None = None, force: bool = True) -> DataFrame:
    """batch of each row by token-bounded buffering; without `force` what is held at the end has none."""

    anyone = user is None

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        held: list = []
        rows = list(zip(pdf[order], pdf[tokens], strict=True))
        full = flush_before(rows, held, most) if anyone else sensory_flush([(*r, bool(u)) for r, u in zip(rows, pdf["_user"], strict=True)], held, most)
        if force and held:
            full.append([i for i, _ in held])
        pairs = [(pdf[by].iloc[0], b, i) for b, items in enumerate(full) for i in items]
        return pd.DataFrame(pairs, columns=[by, "batch", order])

    rows = df.select(by, order, F.col(tokens).cast("long").alias(tokens), (F.lit(True) if user is None else user).alias("_user"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.groupBy(by).applyInPandas(fold, f"{by} {kinds[by]}, batch int, {order} {kinds[order]}")


def stream_token_batches(df: DataFrame, by: str, order: str, tokens: str, most: int) -> DataFrame:
    """The same buffers on a stream (by, order long, tokens long): a batch comes out when a later row overflows it."""
    kind = df.schema[by].dataType.simpleString()

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, sizes, done = state.get if state.exists else ([], [], 0)
        held = list(zip(items, sizes, strict=True))
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for batch in flush_before(list(zip(rows[order].tolist(), rows[tokens].tolist(), strict=True)), held, most):
            out += [(key[0], done, i) for i in batch]
            done += 1
        state.update(([i for i, _ in held], [n for _, n in held], done))
        yield pd.DataFrame(out, columns=[by, "batch", order])

    return df.select(by, order, tokens).groupBy(by).applyInPandasWithState(fold, f"{by} {kind}, batch int, {order} long", "items array<long>, sizes array<long>, done int", "append", GroupStateTimeout.NoTimeout)


def trimmed(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The newest rows of each queue, at most so many."""
    return ranked(df, [by], [F.desc(order)], "_p").filter(F.col("_p") <= most).drop("_p")


def pending(delivered: DataFrame, acked: DataFrame, now: Column, idle_seconds: float, count: int) -> DataFrame:
    """What a consumer takes over: of the first 3 x count pending rows those idle long enough, at most count."""
    open_ = delivered.join(acked, "message_id", "left_anti").orderBy("message_id").limit(3 * count)
    idle = F.unix_micros(now) - F.unix_micros(F.col("delivered_at").cast("timestamp"))
    return open_.filter(idle >= idle_seconds * 1e6).orderBy("message_id").limit(count)


def acknowledged(queue: DataFrame, acked: DataFrame) -> DataFrame:
    return queue.join(acked, "message_id", "left_anti")


def group_read(queue: DataFrame, delivered: DataFrame, acked: DataFrame, now: Column, idle_seconds: float, count: int) -> DataFrame:
    """New messages first, then idle pending ones to fill the quota."""
    new = queue.join(delivered, "message_id", "left_anti").orderBy("message_id").limit(count).select("message_id", F.lit(0).alias("source"))
    old = pending(delivered, acked, now, idle_seconds, count).select("message_id", F.lit(1).alias("source"))
    return new.unionByName(old).orderBy("source", "message_id").limit(count)


def broker(queue: DataFrame, stream: str, message: str, quota: int, batch: int) -> DataFrame:
    """Each stream's first `quota` messages, in batches of `batch`."""
    rows = ranked(queue, [stream], [message], "_p").filter(F.col("_p") <= quota)
    return rows.withColumn("batch", F.floor((F.col("_p") - 1) / batch).cast("int")).drop("_p")


def activity(df: DataFrame, key: str, ts: str, now: Column, recent_seconds: int, gone_seconds: int) -> DataFrame:
    """active, idle or gone by the age of a key's last row."""
    age = (F.unix_micros(now) - F.unix_micros(F.col("last").cast("timestamp"))) / 1e6
    state = F.when(age <= recent_seconds, "active").when(age > gone_seconds, "gone").otherwise("idle")
    return df.groupBy(key).agg(F.max(ts).alias("last")).select(key, state.alias("state"))


def retained(df: DataFrame, ts: str, now: Column, days: int) -> DataFrame:
    """Rows that are not older than so many days; one that is exactly as old stays."""
    return df.filter(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def merge_items(stored: DataFrame, live: DataFrame, key: str, score: str, size: int) -> DataFrame:
    """Live rows win by key; then the best by score, stored order (the key) breaking ties."""
    both = live.withColumn("_s", F.lit(0)).unionByName(stored.withColumn("_s", F.lit(1)))
    once = ranked(both, [key], ["_s"], "_p").filter("_p = 1").drop("_p", "_s")
    return once.orderBy(F.desc(score), key).limit(size)


def windowed_counts(df: DataFrame, ts: str, by: str, width: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """An extension: tumbling or sliding counts; with a watermark on streams."""
    rows = df if late is None else df.withWatermark(ts, late)
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return rows.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def session_counts(df: DataFrame, ts: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """An extension: sessions that end after a gap."""
    rows = df if late is None else df.withWatermark(ts, late)
    return rows.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def read_files(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A Parquet folder as a stream, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: str | None = None) -> None:
    """Run a stream through foreachBatch until what is there is done (or for ever, at a trigger interval); the checkpoint makes
    a restarted run go on where the last one ended, at least once."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=trigger) if trigger else writer.trigger(availableNow=True)).start()
    query.awaitTermination()


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """foreachBatch sink: rows whose key the Parquet table at path lacks are appended; a replayed batch adds nothing.

    Only row groups whose keys lie between the batch's least and largest are read.  A null key is appended once.
    """

    def sink(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            low, high = rows.agg(F.min(key), F.max(key)).first()
            known = spark.read.parquet(path).select(F.col(key).alias("_known"))
            near = F.col("_known").isNull()
            known = known.filter(near if low is None else near | F.col("_known").between(low, high))
            rows = rows.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        rows.write.mode("append").parquet(path)

    return sink
