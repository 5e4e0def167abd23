"""Maintenance operators in batch over events and conversations; tests run the same folds as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.plans.registry import query, table
from palimpsest.streaming import maintenance as mt


@query("r1_anchored_windows", """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, i, event_id, t, t AS clock, t AS last, 0 AS w FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, e.event_id, e.t,
CASE WHEN e.t <= f.clock + 21600000000 THEN f.clock WHEN e.t <= f.t + 21600000000 THEN f.t ELSE e.t END, e.t, CASE WHEN e.t <= f.clock + 21600000000 THEN f.w ELSE f.w + 1 END FROM f JOIN e ON e.user_id = f.user_id AND e.i = f.i + 1)
SELECT user_id, event_id, CAST(w AS INTEGER) AS window_ FROM f""")
def r1(spark, d):
    return mt.time_windows(table(spark, d, "events"), "user_id", "event_id", "ts", 6 * 3600).withColumnRenamed("window", "window_")


def _turns(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(tx.words(F.col("text"))).cast("long").alias("n"))


@query("r2_sensory_buffer")
def r2(spark, d):
    return mt.token_batches(_turns(spark, d), "conv_id", "turn", "n", 150, F.col("role") == "user", force=False)


@query("r3_short_term_buffer", """WITH RECURSIVE c AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, n AS held, 0 AS batch FROM c WHERE i = 1 UNION ALL SELECT c.conv_id, c.turn, c.i, CASE WHEN held + c.n > 150 THEN c.n ELSE held + c.n END, CASE WHEN held + c.n > 150 THEN batch + 1 ELSE batch END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id, turn, batch FROM f""")
def r3(spark, d):
    return mt.token_batches(_turns(spark, d), "conv_id", "turn", "n", 150)


@query("r4_trimmed_queue", "SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5")
def r4(spark, d):
    return mt.trimmed(table(spark, d, "events"), "user_id", "event_id", 5).select("event_id")


def _queue(spark, d):
    e = table(spark, d, "events")
    queue = e.select(F.col("event_id").alias("message_id"))
    delivered = e.filter("event_type = 'click'").select(F.col("event_id").alias("message_id"), F.col("ts").alias("delivered_at"))
    return queue, delivered, queue.filter("message_id % 3 = 0")


_NOW = "2024-02-15 00:00:00"


@query("r5_group_read", "SELECT message_id, source FROM (SELECT * FROM (SELECT event_id AS message_id, 0 AS source FROM events WHERE event_type <> 'click' ORDER BY 1 LIMIT 30) UNION ALL SELECT event_id, 1 FROM (SELECT * FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 ORDER BY event_id LIMIT 90) WHERE ts <= TIMESTAMP '2024-02-14 23:00:00') ORDER BY source, message_id LIMIT 30")
def r5(spark, d):
    queue, delivered, acked = _queue(spark, d)
    return mt.group_read(queue, delivered, acked, F.lit(_NOW).cast("timestamp"), 3600, 30)


@query("r6_acknowledged", "SELECT event_id AS message_id FROM events WHERE event_id % 3 <> 0")
def r6(spark, d):
    queue, _, acked = _queue(spark, d)
    return mt.acknowledged(queue, acked)


@query("r7_pending", "SELECT event_id AS message_id FROM (SELECT * FROM events WHERE event_type = 'click' AND event_id % 3 <> 0 ORDER BY event_id LIMIT 60) WHERE ts <= TIMESTAMP '2024-02-14 23:00:00' ORDER BY event_id LIMIT 20")
def r7(spark, d):
    _, delivered, acked = _queue(spark, d)
    return mt.pending(delivered, acked, F.lit(_NOW).cast("timestamp"), 3600, 20).select("message_id")


@query("r8_activity", "SELECT user_id, CASE WHEN age <= 43200 THEN 'active' WHEN age > 172800 THEN 'gone' ELSE 'idle' END AS state FROM (SELECT user_id, (epoch_us(TIMESTAMP '2024-01-30 00:00:00') - epoch_us(max(ts))) / 1e6 AS age FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)")
def r8(spark, d):
    now = F.lit("2024-01-30 00:00:00").cast("timestamp")
    return mt.activity(table(spark, d, "events").filter(F.col("ts") < now), "user_id", "ts", now, 43200, 172800)


@query("r9_broker", "SELECT event_type, event_id, CAST(floor((r - 1) / 4.0) AS INTEGER) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r FROM events) WHERE r <= 10")
def r9(spark, d):
    return mt.broker(table(spark, d, "events"), "event_type", "event_id", 10, 4).select("event_type", "event_id", "batch")


@query("r10_retention", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 10 DAY")
def r10(spark, d):
    return mt.retained(table(spark, d, "events"), "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"), 10).select("event_id")


@query("r12_merge_items", "SELECT id, score FROM (SELECT c_custkey AS id, c_acctbal + 5 AS score FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0) ORDER BY score DESC, id LIMIT 25")
def r12(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score"))
    return mt.merge_items(c.filter("id % 3 = 0"), c.filter("id % 2 = 0").withColumn("score", F.col("score") + 5), "id", "score", 25)


@query("ext_tumbling_counts", "SELECT time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext1(spark, d):
    return mt.windowed_counts(table(spark, d, "events"), "ts", "event_type", "1 day").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("ext_session_counts", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def ext2(spark, d):
    return mt.session_counts(table(spark, d, "events"), "ts", "user_id", "2 hours").withColumn("start", F.col("start").cast("timestamp_ntz"))
