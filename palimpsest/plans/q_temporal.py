"""The bitemporal store over orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import dates
from palimpsest.operators import bitemporal as bt
from palimpsest.operators import compiler, joins
from palimpsest.plans.q_joins import _FACTS, _facts
from palimpsest.plans.registry import query, table

_ASK = """(SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) + 7 AS later, o_orderkey % 7 AS k FROM orders)"""


def _asked(spark, d):
    day, later, k = F.to_date("o_orderdate"), F.date_add(F.to_date("o_orderdate"), 7), F.col("o_orderkey") % 7
    s, e = F.date_format(day, "yyyy-MM-dd"), F.date_format(later, "yyyy/MM/dd")
    q = (
        F.when(k == 0, F.concat(F.lit("What held as of "), s)).when(k == 1, F.concat(F.lit("Before "), s, F.lit("?"))).when(k == 2, F.concat(F.lit("after "), F.date_format(day, "MMMM d, yyyy"))).when(k == 3, F.concat(F.lit("from "), s, F.lit(" to "), e))
        .when(k == 4, F.concat(F.lit("between "), e, F.lit(" and "), s)).when(k == 5, F.concat(F.lit("discussed on "), s)).otherwise(F.concat(F.lit("on "), F.date_format(day, "yyyy-MM")))
    )
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), day.alias("day"), later.alias("later"), q.alias("question"))


@query("t1_temporal_questions", f"SELECT id, CASE k WHEN 0 THEN 'as_of' WHEN 1 THEN 'before' WHEN 2 THEN 'after' WHEN 3 THEN 'interval' WHEN 5 THEN 'record' END AS kind, CASE WHEN k IN (0, 1, 2, 3, 5) THEN day END AS start, CASE WHEN k = 3 THEN later WHEN k IN (0, 1, 2, 5) THEN day END AS end_ FROM {_ASK}")
def t1(spark, d):
    q = _asked(spark, d).select("id", dates.temporal_query(F.col("question")).alias("q"))
    return q.select("id", "q.kind", "q.start", F.col("q.end").alias("end_"))


@query("t2_date_matches", "SELECT kind, count(*) FILTER (WHERE CASE kind WHEN 'interval' THEN day >= DATE '1995-03-01' AND day <= DATE '1995-06-30' WHEN 'as_of' THEN day <= DATE '1995-03-01' WHEN 'before' THEN day < DATE '1995-03-01' WHEN 'after' THEN day > DATE '1995-03-01' ELSE day = DATE '1995-03-01' END) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS day FROM orders), (SELECT unnest(['interval', 'as_of', 'before', 'after', 'exact']) AS kind) GROUP BY 1")
def t2(spark, d):
    rows = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), F.explode(F.array(*map(F.lit, ("interval", "as_of", "before", "after", "exact")))).alias("kind"))
    s, e = F.lit("1995-03-01").cast("date"), F.lit("1995-06-30").cast("date")
    return rows.groupBy("kind").agg(F.count_if(dates.date_matches(F.col("day"), F.col("kind"), s, e)).alias("n"))


@query("t3_episode_match", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 OR o_orderdate > TIMESTAMP '1995-03-01' THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM orders")
def t3(spark, d):
    day = F.lit("1995-03-01").cast("timestamp")
    return table(spark, d, "orders").select("o_orderkey", dates.episode_match(F.col("o_orderdate"), F.lit("as_of"), day, day, F.col("o_orderkey") % 5 == 0).alias("score"))


@query("t4_claim_match", f"SELECT id, CAST(CASE WHEN id % 2 = 0 AND coalesce(recorded <= TIMESTAMP '1995-06-17', FALSE) AND valid_from <= TIMESTAMP '1995-06-17' AND (valid_to IS NULL OR TIMESTAMP '1995-06-17' < valid_to) THEN 1 WHEN id % 2 = 1 AND valid_from <= TIMESTAMP '1995-07-17' AND (valid_to IS NULL OR TIMESTAMP '1995-06-17' < valid_to) THEN 1 WHEN coalesce(recorded <= TIMESTAMP '1995-06-17', FALSE) THEN 0.5 ELSE 0 END AS DOUBLE) AS score FROM {_FACTS}")
def t4(spark, d):
    at, end = F.lit("1995-06-17").cast("timestamp"), F.lit("1995-07-17").cast("timestamp")
    c = {n: F.col(n) for n in ("recorded", "valid_from", "valid_to")}
    kind = F.when(F.col("id") % 2 == 0, "as_of").otherwise("interval")
    score = bt.claim_match(kind, joins.visible_as_of(c["recorded"], c["valid_from"], c["valid_to"], at), F.lit(False), F.lit(False), joins.overlaps(c["valid_from"], c["valid_to"], at, end), F.coalesce(c["recorded"] <= at, F.lit(False)))
    return _facts(spark, d).select("id", score.alias("score"))


@query("t5_qualifier_filter", "SELECT o_orderkey FROM orders WHERE CASE o_orderkey % 4 WHEN 0 THEN TRUE WHEN 1 THEN o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate + INTERVAL 30 DAY < TIMESTAMP '1996-01-01' WHEN 2 THEN FALSE ELSE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' END")
def t5(spark, d):
    k, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    q = {"start_time": F.when((k == 1) | (k == 2), day), "end_time": F.when(k == 1, F.expr("o_orderdate + INTERVAL 30 DAY")), "point_in_time": F.when(k == 3, day), "reference_time": F.lit(None).cast("timestamp"), "record_time": F.lit(None).cast("timestamp")}
    keep = dates.qualifier_filter(q, F.lit("1995-01-01").cast("timestamp"), "ge", F.lit("1996-01-01").cast("timestamp"), "lt")
    return table(spark, d, "orders").filter(keep).select("o_orderkey")


@query("t6_current_state", f"SELECT id FROM {_FACTS} WHERE id % 3 <> 0 AND coalesce(recorded <= TIMESTAMP '1995-06-17', FALSE) AND valid_from <= TIMESTAMP '1995-06-17' AND (valid_to IS NULL OR TIMESTAMP '1995-06-17' < valid_to)")
def t6(spark, d):
    status = F.when(F.col("id") % 3 == 0, "superseded").when(F.col("id") % 3 == 1, "active").otherwise("contested")
    return _facts(spark, d).filter(bt.current_state(status, F.col("recorded"), F.col("valid_from"), F.col("valid_to"), F.lit("1995-06-17").cast("timestamp"))).select("id")


_STATES = """
WITH RECURSIVE c AS (
  SELECT event_id AS claim_id, user_id AS subject, event_type AS slot, CAST(floor(value / 40) AS BIGINT) AS value, CAST(ts AS DATE) AS session, ts AS recorded,
         CASE WHEN event_id % 2 = 0 THEN ts WHEN event_id % 5 = 0 THEN ts - INTERVAL 30 DAY END AS valid_from, event_id % 3 = 0 AS correction,
         list_extract(['NEW', 'CORROBORATE', 'SUPERSEDE', 'CONFLICT', 'DUPLICATE', 'REFINE', 'EPISODIC', 'SUPERSEDE'], CAST((event_id * event_id + user_id) % 8 + 1 AS BIGINT)) AS decision
  FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY subject, slot ORDER BY claim_id) AS rn FROM c),
run AS (
  SELECT subject, slot, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS claim_id, CAST(NULL AS VARCHAR) AS op, CAST(NULL AS BIGINT) AS open_id, CAST(NULL AS DATE) AS open_session, CAST(NULL AS BIGINT) AS open_value
  FROM n GROUP BY 1, 2
  UNION ALL
  SELECT subject, slot, rn, claim_id, op, CASE WHEN adds THEN claim_id ELSE open_id END, CASE WHEN adds THEN session ELSE open_session END, CASE WHEN adds THEN value ELSE open_value END
  FROM (SELECT *, op NOT IN ('EPISODIC', 'DUPLICATE', 'CORROBORATE') AS adds
        FROM (SELECT n.subject, n.slot, n.rn, n.claim_id, n.session, n.value, r.open_id, r.open_session, r.open_value,
                     CASE WHEN decision = 'EPISODIC' THEN 'EPISODIC' WHEN r.open_id IS NULL THEN 'NEW'
                          WHEN coalesce(n.session = r.open_session, FALSE) AND decision = 'CORROBORATE' THEN 'DUPLICATE'
                          WHEN coalesce(n.session = r.open_session, FALSE) AND decision = 'SUPERSEDE' AND coalesce(n.value = r.open_value, FALSE) THEN 'DUPLICATE'
                          WHEN coalesce(n.session = r.open_session, FALSE) AND decision = 'CONFLICT' THEN 'REFINE' ELSE decision END AS op
              FROM run r JOIN n ON n.subject = r.subject AND n.slot = r.slot AND n.rn = r.rn + 1))),
f AS (SELECT n.*, run.op, run.open_id FROM n JOIN run USING (subject, slot, rn)),
a AS (SELECT *, row_number() OVER w AS version, lead(op) OVER w AS next_op, lead(valid_from) OVER w AS next_from, lead(recorded) OVER w AS next_recorded, lead(correction) OVER w AS next_correction
      FROM f WHERE claim_id = open_id WINDOW w AS (PARTITION BY subject, slot ORDER BY rn)),
e AS (SELECT open_id, count(*) AS merged FROM f WHERE op IN ('DUPLICATE', 'CORROBORATE') GROUP BY 1)
SELECT f.subject, f.slot, f.claim_id, f.op AS operation,
  CASE WHEN f.op = 'EPISODIC' THEN 'standalone' WHEN a.claim_id IS NULL THEN 'merged' WHEN next_op = 'SUPERSEDE' THEN 'superseded' WHEN next_op = 'REFINE' THEN 'refined'
       WHEN next_op = 'CONFLICT' OR f.op = 'CONFLICT' THEN 'contested' ELSE 'active' END AS status,
  CAST(coalesce(a.version, 0) AS INTEGER) AS version,
  CASE WHEN next_op = 'SUPERSEDE' AND next_from IS NOT NULL THEN
       CASE WHEN next_correction AND (a.valid_from IS NULL OR CAST(next_from AS DATE) >= CAST(a.valid_from AS DATE)) THEN next_from
            WHEN NOT next_correction AND CAST(next_from AS DATE) >= CAST(a.recorded AS DATE) AND (a.valid_from IS NULL OR CAST(next_from AS DATE) >= CAST(a.valid_from AS DATE)) THEN next_from
            WHEN a.valid_from IS NOT NULL AND CAST(next_recorded AS DATE) < CAST(a.valid_from AS DATE) THEN NULL ELSE next_recorded END END AS ends_at,
  CAST(CASE WHEN a.claim_id IS NULL THEN 1 ELSE 1 + coalesce(merged, 0) END AS INTEGER) AS evidence
FROM f LEFT JOIN a ON a.claim_id = f.claim_id LEFT JOIN e ON e.open_id = a.claim_id
"""


@query("t7_state_machine", _STATES)
def t7(spark, d):
    e, i = table(spark, d, "events"), F.col("event_id")
    names = ("NEW", "CORROBORATE", "SUPERSEDE", "CONFLICT", "DUPLICATE", "REFINE", "EPISODIC", "SUPERSEDE")
    decisions = F.element_at(F.array(*map(F.lit, names)), ((i * i + F.col("user_id")) % 8 + 1).cast("int"))
    claims = e.select(
        i.alias("claim_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 40).alias("value"), i.alias("seq"),
        F.to_date("ts").alias("session"), decisions.alias("decision"), F.col("ts").alias("recorded"),
        F.when(i % 2 == 0, F.col("ts")).when(i % 5 == 0, F.expr("ts - INTERVAL 30 DAY")).alias("valid_from"), (i % 3 == 0).alias("correction"),
    )
    return bt.compile_states(claims).withColumn("ends_at", F.col("ends_at").cast("timestamp_ntz"))


@query("t7_compiled_claims")
def t7_compiled(spark, d):
    """Users' events as claims: equal values of a slot are evidence for the open claim, whichever it is; other values follow the decision about an earlier event."""
    e, i = table(spark, d, "events"), F.col("event_id")
    names = ("SUPERSEDE", "REFINE", "CONFLICT", "CORROBORATE", "NEW")
    relations = ("changed", "refinement", "contradictory", "equivalent", "uncertain")
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("value") * 100) % len(words) + 1).cast("int"))
    earlier = F.lag("event_id", 2).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    claims = e.select(
        F.col("user_id").alias("subject"), i.alias("claim_id"), i.alias("seq"), F.col("event_type").alias("slot"), F.floor(F.col("value") / 8).alias("value"), F.to_date("ts").alias("episode"),
        F.array(F.hour("ts")).alias("turns"), F.col("ts").alias("recorded"), F.col("ts").alias("valid_from"), earlier.alias("matched_id"), pick(names).alias("decision"), pick(relations).alias("relation"),
        (F.length("props") % 10 / 9 + 0.3).alias("confidence"),
    )
    got = compiler.compile_claims(claims, ["subject", "slot"])
    return got.select("subject", "slot", "claim_id", "operation", "matched_id", "fallback", F.size("changes").alias("n_changes"))


@query("t8_interval_closing", "SELECT event_id, version, status, valid_to FROM (SELECT event_id, CAST(row_number() OVER w AS INTEGER) AS version, CASE WHEN lead(ts) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS status, lead(ts) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))")
def t8(spark, d):
    v = bt.versions(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], "ts")
    return v.select("event_id", "version", "status", F.col("valid_to").cast("timestamp_ntz").alias("valid_to"))


_CLOSING = """
WITH x AS (
  SELECT o_orderkey, o_orderkey % 7 AS k, o_orderkey % 2 = 0 AS correction, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS old_from,
         CASE o_orderkey % 3 WHEN 0 THEN o_orderdate + INTERVAL 20 DAY WHEN 1 THEN o_orderdate - INTERVAL 1 DAY END AS old_to, o_orderdate + INTERVAL 3 DAY AS old_recorded
  FROM orders),
y AS (SELECT *, CASE k WHEN 0 THEN NULL WHEN 1 THEN old_recorded - INTERVAL 7 DAY WHEN 2 THEN old_recorded - INTERVAL 2 DAY ELSE old_recorded + INTERVAL 2 DAY END AS new_from,
             CASE k WHEN 4 THEN NULL WHEN 1 THEN old_recorded - INTERVAL 5 DAY ELSE old_recorded + INTERVAL 6 DAY END AS new_recorded,
             CASE WHEN old_from IS NOT NULL AND old_to < old_from THEN NULL ELSE old_to END AS own_end FROM x),
z AS (SELECT *, CASE WHEN new_from IS NULL THEN 'stay'
                     WHEN correction AND old_from IS NOT NULL AND new_from < old_from THEN 'fall back' WHEN correction THEN 'shift'
                     WHEN new_from < old_recorded OR (old_from IS NOT NULL AND new_from < old_from) THEN 'fall back' ELSE 'shift' END AS way FROM y)
SELECT o_orderkey, CASE WHEN way = 'stay' THEN own_end WHEN way = 'shift' THEN new_from
                        WHEN new_recorded IS NULL OR (old_from IS NOT NULL AND new_recorded < old_from) THEN own_end ELSE new_recorded END AS ends
FROM z
"""


@query("t8_guarded_closing", _CLOSING)
def t8b(spark, d):
    k, date = F.col("o_orderkey"), F.col("o_orderdate")
    day = lambda n: F.expr(f"o_orderdate + INTERVAL {n} DAY")
    old_from, old_to = F.when(k % 5 != 0, date), F.when(k % 3 == 0, day(20)).when(k % 3 == 1, day(-1))
    new_from = F.when(k % 7 == 0, None).when(k % 7 == 1, day(-4)).when(k % 7 == 2, day(1)).otherwise(day(5))
    new_recorded = F.when(k % 7 == 4, None).when(k % 7 == 1, day(-2)).otherwise(day(9))
    ends = bt.closing_time(old_from, old_to, day(3), new_from, new_recorded, k % 2 == 0)
    return table(spark, d, "orders").select("o_orderkey", ends.cast("timestamp_ntz").alias("ends"))


@query("t9_session_guards", "SELECT event_id, CASE WHEN user_id % 2 = 0 AND event_type = 'click' THEN 'DUPLICATE' WHEN user_id % 2 = 0 AND event_type = 'view' THEN 'REFINE' WHEN event_type = 'click' THEN 'CORROBORATE' WHEN event_type = 'view' THEN 'CONFLICT' WHEN user_id % 2 = 0 AND event_id % 3 = 0 THEN 'DUPLICATE' ELSE 'SUPERSEDE' END AS op FROM events")
def t9(spark, d):
    decision = F.when(F.col("event_type") == "click", "CORROBORATE").when(F.col("event_type") == "view", "CONFLICT").otherwise("SUPERSEDE")
    return table(spark, d, "events").select("event_id", bt.guarded_decision(decision, F.col("user_id") % 2 == 0, F.col("event_id") % 3 == 0).alias("op"))


@query("t10_attach_evidence", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 1 ELSE 2 END AS n FROM lineitem")
def t10(spark, d):
    ev = lambda turn, kind: F.array(F.struct(F.col("l_orderkey").alias("episode_id"), F.array(turn).alias("turn_ids"), F.lit(kind).alias("support_type")))
    both = bt.attach_evidence(ev(F.lit(1), "direct"), ev(F.col("l_linenumber"), "later"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.size(bt.attach_evidence(both, ev(F.lit(1), "again"))).alias("n"))


@query("t11_repaired_bounds", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (1, 3) THEN NULL ELSE o_orderdate END AS s, CASE WHEN o_orderkey % 4 = 2 THEN o_orderdate + INTERVAL 2 DAY WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL 2 DAY END AS e FROM orders")
def t11(spark, d):
    k, day = F.col("o_orderkey") % 4, lambda n: F.expr(f"o_orderdate + INTERVAL {n} DAY")
    s, e = bt.repaired_bounds(F.when(k == 0, "state").otherwise("event"), F.col("o_orderdate"), F.when(k == 3, day(-2)).otherwise(day(2)), F.when(k == 1, day(-1)).otherwise(day(1)))
    return table(spark, d, "orders").select("o_orderkey", s.cast("timestamp_ntz").alias("s"), e.cast("timestamp_ntz").alias("e"))


@query("t12_event_annotation", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 IN (0, 1) THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 4 AS INTEGER) END AS end_ FROM orders")
def t12(spark, d):
    k, day = F.col("o_orderkey") % 4, F.to_date("o_orderdate")
    a = bt.event_annotation(day, F.when(k == 1, F.date_add(day, 1)).when(k == 2, F.date_add(day, -1)), F.when(k == 3, "century").otherwise("exact"))
    return table(spark, d, "orders").select("o_orderkey", a["end"].alias("end_"))


@query("t13_span_index", "SELECT o_custkey AS episode, count(*) AS n, min(o_orderdate) AS first FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def t13(spark, d):
    claims = table(spark, d, "orders").select(F.col("o_custkey").alias("episode"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderdate")).alias("start"), F.col("o_orderdate").alias("end"), F.col("o_orderkey").alias("claim_id"))
    ix = bt.span_index(claims, "episode")
    return ix.select("episode", F.size("spans").cast("long").alias("n"), F.get("spans", 0)["start"].cast("timestamp_ntz").alias("first"))


@query("t14_temporal_rerank", """WITH r AS (SELECT o_custkey AS query, o_orderkey AS item, o_totalprice AS score, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders), a AS (SELECT query, min(day) AS anchor FROM r WHERE day IS NOT NULL GROUP BY 1),
n AS (SELECT r.*, CASE WHEN max(score) OVER w <= min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS norm, abs(date_diff('day', anchor, day)) AS gap FROM r LEFT JOIN a USING (query) WINDOW w AS (PARTITION BY query)),
f AS (SELECT query, item, round(norm + 0.3 * CASE WHEN day IS NULL THEN 0.0 ELSE greatest(0.0, 1 - gap / 30) END, 6) AS final FROM n) SELECT query, item, final, CAST(row_number() OVER (PARTITION BY query ORDER BY final DESC, item) AS INTEGER) AS rank FROM f""")
def t14(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"), F.when(F.col("o_orderkey") % 4 != 0, F.to_date("o_orderdate")).alias("day"))
    anchors = rows.filter("day is not null").groupBy("query").agg(F.min("day").alias("anchor"))
    return bt.temporal_rerank(rows, anchors, 0.3).select("query", "item", "final", "rank")


@query("t15_q_learning", """WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events), q AS (SELECT user_id, CAST(0 AS BIGINT) AS i, CAST(0.0 AS DOUBLE) AS q FROM (SELECT DISTINCT user_id FROM r)
UNION ALL SELECT r.user_id, r.i, 0.7 * q.q + 0.3 * r.value FROM q JOIN r ON r.user_id = q.user_id AND r.i = q.i + 1) SELECT user_id, max(i) AS visits, round(arg_max(q, i), 6) AS q FROM q GROUP BY 1""")
def t15(spark, d):
    got = bt.q_learning(table(spark, d, "events"), "user_id", "event_id", "value")
    return got.select("user_id", "visits", F.round("q", 6).alias("q"))


@query("t16_importance", "SELECT user_id, CAST(round(sum(value) * 0.5 + least(count(*) * 0.3, 5.0) * 0.3 + least(count(DISTINCT event_type) * 0.2, 2.0) * 0.2, 4) AS DOUBLE) AS score FROM events GROUP BY 1")
def t16(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.sum("value").alias("s"), F.count("*").alias("a"), F.count_distinct("event_type").alias("b"))
    return g.select("user_id", F.round(bt.importance(F.col("s"), F.col("a"), F.col("b"), (0.5, 0.3, 0.2)), 4).alias("score"))


@query("t17_working_memory", """WITH o AS (SELECT c_custkey AS item, c_acctbal AS score FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS item, c_acctbal + 1 AS score FROM customer WHERE c_custkey % 3 = 0),
f AS (SELECT item, n.score, CASE WHEN o.item IS NULL THEN 0 ELSE 1 END AS hits, 0 AS age FROM n LEFT JOIN o USING (item) UNION ALL SELECT item, 0.0, 0, 1 FROM (SELECT * FROM o WHERE item NOT IN (SELECT item FROM n) ORDER BY score DESC, item LIMIT 5))
SELECT item, score, hits FROM f ORDER BY age, score DESC, item LIMIT 22""")
def t17(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("item"), F.col("c_acctbal").alias("score"))
    old = c.filter("item % 2 = 0").withColumn("hits", F.lit(0))
    new = c.filter("item % 3 = 0").withColumn("score", F.col("score") + 1)
    return bt.merge_working(old, new, 5, 22).select("item", "score", "hits")


def _actions(spark, d):
    c = table(spark, d, "customer")
    memory = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text"))
    event = F.element_at(F.array(*map(F.lit, ("ADD", "UPDATE", "DELETE", "NONE"))), (F.col("c_custkey") % 4 + 1).cast("int"))
    return bt.apply_actions(memory, c.select(F.col("c_custkey").alias("id"), event.alias("event"), F.when(F.col("c_custkey") % 5 == 0, "").otherwise(F.col("c_mktsegment")).alias("text"), F.lit(1).alias("seq")))


_MEMORY = "(SELECT c_custkey AS id, c_custkey % 3 <> 0 AS known, c_custkey % 4 AS k, c_custkey % 5 = 0 AS blank, c_name AS old, c_mktsegment AS new FROM customer)"


@query("t19_actions", f"SELECT id, CASE WHEN k IN (0, 1) AND NOT blank THEN new ELSE old END AS text FROM {_MEMORY} WHERE (k IN (0, 1) AND NOT blank) OR (known AND k <> 2)")
def t19(spark, d):
    return _actions(spark, d)[0]


@query("t18_memory_history", f"SELECT id, CASE WHEN k = 0 THEN 'ADD' WHEN k = 1 AND known THEN 'UPDATE' WHEN k = 1 THEN 'ADD' ELSE 'DELETE' END AS event, CASE WHEN known THEN old END AS old_text FROM {_MEMORY} WHERE (k IN (0, 1) AND NOT blank) OR (known AND k = 2)")
def t18(spark, d):
    return _actions(spark, d)[1].select("id", "event", "old_text")


@query("g9_invariants", """SELECT 'duplicate edges' AS rule, count(*) AS n FROM (SELECT 1 FROM (SELECT o_custkey AS s, o_orderkey % 100 AS t FROM orders) GROUP BY s, t HAVING count(*) > 1) UNION ALL SELECT 'dangling edges', count(*) FROM orders WHERE o_orderkey % 100 NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)
UNION ALL SELECT 'several active versions', count(*) FROM (SELECT 1 FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 5 = 1 GROUP BY c_nationkey, c_mktsegment HAVING count(*) > 1) UNION ALL SELECT 'self-loops', count(*) FROM orders WHERE o_custkey = o_orderkey % 100""")
def g9(spark, d):
    claims = table(spark, d, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("claim_id"), F.col("c_nationkey").alias("subject"), F.col("c_mktsegment").alias("slot"), F.when(F.col("c_custkey") % 5 == 1, "active").otherwise("superseded").alias("status"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id"), F.lit("r").alias("relation"))
    return bt.invariants(claims, edges)
