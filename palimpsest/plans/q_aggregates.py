"""Aggregates over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import aggregates as ag
from palimpsest.plans.registry import query, table


def _r(df, *cols, digits=6):
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


_RESULTS = "(SELECT event_type AS query_type, CASE WHEN user_id % 7 <> 0 THEN value END AS score, CASE WHEN user_id % 11 <> 0 THEN value > 5 END AS is_correct FROM events)"


def _results(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("query_type"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("score"), F.when(F.col("user_id") % 11 != 0, F.col("value") > 5).alias("is_correct"))


@query("a1_accuracy", f"""SELECT query_type, count(*) AS executed, count(*) FILTER (WHERE ok) AS scored, count(*) FILTER (WHERE NOT ok) AS unscored, round(count(*) FILTER (WHERE ok AND is_correct) / count(*) FILTER (WHERE ok), 6) AS accuracy,
round(sum(score) FILTER (WHERE ok) / count(*) FILTER (WHERE ok), 6) AS avg_score FROM (SELECT *, score IS NOT NULL AND is_correct IS NOT NULL AS ok FROM {_RESULTS}) GROUP BY ROLLUP (query_type)""")
def a1(spark, d):
    return _r(ag.accuracy(_results(spark, d), "query_type"), "accuracy", "avg_score")


@query("a2_metric_stats", "SELECT metric, count(*) AS n, round(avg(value), 6) AS mean FROM (SELECT 'price' AS metric, l_extendedprice AS value FROM lineitem UNION ALL SELECT 'discount', l_discount FROM lineitem UNION ALL SELECT 'tax', CASE WHEN l_linenumber > 2 THEN l_tax END FROM lineitem) WHERE value IS NOT NULL GROUP BY 1")
def a2(spark, d):
    m = F.create_map(F.lit("price"), F.col("l_extendedprice"), F.lit("discount"), F.col("l_discount"), F.lit("tax"), F.when(F.col("l_linenumber") > 2, F.col("l_tax")))
    return _r(ag.metric_stats(table(spark, d, "lineitem").select(m.alias("metrics")), "metrics"), "mean")


@query("a3_node_rates", "SELECT count(*) AS n_nodes, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS mention_rate, round(avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0.0 END), 6) AS link_rate FROM lineitem WHERE l_returnflag = 'R'")
def a3(spark, d):
    node = F.struct((F.col("l_tax") > 0.04).cast("int").alias("mentioned"), (F.col("l_discount") > 0.05).cast("int").alias("linked"))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.collect_list(node).alias("nodes"))
    return _r(ag.node_rates(rows, "nodes", F.col("l_returnflag") == "R"), "mention_rate", "link_rate")


@query("a4_efficiency", "SELECT round(sum(value), 4) AS memory_time, round(sum(value * 2), 4) AS query_time, count(s) AS scored, round(sum(value) / count(s), 6) AS memory_per_scored, round(sum(value * 2) / count(s), 6) AS query_per_scored FROM (SELECT value, CASE WHEN user_id % 7 <> 0 THEN value END AS s FROM events)")
def a4(spark, d):
    e = table(spark, d, "events").select(F.col("value").alias("m"), (F.col("value") * 2).alias("q"), F.when(F.col("user_id") % 7 != 0, F.col("value")).alias("score"))
    return _r(_r(ag.efficiency(e, "m", "q"), "memory_time", "query_time", digits=4), "memory_per_scored", "query_per_scored")


@query("a5_retrieval_quality", """WITH r AS (SELECT event_type, user_id % 9 <> 0 AS on_, user_id % 4 AS tp, user_id % 3 AS fp, event_id % 2 AS fn FROM events), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS re FROM r),
a AS (SELECT event_type, count(*) AS n, count(*) FILTER (WHERE on_) / count(*) AS coverage, avg(pr) FILTER (WHERE on_) AS mp, avg(re) FILTER (WHERE on_) AS mr, sum(tp) FILTER (WHERE on_) / sum(tp + fp) FILTER (WHERE on_) AS ip, sum(tp) FILTER (WHERE on_) / sum(tp + fn) FILTER (WHERE on_) AS ir FROM p GROUP BY ROLLUP (event_type))
SELECT event_type, n, round(coverage, 6) AS coverage, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(ip, 6) AS micro_precision, round(ir, 6) AS micro_recall, round(2 * ip * ir / (ip + ir), 6) AS micro_f1 FROM a""")
def a5(spark, d):
    e = table(spark, d, "events").select("event_type", (F.col("user_id") % 9 != 0).alias("available"), (F.col("user_id") % 4).alias("tp"), (F.col("user_id") % 3).alias("fp"), (F.col("event_id") % 2).alias("fn"))
    ratio = lambda other: F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(0.0)
    got = ag.retrieval_quality(e.withColumn("precision", ratio("fp")).withColumn("recall", ratio("fn")), "event_type")
    return _r(got, "coverage", "macro_precision", "macro_recall", "micro_precision", "micro_recall", "micro_f1")


@query("a6_describe", """WITH l AS (SELECT l_returnflag, 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT l_returnflag, 'l_discount', l_discount FROM lineitem),
g AS (SELECT l_returnflag, metric, value FROM l UNION ALL SELECT NULL, metric, value FROM l)
SELECT l_returnflag, metric, round(avg(value), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS std, median(value) AS median, min(value) AS min, max(value) AS max, count(*) AS n FROM g GROUP BY 1, 2""")
def a6(spark, d):
    return _r(ag.describe(table(spark, d, "lineitem"), ["l_returnflag"], ["l_quantity", "l_discount"]), "mean", "std", digits=4)


@query("a7_grouped_counts", "SELECT json_extract_string(props, '$.k') AS k, event_type, count(*) AS n FROM events WHERE value > 2 GROUP BY 1, 2")
def a7(spark, d):
    return ag.grouped_counts(table(spark, d, "events"), {"k": F.get_json_object("props", "$.k"), "event_type": F.col("event_type")}, F.col("value") > 2)


@query("a8_fact_counts", "SELECT count(*) AS n, count(DISTINCT CASE WHEN l_returnflag <> '' THEN l_returnflag END) AS n_subjects, count(DISTINCT l_partkey) AS n_objects FROM lineitem")
def a8(spark, d):
    return ag.fact_counts(table(spark, d, "lineitem"), "l_returnflag", "l_partkey")


@query("a9_health", "SELECT count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS n_click, count(*) FILTER (WHERE event_type = 'view') AS n_view, count(DISTINCT user_id) AS n_sources, count(user_id) - count(DISTINCT user_id) AS n_duplicate_sources FROM events")
def a9(spark, d):
    return ag.health(table(spark, d, "events"), "event_type", "user_id", ["click", "view"])


@query("a10_distribution", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a10(spark, d):
    return ag.grouped_counts(table(spark, d, "events"), {"event_type": F.col("event_type")})


@query("a11_accuracy_by_length", "SELECT CAST(ceil(n_chars / 1000.0) AS BIGINT) AS bucket, count(*) AS n, round(avg(quality), 6) AS accuracy FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def a11(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return docs.groupBy(F.ceil(F.col("n_chars") / 1000.0).alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("accuracy"))


@query("a12_usage", "SELECT l_returnflag, l_linestatus, count(*) AS calls, sum(l_quantity) AS l_quantity, round(sum(l_tax), 2) AS l_tax FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def a12(spark, d):
    return _r(ag.usage(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", ["l_quantity", "l_tax"]), "l_tax", digits=2)


@query("a13_phase_usage", "SELECT count(*) AS calls, count(*) FILTER (WHERE user_id % 5 <> 0) AS ok_calls, round(sum(value), 4) AS latency, round(sum(value) / count(*) FILTER (WHERE user_id % 5 <> 0), 6) AS avg_latency FROM events WHERE event_type IN ('click', 'view')")
def a13(spark, d):
    got = ag.phase_usage(table(spark, d, "events"), "event_type", ["click", "view"], "value", F.col("user_id") % 5 != 0)
    return _r(_r(got, "latency", digits=4), "avg_latency")


@query("a14_comparison", "SELECT 'a' AS run, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 'b', count(*), NULL FROM events WHERE event_id % 2 = 1")
def a14(spark, d):
    e = table(spark, d, "events")
    return ag.comparison({"b": e.filter("event_id % 2 = 1").agg(F.count("*").alias("n")), "a": e.filter("event_id % 2 = 0").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))})


@query("a16_entities", "SELECT l_orderkey, string_agg(e, ',' ORDER BY e) AS entities FROM (SELECT DISTINCT l_orderkey, unnest(['p' || l_partkey, 's' || l_suppkey]) AS e FROM lineitem) GROUP BY 1")
def a16(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("subject"), F.concat(F.lit("s"), "l_suppkey").alias("object"))
    return ag.entities(t, "l_orderkey").withColumn("entities", F.array_join("entities", ","))


@query("a17_token_sum", "SELECT CAST(sum(floor(length(text) / 3.0)) AS BIGINT) AS tokens FROM documents")
def a17(spark, d):
    from palimpsest.functions import text as tx

    return table(spark, d, "documents").agg(F.sum(tx.estimated_tokens(F.col("text"))).alias("tokens"))


_RECALL = """WITH g AS (SELECT l_orderkey, list(DISTINCT l_partkey) FILTER (WHERE l_tax > 0.03) AS gold, list(l_partkey ORDER BY l_linenumber, l_partkey) AS found FROM lineitem GROUP BY 1), h AS (SELECT l_orderkey, coalesce(gold, []) AS gold, found FROM g),
e AS (SELECT l_orderkey, len(gold) AS n, k, len(list_intersect(list_distinct(found[1:k]), gold)) AS hits,
list_sum(list_transform(found[1:k], lambda x, i: CASE WHEN list_contains(gold, x) THEN CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / log2(i) END ELSE 0.0 END)) AS dcg,
list_sum(list_transform(range(1, greatest(least(len(gold), k), 1) + 1), lambda i: CASE WHEN i = 1 THEN 1.0 ELSE 1.0 / log2(i) END)) AS ideal FROM h, (SELECT unnest([1, 3]) AS k))
SELECT round(avg(hits / n) FILTER (WHERE k = 1), 4) AS recall_1, round(avg(CASE WHEN hits = n THEN 1.0 ELSE 0.0 END) FILTER (WHERE k = 1), 4) AS all_1, round(avg(dcg / ideal) FILTER (WHERE k = 1), 4) AS ndcg_1,
round(avg(hits / n) FILTER (WHERE k = 3), 4) AS recall_3, round(avg(CASE WHEN hits = n THEN 1.0 ELSE 0.0 END) FILTER (WHERE k = 3), 4) AS all_3, round(avg(dcg / ideal) FILTER (WHERE k = 3), 4) AS ndcg_3 FROM e WHERE n > 0"""


@query("a18_recall_ndcg", _RECALL)
def a18(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_tax") > 0.03, F.col("l_partkey"))).alias("gold"),
        F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"]).alias("found"),
    )
    return ag.recall_at(rows, [1, 3])


@query("a19_nested_groups", "SELECT user_id, event_type, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS items FROM events GROUP BY 1, 2")
def a19(spark, d):
    return ag.nested_groups(table(spark, d, "events"), "user_id", "event_type", "event_id").withColumn("items", F.array_join(F.col("items").cast("array<string>"), ","))


@query("a20_injection_stats", """WITH p AS (SELECT event_type, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events), g AS (SELECT event_type, p - lag(p, 1, -1) OVER (ORDER BY p) - 1 AS gap FROM p WHERE event_type IN ('error', 'view'))
SELECT (SELECT count(*) FROM p) AS n, count(*) AS n_noise, round(avg(gap), 6) AS avg_gap, count(DISTINCT event_type) AS n_kinds, round(count(*) / (SELECT count(*) FROM p), 6) AS noise_ratio FROM g""")
def a20(spark, d):
    return _r(ag.injection_stats(table(spark, d, "events"), "event_id", F.col("event_type").isin("error", "view"), "event_type"), "avg_gap", "noise_ratio")


@query("a21_balanced_parts")
def a21(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return ag.balance(docs, "lang", "doc_id", "n_chars", 4).unionByName(ag.balance(docs, "lang", "doc_id", "n_chars", 4, "differencing"))


@query("a22_imbalance", "SELECT min(t) AS least, max(t) AS most, round(avg(t), 4) AS mean, CAST(sum(ceil(t / 5000.0)) AS BIGINT) AS batches FROM (SELECT lang, CAST(sum(n_chars) AS BIGINT) AS t FROM documents GROUP BY 1)")
def a22(spark, d):
    return _r(ag.imbalance(table(spark, d, "documents"), "lang", "n_chars", 5000), "mean", digits=4)
