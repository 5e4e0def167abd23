"""Filter operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.operators import filters, ranking
from palimpsest.plans.registry import query, table

_PROPS = filters.json_field("props")


@query("f1_scan_filters", "SELECT doc_id, lang, source FROM documents WHERE lang IN ('en', 'fr') AND source IN ('src0', 'src1', 'src2')")
def f1(spark, d):
    return table(spark, d, "documents").filter(F.col("lang").isin("en", "fr") & F.col("source").isin("src0", "src1", "src2")).select("doc_id", "lang", "source")


@query("f2_dict_filter", "SELECT event_id, user_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 20 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <= 60 AND event_type ILIKE '%ic%'")
def f2(spark, d):
    e = table(spark, d, "events")
    keep = filters.condition({"k": {"gt": 20, "lte": 60}}, _PROPS) & filters.condition({"event_type": {"contains": "IC"}})
    return e.filter(keep).select("event_id", "user_id")


@query("f2_dict_filter_in_like", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_type ILIKE '%LI%' AND json_extract_string(props, '$.k') IN ('1', '2', '3', '50')")
def f2b(spark, d):
    e = table(spark, d, "events")
    return e.filter(filters.condition({"event_type": {"in": ["click", "view"], "like": "LI"}}) & filters.condition({"k": {"in": [1, 2, 3, 50]}}, _PROPS)).select("event_id")


@query("f2_timestamp_filter", "SELECT event_id FROM (SELECT event_id, ts AS created_at FROM events) WHERE created_at >= TIMESTAMP '2024-01-05 00:00:00' AND created_at < TIMESTAMP '2024-01-20 12:00:00'")
def f2c(spark, d):
    e = table(spark, d, "events").withColumnRenamed("ts", "created_at")
    return e.filter(filters.condition({"created_at": {"gte": "2024-01-05 00:00:00", "lt": "2024-01-20 12:00:00"}})).select("event_id")


@query("f3_and_or", "SELECT event_id FROM events WHERE (event_type = 'click' OR CAST(json_extract_string(props, '$.k') AS DOUBLE) < 10)")
def f3(spark, d):
    e = table(spark, d, "events")
    return e.filter(filters.combined({"or": [{"event_type": "click"}, {"k": {"lt": 10}}]}, lambda n: _PROPS(n) if n == "k" else F.col(n))).select("event_id")


@query("f3_and_wins", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id < 30")
def f3b(spark, d):
    spec = {"and": [{"event_type": "view"}, {"user_id": {"lt": 30}}], "or": [{"event_type": "click"}]}
    return table(spark, d, "events").filter(filters.combined(spec)).select("event_id")


@query("f4_list_filter", "SELECT event_id, value FROM events WHERE value >= 2 AND event_type IN ('click', 'error') AND user_id <> -1 AND contains(event_type, 'r')")
def f4(spark, d):
    spec = [{"field": "value", "op": ">=", "value": 2}, {"field": "event_type", "op": "in", "value": ["click", "error"]}, {"field": "event_type", "op": "contains", "value": "r"}]
    return table(spark, d, "events").filter(filters.listed(spec)).select("event_id", "value")


@query("f5_tag_filter", "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND json_extract_string(props, '$.k') IN ('5', '6', '7', '8', '9') AND (event_type = 'click' OR event_type = 'view')")
def f5(spark, d):
    keep = filters.tags({"k": {"$exists": True, "$in": [5, 6, 7, 8, 9]}, "scope": "skipped"}, _PROPS, ["click", "view"], F.col("event_type"))
    return table(spark, d, "events").filter(keep).select("event_id")


@query("f5_empty_lists_deny", "SELECT count(*) FILTER (WHERE FALSE) AS n_in, count(*) FILTER (WHERE FALSE) AS n_scopes FROM events")
def f5b(spark, d):
    e = table(spark, d, "events")
    none = filters.tags({"k": {"$in": []}}, _PROPS)
    return e.agg(F.count_if(none).alias("n_in"), F.count_if(filters.tags({}, _PROPS, [], F.col("event_type"))).alias("n_scopes"))


@query("f6_tag_filter_scalar_flavour", "SELECT event_id FROM events WHERE contains(json_extract_string(props, '$.k'), '7')")
def f6(spark, d):
    keep = filters.tags({"k": {"$contains": "7"}}, _PROPS, [], F.col("event_type"), deny_on_no_scope=False)
    return table(spark, d, "events").filter(keep).select("event_id")


@query("f7_range_filter", "SELECT event_id FROM events WHERE value >= 1.5 AND value <= 9.5 AND event_type = 'click'")
def f7(spark, d):
    return table(spark, d, "events").filter(filters.payload({"value": {"gte": 1.5, "lte": 9.5}, "event_type": "click"})).select("event_id")


@query("f7_range_filter_one_sided", "SELECT event_id FROM events WHERE value <= 3.5 AND user_id >= 10")
def f7b(spark, d):
    return table(spark, d, "events").filter(filters.payload({"value": {"lte": 3.5}, "user_id": {"gte": 10}}, one_sided=True)).select("event_id")


@query("f8_filter_after_fetch", "SELECT event_id, value FROM (SELECT * FROM events ORDER BY value DESC, event_id LIMIT 40) WHERE event_type IN ('click', 'view') ORDER BY value DESC, event_id LIMIT 20")
def f8(spark, d):
    got = filters.after_fetch(table(spark, d, "events"), {"event_type": ["click", "view"]}, 20, [F.desc("value"), F.col("event_id")])
    return got.select("event_id", "value")


@query("f9_time_range", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts <= TIMESTAMP '2024-01-09 00:00:00'")
def f9(spark, d):
    return table(spark, d, "events").filter(F.col("ts").between(F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-09").cast("timestamp"))).select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("f10_substring_facts", "SELECT p_partkey FROM part WHERE contains(p_name, '1') OR contains(p_brand, '1') OR contains(p_type, '1')")
def f10(spark, d):
    p = table(spark, d, "part")
    return p.filter(filters.some([F.col(c).contains("1") for c in ("p_name", "p_brand", "p_type")])).select("p_partkey")




@query("f11_subgraph", "SELECT source_id, target_id, count(*) AS n FROM (SELECT o_custkey AS source_id, o_orderkey % 50 AS target_id FROM orders) e WHERE source_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') AND target_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1, 2")
def f11(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_mktsegment")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 50).alias("target_id"))
    _, kept = filters.subgraph(nodes, edges, F.col("c_mktsegment") == "BUILDING")
    return kept.groupBy("source_id", "target_id").agg(F.count("*").alias("n"))


@query("f12_long_enough", r"SELECT doc_id FROM documents WHERE CASE WHEN regexp_matches(text, '^[\x00-\x7F]*$') THEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) >= 200 ELSE length(text) >= 200 END")
def f12(spark, d):
    return table(spark, d, "documents").filter(filters.long_enough(F.col("text"), 200)).select("doc_id")


@query("f13_relativity", "SELECT event_id FROM events WHERE coalesce(value, 1.0) >= 5")
def f13(spark, d):
    return ranking.with_threshold(table(spark, d, "events"), "value", 5.0).select("event_id")


@query("f14_no_information", "SELECT DISTINCT event_type FROM events WHERE lower(trim(event_type)) NOT IN ('error', 'unknown', 'none') AND NOT regexp_matches(event_type, 'ick')")
def f14(spark, d):
    from palimpsest.functions import text

    e = table(spark, d, "events")
    return e.filter(~text.no_information(F.col("event_type"), ("error", "unknown", "none")) & ~text.has_marker(F.col("event_type"), ("ick",))).select("event_type").distinct()


@query("f15_claim_validation", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS modality FROM events WHERE event_type IS NOT NULL AND user_id IN (SELECT user_id FROM events WHERE user_id < 40)")
def f15(spark, d):
    e = table(spark, d, "events")
    allowed = F.sequence(F.lit(0), F.lit(39)).cast("array<bigint>")
    ok = F.col("event_type").isNotNull() & (F.size(F.array_except(F.array("user_id"), allowed)) == 0)
    return e.filter(ok).select("event_id", F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).otherwise("other").alias("modality"))


@query("f16_all_tags", "SELECT DISTINCT user_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'error', 'view') GROUP BY user_id HAVING count(DISTINCT event_type) = 3)")
def f16(spark, d):
    e = table(spark, d, "events")
    return filters.tagged_all(e.select("user_id").distinct(), e, "user_id", "event_type", ["click", "error", "view"], True)


@query("f16_any_tag", "SELECT DISTINCT user_id FROM events WHERE event_type IN ('error')")
def f16b(spark, d):
    e = table(spark, d, "events")
    return filters.tagged_all(e.select("user_id").distinct(), e, "user_id", "event_type", ["error"], False)


@query("f17_valid_triples", "SELECT DISTINCT p[1] AS subject, p[2] AS predicate, p[3] AS object FROM (SELECT string_split(p_type || '|' || p_brand || '|' || CAST(p_size AS VARCHAR), '|') AS p FROM part UNION ALL SELECT string_split(p_brand, '|') FROM part) WHERE len(p) = 3")
def f17(spark, d):
    p = table(spark, d, "part")
    parts = p.select(F.split(F.concat_ws("|", "p_type", "p_brand", F.col("p_size").cast("string")), r"\|").alias("p")).union(p.select(F.split("p_brand", r"\|")))
    return parts.filter(F.size("p") == 3).select(F.get("p", 0).alias("subject"), F.get("p", 1).alias("predicate"), F.get("p", 2).alias("object")).distinct()


@query("f18_isolated", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 = 0) AND c_custkey NOT IN (SELECT o_orderkey % 50 FROM orders)")
def f18(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    orders = table(spark, d, "orders")
    edges = orders.filter("o_custkey % 3 = 0").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 50).alias("target_id"))
    edges = edges.union(orders.select((F.col("o_orderkey") % 50), (F.col("o_orderkey") % 50)))
    return filters.isolated(nodes, edges)


@query("f19_no_file_markers", "SELECT page_id FROM pages WHERE NOT contains(html, 'File URL:') AND NOT contains(html, 'File ID:') AND NOT contains(html, 'ref=x') AND NOT contains(html, 'Filename:')")
def f19(spark, d):
    return table(spark, d, "pages").filter(~filters.some([F.col("html").contains(m) for m in ("File URL:", "File ID:", "Filename:", "ref=x")])).select("page_id")


@query("f20_soft_delete", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'deleted' ELSE 'activated' END AS status, CASE WHEN user_id % 5 = 0 THEN 'now' ELSE '' END AS deleted_at, CASE WHEN user_id % 5 = 0 THEN 'batch' ELSE '' END AS deleted_by FROM events")
def f20(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.lit("activated").alias("status"), F.lit("").alias("deleted_at"), F.lit("").alias("deleted_by"))
    return filters.soft_deleted(e, F.col("user_id") % 5 == 0).drop("user_id")


@query("f20_restore", "SELECT event_id, CASE WHEN user_id % 10 = 0 OR user_id % 5 <> 0 THEN 'activated' ELSE 'deleted' END AS status FROM events")
def f20b(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", F.lit("activated").alias("status"), F.lit("").alias("deleted_at"), F.lit("").alias("deleted_by"))
    gone = filters.soft_deleted(e, F.col("user_id") % 5 == 0)
    return filters.soft_deleted(gone, F.col("user_id") % 10 == 0, restore=True).select("event_id", "status")


@query("f20_hard_delete", "SELECT o_custkey AS source_id, count(*) AS n FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1")
def f20c(spark, d):
    gone = table(spark, d, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("source_id"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"))
    return edges.join(gone, "source_id", "left_anti").groupBy("source_id").agg(F.count("*").alias("n"))


@query("f21_list_by_scopes", "SELECT event_id FROM (SELECT * FROM events WHERE (event_type = 'click' OR event_type = 'view') AND user_id < 60 AND CAST(json_extract_string(props, '$.k') AS DOUBLE) <> 3 ORDER BY event_id LIMIT 100)")
def f21(spark, d):
    keep = filters.tags({}, _PROPS, ["click", "view"], F.col("event_type")) & (F.col("user_id") < 60) & (_PROPS("k").cast("double") != 3)
    return table(spark, d, "events").filter(keep).orderBy("event_id").limit(100).select("event_id")


@query("f22_any_keyword", "SELECT doc_id FROM (SELECT doc_id FROM documents WHERE contains(lower(text), 'hation') OR contains(lower(text), 'eaux') ORDER BY doc_id LIMIT 25)")
def f22(spark, d):
    words = F.array(F.lit("hation"), F.lit("eaux"))
    return table(spark, d, "documents").filter(F.exists(words, lambda w: F.lower("text").contains(w))).orderBy("doc_id").limit(25).select("doc_id")
