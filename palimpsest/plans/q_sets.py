"""Set operations and deduplication over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import lexical, ranking, selection, sets
from palimpsest.plans.q_joins import cos
from palimpsest.plans.q_lexical import part_vectors
from palimpsest.plans.registry import query, table

_ARRAYS = "(SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS p, list(l_suppkey ORDER BY l_linenumber, l_suppkey) FILTER (WHERE l_tax > 0.03) AS g FROM lineitem GROUP BY 1)"


def _arrays(spark, d):
    ids = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct("l_linenumber", "l_suppkey")))), lambda x: x["l_suppkey"])
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(ids(F.lit(True)).alias("p"), ids(F.col("l_tax") > 0.03).alias("g"))


@query("d1_intersect_except", f"SELECT l_orderkey, len(list_intersect(list_distinct(p), coalesce(g, []))) AS tp, len(list_filter(list_distinct(p), lambda x: NOT list_contains(coalesce(g, []), x))) AS fp, CAST(0 AS BIGINT) AS fn FROM {_ARRAYS}")
def d1(spark, d):
    hit, wrong, missed = sets.predicted_vs_gold(F.col("p"), F.col("g"))
    return _arrays(spark, d).select("l_orderkey", *[F.size(x).cast("long").alias(n) for x, n in ((hit, "tp"), (wrong, "fp"), (missed, "fn"))])


@query("d2_normalized_ids", "SELECT event_id, CASE WHEN user_id % 4 = 0 THEN CAST(user_id AS VARCHAR) ELSE user_id || ',x' || user_id END AS ids FROM events")
def d2(spark, d):
    e = table(spark, d, "events")
    u = F.col("user_id").cast("string")
    raw = F.array(u, F.concat(u, F.lit(".0")), F.lit("None"), F.lit("true"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("x"), u)), F.lit(" "))
    return e.select("event_id", F.array_join(sets.normalized_ids(raw), ",").alias("ids"))


@query("d3_gold_union", f"SELECT l_orderkey, len(list_distinct(p)) AS n FROM {_ARRAYS}")
def d3(spark, d):
    return _arrays(spark, d).select("l_orderkey", F.size(sets.union_ids(F.col("g").cast("array<string>"), F.col("p").cast("array<string>"), F.lit(None).cast("array<string>"))).cast("long").alias("n"))


@query("d4_last_writer", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'b' ELSE 'a' END AS channel FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 AND event_id % 2 = 0 UNION ALL SELECT event_id, 'b' FROM events WHERE event_id % 3 = 0 AND event_id % 2 = 1")
def d4(spark, d):
    e = table(spark, d, "events").select("event_id")
    return sets.union_last_wins([e.filter("event_id % 2 = 0").withColumn("channel", F.lit("a")), e.filter("event_id % 3 = 0").withColumn("channel", F.lit("b"))], "event_id")


@query("d5_dedupe_by_text", "SELECT digest, max(n_chars) AS n_chars, arg_min(doc_id, (-n_chars, doc_id)) AS doc_id FROM (SELECT md5(text) AS digest, n_chars, doc_id FROM documents) GROUP BY 1")
def d5(spark, d):
    docs = table(spark, d, "documents").select(F.md5("text").alias("digest"), "n_chars", "doc_id")
    return ranking.dedupe_max(docs, ["digest"], "n_chars", "doc_id")


@query("d6_greedy_near_duplicates")
def d6(spark, d):
    return lexical.tfidf_near_duplicates(part_vectors(spark, d), table(spark, d, "part"), "p_partkey", 0.75)


def _greedy_sql(order: str, bar: float, cap: int | None = None) -> str:
    """Each label's rows in order; a list of the kept ones grows by whoever is in conflict with none of them."""
    room = f" AND len(kept) < {cap}" if cap else ""
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY {order}) AS r FROM embeddings),
c AS MATERIALIZED (SELECT b.label, b.vec_id, list(a.vec_id) AS against FROM o a JOIN o b ON a.label = b.label AND a.r < b.r AND {cos('a.embedding', 'b.embedding')} > {bar} GROUP BY 1, 2),
n AS MATERIALIZED (SELECT o.label, o.r, o.vec_id, coalesce(c.against, []::BIGINT[]) AS against FROM o LEFT JOIN c USING (label, vec_id)),
g AS (SELECT label, 0::BIGINT AS r, []::BIGINT[] AS kept FROM n GROUP BY 1
UNION ALL SELECT n.label, n.r, CASE WHEN NOT list_has_any(kept, against){room} THEN list_append(kept, vec_id) ELSE kept END FROM g JOIN n ON n.label = g.label AND n.r = g.r + 1),
k AS (SELECT label, arg_max(kept, r) AS kept FROM g GROUP BY 1)
SELECT label, unnest(kept) AS vec_id, CAST(generate_subscripts(kept, 1) AS INTEGER) AS place FROM k"""


@query("d7_diverse_subset", _greedy_sql("vec_id", 0.2))
def d7(spark, d):
    e = table(spark, d, "embeddings").withColumn("score", -F.col("vec_id").cast("double"))
    return selection.greedy_diverse(e, "label", "vec_id", "score", "embedding", 0.2)


@query("d8_score_ordered_dedupe", _greedy_sql("vec_id * 37 % 101 DESC, vec_id", 0.3, 10))
def d8(spark, d):
    e = table(spark, d, "embeddings").withColumn("score", F.pmod(F.col("vec_id") * 37, F.lit(101)).cast("double"))
    return selection.greedy_diverse(e, "label", "vec_id", "score", "embedding", 0.3, cap=10)


@query("d9_mmr_dedupe")
def d9(spark, d):
    e = table(spark, d, "embeddings").withColumn("score", F.pmod(F.col("vec_id") * 37, F.lit(101)) / 101.0).withColumn("text", F.concat(F.lit("memory "), F.col("vec_id") % 90))
    return selection.mmr_dedupe(e, "label", "vec_id", "score", "embedding", "text", 12)


@query("d10_state_mmr")
def d10(spark, d):
    e = table(spark, d, "embeddings").select("label", "vec_id", (F.pmod(F.col("vec_id") * 37, F.lit(101)) / 101.0).alias("score"), "embedding", F.when(F.col("vec_id") % 3 == 0, "turn").otherwise("claim").alias("kind"), (F.col("vec_id") % 11).alias("source"), F.array(F.col("vec_id") + 5, F.col("vec_id") - 20).alias("related"))
    return selection.state_mmr(e, "label", "vec_id", "score", "embedding", 8)


@query("d11_edge_dedupe", "SELECT DISTINCT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation FROM lineitem")
def d11(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation")).dropDuplicates(["source_id", "target_id", "relation"])


@query("d12_same_content", r"SELECT trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS content, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY 1 HAVING count(*) > 1")
def d12(spark, d):
    return table(spark, d, "part").groupBy(tx.slot(F.col("p_type")).alias("content")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first")).filter("n > 1")


@query("d13_drop_pointed_at", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_orderkey % 100 FROM orders WHERE o_orderstatus = 'F' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10))")
def d13(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id"), F.when(F.col("o_orderstatus") == "F", "SUMMARY").otherwise("OTHER").alias("relation"))
    return sets.drop_pointed_at(rows, edges, F.col("c_nationkey") < 10).select("id")


@query("d14_neighbour_ids", "SELECT DISTINCT n FROM (SELECT l_suppkey AS n FROM lineitem WHERE l_partkey = 7 UNION SELECT l_partkey FROM lineitem WHERE l_suppkey = 7)")
def d14(spark, d):
    li = table(spark, d, "lineitem")
    return li.filter("l_partkey = 7").select(F.col("l_suppkey").alias("n")).union(li.filter("l_suppkey = 7").select("l_partkey")).distinct()


@query("d15_connected_only", "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0) OR c_custkey IN (SELECT o_orderkey % 100 FROM orders WHERE o_orderkey % 9 = 0)")
def d15(spark, d):
    edges = table(spark, d, "orders").filter("o_orderkey % 9 = 0").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id"))
    return sets.connected_only(table(spark, d, "customer").select(F.col("c_custkey").alias("id")), edges)


@query("d16_merge_target", f"""SELECT task, target, similarity FROM (SELECT x.vec_id AS task, y.vec_id AS target, round({cos('x.embedding', 'y.embedding')}, 6) AS similarity,
row_number() OVER (PARTITION BY x.vec_id ORDER BY round({cos('x.embedding', 'y.embedding')}, 6) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 20 = 0) WHERE r = 1 AND similarity >= 0.4""")
def d16(spark, d):
    e = table(spark, d, "embeddings")
    return sets.merge_target(e.filter("vec_id % 20 = 0"), e, "embedding", "vec_id", 0.4)


@query("d17_second_minus_first", """WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents) SELECT min(doc_id) AS doc_id FROM n WHERE doc_id % 2 = 1 AND t NOT IN (SELECT t FROM n WHERE doc_id % 2 = 0) GROUP BY t""")
def d17(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sets.second_minus_first(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), "text", "doc_id").select("doc_id")


@query("d18_nodes_and_edges", "SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem) AS n_nodes, (SELECT count(*) FROM (SELECT DISTINCT l_partkey, l_returnflag, l_suppkey FROM lineitem)) AS n_edges")
def d18(spark, d):
    li = table(spark, d, "lineitem")
    nodes = li.dropDuplicates(["l_partkey"]).agg(F.count("*").alias("n_nodes"))
    return nodes.crossJoin(li.dropDuplicates(["l_partkey", "l_returnflag", "l_suppkey"]).agg(F.count("*").alias("n_edges")))  # single rows
