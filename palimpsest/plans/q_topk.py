"""Top-k, reranking and pagination over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.operators import fuzzy, selection, topk
from palimpsest.plans.q_joins import DOT, _TRIPLETS, cos, triplets
from palimpsest.plans.q_lexical import BM25, best
from palimpsest.plans.registry import query, table

Q = [((i * 37) % 19 - 9) / 10 for i in range(64)]
QS = "[" + ", ".join(map(str, Q)) + "]::DOUBLE[]"
_DOT = f"round({DOT.format(a='embedding', b=QS)}, 6)"
_COS = f"round({cos('embedding', QS)}, 6)"


@query("k1_dense_topk", f"SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def k1(spark, d):
    return topk.dense(table(spark, d, "embeddings"), "vec_id", "embedding", Q, 10)


@query("k2_bm25_topk_positive", BM25 + " SELECT query, doc, score FROM k WHERE rank <= 3 AND score > 0")
def k2(spark, d):
    return best(spark, d, 3).select("query", "doc", "score")


@query("k5_cosine_topk", f"SELECT vec_id, {_COS} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 10")
def k5(spark, d):
    return topk.dense(table(spark, d, "embeddings"), "vec_id", "embedding", Q, 10, "cosine")


@query("k6_l2_topk", f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {QS}), 6) AS score FROM embeddings ORDER BY score, vec_id LIMIT 10")
def k6(spark, d):
    return topk.dense(table(spark, d, "embeddings"), "vec_id", "embedding", Q, 10, "l2")


def _scored(spark, d):
    e = table(spark, d, "embeddings")
    return e.select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), topk.vector(Q)), 6).alias("score"))


_SCORED = f"(SELECT vec_id, label, {_COS} AS score FROM embeddings)"


@query("k7_threshold_after_cut", f"SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM {_SCORED}) WHERE r <= 30 AND score >= 0.2")
def k7(spark, d):
    return topk.cut_then_threshold(_scored(spark, d), ["label"], 30, 0.2, "vec_id").select("vec_id", "label", "score")


@query("k8_level_weights", f"""WITH w AS (SELECT vec_id, round(score * CASE label WHEN 1 THEN 1.2 WHEN 2 THEN 0.8 ELSE 1.0 END, 6) AS score FROM {_SCORED} WHERE score > 0.3), b AS (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM w)
SELECT CAST(s.rank AS INTEGER) AS rank, vec_id, coalesce(score, -1.0) AS score FROM (SELECT unnest(range(1, 9)) AS rank) s LEFT JOIN b USING (rank)""")
def k8(spark, d):
    rows = _scored(spark, d).filter("score > 0.3").withColumn("label", F.col("label").cast("string"))
    return topk.weighted_rerank(rows, "label", {"1": 1.2, "2": 0.8}, 8, "vec_id")


@query("k9_trim_by_type", f"SELECT vec_id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM {_SCORED}) WHERE r <= CASE label WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 0 END AND round(score, 2) <> 0")
def k9(spark, d):
    rows = _scored(spark, d).withColumn("kind", F.col("label").cast("string"))
    return topk.trim_by_type(rows, "kind", {"0": 5, "1": 3}, "vec_id", drop_zero=True).select("vec_id", "label", "score")


@query("k11_best_triplets", f"WITH t AS ({_TRIPLETS}), k AS (SELECT *, source_id * 1000000 + target_id * 10 + CASE relation WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS o FROM t), b AS (SELECT * FROM k ORDER BY total, o DESC LIMIT 7) SELECT source_id, target_id, relation, total, CAST(row_number() OVER (ORDER BY total DESC, o) AS INTEGER) AS rank FROM b")
def k11(spark, d):
    code = F.when(F.col("relation") == "A", 1).when(F.col("relation") == "N", 2).otherwise(3)
    t = triplets(spark, d).withColumn("o", F.col("source_id") * 1000000 + F.col("target_id") * 10 + code)
    return topk.best_triplets(t, 7, "o").select("source_id", "target_id", "relation", "total", "rank")


@query("k12_keyset_page", """WITH p AS (SELECT event_id, ts FROM events WHERE ts < TIMESTAMP '2024-01-12 00:00:00' OR (ts = TIMESTAMP '2024-01-12 00:00:00' AND event_id < 100) ORDER BY ts DESC, event_id DESC LIMIT 26)
SELECT event_id, (SELECT count(*) FROM p) > 25 AS has_more FROM (SELECT * FROM p ORDER BY ts DESC, event_id DESC LIMIT 25)""")
def k12(spark, d):
    cursor = topk.encode_cursor("2024-01-12 00:00:00", 100)
    return topk.keyset_page(table(spark, d, "events"), "ts", "event_id", 25, tuple(topk.decode_cursor(cursor))).select("event_id", "has_more")


@query("k13_keyset_page_ascending", "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-05 00:00:00' OR (ts = TIMESTAMP '2024-01-05 00:00:00' AND event_id > 50) ORDER BY ts, event_id LIMIT 25")
def k13(spark, d):
    return topk.keyset_page(table(spark, d, "events"), "ts", "event_id", 25, ("2024-01-05 00:00:00", 50), descending=False).select("event_id")


@query("k14_listing", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND ts > TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-20' AND contains(lower(props), '\"k\": 1') AND user_id % 6 <> 0 ORDER BY event_id LIMIT 60")
def k14(spark, d):
    got = topk.listing(table(spark, d, "events"), {"event_type": ["click", "view"]}, "2024-01-02", "2024-01-20", contains={"props": '"K": 1'}, deleted=F.col("user_id") % 6 == 0)
    return got.orderBy("event_id").limit(60).select("event_id")


_TEMPORAL = "(SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS s, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate END AS e FROM orders)"


def _temporal(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("s"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderdate")).alias("e"))


@query("k15_temporal_order", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s ASC NULLS LAST, o_orderkey) AS INTEGER) AS rank FROM {_TEMPORAL}")
def k15(spark, d):
    return topk.temporal_order(_temporal(spark, d), ["o_custkey"], "s", "e", "o_orderkey").select("o_orderkey", "rank")


@query("k15_temporal_order_descending", f"SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY e DESC NULLS FIRST, o_orderkey) AS INTEGER) AS rank FROM {_TEMPORAL}")
def k15b(spark, d):
    return topk.temporal_order(_temporal(spark, d), ["o_custkey"], "s", "e", "o_orderkey", descending=True).select("o_orderkey", "rank")


@query("k17_fuzzy_topk", "SELECT p_partkey, CAST(d AS INTEGER) AS distance FROM (SELECT p_partkey, levenshtein(lower(p_type), 'economy brass') AS d FROM part) ORDER BY d, p_partkey LIMIT 15")
def k17(spark, d):
    p = table(spark, d, "part").select("p_partkey", F.levenshtein(F.lower("p_type"), F.lit("economy brass")).alias("distance"))
    return p.orderBy("distance", "p_partkey").limit(15)


@query("k17_partial_ratio")
def k17_partial(spark, d):
    """The benchmark items' first words as searches, over the names and types of all parts."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("question"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return fuzzy.partial_ratio_top_k(names, "id", "name", q, 5)


@query("k18_value_selection", f"SELECT vec_id, label FROM {_SCORED} WHERE label >= 1 ORDER BY label DESC, score DESC, vec_id LIMIT 12")
def k18(spark, d):
    return selection.epsilon_greedy(_scored(spark, d), "label", "score", "vec_id", 12, least=1).select("vec_id", "label")


@query("k19_threshold_then_first", f"SELECT vec_id FROM {_SCORED} WHERE score >= 0.1 ORDER BY vec_id LIMIT 20")
def k19(spark, d):
    return topk.threshold_then_first(_scored(spark, d), ["vec_id"], 20, 0.1).select("vec_id")


@query("k19_random_rows", "SELECT CAST(20 AS BIGINT) AS n, CAST(20 AS BIGINT) AS n_distinct FROM (SELECT 1)")
def k19b(spark, d):
    return topk.random_rows(table(spark, d, "embeddings"), "vec_id", 20).agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("n_distinct"))


@query("k20_with_links", f"""WITH h AS (SELECT vec_id AS item, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM {_SCORED} QUALIFY rank <= 8), l AS (SELECT item, rank, 0 AS pos FROM h UNION ALL SELECT (item * 7 + p * 13) % 100, rank, p FROM h, (SELECT unnest([1, 2, 3]) AS p)),
f AS (SELECT item, min(rank * 10 + pos) AS place FROM l GROUP BY 1) SELECT item, CAST(row_number() OVER (ORDER BY place, item) AS INTEGER) AS at_ FROM f""")
def k20(spark, d):
    from palimpsest.operators.ranking import top_k

    hits = top_k(_scored(spark, d), [], [F.desc("score"), "vec_id"], 8).select(F.lit(1).alias("query"), F.col("vec_id").alias("item"), "rank")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("pos"))
    links = e.withColumn("linked", (F.col("item") * 7 + F.col("pos") * 13) % 100)
    return topk.with_links(hits, links, 3).select("item", F.col("at").alias("at_"))


_TURNS = "(SELECT l_suppkey AS claim, l_orderkey AS ref, l_partkey * 10 + l_linenumber AS pos, l_quantity AS score FROM lineitem)"


def _turns(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("claim"), F.col("l_orderkey").alias("ref"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("pos"), F.col("l_quantity").alias("score"), F.lit("t").alias("turn"))


@query("k21_provenance_turns", f"""WITH t AS (SELECT * FROM {_TURNS}), b AS (SELECT claim, ref, row_number() OVER (PARTITION BY claim ORDER BY max(score) DESC, ref) AS r FROM t GROUP BY 1, 2), k AS (SELECT t.*, row_number() OVER (PARTITION BY claim ORDER BY score DESC, ref, pos) AS r2 FROM t JOIN b USING (claim, ref) WHERE r <= 3)
SELECT claim, ref, pos, CAST(row_number() OVER (PARTITION BY claim ORDER BY ref, pos) AS INTEGER) AS place FROM k WHERE r2 <= 5""")
def k21(spark, d):
    return topk.provenance_turns(_turns(spark, d), 3, 5).select("claim", "ref", "pos", "place")


@query("k22_unused_turns", f"SELECT ref, pos, CAST(row_number() OVER (ORDER BY ref, pos) AS INTEGER) AS place FROM (SELECT * FROM {_TURNS} WHERE NOT (ref % 2 = 0 AND pos % 10 = 1) ORDER BY score DESC, ref, pos LIMIT 12)")
def k22(spark, d):
    t = _turns(spark, d)
    return topk.unused_turns(t, t.filter("ref % 2 = 0 and pos % 10 = 1").select("ref", "pos"), 12).select("ref", "pos", "place")


@query("k23_state_candidates", f"SELECT vec_id, CAST(row_number() OVER (ORDER BY label = 3 DESC, score DESC, vec_id % 5 DESC, vec_id) AS INTEGER) AS rank FROM (SELECT * FROM {_SCORED} WHERE label = 3 OR score >= 0.2 ORDER BY label = 3 DESC, score DESC, vec_id % 5 DESC, vec_id LIMIT 9)")
def k23(spark, d):
    return topk.state_candidates(_scored(spark, d).withColumn("full", F.col("vec_id") % 5), F.col("label") == 3, "score", "full", "vec_id", 9, 0.2).select("vec_id", "rank")


@query("k24_context_ids", f"SELECT id FROM (SELECT vec_id, unnest(string_split(vec_id || ',' || (vec_id + 1), ',')) AS id FROM (SELECT vec_id, {_DOT} AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 6))")
def k24(spark, d):
    top = topk.dense(table(spark, d, "embeddings"), "vec_id", "embedding", Q, 6)
    return top.select(F.explode(F.split(F.concat_ws(",", "vec_id", F.col("vec_id") + 1), ",")).alias("id"))


@query("k25_multi_vector", f"""WITH q AS (SELECT vec_id AS q, embedding AS qv FROM embeddings ORDER BY vec_id LIMIT 3), s AS (SELECT q, vec_id, label, round({cos('embedding', 'qv')}, 6) AS score FROM embeddings, q),
a AS (SELECT vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s), b AS (SELECT vec_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, vec_id) AS r FROM s WHERE label = 2), u AS (SELECT vec_id, max(score) AS score FROM (SELECT * FROM a WHERE r <= 5 UNION ALL SELECT * FROM b WHERE r <= 5) GROUP BY 1)
SELECT vec_id, score, CAST(row_number() OVER (ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM u""")
def k25(spark, d):
    e = table(spark, d, "embeddings")
    return topk.multi_vector(e, "vec_id", "embedding", e, "vec_id", "embedding", 5, F.col("label") == 2, 3).select("vec_id", "score", "rank")


@query("k26_boosts", f"SELECT vec_id, round(least(greatest(CASE WHEN label = 1 THEN least(greatest(score * 1.5, 0.0), 1.0) ELSE score END * CASE WHEN vec_id % 2 = 0 THEN 0.8 ELSE 1.0 END, CASE WHEN vec_id % 2 = 0 THEN 0.0 ELSE -9.0 END), CASE WHEN vec_id % 2 = 0 THEN 1.0 ELSE 9.0 END), 6) AS score FROM {_SCORED}")
def k26(spark, d):
    return _scored(spark, d).select("vec_id", F.round(topk.boosted(F.col("score"), [(F.col("label") == 1, 0.5), (F.col("vec_id") % 2 == 0, -0.2)]), 6).alias("score"))


@query("k27_quota_split", f"""WITH r AS (SELECT *, vec_id % 150 AS t, label % 2 = 0 AS know FROM {_SCORED}), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, vec_id) AS d FROM r) WHERE d = 1),
q AS (SELECT *, greatest(6, 10 - (SELECT count(*) FROM o WHERE NOT know)) AS quota, row_number() OVER (PARTITION BY know ORDER BY score DESC, vec_id) AS p FROM o)
SELECT vec_id FROM q WHERE CASE WHEN know THEN p <= quota ELSE p <= 10 - least((SELECT count(*) FROM o WHERE know), quota) END""")
def k27(spark, d):
    rows = _scored(spark, d).withColumn("t", F.col("vec_id") % 150).withColumn("g", F.lit(1))
    return topk.quota_split(rows, "g", F.col("label") % 2 == 0, "t", 10, 0.6, [F.desc("score"), "vec_id"]).select("vec_id")


@query("k28_threshold_with_minimum", f"""WITH r AS (SELECT *, vec_id % 3 = 0 AS own, score >= 0.25 AS ok FROM {_SCORED}), p AS (SELECT *, row_number() OVER (PARTITION BY label, own ORDER BY vec_id) AS p, count(*) FILTER (WHERE ok) OVER (PARTITION BY label) AS n, count(*) FILTER (WHERE ok AND own) OVER (PARTITION BY label) AS m FROM r)
SELECT vec_id FROM p WHERE CASE WHEN n < 3 THEN p <= 3 ELSE ok OR (own AND p <= 3 AND m < 3) END""")
def k28(spark, d):
    return topk.threshold_with_minimum(_scored(spark, d), "label", F.col("vec_id") % 3 == 0, 0.25, 3, "vec_id").select("vec_id")


@query("k29_recent", "SELECT event_id FROM events WHERE user_id = 3 AND ts >= TIMESTAMP '2024-01-02' AND event_type IN ('click', 'view') ORDER BY ts DESC, event_id LIMIT 10")
def k29(spark, d):
    got = topk.listing(table(spark, d, "events"), {"user_id": 3, "event_type": ["click", "view"]}).filter(F.col("ts") >= F.lit("2024-01-02").cast("timestamp"))
    return got.orderBy(F.desc("ts"), "event_id").limit(10).select("event_id")


@query("k30_mean_vector_query", f"""WITH m AS (SELECT list(x ORDER BY i) AS mean FROM (SELECT i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id IN (3, 5, 8) GROUP BY 1))
SELECT vec_id, round({DOT.format(a='embedding', b='mean')}, 5) AS score FROM embeddings, m ORDER BY round({DOT.format(a='embedding', b='mean')}, 5) DESC, vec_id LIMIT 10""")
def k30(spark, d):
    e = table(spark, d, "embeddings")
    mean = topk.keyword_vector(e.filter(F.col("vec_id").isin(3, 5, 8)), "embedding", 64)
    scored = e.crossJoin(F.broadcast(mean)).select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("mean")), 5).alias("score"))  # one row
    return scored.orderBy(F.desc("score"), "vec_id").limit(10)


@query("k31_keyword_counts", "SELECT keyword, count(*) AS n FROM (SELECT unnest([event_type, 'u' || user_id % 5]) AS keyword FROM events WHERE ts >= TIMESTAMP '2024-01-02' AND ts <= TIMESTAMP '2024-01-10' AND user_id % 9 <> 0) GROUP BY 1")
def k31(spark, d):
    e = table(spark, d, "events").withColumn("words", F.when(F.col("user_id") % 9 != 0, F.array("event_type", F.concat(F.lit("u"), F.col("user_id") % 5))))
    return topk.keyword_counts(e, "ts", "words", "2024-01-02", "2024-01-10")
