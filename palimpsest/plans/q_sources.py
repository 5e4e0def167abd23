"""Sources, sinks and connectors over the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from palimpsest.operators.tables import shared_dir
from palimpsest.plans.q_lexical import BM25
from palimpsest.plans.registry import query, table
from palimpsest.sources import corpus, ingest


@query("s1_persona_scan", """WITH p AS (SELECT doc_id, CAST(regexp_extract(source, '(\\d+)', 1) AS BIGINT) AS persona FROM documents)
SELECT doc_id, persona FROM p WHERE persona IN (SELECT DISTINCT persona FROM p WHERE persona IN (1, 2, 3, 5, 8, 13) ORDER BY persona LIMIT 3)""")
def s1(spark, d):
    docs = table(spark, d, "documents").select("doc_id", ingest.persona_of(F.regexp_replace("source", "^src", "persona_")).alias("persona"))
    return ingest.first_personas(docs, "persona", [1, 2, 3, 5, 8, 13], 3)


@query("s2_dialogue_rows", """SELECT conv_id, string_agg(CASE role WHEN 'user' THEN 'Patient: ' ELSE 'Doctor: ' END || text, chr(10) || chr(10) ORDER BY turn) AS content
FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id""")
def s2(spark, d):
    s = ingest.sessions_of(table(spark, d, "conversations"), "conv_id", "turn", "role", "text")
    return s.select("conv_id", ingest.dialogue_text(F.col("messages")).alias("content")).filter(F.col("content") != "")


@query("s2_noise_kind", "SELECT event_id, CASE WHEN user_id % 7 = 0 THEN 'family' WHEN user_id % 3 = 0 THEN 'knowledge' ELSE 'clean' END AS kind FROM events")
def s2b(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", ingest.noise_kind(F.when(F.col("user_id") % 3 == 0, "n"), F.when(F.col("user_id") % 7 == 0, "f")).alias("kind"))


@query("s3_dynamic_sessions", "SELECT conv_id, CAST(turn + 1 AS INTEGER) AS n, md5(text) AS turns, role AS date FROM conversations")
def s3(spark, d):
    c = table(spark, d, "conversations")
    pairs = F.flatten(F.collect_list(F.array(
        F.struct(F.concat(F.lit("session_"), (F.col("turn") + 1).cast("string")).alias("k"), F.col("text").alias("v")),
        F.struct(F.concat(F.lit("session_"), (F.col("turn") + 1).cast("string"), F.lit("_date_time")).alias("k"), F.col("role").alias("v")),
    )))
    raw = c.groupBy("conv_id").agg(F.to_json(F.map_from_entries(pairs)).alias("conversation"))
    return ingest.dynamic_sessions(raw, "conv_id", "conversation").withColumn("turns", F.md5("turns"))


@query("s4_questions", "SELECT event_id, CASE WHEN user_id % 5 + 1 = 5 THEN 'No information available' ELSE event_type END AS answer, CASE WHEN value IS NULL THEN 0 ELSE 1 END AS n_evidence FROM events WHERE user_id % 5 + 1 IN (1, 4, 5)")
def s4(spark, d):
    e = table(spark, d, "events").select("event_id", (F.col("user_id") % 5 + 1).alias("category"), F.col("event_type").alias("answer"), F.col("value").cast("string").alias("evidence"))
    return ingest.parse_questions(e, [1, 4, 5]).select("event_id", "answer", F.size("evidence").alias("n_evidence"))


@query("s5_embedding_table", "SELECT vec_id, len(embedding) AS dims, label, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[-1] AS DOUBLE) AS last FROM (SELECT vec_id, embedding, CAST(label AS BIGINT) AS label FROM embeddings)")
def s5(spark, d):
    """Saved in two batches, the second with rows of the first, and read back by a store that is opened anew."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("payload"))
    root = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/store-{uuid.uuid4().hex}"
    saved = ingest.VectorTable(spark, root, "embeddings")
    saved.insert(e.filter("id % 2 = 0"))
    saved.insert(e)
    rows = ingest.VectorTable(spark, root, "embeddings").rows
    v = F.col("vector")
    return rows.select(F.col("id").cast("long").alias("vec_id"), F.size(v).cast("long").alias("dims"), F.col("payload").cast("long").alias("label"), v[0].alias("first"), F.element_at(v, -1).alias("last"))


@query("s18_corpus_search", BM25 + " SELECT query, CAST(doc AS VARCHAR) AS doc, score, CAST(rank AS INTEGER) AS rank, lang AS title, md5(text) AS text FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, CAST(doc AS VARCHAR)) AS rank FROM k) JOIN documents ON doc = doc_id WHERE rank <= 3 AND score > 0")
def s18(spark, d):
    """Documents as JSON Lines, loaded, indexed and searched by the benchmark's items, with the texts that are found."""
    docs = table(spark, d, "documents")
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/corpus-{uuid.uuid4().hex}"
    docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("title"), F.col("text").alias("contents")).write.json(path, compression="gzip")
    held = corpus.indexed(corpus.load(spark, path))
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    return held.search(items, 3).withColumn("text", F.md5("text"))


_STORE = "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents WHERE doc_id % 2 = 0"


def _chunks(spark, d):
    return table(spark, d, "documents").select("doc_id", ingest.content_id(F.col("text")).alias("hash_id"))


@query("s6_upsert_by_hash", "SELECT DISTINCT 'chunk-' || md5(text) AS hash_id FROM documents")
def s6(spark, d):
    c = _chunks(spark, d)
    return ingest.upsert_new(c.filter("doc_id % 2 = 0").select("hash_id").distinct(), c.select("hash_id"))


@query("s7_missing_hashes", f"SELECT doc_id FROM documents WHERE doc_id % 2 = 1 AND 'chunk-' || md5(text) NOT IN ({_STORE})")
def s7(spark, d):
    c = _chunks(spark, d)
    return ingest.missing(c.filter("doc_id % 2 = 1"), c.filter("doc_id % 2 = 0")).select("doc_id")


@query("s8_delete_by_id", "SELECT doc_id FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 3)")
def s8(spark, d):
    c = _chunks(spark, d)
    return ingest.delete_ids(c, c.filter("doc_id % 10 = 3")).select("doc_id")


@query("s12_upsert_nodes", """SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.memory ELSE o.memory END AS memory,
CASE WHEN o.id IS NULL THEN 'new' ELSE 'old' END AS user_name, CASE WHEN o.id IS NULL THEN CAST(2 AS INTEGER) ELSE 1 END AS created_at, CASE WHEN n.id IS NOT NULL THEN CAST(2 AS INTEGER) ELSE 1 END AS updated_at
FROM (SELECT c_custkey AS id, c_name AS memory FROM customer WHERE c_custkey % 3 <> 0) o FULL JOIN (SELECT c_custkey AS id, c_mktsegment AS memory FROM customer WHERE c_custkey % 2 = 0) n ON o.id = n.id""")
def s12(spark, d):
    c = table(spark, d, "customer")
    rows = lambda df, memory, user, when: df.select(F.col("c_custkey").alias("id"), F.col(memory).alias("memory"), F.lit("{}").alias("properties"), F.lit(None).cast("array<double>").alias("embedding"), F.lit(user).alias("user_name"), F.lit(when).alias("created_at"), F.lit(when).alias("updated_at"))
    got = ingest.upsert_nodes(rows(c.filter("c_custkey % 3 <> 0"), "c_name", "old", 1), rows(c.filter("c_custkey % 2 = 0"), "c_mktsegment", "new", 2))
    return got.select("id", "memory", "user_name", "created_at", "updated_at")


@query("s14_scroll", "SELECT event_id FROM events WHERE event_type = 'click' ORDER BY event_id LIMIT 50 OFFSET 20")
def s14(spark, d):
    return ingest.scroll(table(spark, d, "events"), F.col("event_type") == "click", "event_id", 50, 20).select("event_id")


@query("s15_graph_export", """WITH own AS (SELECT c_custkey AS id FROM customer WHERE c_nationkey = 7),
e AS (SELECT DISTINCT o_custkey AS source_id, o_orderkey % 100 AS target_id FROM orders)
SELECT source_id, target_id FROM e WHERE source_id IN (SELECT id FROM own) OR target_id IN (SELECT id FROM own)""")
def s15(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("created_at"))
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id"))
    return ingest.graph_export(nodes, edges, F.col("c_nationkey") == 7)[1]


@query("s16_history", "SELECT CAST(event_id AS VARCHAR) AS new_memory, event_type AS event FROM events WHERE user_id = 5 AND event_id % 2 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), event_type FROM events WHERE user_id = 5 AND event_id % 2 = 1")
def s16(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("memory_id"), F.col("event_id").cast("string").alias("new_memory"), F.col("event_type").alias("event"), F.col("ts").alias("updated_at"), "event_id")
    history = ingest.add_history(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"))
    return ingest.history_of(history, "5").select("new_memory", "event")


@query("s19_interleaved_order", """SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents WHERE doc_id % 5 <> 0""")
def s19(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").alias("ix"))
    got = ingest.interleave_noise(docs.filter("doc_id % 5 <> 0"), docs.filter("doc_id % 5 = 0"))
    kept = got.filter(~F.col("is_noise"))
    # Noise moves rows apart but keeps their order.
    from palimpsest.operators.ranking import running

    return running(kept.select("doc_id", "position"), ["position"], F.lit(1).cast("long"), "r").select("doc_id", (F.col("r") - 1).alias("position"))


@query("s20_noise_over_noise", "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 5 = 0 OR doc_id % 7 = 0) AS n_noise FROM documents")
def s20(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id"), F.col("doc_id").alias("ix"))
    once = ingest.interleave_noise(docs.filter("doc_id % 5 <> 0 and doc_id % 7 <> 0"), docs.filter("doc_id % 5 = 0"))
    again = ingest.interleave_noise(once.select("doc_id", F.col("position").cast("long").alias("ix")), docs.filter("doc_id % 7 = 0 and doc_id % 5 <> 0"), seed=7)
    return again.agg(F.count("*").alias("n"), F.count_if((F.col("doc_id") % 5 == 0) | (F.col("doc_id") % 7 == 0)).alias("n_noise"))


@query("s21_nested_export", """SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS n_items, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) AS items
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) > 0""")
def s21(spark, d):
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_quantity")
    got = ingest.nested(table(spark, d, "orders").select("o_orderkey"), items, "o_orderkey", ["l_linenumber", "l_partkey"]).filter("items is not null")
    return got.select("o_orderkey", F.size("items").cast("long").alias("n_items"), F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_partkey"].cast("string"))), ",").alias("items"))
