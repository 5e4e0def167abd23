"""Plug-in surfaces over the driver tables."""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import metrics as m
from palimpsest.functions import text as tx
from palimpsest.operators import lexical, rerank, retrievers
from palimpsest.operators.tables import cut, shared_dir
from palimpsest.plans.q_joins import cos
from palimpsest.plans.q_lexical import _LEX, BM25
from palimpsest.plans.registry import query, table


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/plugin-{uuid.uuid4().hex}"


def _numbers(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]


@query("r13_incremental_index", BM25 + " SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5 AND score > 0")
def r13(spark, d):
    """The index of two batches, the second of which comes with rows of the first, gives what one built at once does."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    growing: retrievers.Retriever = retrievers.GrowingIndex(spark, _folder(spark))
    growing.memorize(docs.filter("doc % 2 = 0"))
    growing.memorize(docs)
    return growing.query(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question")), 5)


@query("u1_vector_retriever", """WITH v AS (SELECT item_id, CAST(length(text) AS DOUBLE) AS l, length(text) - length(replace(text, ' ', '')) AS s FROM benchmark), n AS (SELECT item_id, l / sqrt(l * l + s * s + 1.0) AS x, s / sqrt(l * l + s * s + 1.0) AS y, 1 / sqrt(l * l + s * s + 1.0) AS z FROM v),
p AS (SELECT CAST(a.item_id AS VARCHAR) AS query, CAST(b.item_id AS VARCHAR) AS doc, round(a.x * b.x + a.y * b.y + a.z * b.z, 6) AS score FROM n a, n b)
SELECT query, doc, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM p) WHERE rank <= 3""")
def u1(spark, d):
    items = table(spark, d, "benchmark")
    dense: retrievers.Retriever = retrievers.VectorRetriever(spark, _folder(spark), "items", retrievers.Embedder(_numbers))
    dense.memorize(items.select(F.col("item_id").alias("doc"), "text"))
    return dense.query(items.select(F.col("item_id").alias("query"), F.col("text").alias("question")), 3)


@query("u3_dataset_info", "SELECT 'talks' AS name, count(*) AS n_units, CAST(sum(s) AS BIGINT) AS n_sessions, CAST(sum(q) AS BIGINT) AS n_queries FROM (SELECT conv_id, count(*) AS s, count(*) FILTER (WHERE role = 'user') AS q FROM conversations GROUP BY 1)")
def u3(spark, d):
    turns = table(spark, d, "conversations").withColumnRenamed("conv_id", "context_id")
    return retrievers.Dataset("talks", turns, turns.filter("role = 'user'")).info()


@query("u5_custom_aggregation", "SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'red widget' THEN 0.5 ELSE 0.0 END AS DOUBLE) AS score FROM part")
def u5(spark, d):
    mid = lambda values: (F.array_max(values) + F.array_min(values)) / 2
    golds = F.array(F.lit("red widget"), F.lit("none such"))
    return table(spark, d, "part").select("p_partkey", m.best_over(m.em, F.col("p_name"), golds, mid).alias("score"))


@query("u6_cosine_distance", f"SELECT x.vec_id, round(1 - {cos('x.embedding', 'y.embedding')}, 6) AS distance FROM embeddings x, embeddings y WHERE y.vec_id = 0")
def u6(spark, d):
    retrievers.register_functions(spark)
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = e.filter("vec_id = 0").select(F.col("v").alias("w"))
    return e.crossJoin(F.broadcast(one)).selectExpr("vec_id", "round(cosine_distance(v, w), 6) AS distance")  # one row


@query("u8_reranker", """WITH s AS (SELECT doc_id, round(CASE lang WHEN 'en' THEN 2.0 ELSE 1.0 END * n_chars, 6) AS score FROM documents)
SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s ORDER BY score DESC, doc_id LIMIT 7""")
def u8(spark, d):
    rerank = retrievers.RERANKERS.make("cosine_local", level="lang", weights={"en": 2.0}, k=7, tie="doc_id")
    scored = table(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return retrievers.RERANKERS.make(None)(rerank(scored)).select("doc_id", "score")


def _overlap(question: str, rows: str) -> str:
    asked = sorted(set(re.findall("[a-z0-9]+", question)))
    return f"""(SELECT doc, round(count(*) / {len(asked)}, 6) AS score FROM (SELECT doc, unnest({_LEX}) AS term FROM {rows}) WHERE term IN ({", ".join(f"'{w}'" for w in asked)}) GROUP BY 1)"""

_ASKED = {"chunks": "the and of in", "summaries": "in the is", "names": "furniture building nation_7 customer", "insights": "nation_7", "pieces": "red steel"}
_DOCS = "(SELECT doc_id AS doc, text FROM documents)"
_HEADS = "(SELECT doc_id AS doc, string_split(text, chr(10))[1] AS text FROM documents)"
_NODES = "(SELECT 'n' || n_nationkey AS doc, n_name AS text FROM nation UNION ALL SELECT DISTINCT 's' || c_mktsegment, c_mktsegment FROM customer UNION ALL SELECT 'c' || c_custkey, c_name FROM customer)"
_EDGES = "(SELECT 'c' || c_custkey AS source_id, 'in' AS relation, 'n' || c_nationkey AS target_id, 2 * c_custkey AS edge FROM customer UNION ALL SELECT 'c' || c_custkey, 'buys', 's' || c_mktsegment, 2 * c_custkey + 1 FROM customer)"
_FIRST = lambda rows, k: f"(SELECT *, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM {rows} ORDER BY rank LIMIT {k})"


@query("u9_search_kinds", f"""WITH f AS (SELECT doc, 1 - score AS distance FROM {_FIRST(_overlap(_ASKED["names"], "(SELECT doc, text FROM " + _NODES + ")"), 10)}),
t AS (SELECT e.*, coalesce(a.distance, 1.0) + coalesce(b.distance, 1.0) + CASE relation WHEN 'buys' THEN 0.5 ELSE 1.0 END AS total FROM {_EDGES} e LEFT JOIN f a ON source_id = a.doc LEFT JOIN f b ON target_id = b.doc ORDER BY total, edge DESC LIMIT 5),
c AS (SELECT row_number() OVER (ORDER BY total DESC, edge) AS rank, x.text || ' -- ' || relation || ' -- ' || y.text AS line FROM t JOIN {_NODES} x ON source_id = x.doc JOIN {_NODES} y ON target_id = y.doc),
i AS (SELECT DISTINCT source_id, relation, target_id FROM {_EDGES} WHERE source_id = 'n7' OR target_id = 'n7')
SELECT 'CHUNKS' AS kind, CAST(doc AS VARCHAR) AS found FROM {_FIRST(_overlap(_ASKED["chunks"], _DOCS), 5)}
UNION ALL SELECT 'SUMMARIES', CAST(doc AS VARCHAR) FROM {_FIRST(_overlap(_ASKED["summaries"], _HEADS), 5)}
UNION ALL SELECT 'RAG_COMPLETION', md5(string_agg(text, chr(10) ORDER BY rank)) FROM {_FIRST(_overlap(_ASKED["chunks"], _DOCS), 5)} JOIN {_DOCS} USING (doc)
UNION ALL SELECT 'INSIGHTS', source_id || ' ' || relation || ' ' || target_id FROM i UNION ALL SELECT 'INSIGHTS by id', source_id || ' ' || relation || ' ' || target_id FROM i
UNION ALL SELECT 'GRAPH_COMPLETION', string_agg(line, chr(10) ORDER BY rank) FROM c UNION ALL SELECT 'GRAPH_SUMMARY_COMPLETION', upper(string_agg(line, chr(10) ORDER BY rank)) FROM c
UNION ALL SELECT 'CODE', p_brand FROM (SELECT p_brand, min(rank) FROM {_FIRST(_overlap(_ASKED["pieces"], "(SELECT p_partkey AS doc, p_name AS text FROM part)"), 8)} JOIN part ON doc = p_partkey GROUP BY 1)
UNION ALL SELECT 'NATURAL_LANGUAGE', CAST(count(*) AS VARCHAR) FROM nation UNION ALL SELECT 'SQL', CAST(count(*) AS VARCHAR) FROM region""")
def u9(spark, d):
    """Every kind over the tables: documents, their first lines, customers with nations and segments, parts as pieces of brands."""
    docs, c, parts = table(spark, d, "documents"), table(spark, d, "customer"), table(spark, d, "part")
    custs, segments = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("s"), "c_mktsegment")
    nodes = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name"))
    nodes = nodes.unionByName(c.select(segments.alias("id"), F.col("c_mktsegment").alias("name")).distinct()).unionByName(c.select(custs.alias("id"), F.col("c_name").alias("name")))
    edges = c.select(custs.alias("source_id"), F.lit("in").alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("target_id"), (2 * F.col("c_custkey")).alias("edge"))
    edges = edges.unionByName(c.select(custs.alias("source_id"), F.lit("buys").alias("relation"), segments.alias("target_id"), (2 * F.col("c_custkey") + 1).alias("edge")))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")

    def over(rows):
        kept = retrievers.OverlapRetriever(spark)
        kept.memorize(rows)
        return kept

    for name in ("nation", "region"):
        table(spark, d, name).createOrReplaceTempView(f"u9_{name}")
    knowledge = retrievers.Knowledge(
        texts, over(texts), over(docs.select(F.col("doc_id").alias("doc"), F.split("text", "\n")[0].alias("text"))), nodes, edges, over(nodes.select(F.col("id").alias("doc"), F.col("name").alias("text"))),
        lambda _: spark.createDataFrame([("buys", 0.5)], "relation string, distance double"), over(parts.select(F.col("p_partkey").alias("doc"), F.col("p_name").alias("text"))),
        parts.select(F.col("p_partkey").alias("piece"), F.col("p_brand").alias("file")), lambda context: context.select(F.upper("context").alias("context")),
        lambda question: f"SELECT count(*) AS n FROM u9_{question.split()[-1]}",
    )
    search = retrievers.Search(spark, knowledge.kinds())
    edge = F.concat_ws(" ", "source_id", "relation", "target_id")
    asked = [
        ("CHUNKS", "CHUNKS", _ASKED["chunks"], 5, F.col("doc")), ("SUMMARIES", "summaries", _ASKED["summaries"], 5, F.col("doc")), ("RAG_COMPLETION", "RAG_COMPLETION", _ASKED["chunks"], 5, F.md5("context")),
        ("INSIGHTS", "insights", _ASKED["insights"], 5, edge), ("INSIGHTS by id", "insights", "n7", 5, edge), ("GRAPH_COMPLETION", "GRAPH_COMPLETION", _ASKED["names"], 5, F.col("context")),
        ("GRAPH_SUMMARY_COMPLETION", "GRAPH_SUMMARY_COMPLETION", _ASKED["names"], 5, F.col("context")), ("CODE", "code", _ASKED["pieces"], 8, F.col("file")),
        ("NATURAL_LANGUAGE", "NATURAL_LANGUAGE", "how many rows has nation", 1, F.col("n")), ("SQL", "SQL", "SELECT count(*) AS n FROM u9_region", 1, F.col("n")),
    ]
    rows = [search.run(kind, question, k).select(F.lit(label).alias("kind"), column.cast("string").alias("found")) for label, kind, question, k, column in asked]
    return reduce(DataFrame.unionByName, rows)


K10_SCORES = f"""WITH q AS (SELECT item_id AS query, {_LEX} AS ts FROM benchmark), d AS (SELECT conv_id * 1000 + turn AS doc, unnest({_LEX}) AS term FROM conversations)
SELECT query, doc, round(count(*) / any_value(n), 6) AS score FROM (SELECT query, len(ts) AS n, unnest(ts) AS term FROM q) JOIN d USING (term) GROUP BY query, doc"""


def _candidates(spark, d):
    """Conversations of the turns that share most tokens with a benchmark item, as memories with their turns as sources."""
    turns = table(spark, d, "conversations")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    docs = turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc"), "text")
    near = lexical.overlap_top_k(items, "query", "question", docs, "doc", "text", 5)
    best = near.groupBy("query", F.floor(F.col("doc") / 1000).alias("item")).agg(F.min("rank").alias("position"))
    memory = F.concat(F.lit("[seen] conversation "), "item")
    rows = best.join(items, "query").withColumn("memory", memory).withColumn("background", F.concat(F.lit("kept at "), "position"))
    sources = turns.select(F.col("conv_id").alias("item"), F.col("turn").alias("ix"), F.when(F.col("turn") % 3 == 0, "file").otherwise("chat").alias("kind"), F.col("text").alias("content"), F.col("turn").cast("string").alias("chat_time"))
    return rows, sources


_RERANKED = f"""WITH b AS (SELECT query, doc // 1000 AS item, min(r) AS position FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS r FROM ({K10_SCORES})) WHERE r <= 5 GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS n, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations),
p AS (SELECT conv_id AS item, n // 2 AS piece, '[' || max(turn) FILTER (WHERE n % 2 = 0) || ']: ' || chr(10) || 'user: ' || coalesce(max(text) FILTER (WHERE n % 2 = 0), '') || chr(10) || 'assistant: ' || coalesce(max(text) FILTER (WHERE n % 2 = 1), '') AS said FROM n GROUP BY 1, 2 HAVING max(text) <> ''),
l AS (SELECT *, coalesce(sum(length(line)) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT conv_id, n, '[' || turn || ']: ' || text || chr(10) AS line FROM n WHERE n >= m - 10 AND text <> '')),
o AS (SELECT conv_id AS item, string_agg(line, '' ORDER BY n) AS said FROM l WHERE before <= 2048 GROUP BY 1),
f AS (SELECT conv_id AS item, string_agg(text, '' ORDER BY n) AS said FROM n WHERE turn % 3 = 0 GROUP BY 1),
g AS (SELECT query, item, position, said FROM b LEFT JOIN (SELECT * FROM f WHERE said <> '') USING (item)),
h AS (SELECT * FROM g WHERE said IS NULL UNION ALL SELECT query, item, position, said FROM (SELECT *, row_number() OVER (PARTITION BY query, said ORDER BY position, item) AS first FROM g WHERE said IS NOT NULL) WHERE first = 1),
x AS (SELECT 'single_turn' AS strategy, query, item, piece, 'conversation ' || item || chr(10) || chr(10) || said AS passage, 'conversation ' || item || chr(10) || chr(10) || 'sources-dialogue-pairs' || said AS memory FROM b JOIN p USING (item)
UNION ALL SELECT 'singleturn_outmem', query, item, piece, 'conversation ' || item || chr(10) || chr(10) || said, '[seen] conversation ' || item FROM b JOIN p USING (item)
UNION ALL SELECT 'concat_sources', query, item, 0, 'conversation ' || item || chr(10) || coalesce(said, ''), '[seen] conversation ' || item FROM b LEFT JOIN o USING (item)
UNION ALL SELECT 'concat_background', query, item, 0, 'conversation ' || item || chr(10) || 'kept at ' || position, '[seen] conversation ' || item || chr(10) || 'conversation ' || item || chr(10) || 'kept at ' || position FROM b
UNION ALL SELECT 'concat_docsource', query, item, 0, y, '[seen] conversation ' || item || chr(10) || y FROM (SELECT *, 'conversation ' || item || CASE WHEN said IS NULL THEN '' ELSE chr(10) || chr(10) || '[Sources]:' || chr(10) || said END AS y FROM h)),
s AS (SELECT x.*, round(len(list_intersect(q.ts, {_LEX.replace("text", "x.passage")})) / len(q.ts), 6) AS score FROM x JOIN (SELECT item_id AS query, {_LEX} AS ts FROM benchmark) q USING (query)),
e AS (SELECT *, row_number() OVER (PARTITION BY strategy, query, item ORDER BY score DESC, piece) AS own FROM s)
SELECT strategy, query, item, CAST(piece AS BIGINT) AS piece, md5(memory) AS memory, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY strategy, query ORDER BY score DESC, item, piece) AS rank FROM e WHERE own = 1 OR strategy <> 'singleturn_outmem') WHERE rank <= 3"""


@query("u8_dialogue_rerank", _RERANKED)
def u8_dialogue(spark, d):
    candidates, sources = _candidates(spark, d)
    candidates = cut(candidates, "candidates")
    rows = [retrievers.RERANKERS.make("strategy", k=3, strategy=name)(candidates, sources).withColumn("strategy", F.lit(name)) for name in rerank.STRATEGIES]
    return reduce(DataFrame.unionByName, rows).select("strategy", "query", "item", "piece", F.md5("memory").alias("memory"), "score", "rank")


@query("u8_entropy_compressor", r"""WITH w AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos, len(ws) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY often, pos) AS r FROM w JOIN (SELECT word, count(*) AS often FROM w GROUP BY 1) USING (word))
SELECT doc_id, md5(coalesce(kept, '')) AS kept FROM documents LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM k WHERE r <= greatest(1, floor(n * 0.5)) GROUP BY 1) USING (doc_id)""")
def u8_entropy(spark, d):
    return retrievers.COMPRESSORS.make("entropy", key="doc_id", text="text", share=0.5)(table(spark, d, "documents")).select("doc_id", F.md5("kept").alias("kept"))


@query("u8_topic_segmenter", f"""WITH t AS (SELECT conv_id, turn, text, {_LEX} AS a, lag({_LEX}) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
s AS (SELECT conv_id, turn, b IS NOT NULL AND len(list_intersect(a, b)) / len(list_distinct(a || b)) < 0.1 AS begins FROM t),
g AS (SELECT conv_id, turn, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS topic FROM s),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, topic ORDER BY turn) - 1) // 4 AS piece FROM g)
SELECT conv_id, turn, CAST(dense_rank() OVER (PARTITION BY conv_id ORDER BY topic, piece) - 1 AS INTEGER) AS segment FROM p""")
def u8_topics(spark, d):
    """Topics begin where a turn shares less than a tenth of the tokens of both with the turn before."""
    turns = table(spark, d, "conversations").withColumn("ts", F.array_distinct(tx.ascii_tokens(F.col("text"))))
    before = F.lag("ts").over(Window.partitionBy("conv_id").orderBy("turn"))
    shared = turns.withColumn("before", before).withColumn("alike", F.try_divide(F.size(F.array_intersect("ts", "before")), F.size(F.array_union("ts", "before"))))
    return retrievers.SEGMENTERS.make("topics", by="conv_id", order="turn", similarity="alike", bar=0.1, most=4)(shared).select("conv_id", "turn", "segment")


@query("u10_embedder", "WITH v AS (SELECT doc_id, length(text) AS l, length(text) - length(replace(text, ' ', '')) AS s FROM documents WHERE text <> '') SELECT doc_id, round(l / sqrt(CAST(l AS DOUBLE) * l + CAST(s AS DOUBLE) * s + 1.0), 6) AS first FROM v")
def u10(spark, d):
    vec = retrievers.Embedder(_numbers).embed(F.col("text"))
    return table(spark, d, "documents").select("doc_id", vec.alias("v")).filter("v is not null").select("doc_id", F.round(F.col("v")[0], 6).alias("first"))
