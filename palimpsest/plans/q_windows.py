"""Order-dependent operators over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import ranking, windows
from palimpsest.plans.registry import query, table

_UNITS = """WITH m AS (SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END AS c FROM events), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cum, sum(c) OVER (PARTITION BY user_id) AS n FROM m),
u AS (SELECT event_id, user_id, CAST(floor((cum - c) / 5) AS BIGINT) AS unit, n FROM r)"""


def _units(spark, d, by):
    return windows.clean_units(table(spark, d, "events").select("event_id", "user_id", "event_type"), by, ["event_id"], F.col("event_type") != "error", 5)


@query("w1_units", _UNITS + ", k AS (SELECT * FROM u WHERE unit < floor(n / 5) AND unit % 3 <> 1) SELECT event_id, user_id, unit, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY unit) - 1 AS INTEGER) AS unit_id FROM k")
def w1(spark, d):
    units = _units(spark, d, ["user_id"])
    return windows.units_with_queries(units, ["user_id"], units.filter("unit % 3 <> 1")).select("event_id", "user_id", "unit", "unit_id")


@query("w2_merged_units", _UNITS.replace("PARTITION BY user_id ORDER BY event_id", "ORDER BY event_id").replace("sum(c) OVER (PARTITION BY user_id)", "sum(c) OVER ()") + " SELECT event_id, unit FROM u WHERE unit < floor(n / 5)")
def w2(spark, d):
    return _units(spark, d, []).select("event_id", "unit")


@query("w8_cumulative_length", "SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum FROM conversations")
def w8(spark, d):
    return windows.cumulative(table(spark, d, "conversations").withColumn("n", F.char_length("text")), ["conv_id"], ["turn"], "n", "cum").select("conv_id", "turn", "cum")


@query("w9_timestamps", "SELECT conv_id, turn, TIMESTAMP '2024-01-01 00:00:00' + (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) * INTERVAL 500 MILLISECOND AS stamp FROM conversations")
def w9(spark, d):
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return windows.timestamps(table(spark, d, "conversations"), ["conv_id"], ["turn"], base, 500).select("conv_id", "turn", F.col("stamp").cast("timestamp_ntz").alias("stamp"))


@query("w10_chat_windows")
def w10(spark, d):
    c = table(spark, d, "conversations").withColumn("n", F.size(tx.words(F.col("text"))))
    return windows.chat_windows(c, "conv_id", "turn", "n", 200, 60)


def _vectors(spark, d):
    """Embeddings of a label as the turns of a conversation."""
    return ranking.ranked(table(spark, d, "embeddings"), ["label"], ["vec_id"], "turn")


@query("w11_boundaries", """WITH t AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS turn, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), l AS (SELECT *, lag(e) OVER (PARTITION BY label ORDER BY turn) AS b FROM t),
s AS (SELECT label, turn, list_inner_product(e, b) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(b, b))) AS sim FROM l WHERE b IS NOT NULL), m AS (SELECT *, 0.2 + greatest(ceil((min(sim) OVER (PARTITION BY label) - 0.2) / 0.05 + 1e-9), 0) * 0.05 AS th FROM s)
SELECT DISTINCT label, CASE WHEN abs(turn - 10) <= 3 THEN 10 ELSE turn END AS cut FROM m WHERE th <= 0.5 + 1e-9 AND sim < round(th, 6)""")
def w11(spark, d):
    return windows.boundaries(_vectors(spark, d), "label", "turn", "embedding", [10]).select("label", F.col("cut").cast("long").alias("cut")).distinct()


_RANKED = "(SELECT lang, doc_id, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS n, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS rank FROM documents)"


def _ranked_docs(spark, d):
    docs = table(spark, d, "documents").select("lang", "doc_id", F.size(tx.words(F.col("text"))).cast("long").alias("n"))
    return ranking.ranked(docs, ["lang"], [F.desc("doc_id")])


@query("w12_token_budget", f"""WITH t AS (SELECT *, sum(n + 10) OVER (PARTITION BY lang ORDER BY rank ROWS UNBOUNDED PRECEDING) AS total FROM {_RANKED}), f AS (SELECT *, 5000 - (total - n - 10) AS rest, min(CASE WHEN total > 5000 THEN rank END) OVER (PARTITION BY lang) AS first FROM t)
SELECT lang, doc_id, CAST(CASE WHEN total <= 5000 THEN n ELSE rest - 10 END AS BIGINT) AS kept_tokens, total > 5000 AS is_cut FROM f WHERE total <= 5000 OR (rank = first AND rest - 10 > 100)""")
def w12(spark, d):
    return windows.pack_to_budget(_ranked_docs(spark, d), ["lang"], "rank", "n", 5000, 10).select("lang", "doc_id", "kept_tokens", "is_cut")


@query("w13_fit_blocks", f"""WITH RECURSIVE r AS (SELECT lang, doc_id, n, rank FROM {_RANKED}), f AS (SELECT lang, CAST(0 AS BIGINT) AS rank, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS doc_id FROM (SELECT DISTINCT lang FROM r)
UNION ALL SELECT r.lang, r.rank, CASE WHEN used + n <= 5000 THEN used + n ELSE used END, CASE WHEN used + n <= 5000 THEN r.doc_id END FROM f JOIN r ON r.lang = f.lang AND r.rank = f.rank + 1) SELECT lang, doc_id FROM f WHERE doc_id IS NOT NULL""")
def w13(spark, d):
    return windows.fit_blocks(_ranked_docs(spark, d), "lang", ["rank", "doc_id"], "n", 5000).select("lang", "doc_id")


@query("w14_evict_oldest", f"SELECT lang, doc_id, CAST(least(n, 3000) AS BIGINT) AS kept_tokens FROM (SELECT *, sum(n) OVER (PARTITION BY lang ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS back FROM {_RANKED}) WHERE back <= 3000 OR rank = 1")
def w14(spark, d):
    return windows.evict_oldest(_ranked_docs(spark, d), ["lang"], "doc_id", "n", 3000).select("lang", "doc_id", "kept_tokens")


@query("w15_latest_per_type", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE r <= 50 OR n < 40")
def w15(spark, d):
    return windows.latest_per_group(table(spark, d, "events"), ["event_type"], [F.desc("ts"), "event_id"], 50, 0.8).select("event_id", "event_type")


@query("w16_even_sample", """WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), i AS (SELECT l_orderkey, n, unnest(CASE WHEN n <= 4 THEN range(n) ELSE list_transform(range(4), lambda i: CAST(floor(i * (n - 1) / 3.0) AS BIGINT)) END) AS ix FROM c) SELECT l_orderkey, string_agg(CAST(ix AS VARCHAR), ',' ORDER BY ix) AS places FROM i GROUP BY 1""")
def w16(spark, d):
    c = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return c.select("l_orderkey", F.array_join(windows.even_indices(F.col("n"), 4).cast("array<string>"), ",").alias("places"))


@query("w17_episode_order", "SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY round(value, 0) DESC, CASE WHEN user_id % 3 <> 0 THEN user_id END ASC NULLS LAST, event_id) AS INTEGER) AS rank FROM events")
def w17(spark, d):
    e = table(spark, d, "events").withColumn("ix", F.when(F.col("user_id") % 3 != 0, F.col("user_id"))).withColumn("score", F.round("value", 0))
    return ranking.ranked(e, ["event_type"], [F.desc("score"), F.asc_nulls_last("ix"), "event_id"]).select("event_id", "rank")


@query("w18_recency_boost", "SELECT o_orderkey, round(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 1e7 + CASE WHEN o_orderdate = max(o_orderdate) OVER (PARTITION BY o_custkey) THEN 1 ELSE 0 END, 7) AS boost FROM orders")
def w18(spark, d):
    from pyspark.sql.window import Window

    latest = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    boost = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date")) / 1e7 + F.when(F.col("o_orderdate") == latest, 1).otherwise(0)
    return table(spark, d, "orders").select("o_orderkey", F.round(boost, 7).alias("boost"))


@query("w19_chunks", f"""WITH d AS (SELECT doc_id, {"list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"} AS t FROM documents), c AS (SELECT doc_id, t, unnest(range(CAST(greatest(ceil((len(t) - 200) / 150.0), 0) AS BIGINT) + 1)) AS k FROM d WHERE len(t) > 0)
SELECT doc_id, CAST(k AS INTEGER) AS chunk, k * 150 AS start, CAST(len(t[k * 150 + 1 : k * 150 + 200]) AS INTEGER) AS n_tokens, md5(array_to_string(t[k * 150 + 1 : k * 150 + 200], ' ')) AS digest FROM c""")
def w19(spark, d):
    got = windows.chunked(table(spark, d, "documents"), "doc_id", tx.words(F.col("text")), 200, 50)
    return got.select("doc_id", "chunk", "start", "n_tokens", F.md5("chunk_text").alias("digest"))
