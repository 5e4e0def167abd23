"""Joins over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import blocks, intervals, joins, pivots
from palimpsest.plans.registry import query, table

DOT = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"
COS = "({dot} / sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


def cos(a: str, b: str) -> str:
    return COS.format(a=a, b=b, dot=DOT.format(a=a, b=b))


@query("j1_queries_by_session", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j1(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.select("o_orderkey", F.col("o_custkey").alias("session_id")).join(c.select(F.col("c_custkey").alias("session_id"), "c_name"), "session_id").select("o_orderkey", "c_name")


@query("j2_translate_ids", """SELECT l_orderkey, string_agg(CAST(g AS VARCHAR), ',' ORDER BY pos) AS ids FROM (SELECT l_orderkey, s_nationkey AS g, min(p) AS pos FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS p FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 0 GROUP BY 1, 2) GROUP BY 1""")
def j2(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: x["l_suppkey"]).alias("ids"))
    mapping = table(spark, d, "supplier").filter("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("from_id"), F.col("s_nationkey").alias("to_id"))
    return joins.translate_ids(rows, "l_orderkey", "ids", mapping).select("l_orderkey", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query("j3_integrity", "SELECT DISTINCT o_custkey AS key, 'no clean parent' AS problem FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j3(spark, d):
    parents = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_acctbal")
    return joins.integrity(parents, table(spark, d, "orders").select(F.col("o_custkey").alias("key")), "key", F.col("c_acctbal") > 0)


@query("j4_evidence_turns", """SELECT o_orderkey AS claim_id, l_linenumber AS pos FROM (SELECT o_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_linenumber IN (1, 3, 4, 5, 6, 7)) WHERE r <= 4""")
def j4(spark, d):
    ev = F.array(F.struct(F.col("o_orderkey").alias("episode_id"), F.array(*[F.lit(i) for i in (1, 3, 4, 5, 6, 7)]).alias("turn_ids")))
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id"), ev.alias("evidence"))
    turns = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("turn_id"), F.col("l_linenumber").alias("pos"))
    return joins.evidence_turns(claims, turns).select("claim_id", "pos")


@query("j5_similar_pairs", f"SELECT x.vec_id AS a, y.vec_id AS b, round({cos('x.embedding', 'y.embedding')}, 6) AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {cos('x.embedding', 'y.embedding')} > 0.3")
def j5(spark, d):
    return pivots.pairs_over(table(spark, d, "embeddings"), "vec_id", "embedding", 0.3).withColumn("similarity", F.round("similarity", 6))


@query("j6_blocked_knn", f"""SELECT query, candidate, score FROM (SELECT x.vec_id AS query, y.vec_id AS candidate, round({DOT.format(a='x.embedding', b='y.embedding')}, 6) AS score,
row_number() OVER (PARTITION BY x.vec_id ORDER BY round({DOT.format(a='x.embedding', b='y.embedding')}, 6) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id) WHERE r <= 5""")
def j6(spark, d):
    e = table(spark, d, "embeddings")
    return joins.knn(e, e, "vec_id", "embedding", 5).select("query", "candidate", "score")


@query("j7_earlier_neighbours", f"""SELECT id, other, score FROM (SELECT x.vec_id AS id, y.vec_id AS other, round({cos('x.embedding', 'y.embedding')}, 6) AS score,
row_number() OVER (PARTITION BY x.vec_id ORDER BY round({cos('x.embedding', 'y.embedding')}, 6) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON y.vec_id < x.vec_id) WHERE r <= 3""")
def j7(spark, d):
    e = table(spark, d, "embeddings")
    return blocks.neighbours(e, e, "vec_id", "embedding", 3, not_after="vec_id").select("id", "other", "score")


@query("j8_reverse_queue", f"""SELECT other, string_agg(CAST(id AS VARCHAR), ',' ORDER BY score DESC, id) AS listed_by FROM (SELECT id, other, score FROM (SELECT x.vec_id AS id, y.vec_id AS other, round({cos('x.embedding', 'y.embedding')}, 6) AS score,
row_number() OVER (PARTITION BY x.vec_id ORDER BY round({cos('x.embedding', 'y.embedding')}, 6) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON y.vec_id < x.vec_id) WHERE r <= 3) WHERE score >= 0.2 GROUP BY other""")
def j8(spark, d):
    return joins.reverse_queue(j7(spark, d), 0.2).select("other", F.array_join(F.col("listed_by").cast("array<string>"), ",").alias("listed_by"))


_FACTS = "(SELECT o_orderkey AS id, o_orderdate AS valid_from, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL 60 DAY END AS valid_to, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + INTERVAL 3 DAY END AS recorded FROM orders)"


def _facts(spark, d):
    day = lambda n: F.expr(f"o_orderdate + INTERVAL {n} DAY")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("valid_from"), F.when(F.col("o_orderkey") % 4 != 0, day(60)).alias("valid_to"), F.when(F.col("o_orderkey") % 9 != 0, day(3)).alias("recorded"))


@query("j9_visible_as_of", f"SELECT id FROM {_FACTS} WHERE coalesce(recorded <= TIMESTAMP '1995-06-17', FALSE) AND valid_from <= TIMESTAMP '1995-06-17' AND (valid_to IS NULL OR TIMESTAMP '1995-06-17' < valid_to)")
def j9(spark, d):
    at = F.lit("1995-06-17").cast("timestamp")
    return _facts(spark, d).filter(joins.visible_as_of(F.col("recorded"), F.col("valid_from"), F.col("valid_to"), at)).select("id")


@query("j10_overlap", f"SELECT id FROM {_FACTS} WHERE valid_from <= TIMESTAMP '1995-03-31' AND (valid_to IS NULL OR TIMESTAMP '1995-03-01' < valid_to)")
def j10(spark, d):
    s, e = (F.lit(x).cast("timestamp") for x in ("1995-03-01", "1995-03-31"))
    return _facts(spark, d).filter(joins.overlaps(F.col("valid_from"), F.col("valid_to"), s, e)).select("id")


#: A supplier's question: what was known on the day its dearest line was shipped.
_ASKED = """(SELECT l_suppkey AS query, l_shipdate AS date FROM (SELECT l_suppkey, l_shipdate,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1)"""


def _asked(spark, d):
    first = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"))
    return table(spark, d, "lineitem").withColumn("r", first).filter("r = 1").select(F.col("l_suppkey").alias("query"), F.col("l_shipdate").alias("date"))


@query("j9_as_of_join", f"""SELECT query, id, 1.0::DOUBLE AS score FROM {_FACTS} JOIN {_ASKED} ON recorded <= date AND valid_from <= date AND (valid_to IS NULL OR date < valid_to)""")
def j9_join(spark, d):
    return intervals.as_of(_facts(spark, d), _asked(spark, d)).select("query", "id", "score")


@query("j10_overlap_join", f"""SELECT query, id FROM {_FACTS} JOIN {_ASKED} ON valid_from <= date + INTERVAL 30 DAY AND (valid_to IS NULL OR date < valid_to)""")
def j10_join(spark, d):
    asked = _asked(spark, d).select("query", F.col("date").alias("start"), F.expr("date + INTERVAL 30 DAY").alias("end"))
    return intervals.overlapping(_facts(spark, d), asked).select("query", "id")


@query("j11_evidence_on_date", "SELECT o_orderkey AS claim_id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-06-01' AND l_shipdate < TIMESTAMP '1995-09-01')")
def j11(spark, d):
    when = table(spark, d, "lineitem").filter((F.col("l_shipdate") >= "1995-06-01") & (F.col("l_shipdate") < "1995-09-01")).select(F.col("l_orderkey").alias("claim_id"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("claim_id")).join(when, "claim_id", "left_semi")


@query("j12_key_or_tags", "SELECT p_partkey FROM part WHERE p_brand IN ('Brand#11', 'Brand#23') OR (CASE WHEN contains(p_type, 'BRASS') THEN 1 ELSE 0 END + CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END) >= 2")
def j12(spark, d):
    tag = lambda c, name: F.when(c, F.lit(name)).otherwise(F.lit(f"not {name}"))
    nodes = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("key"), F.array(tag(F.col("p_type").contains("BRASS"), "brass"), tag(F.col("p_size") % 2 == 0, "even"), tag(F.col("p_size") % 3 == 0, "three")).alias("tags"))
    return joins.key_or_tags(nodes, ["Brand#11", "Brand#23"], ["brass", "even", "three"]).select("p_partkey")


_TRIPLETS = """SELECT l_partkey AS source_id, l_suppkey AS target_id, l_returnflag AS relation, round(coalesce(a.d, 1.0) + coalesce(b.d, 1.0) + coalesce(CASE l_returnflag WHEN 'R' THEN 0.25 WHEN 'A' THEN 0.5 END, 1.0), 6) AS total
FROM (SELECT DISTINCT l_partkey, l_suppkey, l_returnflag FROM lineitem) l LEFT JOIN (SELECT p_partkey, p_size / 50.0 AS d FROM part WHERE p_size < 25) a ON l_partkey = a.p_partkey
LEFT JOIN (SELECT s_suppkey, (s_suppkey % 10) / 10.0 AS d FROM supplier WHERE s_suppkey % 2 = 0) b ON l_suppkey = b.s_suppkey"""


def triplets(spark, d):
    edges = table(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.col("l_returnflag").alias("relation")).distinct()
    parts = table(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("p"), "p_partkey").alias("id"), (F.col("p_size") / 50.0).alias("distance"))
    suppliers = table(spark, d, "supplier").filter("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), ((F.col("s_suppkey") % 10) / 10.0).alias("distance"))
    relation = spark.createDataFrame([("R", 0.25), ("A", 0.5)], "relation string, distance double")
    got = joins.triplet_distances(edges, parts.unionByName(suppliers), relation)
    return got.select(F.substring("source_id", 2, 20).cast("long").alias("source_id"), F.substring("target_id", 2, 20).cast("long").alias("target_id"), "relation", F.round("total", 6).alias("total"))


query("j13_triplet_distances", _TRIPLETS)(triplets)


@query("j14_neighbours_both_ways", """WITH e AS (SELECT DISTINCT o_custkey AS s, o_orderkey % 100 AS t FROM orders) SELECT DISTINCT id, neighbour FROM (SELECT s AS id, t AS neighbour FROM e WHERE s IN (SELECT c_custkey FROM customer) UNION ALL SELECT t, s FROM e WHERE t IN (SELECT c_custkey FROM customer))""")
def j14(spark, d):
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id")).distinct()
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return joins.neighbours_both_ways(nodes, edges)


@query("j15_rematch", """WITH ds AS (SELECT c_custkey AS row_id, CAST(c_nationkey AS BIGINT) AS context_id, c_mktsegment AS query_type, CAST(c_custkey % 40 AS BIGINT) AS query_id FROM customer),
sv AS (SELECT s_suppkey AS answer_id, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS BIGINT) END AS context_id, CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS query_type, s_suppkey % 45 AS query_id FROM supplier),
u AS (SELECT query_type, query_id, count(*) AS n, min(row_id) AS row_id FROM ds GROUP BY 1, 2)
SELECT answer_id, CASE WHEN n = 1 THEN u.row_id END AS row_id, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status FROM sv LEFT JOIN u USING (query_type, query_id) WHERE context_id IS NULL
UNION ALL SELECT answer_id, ds.row_id, CASE WHEN ds.row_id IS NULL THEN 'unknown in context' ELSE 'matched' END FROM sv LEFT JOIN ds USING (context_id, query_type, query_id) WHERE sv.context_id IS NOT NULL""")
def j15(spark, d):
    ds = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").cast("long").alias("context_id"), F.col("c_mktsegment").alias("query_type"), (F.col("c_custkey") % 40).alias("query_id"))
    sv = table(spark, d, "supplier").select(F.col("s_suppkey").alias("answer_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("long")).alias("context_id"), F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("query_type"), (F.col("s_suppkey") % 45).alias("query_id"))
    return joins.rematch(sv, ds, ["query_type", "query_id"])


@query("j16_context_buckets", """SELECT CAST(ceil(cum / 1000.0) AS BIGINT) AS bucket, count(*) AS n, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) AS BIGINT) AS n_user FROM (SELECT role, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS cum FROM conversations) GROUP BY 1""")
def j16(spark, d):
    from palimpsest.operators import windows

    c = windows.cumulative(table(spark, d, "conversations").withColumn("n", F.char_length("text")), ["conv_id"], ["turn"], "n", "cum")
    return c.groupBy(F.ceil(F.col("cum") / 1000.0).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("n_user"))


@query("j17_contained", r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS n FROM documents),
h AS (SELECT line, doc_id AS original_id FROM (SELECT DISTINCT line FROM l WHERE line <> '') JOIN documents ON contains(text, line))
SELECT l.doc_id || ':' || n AS chunk_id, original_id FROM l JOIN h USING (line)""")
def j17(spark, d):
    """Every line of every document, as a dated turn, against all documents."""
    docs = table(spark, d, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line")).filter("line <> ''")
    chunks = lines.select(F.concat_ws(":", "doc_id", "n").alias("chunk_id"), F.concat(F.lit("Date: 2024\nuser: "), "line").alias("chunk"))
    return joins.contained_in(chunks, docs.select(F.col("doc_id").alias("original_id"), F.col("text").alias("original")))


@query("j18_nodes_by_type", "SELECT kind, count(*) AS n, min(id) AS first FROM (SELECT 'customer' AS kind, 'customer-' || c_custkey AS id FROM customer UNION ALL SELECT 'part', 'part-' || p_partkey FROM part) GROUP BY 1")
def j18(spark, d):
    ids = table(spark, d, "customer").select(F.concat(F.lit("customer-"), "c_custkey").alias("id")).union(table(spark, d, "part").select(F.concat(F.lit("part-"), "p_partkey")))
    return ids.groupBy(F.get(F.split("id", "-"), 0).alias("kind")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query("j19_roll_up", """WITH g AS (SELECT o_orderkey AS gist_id, o_custkey AS verbatim_id, o_totalprice AS score FROM orders),
f AS (SELECT l_orderkey AS gist_id, l_quantity AS score FROM lineitem)
SELECT verbatim_id, round(avg(score) * count(*), 2) AS total, count(*) AS n FROM (SELECT verbatim_id, score FROM g WHERE gist_id % 3 = 0 UNION ALL SELECT g.verbatim_id, f.score * 0.5 FROM f JOIN g USING (gist_id)) GROUP BY 1""")
def j19(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    gists = o.filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("gist_id"), F.col("o_totalprice").alias("score"))
    fact = F.concat_ws("-", "l_orderkey", "l_linenumber")
    facts = li.select(fact.alias("fact_id"), F.col("l_quantity").alias("score"))
    got = joins.roll_up(facts, li.select(fact.alias("fact_id"), F.col("l_orderkey").alias("gist_id")).distinct(), gists, o.select(F.col("o_orderkey").alias("gist_id"), F.col("o_custkey").alias("verbatim_id")), 0.5)
    return got.select("verbatim_id", F.round(F.col("score") * F.col("n"), 2).alias("total"), "n")


@query("j20_reconstruct", "SELECT event_id FROM events WHERE date_trunc('hour', ts) IN (SELECT date_trunc('hour', ts) FROM (SELECT * FROM events WHERE user_id % 2 = 1 ORDER BY value DESC, event_id LIMIT 10))")
def j20(spark, d):
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    return joins.reconstruct(e, "event_id", "hour", [F.desc("value"), F.col("event_id")], 10, F.col("user_id") % 2 == 0).select("event_id")


@query("j21_existing_edges", "SELECT DISTINCT 'p' || l_partkey AS source_id, 'o' || l_orderkey AS target_id, 'exists_in' AS relation FROM lineitem WHERE l_orderkey % 2 = 0")
def j21(spark, d):
    li = table(spark, d, "lineitem")
    nodes = li.select(F.concat(F.lit("o"), "l_orderkey").alias("chunk_id"), F.concat(F.lit("p"), "l_partkey").alias("node_id"), F.lit("part").alias("type_id"))
    relations = li.select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("s"), "l_suppkey").alias("target_id"), F.lit("made_by").alias("relation"))
    graph = li.filter("l_orderkey % 2 = 0").select(F.concat(F.lit("p"), "l_partkey").alias("source_id"), F.concat(F.lit("o"), "l_orderkey").alias("target_id"), F.lit("exists_in").alias("relation"))
    return joins.existing_edges(nodes, relations, graph)


@query("j22_closest", """SELECT item_id, candidate_id, CAST(distance AS INTEGER) AS distance FROM (SELECT a.p_partkey AS item_id, b.p_partkey AS candidate_id, levenshtein(a.p_name, b.p_name) AS distance,
row_number() OVER (PARTITION BY a.p_partkey ORDER BY levenshtein(a.p_name, b.p_name), b.p_partkey) AS r FROM part a JOIN part b ON a.p_partkey <> b.p_partkey) WHERE r = 1""")
def j22(spark, d):
    p = table(spark, d, "part")
    return joins.closest(p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item")), p.select(F.col("p_partkey").alias("candidate_id"), F.col("p_name").alias("candidate")))
