"""Graph operators over customers, orders, parts and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import dates
from palimpsest.operators import aggregates as ag
from palimpsest.operators import graph, joins, pivots, topk
from palimpsest.plans.q_joins import _TRIPLETS, cos, triplets
from palimpsest.plans.registry import query, table

_E = "(SELECT DISTINCT o_custkey AS s, o_orderkey % 60 AS t FROM orders WHERE o_custkey <> o_orderkey % 60)"


def _edges(spark, d):
    o = table(spark, d, "orders").filter("o_custkey <> o_orderkey % 60")
    return o.select(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 60).alias("target_id")).distinct()


def _seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


@query("g1_edge_weight", f"SELECT x.vec_id AS a, y.vec_id AS b, round(0.7 * {cos('x.embedding', 'y.embedding')} + 0.3 * CASE WHEN x.label = y.label THEN 1.0 ELSE 0.5 END, 6) AS weight FROM embeddings x JOIN embeddings y ON y.vec_id = x.vec_id + 1")
def g1(spark, d):
    from palimpsest.functions.vectors import cosine

    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.array(F.lit("all"), F.col("label").cast("string")).alias("concepts"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vb"), F.col("concepts").alias("cb"))
    return e.join(b, "vec_id").select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.round(graph.edge_weight(cosine(F.col("embedding"), F.col("vb")), F.col("concepts"), F.col("cb")), 6).alias("weight"))


def _unrolled(rounds: int, damping: float) -> str:
    sql = f"WITH e AS MATERIALIZED (SELECT s, t, 1.0 / count(*) OVER (PARTITION BY s) AS w FROM {_E}), p AS (SELECT unnest([1, 2, 4])::BIGINT AS id, 1.0 / 3 AS p), r0 AS (SELECT id, p AS r FROM p)"
    for i in range(rounds):
        sql += f""", l{i} AS MATERIALIZED (SELECT coalesce(sum(r), 0.0) AS l FROM r{i} WHERE id NOT IN (SELECT s FROM e)), m{i} AS MATERIALIZED (SELECT t AS id, sum(r * w) AS m FROM r{i} JOIN e ON e.s = r{i}.id GROUP BY 1),
r{i + 1} AS MATERIALIZED (SELECT coalesce(m.id, p.id) AS id, {damping} * (coalesce(m, 0.0) + l * coalesce(p, 0.0)) + {1 - damping} * coalesce(p, 0.0) AS r FROM m{i} m FULL JOIN p ON m.id = p.id, l{i})"""
    return sql + f" SELECT id, round(r, 9) AS ppr FROM r{rounds}"


@query("g2_ppr", _unrolled(20, 0.85))
def g2(spark, d):
    seeds = _seeds(spark, 1, 2, 4).withColumn("weight", F.lit(1.0))
    return graph.pagerank(_edges(spark, d).withColumn("weight", F.lit(1.0)), seeds, rounds=20, tolerance=None).withColumn("ppr", F.round("ppr", 9))


@query("g3_ppr_half_damping", _unrolled(20, 0.5))
def g3(spark, d):
    seeds = _seeds(spark, 1, 2, 4, 7).withColumn("weight", F.when(F.col("id") == 7, -1.0).otherwise(2.0))
    return graph.pagerank(_edges(spark, d).withColumn("weight", F.lit(1.0)), seeds, damping=0.5, rounds=20, tolerance=None).withColumn("ppr", F.round("ppr", 9))


@query("g2_expanded_scores")
def g2b(spark, d):
    base = _seeds(spark, 1, 2, 4).withColumn("score", F.lit(1.0))
    return graph.expand_scores(base, _edges(spark, d).withColumn("relation", F.lit("supersedes")), {"supersedes": 1.2, "related": 0.7})


@query("g4_k_hop", f"WITH RECURSIVE h AS (SELECT unnest([1, 4])::BIGINT AS id, 0 AS hop UNION SELECT e.t, hop + 1 FROM h JOIN {_E} e ON e.s = h.id WHERE hop < 3) SELECT id, min(hop) AS hop FROM h GROUP BY 1")
def g4(spark, d):
    return graph.k_hop(_edges(spark, d), _seeds(spark, 1, 4), 3)


@query("g5_cheapest_paths", f"WITH RECURSIVE b AS (SELECT 1::BIGINT AS id, 2.0::DOUBLE AS cost, 0 AS h UNION ALL SELECT e.t, cost + 1 / (0.5 + (e.t % 5) / 10), h + 1 FROM b JOIN {_E} e ON e.s = b.id WHERE h < 4) SELECT id, round(min(cost), 6) AS cost FROM b GROUP BY 1")
def g5(spark, d):
    e = _edges(spark, d).withColumn("weight", 0.5 + (F.col("target_id") % 5) / 10)
    return graph.cheapest_paths(e, _seeds(spark, 1).withColumn("similarity", F.lit(0.5)), 4).withColumn("cost", F.round("cost", 6))


@query("g5_expansion")
def g5_expansion(spark, d):
    """Customers and order numbers as nodes, statuses and priorities of the orders at them as concepts."""
    o = table(spark, d, "orders")
    out = _edges(spark, d).withColumn("weight", 0.2 + (F.col("target_id") % 5) / 10)
    both = out.unionByName(out.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), "weight"))
    named = lambda c, name: o.select((F.col("o_orderkey") % 60).alias("id"), F.col(c).alias("concept")).unionByName(o.select(F.col("o_custkey").alias("id"), F.concat_ws(" ", F.lit(name), c, F.col("o_custkey") % 9).alias("concept")))
    got = graph.expansion(both, _seeds(spark, 1, 7).withColumn("similarity", F.lit(0.5)), named("o_orderstatus", "status").unionByName(named("o_orderpriority", "priority")))
    return got.withColumn("cost", F.round("cost", 6))


@query("g6_paths", f"WITH RECURSIVE p AS (SELECT [s, t] AS path, t FROM {_E} WHERE s = 1 UNION ALL SELECT list_append(path, e.t), e.t FROM p JOIN {_E} e ON e.s = p.t WHERE p.t <> 9 AND NOT list_contains(path, e.t) AND len(path) <= 3) SELECT CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM p WHERE t = 9")
def g6(spark, d):
    got = graph.paths(_edges(spark, d), 1, 9, 3)
    return got.select("hops", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@query("g7_subgraph", f"WITH b AS (SELECT s, t FROM {_E} UNION SELECT t, s FROM {_E}), n1 AS (SELECT 1::BIGINT AS id UNION SELECT t FROM b WHERE s = 1) SELECT s AS source_id, t AS target_id FROM {_E} WHERE s IN (SELECT id FROM n1) AND t IN (SELECT id FROM n1)")
def g7(spark, d):
    return graph.subgraph(_edges(spark, d), _seeds(spark, 1), 1)


@query("g8_version_chain", """WITH v AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n, user_id, event_type FROM events) SELECT a.event_id AS start, b.event_id AS prior, CAST(a.n - b.n AS INTEGER) AS depth FROM v a JOIN v b USING (user_id, event_type) JOIN (SELECT user_id, event_type, max(n) AS top FROM v GROUP BY 1, 2) m USING (user_id, event_type) WHERE a.n = m.top AND a.n - b.n BETWEEN 1 AND 3""")
def g8(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").withColumn("prior", F.lag("event_id").over(Window.partitionBy("user_id", "event_type").orderBy("event_id")))
    edges = e.filter("prior is not null").select(F.col("event_id").alias("source_id"), F.col("prior").alias("target_id"))
    current = e.groupBy("user_id", "event_type").agg(F.max("event_id").alias("id")).select("id")
    got = graph.version_chain(current, edges, 3, 3)
    return got.select("start", F.col("at").alias("prior"), "depth")


@query("a15_graph_metrics", f"""WITH RECURSIVE n AS (SELECT c_custkey AS id FROM customer UNION SELECT 0), e AS (SELECT s, t FROM {_E} WHERE s IN (SELECT id FROM n) AND t IN (SELECT id FROM n)), b AS (SELECT s, t FROM e UNION SELECT t, s FROM e),
r AS (SELECT id, id AS root FROM n UNION SELECT b.t, root FROM r JOIN b ON b.s = r.id), c AS (SELECT id, min(root) AS root FROM r GROUP BY 1), z AS (SELECT root, count(*) AS size FROM c GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, round(2.0 * (SELECT count(*) FROM e) / (SELECT count(*) FROM n), 6)::DOUBLE AS mean_degree, round((SELECT count(*) FROM e) / ((SELECT count(*) FROM n) * ((SELECT count(*) FROM n) - 1)), 6) AS density, count(*) AS n_components, max(size) AS largest FROM z""")
def a15(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id")).union(spark.createDataFrame([(0,)], "id long")).distinct()
    edges = _edges(spark, d)
    for end in ("source_id", "target_id"):
        edges = edges.join(nodes.withColumnRenamed("id", end), end, "left_semi")
    got = ag.graph_metrics(nodes, edges, graph.components(edges))
    return got.withColumn("mean_degree", F.round("mean_degree", 6)).withColumn("density", F.round("density", 6))


@query("g10_clusters")
def g10(spark, d):
    return graph.cluster(table(spark, d, "embeddings"), "vec_id", "embedding")


_M = f"(SELECT s, t, CASE WHEN s % 7 = 0 THEN 'MERGED_TO' ELSE 'r' END AS relation FROM {_E})"


@query("g11_merge_nodes", f"""WITH e AS (SELECT *, CASE WHEN s % 10 = 1 THEN s + 1 END AS ms, CASE WHEN t % 10 = 1 THEN t + 1 END AS mt FROM {_M}), x AS (SELECT *, (ms IS NOT NULL OR mt IS NOT NULL) AND relation <> 'MERGED_TO' AS mv, coalesce(ms, s) AS ns, coalesce(mt, t) AS nt FROM e),
k AS (SELECT s, t, relation FROM x WHERE NOT mv OR ns = nt), m AS (SELECT DISTINCT ns AS s, nt AS t, relation FROM x WHERE mv AND ns <> nt), f AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.relation = m.relation AND ((k.s = m.s AND k.t = m.t) OR (k.s = m.t AND k.t = m.s))))
SELECT s AS source_id, t AS target_id, relation FROM k UNION ALL SELECT s, t, relation FROM (SELECT *, row_number() OVER (PARTITION BY least(s, t), greatest(s, t), relation ORDER BY s) AS r FROM f) WHERE r = 1""")
def g11(spark, d):
    e = _edges(spark, d).withColumn("relation", F.when(F.col("source_id") % 7 == 0, "MERGED_TO").otherwise("r"))
    ends = e.select(F.col("source_id").alias("from_id")).union(e.select("target_id")).distinct().filter("from_id % 10 = 1")
    return graph.merge_nodes(e, ends.withColumn("to_id", F.col("from_id") + 1))


@query("g12_conflict_candidates", f"SELECT id, other, score FROM (SELECT x.vec_id AS id, y.vec_id AS other, round({cos('x.embedding', 'y.embedding')}, 6) AS score, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({cos('x.embedding', 'y.embedding')}, 6) DESC, y.vec_id) AS r FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE round({cos('x.embedding', 'y.embedding')}, 6) >= 0.25) WHERE r <= 5")
def g12(spark, d):
    e = table(spark, d, "embeddings")
    return pivots.neighbours(e, e, "vec_id", "embedding", 5, 0.25).select("id", "other", "score")


@query("g12_merged_metadata", "SELECT coalesce(a.c_custkey, b.c_custkey) AS id, coalesce(CASE WHEN a.c_custkey % 4 <> 0 THEN a.c_name END, b.c_mktsegment) AS name, CASE WHEN a.c_custkey IS NULL THEN 1 ELSE 1 END + CASE WHEN a.c_custkey IS NOT NULL AND b.c_custkey IS NOT NULL THEN 1 ELSE 0 END AS n FROM (SELECT * FROM customer WHERE c_custkey % 2 = 0) a FULL JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) b ON a.c_custkey = b.c_custkey")
def g12b(spark, d):
    c = table(spark, d, "customer")
    a = c.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_name")).alias("name"), F.array(F.lit("a")).alias("sources"))
    b = c.filter("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), F.array(F.lit("b")).alias("sources"))
    return graph.merged_metadata(a, b, ["name"], "sources").select("id", "name", F.size("sources").alias("n"))


@query("g13_connected_facts", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 4, 7) AND o_orderdate >= TIMESTAMP '1993-01-01' AND o_orderdate <= TIMESTAMP '1996-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 20")
def g13(spark, d):
    o = table(spark, d, "orders").join(_seeds(spark, 1, 4, 7).withColumnRenamed("id", "o_custkey"), "o_custkey", "left_semi")
    none = F.lit(None).cast("timestamp")
    q = {"start_time": none, "end_time": none, "point_in_time": F.col("o_orderdate"), "reference_time": none, "record_time": none}
    keep = dates.qualifier_filter(q, F.lit("1993-01-01").cast("timestamp"), "ge", F.lit("1996-01-01").cast("timestamp"), "le")
    return o.filter(keep).orderBy("o_orderdate", "o_orderkey").limit(20).select("o_orderkey")


@query("g14_triplet_search", f"SELECT source_id, target_id, relation, total FROM ({_TRIPLETS}) ORDER BY total, source_id * 1000000 + target_id * 10 + CASE relation WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END DESC LIMIT 5")
def g14(spark, d):
    code = F.when(F.col("relation") == "A", 1).when(F.col("relation") == "N", 2).otherwise(3)
    t = triplets(spark, d).withColumn("o", F.col("source_id") * 1000000 + F.col("target_id") * 10 + code)
    return topk.best_triplets(t, 5, "o").select("source_id", "target_id", "relation", "total")


@query("g16_ontology_neighbours", "SELECT DISTINCT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def g16(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    is_a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("source_id"), F.col("r_name").alias("target_id"))
    seed = spark.createDataFrame([("ASIA",)], "id string")
    return joins.neighbours_both_ways(seed, is_a).select(F.col("neighbour").alias("child"), F.col("id").alias("parent"))
