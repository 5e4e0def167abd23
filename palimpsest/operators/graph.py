"""Graph operators: weights, bounded expansion, personalised PageRank, paths, chains, components, merges.

Iterations are joins and aggregates on edge tables; every few rounds the state is cut to the shared
folder.  Frontiers and scores stay distributed; the driver sees only counts and sums.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.ranking import ranked, top_k
from palimpsest.operators.tables import cut


def edge_weight(cosine: Column, a: Column, b: Column, mix: float = 0.7) -> Column:
    """mix * cosine + (1 - mix) * shared concepts over the smaller set (0 if either is empty)."""
    small = F.least(F.size(a), F.size(b))
    return mix * cosine + (1 - mix) * F.when(small <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def both_ways(edges: DataFrame) -> DataFrame:
    others = [c for c in edges.columns if c not in ("source_id", "target_id")]
    return edges.unionByName(edges.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"), *others))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(id, hop): nodes within so many hops of seeds (id); each at its first hop."""
    seen = seeds.select("id").distinct().withColumn("hop", F.lit(0))
    for h in range(1, hops + 1):
        frontier = seen.filter(F.col("hop") == h - 1).select(F.col("id").alias("source_id"))
        step = edges.join(frontier, "source_id").select(F.col("target_id").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(step.withColumn("hop", F.lit(h)))
        if h % 4 == 0:
            seen = cut(seen, "k-hop")
    return seen


def subgraph(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Edges with both ends within so many undirected hops."""
    near = k_hop(both_ways(edges), seeds, hops).select("id")
    for end in ("source_id", "target_id"):
        edges = edges.join(near.withColumnRenamed("id", end), end, "left_semi")
    return edges


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, ppr): personalised PageRank over weighted edges; seeds (id, weight).

    Negative and odd seed weights count as 0.  What nodes without out-edges hold goes to the seeds.  Stops when the L1
    change is under the tolerance, or after so many rounds (exactly so many if tolerance is None).
    """
    w = F.when(F.isnan("weight") | (F.col("weight") < 0), 0.0).otherwise(F.col("weight").cast("double"))
    start = seeds.select("id", w.alias("weight")).groupBy("id").agg(F.sum("weight").alias("weight")).filter("weight > 0")
    total = start.agg(F.sum("weight")).first()[0]
    if not total:
        return start.select("id", F.lit(0.0).alias("ppr"))
    personal = cut(start.select("id", (F.col("weight") / total).alias("p")), "ppr-seeds")
    clean = edges.groupBy("source_id", "target_id").agg(F.sum(F.col("weight").cast("double")).alias("weight")).filter("weight > 0")
    out = clean.groupBy("source_id").agg(F.sum("weight").alias("out"))
    share = cut(clean.join(out, "source_id").select("source_id", "target_id", (F.col("weight") / F.col("out")).alias("share")), "ppr-edges")
    sources = share.select(F.col("source_id").alias("id")).distinct()
    rank = personal.select("id", F.col("p").alias("ppr"))
    for r in range(rounds):
        moved = share.join(rank.withColumnRenamed("id", "source_id"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.sum(F.col("ppr") * F.col("share")).alias("moved"))
        loose = rank.join(sources, "id", "left_anti").agg(F.coalesce(F.sum("ppr"), F.lit(0.0)).alias("loose"))
        after = moved.join(personal, "id", "full_outer").crossJoin(F.broadcast(loose))  # one row
        after = after.select("id", (damping * (F.coalesce("moved", F.lit(0.0)) + F.col("loose") * F.coalesce("p", F.lit(0.0))) + (1 - damping) * F.coalesce("p", F.lit(0.0))).alias("ppr"))
        after = cut(after, f"ppr-{r}")
        if tolerance is not None:
            change = after.join(rank.withColumnRenamed("ppr", "old"), "id", "full_outer").agg(F.sum(F.abs(F.coalesce("ppr", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
            rank = after
            if (change or 0.0) < tolerance:
                break
        rank = after
    return rank


def expand_scores(base: DataFrame, edges: DataFrame, relation_weights: Mapping[str, float], hops: int = 2, mix: float = 0.65, rounds: int = 20, tolerance: float | None = 1e-6) -> DataFrame:
    """(id, score): mix * base + (1 - mix) * ppr on the subgraph that the base reaches along the edges within so many hops.

    The base score is min-max normalised (all 1 if it is constant); nodes found on the way score (1 - mix) * ppr.  Edges of
    relations without a weight are left out.
    """
    weight = F.element_at(F.create_map(*[x for k, v in relation_weights.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("relation"))
    known = cut(edges.select("source_id", "target_id", weight.alias("weight")).filter("weight > 0"), "expand-edges")
    seen = base.select("id").distinct()
    for _ in range(hops):
        step = known.join(seen.withColumnRenamed("id", "source_id"), "source_id", "left_semi").select(F.col("target_id").alias("id"))
        seen = seen.unionByName(step).distinct()
    seen = cut(seen, "expand-nodes")
    for end in ("source_id", "target_id"):
        known = known.join(seen.withColumnRenamed("id", end), end, "left_semi")
    ppr = pagerank(known, base.select("id", F.col("score").alias("weight")), rounds=rounds, tolerance=tolerance)
    ends = base.agg(F.min("score").alias("low"), F.max("score").alias("high"))
    flat = F.when(F.col("high") <= F.col("low"), 1.0).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    own = base.crossJoin(F.broadcast(ends)).select("id", flat.alias("base"))  # one row
    both = own.join(seen.join(ppr, "id", "left"), "id", "full_outer").withColumn("ppr", F.coalesce("ppr", F.lit(0.0)))
    return both.select("id", F.when(F.col("base").isNotNull(), mix * F.col("base") + (1 - mix) * F.col("ppr")).otherwise((1 - mix) * F.col("ppr")).alias("score"))


def cheapest_paths(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(id, cost); an edge costs 1 / weight, a seed (id, similarity) starts at 1 / similarity.

    Bellman-Ford: a round relaxes the edges of nodes that became cheaper in the one before, until none does, or for so many rounds (hops).
    """
    known = cut(edges.select("source_id", "target_id", (1 / F.col("weight")).alias("step")), "paths-edges")
    best = cut(seeds.groupBy("id").agg(F.min(1 / F.col("similarity")).alias("cost")).withColumn("fresh", F.lit(True)), "paths")
    done = 0
    while (rounds is None or done < rounds) and not best.filter("fresh").isEmpty():
        step = known.join(best.filter("fresh").select(F.col("id").alias("source_id"), "cost"), "source_id").groupBy(F.col("target_id").alias("id")).agg(F.min(F.col("cost") + F.col("step")).alias("offer"))
        both = best.select("id", "cost").join(step, "id", "full_outer")
        best = cut(both.select("id", F.least("cost", "offer").alias("cost"), F.coalesce(F.col("offer") < F.col("cost"), F.col("cost").isNull()).alias("fresh")), "paths")
        done += 1
    return best.select("id", "cost")


def expansion(edges: DataFrame, seeds: DataFrame, concepts: DataFrame) -> DataFrame:
    """(place, id, cost, expands): nodes in the order in which a search by priority reaches them.

    A seed (id, similarity) has priority 1 / similarity, an edge adds 1 / weight; the cheapest node comes next, ties by id.  A node
    leads on only if it has a concept (id, concept) that no node before it had, so a concept's first node is what counts, and a
    node without concepts never leads on.

    Nodes are settled in rounds: all that are cheaper than any way on from the front could be, as no node of the front can make them
    cheaper.  Rounds are bounded by the range of costs over the cheapest step, whatever the number of hops; each takes joins of the front only.
    """
    least = 1e-10
    known = cut(edges.select("source_id", "target_id", (1 / F.greatest(F.col("weight"), F.lit(least))).alias("step")), "expansion-edges")
    cheapest = cut(known.groupBy(F.col("source_id").alias("id")).agg(F.min("step").alias("out")), "expansion-out")
    named = cut(concepts.select("id", "concept").distinct(), "expansion-concepts")
    front = cut(seeds.groupBy("id").agg(F.min(1 / F.greatest(F.col("similarity"), F.lit(least))).alias("cost")).join(cheapest, "id", "left"), "expansion-front")
    settled, known_concepts = [], None
    while True:
        limit = front.agg(F.min(F.col("cost") + F.coalesce("out", F.lit(float("inf")))).alias("limit"), F.min("cost").alias("cost")).first()
        if limit["cost"] is None:
            break
        # A step so small that it adds nothing still settles the cheapest.
        now = front.filter((F.col("cost") < limit["limit"]) | (F.col("cost") == limit["cost"]))
        news = now.join(named, "id")
        if known_concepts is not None:
            news = news.join(known_concepts, "concept", "left_anti")
        firsts = cut(news.groupBy("concept").agg(F.min(F.struct("cost", "id")).alias("first")).select("concept", "first.id"), "expansion-firsts")
        leads = firsts.select("id").distinct().withColumn("expands", F.lit(True))
        batch = cut(now.join(leads, "id", "left").select("id", "cost", F.coalesce("expands", F.lit(False)).alias("expands")), "expansion-settled")
        settled.append(batch)
        known_concepts = firsts.select("concept") if known_concepts is None else known_concepts.unionByName(firsts.select("concept"))
        offers = batch.filter("expands").withColumnRenamed("id", "source_id").join(known, "source_id").select(F.col("target_id").alias("id"), (F.col("cost") + F.col("step")).alias("cost"))
        every = reduce(DataFrame.unionByName, settled).select("id")
        rest = front.select("id", "cost").unionByName(offers).groupBy("id").agg(F.min("cost").alias("cost")).join(every, "id", "left_anti")
        front = cut(rest.join(cheapest, "id", "left"), "expansion-front")
        if len(settled) % 10 == 0:  # keeps plans short
            settled, known_concepts = [cut(reduce(DataFrame.unionByName, settled), "expansion-settled")], cut(known_concepts, "expansion-known")
    if not settled:
        return front.select(F.lit(0).cast("long").alias("place"), "id", "cost", F.lit(False).alias("expands")).limit(0)
    return _placed(reduce(DataFrame.unionByName, settled))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with place from 1 by (cost, id): sorted over all tasks, numbered inside each, offsets from the counts of parts."""
    part = cut(rows.repartitionByRange("cost", "id").withColumn("_part", F.spark_partition_id()), "places")
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = part.groupBy("_part").agg(F.count("*").alias("n")).select("_part", F.coalesce(before, F.lit(0)).alias("offset"))  # a row a part
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("cost", "id"))
    return part.withColumn("_inside", inside).join(F.broadcast(offsets), "_part").select((F.col("offset") + F.col("_inside")).alias("place"), "id", "cost", "expands")


def paths(edges: DataFrame, source, target, most: int) -> DataFrame:
    """(hops, path): cycle-free paths of at most so many edges, shortest first, then by the path."""
    now = edges.filter(F.col("source_id") == source).select(F.array("source_id", "target_id").alias("path"), F.col("target_id").alias("at"))
    found = now.filter(F.col("at") == target)
    for _ in range(most - 1):
        rest = now.filter(F.col("at") != target)
        now = rest.join(edges, rest["at"] == edges["source_id"]).filter(~F.array_contains("path", F.col("target_id"))).select(F.concat("path", F.array("target_id")).alias("path"), F.col("target_id").alias("at"))
        found = found.unionByName(now.filter(F.col("at") == target))
    return found.select((F.size("path") - 1).alias("hops"), "path").orderBy("hops", "path")


def version_chain(starts: DataFrame, edges: DataFrame, most: int = 3, depth: int | None = None) -> DataFrame:
    """Predecessors of each start, breadth first, the first `most` ones; edges lead from a version to the one before it.

    A start goes on until it has as many or there are no more; depth, if given, bounds the layers.
    """
    front = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct(), "chain-front")
    seen, h = None, 0
    while (depth is None or h < depth) and not front.isEmpty():
        h += 1
        layer = front.join(edges, front["at"] == edges["source_id"]).select("start", F.col("target_id").alias("at")).distinct()
        if seen is not None:
            layer = layer.join(seen.select("start", "at"), ["start", "at"], "left_anti")
        layer = layer.withColumn("depth", F.lit(h))
        seen = cut(layer if seen is None else seen.unionByName(layer), "chain")
        enough = seen.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") >= most).select("start")
        front = cut(seen.filter(F.col("depth") == h).select("start", "at").join(enough, "start", "left_anti"), "chain-front")
    if seen is None:
        return ranked(front.withColumn("depth", F.lit(0)).limit(0), ["start"], ["depth", "at"])
    return top_k(seen, ["start"], ["depth", "at"], most)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node reaches along edges either way."""
    ends = edges.select(F.col("source_id").alias("u"), F.col("target_id").alias("v"))
    pairs = cut(ends.union(ends.select("v", "u")).filter("u <> v").distinct(), "cc-edges")
    label = pairs.select(F.col("u").alias("node")).distinct().withColumn("root", F.col("node"))
    for r in range(rounds):
        low = pairs.join(label.withColumnsRenamed({"node": "v"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("low"))
        nearer = label.join(low, "node").select("node", F.least("root", "low").alias("root"))
        # Pointer jumping: follow the label's own label.
        jump = nearer.select(F.col("node").alias("root"), F.col("root").alias("top"))
        after = cut(nearer.join(jump, "root", "left").select("node", F.least("root", F.coalesce("top", "root")).alias("root")), f"cc-{r}")
        if not after.join(label.withColumnRenamed("root", "old"), "node").filter("root <> old").limit(1).count():
            return after
        label = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _nearest(x, centers):
    import numpy as np

    return np.argmin((centers * centers).sum(1) - 2 * (x @ centers.T), axis=1)


def _centers(x, k: int, seed: int, rounds: int = 25):
    """At most k centres of Lloyd's steps from distinct rows; a single one if the rows don't come apart."""
    import numpy as np

    distinct = np.unique(x, axis=0)
    at = distinct[np.random.default_rng(seed).choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = _nearest(x, at)
        after = np.array([x[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(at)])
        if np.array_equal(after, at):
            break
        at = after
    return at if len(np.unique(_nearest(x, at))) > 1 else at[:1]


def _pieces(x, most: int, seed: int) -> list:
    """Row numbers of clusters of at most `most` rows; equal rows are cut in their order."""
    import numpy as np

    out, open_ = [], [np.arange(len(x))]
    while open_:
        own = open_.pop()
        k = -(-len(own) // most)
        if k <= 1:
            out.append(own)
            continue
        centers = _centers(x[own], k, seed)
        if len(centers) < 2:
            out += np.array_split(own, k)
        else:
            label = _nearest(x[own], centers)
            open_ += [own[label == i] for i in np.unique(label)]
    return out


def cluster(df: DataFrame, key: str, vec: str, most: int = 20, least: int = 10, seed: int = 7, local: int = 4096, fan: int = 16) -> DataFrame:
    """(key, cluster): k-means with k = ceil(n / most), again until no cluster has over `most` members; those with over `least` are kept.

    Clusters of over `local` members are first split together, level by level, by `fan` centres each that a sample
    of at most `local` members gives; the others are finished in one task each.  Equal vectors are halved by the hashed key, then cut in its order.
    """
    import numpy as np
    import pandas as pd

    from palimpsest.functions import vectors

    kind = df.select(key).schema[0].dataType.simpleString()
    rows = cut(df.select(F.col(key).alias("k"), F.col(vec).cast("array<double>").alias("v"), F.lit("c").alias("cluster")), "cluster-0")

    def fitted(pdf):
        x = np.array(pdf.sort_values("k")["v"].tolist(), float)
        return pd.DataFrame({"cluster": pdf["cluster"].iloc[:1].tolist(), "centers": [_centers(x, fan, seed).tolist()]})

    level = 0
    while True:
        big = rows.groupBy("cluster").count().filter(F.col("count") > local).select("cluster")
        if not big.limit(1).count():
            break
        level += 1
        sample = top_k(rows.join(big, "cluster", "left_semi"), ["cluster"], [F.xxhash64("k"), "k"], local).select("cluster", "k", "v")
        centers = cut(sample.groupBy("cluster").applyInPandas(fitted, "cluster string, centers array<array<double>>"), f"cluster-centers-{level}")
        near = F.transform("centers", lambda c: vectors.dot(F.col("v"), c) - vectors.dot(c, c) / 2)
        part = F.when(F.size("centers") > 1, F.array_position(near, F.array_max(near))).otherwise(F.pmod(F.xxhash64("k"), F.lit(2)))
        named = F.when(F.col("centers").isNull(), F.col("cluster")).otherwise(F.concat_ws(".", "cluster", part.cast("string")))
        rows = cut(rows.join(centers, "cluster", "left").select("k", "v", named.alias("cluster")), f"cluster-{level}")

    def finished(pdf):
        pdf = pdf.sort_values("k")
        found = [own for own in _pieces(np.array(pdf["v"].tolist(), float), most, seed) if len(own) > least]
        at = np.concatenate(found) if found else np.array([], int)
        names = [f"{pdf['cluster'].iloc[0]}.{i}" for i, own in enumerate(found) for _ in own]
        return pd.DataFrame({"k": pdf["k"].to_numpy()[at], "cluster": pd.Series(names, dtype=object)})

    return rows.groupBy("cluster").applyInPandas(finished, f"k {kind}, cluster string").withColumnRenamed("k", key)


def merge_nodes(edges: DataFrame, merged: DataFrame, lineage: str = "MERGED_TO") -> DataFrame:
    """Edges after nodes (from_id, to_id) were merged: lineage stays, self-loops that would come about stay behind, an edge
    moves only where no edge of its relation joins the two ends yet, either way."""
    def ends(end: str) -> Column:
        return F.coalesce(F.col(f"to_{end}"), F.col(end))

    out = edges
    for end in ("source_id", "target_id"):
        out = out.join(merged.select(F.col("from_id").alias(end), F.col("to_id").alias(f"to_{end}")), end, "left")
    moves = (F.col("to_source_id").isNotNull() | F.col("to_target_id").isNotNull()) & (F.col("relation") != lineage)
    loop = ends("source_id") == ends("target_id")
    stay = out.filter(~moves | loop).select("source_id", "target_id", "relation")
    moved = out.filter(moves & ~loop).select(ends("source_id").alias("source_id"), ends("target_id").alias("target_id"), "relation").distinct()
    taken = both_ways(stay).distinct()
    pair = lambda df: df.withColumn("lo", F.least("source_id", "target_id")).withColumn("hi", F.greatest("source_id", "target_id"))
    fresh = ranked(pair(moved.join(taken, ["source_id", "target_id", "relation"], "left_anti")), ["lo", "hi", "relation"], ["source_id"], "_p").filter("_p = 1")
    return stay.unionByName(fresh.select("source_id", "target_id", "relation"))


def merged_metadata(a: DataFrame, b: DataFrame, fields: list[str], sources: str) -> DataFrame:
    """Rows of both by id: the first non-null of each field, sources joined."""
    x, y = a.alias("x"), b.alias("y")
    empty = F.array().cast(a.schema[sources].dataType)
    return x.join(y, "id", "full_outer").select("id", *[F.coalesce(f"x.{f}", f"y.{f}").alias(f) for f in fields], F.concat(F.coalesce(f"x.{sources}", empty), F.coalesce(f"y.{sources}", empty)).alias(sources))
