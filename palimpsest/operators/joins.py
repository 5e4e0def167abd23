"""Joins: provenance, similarity, time-bounded, as-of and overlap, and their reverse lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators import containment, fuzzy
from palimpsest.operators.ranking import top_k
from palimpsest.operators.tables import MEMBERS, cut, members


def translate_ids(df: DataFrame, by: str, ids: str, mapping: DataFrame) -> DataFrame:
    """Each row's array of ids through mapping (from_id, to_id): unknown ones drop, the first of equals stays, order is kept."""
    rows = df.select(by, F.posexplode(ids).alias("_at", "from_id")).join(mapping, "from_id")
    first = rows.groupBy(by, "to_id").agg(F.min("_at").alias("_at"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "to_id"))), lambda x: x["to_id"]).alias(ids))


def integrity(parents: DataFrame, children: DataFrame, key: str, clean: Column) -> DataFrame:
    """Children whose parent is missing or not clean, and keys that more than one parent bears."""
    orphans = children.join(parents.filter(clean), key, "left_anti").select(key, F.lit("no clean parent").alias("problem")).distinct()
    twice = parents.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.lit("key borne twice").alias("problem"))
    return orphans.unionByName(twice)


def evidence_turns(claims: DataFrame, turns: DataFrame, at_most: int = 4) -> DataFrame:
    """claims (claim_id, evidence array<struct<episode_id, turn_ids>>) to their turns (episode_id, turn_id, pos), first ones first."""
    e = claims.select("claim_id", F.posexplode("evidence").alias("_e", "ev")).select("claim_id", "_e", "ev.episode_id", F.explode("ev.turn_ids").alias("turn_id"))
    return top_k(e.join(turns, ["episode_id", "turn_id"]), ["claim_id"], ["_e", "pos", "turn_id"], at_most).drop("_e")


def knn(queries: DataFrame, candidates: DataFrame, key: str, vec: str, k: int, chunk_bytes: int = 8 << 20, block: int = 1024, at_once: int = 512) -> DataFrame:
    """(query, candidate, rank, score): the k best inner products (six digits) of each query, ties to the smaller candidate.

    Queries go in chunks of about chunk_bytes, each broadcast to one pass over the candidates; a task holds one block of
    candidates, k rows for each query of the chunk and the scores of a block for at_once queries.
    """
    import numpy as np
    import pandas as pd

    context = queries.sparkSession.sparkContext
    q = queries.select(F.col(key).alias("query"), F.col(vec).cast("array<double>").alias("qv")).filter("qv is not null")
    c = candidates.select(F.col(key).alias("candidate"), F.col(vec).cast("array<double>").alias("cv")).filter("cv is not null")
    n_chunks = max(1, -(-(q.agg(F.sum(8 * F.size("qv") + 64)).first()[0] or 0) // chunk_bytes))

    def nearest(shared):
        def run(parts):
            ids, rows = shared.value
            kept_s, kept_c = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for pdf in parts:
                for i in range(0, len(pdf) if len(ids) else 0, block):
                    own = pdf["candidate"].to_numpy()[i : i + block]
                    vectors = np.stack(pdf["cv"].to_numpy()[i : i + block]).T
                    for j in range(0, len(ids), at_once):  # so many queries that their scores fill a few MB
                        to = slice(j, j + at_once)
                        scores = np.round(rows[to] @ vectors, 6)
                        scores[ids[to, None] == own] = -np.inf
                        news = np.flatnonzero((scores >= kept_s[to, -1:]).any(1))
                        s = np.hstack([kept_s[to][news], scores[news]])
                        at = np.hstack([kept_c[to][news], np.broadcast_to(own, (len(news), len(own)))])
                        order = np.lexsort((at, -s), axis=1)[:, :k]
                        kept_s[j + news], kept_c[j + news] = np.take_along_axis(s, order, 1), np.take_along_axis(at, order, 1)
            real = np.isfinite(kept_s)
            yield pd.DataFrame({"query": np.repeat(ids, real.sum(1)), "candidate": kept_c[real], "score": kept_s[real]})

        return run

    found = []
    for n in range(n_chunks):
        rows = q.filter(F.pmod(F.xxhash64("query"), F.lit(n_chunks)) == n).collect()
        if rows:
            shared = context.broadcast((np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)))
            found.append(c.mapInPandas(nearest(shared), "query long, candidate long, score double"))
    if not found:
        return q.sparkSession.createDataFrame([], "query long, candidate long, score double, rank int")
    return top_k(reduce(DataFrame.unionByName, found), ["query"], [F.desc("score"), "candidate"], k)


def reverse_queue(queue: DataFrame, least: float) -> DataFrame:
    """Who lists me: queue (id, other, score) turned round, entries with at least the score, best first."""
    entry = F.struct((-F.col("score")).alias("s"), F.col("id"))
    return queue.filter(F.col("score") >= least).groupBy("other").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["id"]).alias("listed_by"))


def visible_as_of(recorded: Column, valid_from: Column, valid_to: Column, date: Column) -> Column:
    """Half-open validity; an unknown record time is not visible, an unknown validity is."""
    known = F.coalesce(recorded <= date, F.lit(False))
    return known & F.coalesce(valid_from <= date, F.lit(True)) & F.coalesce(date < valid_to, F.lit(True))


def overlaps(valid_from: Column, valid_to: Column, start: Column, end: Column) -> Column:
    """A half-open fact against a closed query interval; open ends reach for ever."""
    return F.coalesce(valid_from <= end, F.lit(True)) & F.coalesce(start < valid_to, F.lit(True))


def key_or_tags(nodes: DataFrame, keys: list[str], tags: list[str], least_tags: int = 2) -> DataFrame:
    """Nodes with one of the keys, or at least two of the tags."""
    shared = F.size(F.array_intersect("tags", F.array(*map(F.lit, tags))))
    return nodes.filter(F.col("key").isin(keys) | (shared >= least_tags))


def triplet_distances(edges: DataFrame, node_distance: DataFrame, edge_distance: DataFrame, missing: float = 1.0) -> DataFrame:
    """source + target + edge distance of (source_id, target_id, relation); what has none counts as `missing`."""
    n = node_distance
    out = edges.join(n.select(F.col("id").alias("source_id"), F.col("distance").alias("ds")), "source_id", "left")
    out = out.join(n.select(F.col("id").alias("target_id"), F.col("distance").alias("dt")), "target_id", "left")
    out = out.join(edge_distance.select("relation", F.col("distance").alias("de")), "relation", "left")
    return out.withColumn("total", F.coalesce("ds", F.lit(missing)) + F.coalesce("dt", F.lit(missing)) + F.coalesce("de", F.lit(missing))).drop("ds", "dt", "de")


def neighbours_both_ways(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, neighbour) along edges and against them, each once."""
    out = nodes.join(edges, nodes["id"] == edges["source_id"]).select("id", F.col("target_id").alias("neighbour"))
    back = nodes.join(edges, nodes["id"] == edges["target_id"]).select("id", F.col("source_id").alias("neighbour"))
    return out.unionByName(back).distinct()


def rematch(saved: DataFrame, dataset: DataFrame, signature: list[str]) -> DataFrame:
    """Saved answers to dataset rows: by (context_id, signature) where a context is given, else by a signature that is unique there.

    status: matched, or why not.
    """
    counted = dataset.withColumn("_n", F.count("*").over(Window.partitionBy(*signature)))
    with_context = saved.filter("context_id is not null").join(dataset.select("context_id", *signature, "row_id"), ["context_id", *signature], "left")
    without = saved.filter("context_id is null").join(counted.select(*signature, F.col("row_id"), "_n").dropDuplicates(signature), signature, "left")
    a = with_context.select("answer_id", "row_id", F.when(F.col("row_id").isNull(), "unknown in context").otherwise("matched").alias("status"))
    b = without.select("answer_id", F.when(F.col("_n") == 1, F.col("row_id")).alias("row_id"), F.when(F.col("_n").isNull(), "unknown").when(F.col("_n") > 1, "ambiguous").otherwise("matched").alias("status"))
    return a.unionByName(b)


def _stripped(chunks: DataFrame) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("chunk", r"^Date: [^\n]*\n", ""), r"^(user|assistant): ", "")
    return chunks.select("chunk_id", bare.alias("bare")).filter("bare is not null")


def _numbered(df: DataFrame, no: str, name: str) -> DataFrame:
    """df stored with a number for each row, which stays the same whoever reads it."""
    return cut(df.withColumn(no, F.monotonically_increasing_id()), name)


def _distinct_originals(originals: DataFrame) -> DataFrame:
    o = originals.filter("original is not null").groupBy(F.sha2("original", 256).alias("digest"))
    return _numbered(o.agg(F.min("original_id").alias("first"), F.count("*").alias("n"), F.first("original").alias("text")), "text_no", "distinct-originals")


def contained_counts(chunks: DataFrame, originals: DataFrame) -> DataFrame:
    """(bare, first_chunk, n_chunks, first_original, n_originals) of each distinct stripped chunk that is part of an original.

    Chunks and originals as in contained_in; equal ones are counted before they meet, so no pairs of copies are made.
    """
    c = _numbered(_stripped(chunks).groupBy("bare").agg(F.min("chunk_id").alias("first_chunk"), F.count("*").alias("n_chunks")), "chunk_no", "distinct-chunks")
    o = _distinct_originals(originals)
    found = containment.parts(c, o).join(o.select("text_no", "first", "n"), "text_no")
    return found.groupBy("chunk_no").agg(F.min("first").alias("first_original"), F.sum("n").alias("n_originals")).join(c, "chunk_no").select("bare", "first_chunk", "n_chunks", "first_original", "n_originals")


def contained_in(chunks: DataFrame, originals: DataFrame, most: int = MEMBERS) -> DataFrame:
    """(chunk_id, original_id) where the stripped chunk (chunk_id, chunk) is part of the original (original_id, original).

    An empty chunk is part of every text; null ones take no part.  See operators.containment for the search.  Equal chunks and
    equal originals meet once; their pairs are made at the end, from rows of about `most` copies, and are not shuffled.
    """
    stripped = cut(_stripped(chunks), "stripped-chunks")
    c = _numbered(stripped.select("bare").distinct(), "chunk_no", "distinct-chunks")
    o = _distinct_originals(originals)
    of_chunk = members(stripped.join(c, "bare").select("chunk_no", "chunk_id"), "chunk_no", "chunk_id", most)
    digests = originals.filter("original is not null").select("original_id", F.sha2("original", 256).alias("digest"))
    of_text = members(digests.join(o.select("digest", "text_no"), "digest").select("text_no", "original_id"), "text_no", "original_id", most)
    met = containment.parts(c, o).join(of_chunk, "chunk_no").join(of_text, "text_no")
    return met.select(F.explode("chunk_ids").alias("chunk_id"), "original_ids").select("chunk_id", F.explode("original_ids").alias("original_id"))


def roll_up(facts: DataFrame, fact_to_gist: DataFrame, gists: DataFrame, gist_to_verbatim: DataFrame, fact_weight: float) -> DataFrame:
    """Scores of gists (weight 1) and of facts through their gists, averaged by verbatim; odd scores are skipped."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    direct = gists.join(gist_to_verbatim, "gist_id").select("verbatim_id", F.col("score"))
    through = facts.join(fact_to_gist, "fact_id").join(gist_to_verbatim, "gist_id").select("verbatim_id", (F.col("score") * fact_weight).alias("score"))
    return direct.unionByName(through).filter(fine(F.col("score"))).groupBy("verbatim_id").agg(F.avg("score").alias("score"), F.count("*").alias("n"))


def reconstruct(rows: DataFrame, key: str, ts: str, order: list, k: int, excluded: Column) -> DataFrame:
    """The k best rows that are not excluded and all rows that share a time with one of them, by time."""
    seeds = rows.filter(~excluded).orderBy(*order).limit(k).select(ts).distinct()
    return rows.join(F.broadcast(seeds) if k <= 10_000 else seeds, ts, "left_semi").dropDuplicates([key]).orderBy(ts, key)


def existing_edges(chunk_nodes: DataFrame, chunk_relations: DataFrame, edges: DataFrame) -> DataFrame:
    """Derived edges (exists_in, is_a, relations) of all chunks that the graph already has.

    The graph's edges are made distinct and looked up among the derived ones, so these need no pass of their own to become distinct.
    """
    key = ["source_id", "target_id", "relation"]
    exists_in = chunk_nodes.select(F.col("node_id").alias("source_id"), F.col("chunk_id").alias("target_id"), F.lit("exists_in").alias("relation"))
    is_a = chunk_nodes.select(F.col("node_id").alias("source_id"), F.col("type_id").alias("target_id"), F.lit("is_a").alias("relation")).distinct()
    every = exists_in.unionByName(is_a).unionByName(chunk_relations.select(*key))
    return edges.select(*key).distinct().join(every, key, "left_semi")


def closest(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each item the other candidate with the least edit distance, then the smaller id, over the whole tables.

    A text that another id bears too is its own closest; only the others are compared, each distinct text once.
    """
    kind = candidates.schema["candidate_id"].dataType
    rows = candidates.filter("candidate is not null")
    ids = rows.groupBy("candidate").agg(F.min("candidate_id").alias("first"))
    second = rows.join(ids, "candidate").filter("candidate_id > first").groupBy("candidate").agg(F.min("candidate_id").alias("second"))
    ids = cut(ids.join(second, "candidate", "left"), "closest-texts")
    own = items.filter("item is not null").join(ids.withColumnRenamed("candidate", "item"), "item", "left")
    twin = F.when(F.col("first") != F.col("item_id"), F.col("first")).otherwise(F.col("second")).cast(kind)
    own = cut(own.select("item_id", "item", twin.alias("candidate_id")), "closest-items")
    same = own.filter("candidate_id is not null").select("item_id", "candidate_id", F.lit(0).alias("distance"))
    alone = own.filter("candidate_id is null").select("item_id", "item")
    near = fuzzy.closest_texts(alone.select("item").distinct(), ids.select("candidate"))
    near = near.join(ids.select("candidate", "first"), "candidate").groupBy("item", "distance").agg(F.min("first").alias("candidate_id"))
    return same.unionByName(alone.join(near, "item").select("item_id", "candidate_id", "distance"))
