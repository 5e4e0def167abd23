"""Top-k and pagination: thresholds before or after the cut, quotas, boosts, keysets, provenance."""

from __future__ import annotations

import base64
import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import vectors
from palimpsest.operators.ranking import ranked, top_k


def vector(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def dense(df: DataFrame, key: str, vec: str, query: Sequence[float], k: int, metric: str = "dot", digits: int = 6) -> DataFrame:
    """(key, score) of the k best for one query vector; ties go to the smaller key, l2 counts down."""
    fn = {"dot": vectors.dot, "cosine": vectors.cosine, "l2": vectors.l2}[metric]
    scored = df.select(key, F.round(fn(F.col(vec), vector(query)), digits).alias("score"))
    order = F.asc("score") if metric == "l2" else F.desc("score")
    return scored.orderBy(order, key).limit(max(k, 0))


def cut_then_threshold(scored: DataFrame, by: Sequence[str], k: int, least: float, tie: str) -> DataFrame:
    """The k best, and of those what reaches the score: there may be fewer than k."""
    return top_k(scored, by, [F.desc("score"), tie], k).filter(F.col("score") >= least)


def threshold_then_first(scored: DataFrame, order: Sequence, k: int, least: float) -> DataFrame:
    return scored.filter(F.col("score") >= least).orderBy(*order).limit(k)


def random_rows(df: DataFrame, key: str, k: int, seed: int = 7) -> DataFrame:
    """k rows by a seeded hash of the key: the same ones on every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def weighted_rerank(scored: DataFrame, level: str, weights: Mapping[str, float], k: int, tie: str) -> DataFrame:
    """score times its level's weight; where fewer than k rows are there, fillers of -1 follow."""
    w = F.coalesce(F.element_at(F.create_map(*[x for a, b in weights.items() for x in (F.lit(a), F.lit(float(b)))]), F.col(level)), F.lit(1.0))
    best = top_k(scored.withColumn("score", F.round(F.col("score") * w, 6)), [], [F.desc("score"), tie], k).select(tie, "score", "rank")
    spark = scored.sparkSession
    slots = spark.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    return slots.join(best, "rank", "left").select("rank", tie, F.coalesce("score", F.lit(-1.0)).alias("score"))


def trim_by_type(scored: DataFrame, kind: str, limits: Mapping[str, int], tie: str, drop_zero: bool = False) -> DataFrame:
    """Each type's own number of rows; drop_zero removes, after the cut, scores that round to 0.00."""
    limit = F.element_at(F.create_map(*[x for a, b in limits.items() for x in (F.lit(a), F.lit(b))]), F.col(kind))
    kept = ranked(scored, [kind], [F.desc("score"), tie]).filter(F.col("rank") <= F.coalesce(limit, F.lit(0)))
    return kept.filter(F.round("score", 2) != 0) if drop_zero else kept


def best_triplets(triplets: DataFrame, k: int, order: str) -> DataFrame:
    """The k smallest totals, largest of them first; on ties the later edge is kept."""
    near = triplets.orderBy("total", F.desc(order)).limit(k)
    return ranked(near, [], [F.desc("total"), order])


def encode_cursor(*values) -> str:
    return base64.urlsafe_b64encode(json.dumps(values, default=str).encode()).decode()


def decode_cursor(cursor: str) -> list:
    return json.loads(base64.urlsafe_b64decode(cursor.encode()))


def keyset_page(df: DataFrame, sort: str, key: str, limit: int, after: tuple | None = None, descending: bool = True) -> DataFrame:
    """limit rows past (sort, key), and has_more from a probe of one more."""
    rows = df
    if after is not None:
        s, i = F.lit(after[0]).cast(df.schema[sort].dataType), F.lit(after[1])
        past = (F.col(sort) < s) if descending else (F.col(sort) > s)
        beyond = (F.col(key) < i) if descending else (F.col(key) > i)
        rows = rows.filter(past | ((F.col(sort) == s) & beyond))
    order = [F.desc(sort), F.desc(key)] if descending else [F.asc(sort), F.asc(key)]
    probe = ranked(rows.orderBy(*order).limit(limit + 1), [], order, "place")
    more = F.max("place").over(Window.partitionBy(F.lit(0))) > limit
    return probe.withColumn("has_more", more).filter(F.col("place") <= limit)


def listing(df: DataFrame, equal: Mapping | None = None, after=None, before=None, time: str = "ts", contains: Mapping[str, str] | None = None, deleted: Column | None = None) -> DataFrame:
    """Equality or membership, exclusive time bounds, case-insensitive substrings, and no deleted rows."""
    for c, v in (equal or {}).items():
        df = df.filter(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    if after is not None:
        df = df.filter(F.col(time) > F.lit(after).cast("timestamp"))
    if before is not None:
        df = df.filter(F.col(time) < F.lit(before).cast("timestamp"))
    for c, v in (contains or {}).items():
        df = df.filter(F.lower(c).contains(v.lower()))
    return df if deleted is None else df.filter(~deleted)


def temporal_order(df: DataFrame, by: Sequence[str], start: str, end: str, tie: str, descending: bool = False) -> DataFrame:
    """In each group by start ascending, missing last; or by end descending, where a missing end comes first."""
    order = F.desc_nulls_first(end) if descending else F.asc_nulls_last(start)
    return ranked(df, by, [order, tie])


def with_links(hits: DataFrame, links: DataFrame, k: int) -> DataFrame:
    """Each hit followed by its first k links; an item's first place counts.  hits (query, item, rank), links (item, pos, linked)."""
    direct = hits.select("query", "item", "rank", F.lit(0).alias("pos"))
    linked = hits.join(links.filter(F.col("pos") <= k), "item").select("query", F.col("linked").alias("item"), "rank", "pos")
    first = direct.unionByName(linked).groupBy("query", "item").agg(F.min(F.struct("rank", "pos")).alias("place"))
    return ranked(first, ["query"], ["place.rank", "place.pos", "item"], "at").select("query", "item", "at")


def provenance_turns(turns: DataFrame, refs: int, per: int) -> DataFrame:
    """(claim, ref, turn, pos, score): the best turn ranks its ref; the best turns of the best refs, in source order."""
    best = turns.groupBy("claim", "ref").agg(F.max("score").alias("ref_score"))
    good = top_k(best, ["claim"], [F.desc("ref_score"), "ref"], refs, "ref_rank")
    kept = top_k(turns.join(good.select("claim", "ref"), ["claim", "ref"], "left_semi"), ["claim"], [F.desc("score"), "ref", "pos"], per)
    return ranked(kept.drop("rank"), ["claim"], ["ref", "pos"], "place")


def unused_turns(turns: DataFrame, used: DataFrame, k: int) -> DataFrame:
    """The k best turns that are not used yet, in source order."""
    fresh = turns.join(used, ["ref", "pos"], "left_anti")
    best = fresh.orderBy(F.desc("score"), "ref", "pos").limit(k)
    return ranked(best, [], ["ref", "pos"], "place")


def state_candidates(rows: DataFrame, exact: Column, slot_score: str, full_score: str, key: str, k: int, least: float) -> DataFrame:
    """An exact slot first, then slot similarity, full similarity and key; others need the least similarity."""
    got = rows.withColumn("exact", exact).filter(F.col("exact") | (F.col(slot_score) >= least))
    return ranked(got.orderBy(F.desc("exact"), F.desc(slot_score), F.desc(full_score), key).limit(k), [], [F.desc("exact"), F.desc(slot_score), F.desc(full_score), key])


def multi_vector(df: DataFrame, key: str, vec: str, queries: DataFrame, q_key: str, q_vec: str, k: int, priority: Column | None = None, most: int = 20) -> DataFrame:
    """k best for each of the first `most` query vectors, with and without the priority filter; the best score by key."""
    q = queries.orderBy(q_key).limit(most).select(F.col(q_key).alias("q"), F.col(q_vec).alias("qv"))
    parts = []
    for rows in [df] + ([df.filter(priority)] if priority is not None else []):
        pairs = rows.crossJoin(F.broadcast(q))  # at most `most` query vectors
        scored = pairs.select("q", key, F.round(vectors.cosine(F.col(vec), F.col("qv")), 6).alias("score"))
        parts.append(top_k(scored, ["q"], [F.desc("score"), key], k).select(key, "score"))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return ranked(every.groupBy(key).agg(F.max("score").alias("score")), [], [F.desc("score"), key])


def boosted(score: Column, boosts: Sequence[tuple[Column, float]]) -> Column:
    """score * (1 + weight) for each condition that holds, kept within [0, 1] after each."""
    for hit, weight in boosts:
        if weight:
            score = F.when(F.coalesce(hit, F.lit(False)), F.least(F.greatest(score * (1 + weight), F.lit(0.0)), F.lit(1.0))).otherwise(score)
    return score


def quota_split(rows: DataFrame, by: str, knowledge: Column, text: str, k: int, share: float, order: Sequence) -> DataFrame:
    """Texts once; knowledge rows up to max(int(k share), k - conversation rows), conversation rows fill the rest."""
    once = ranked(rows, [by, text], list(order), "_d").filter("_d = 1").drop("_d").withColumn("_k", knowledge)
    spec = Window.partitionBy(by)
    n_talk = F.count_if(~F.col("_k")).over(spec)
    placed = ranked(once.withColumn("_quota", F.greatest(F.lit(int(k * share)), k - n_talk)), [by, "_k"], list(order), "_p")
    n_know = F.least(F.count_if(F.col("_k")).over(spec), F.col("_quota"))
    placed = placed.withColumn("_rest", k - n_know)
    return placed.filter(F.when(F.col("_k"), F.col("_p") <= F.col("_quota")).otherwise(F.col("_p") <= F.col("_rest"))).drop("_k", "_p", "_quota", "_rest")


def threshold_with_minimum(rows: DataFrame, by: str, personal: Column, least: float, minimum: int, order: str) -> DataFrame:
    """Rows of the score; where they are fewer than the minimum, the first personal and the first other ones in order;
    else personal rows are topped up to the minimum."""
    spec = Window.partitionBy(by)
    got = rows.withColumn("_own", personal).withColumn("_ok", F.col("score") >= least)
    got = ranked(got, [by, "_own"], [order], "_p").withColumn("_n", F.count_if("_ok").over(spec)).withColumn("_m", F.count_if(F.col("_ok") & F.col("_own")).over(spec))
    top_up = F.col("_own") & (F.col("_p") <= minimum) & (F.col("_m") < minimum)
    return got.filter(F.when(F.col("_n") < minimum, F.col("_p") <= minimum).otherwise(F.col("_ok") | top_up)).drop("_own", "_ok", "_p", "_n", "_m")


def keyword_vector(words: DataFrame, vec: str, dims: int) -> DataFrame:
    """One row: the mean of the keywords' vectors."""
    parts = words.select(F.posexplode(vec).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))


def keyword_counts(queue: DataFrame, time: str, words: str, start, end) -> DataFrame:
    """Keywords of the rows between two times, both included; null lists are empty."""
    rows = queue.filter(F.col(time).between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))
    return rows.select(F.explode(F.coalesce(words, F.array().cast("array<string>"))).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))
