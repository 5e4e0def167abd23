"""Aggregates of scored results, usage and graphs: overall and by group in one pass through rollup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.tables import cut


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def accuracy(results: DataFrame, by: str, score: str = "score", correct: str = "is_correct") -> DataFrame:
    """executed, scored, unscored, accuracy, avg_score overall (null group) and by group; unscored rows leave the denominators."""
    ok = F.col(score).isNotNull() & F.col(correct).isNotNull()
    agg = results.rollup(by).agg(F.count("*").alias("executed"), F.count_if(ok).alias("scored"), F.count_if(ok & F.col(correct)).alias("n_correct"), F.sum(F.when(ok, F.col(score))).alias("total"))
    return agg.select(by, "executed", "scored", (F.col("executed") - F.col("scored")).alias("unscored"), _ratio(F.col("n_correct"), F.col("scored")).alias("accuracy"), _ratio(F.col("total"), F.col("scored")).alias("avg_score"))


def metric_stats(results: DataFrame, metrics: str) -> DataFrame:
    """n and mean of each metric of a map column; a row may feed several."""
    return results.select(F.explode(metrics).alias("metric", "value")).filter("value is not null").groupBy("metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def node_rates(results: DataFrame, nodes: str, keep: Column) -> DataFrame:
    """Rates over an array of {mentioned, linked}; no row where there are no nodes."""
    n = results.filter(keep).select(F.explode(nodes).alias("n"))
    out = n.agg(F.count("*").alias("n_nodes"), F.avg(F.col("n.mentioned").cast("double")).alias("mention_rate"), F.avg(F.col("n.linked").cast("double")).alias("link_rate"))
    return out.filter("n_nodes > 0")


def efficiency(results: DataFrame, memory_time: str, query_time: str, score: str = "score") -> DataFrame:
    """Times are summed over all rows and spread over the scored ones."""
    agg = results.agg(F.sum(memory_time).alias("memory_time"), F.sum(query_time).alias("query_time"), F.count(score).alias("scored"))
    return agg.withColumn("memory_per_scored", _ratio(F.col("memory_time"), F.col("scored"))).withColumn("query_per_scored", _ratio(F.col("query_time"), F.col("scored")))


def retrieval_quality(results: DataFrame, by: str) -> DataFrame:
    """Macro means over available rows, micro rates from pooled tp, fp, fn, and coverage; overall (null) and by group.

    results: by, available, tp, fp, fn, precision, recall.
    """
    on = F.col("available")
    agg = results.rollup(by).agg(
        F.count("*").alias("n"), F.count_if(on).alias("n_available"), F.avg(F.when(on, F.col("precision"))).alias("macro_precision"), F.avg(F.when(on, F.col("recall"))).alias("macro_recall"),
        *(F.sum(F.when(on, F.col(c))).alias(c) for c in ("tp", "fp", "fn")),
    )
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return agg.select(by, "n", _ratio(F.col("n_available"), F.col("n")).alias("coverage"), "macro_precision", "macro_recall", p.alias("micro_precision"), r.alias("micro_recall"), _ratio(2 * p * r, p + r).alias("micro_f1"))


def describe(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """mean, sample deviation (0 for one row), exact median, min, max and n of each column, overall (nulls) and by group."""
    long = df.unpivot([F.col(c) for c in by], [F.col(c).cast("double").alias(c) for c in columns], "metric", "value").filter("value is not null")
    aggs = (F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.median("value").alias("median"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("*").alias("n"))
    parts = long.groupBy(*by, "metric").agg(*aggs)
    whole = long.groupBy("metric").agg(*aggs).select(*[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in by], "*")
    return parts.unionByName(whole)


def grouped_counts(df: DataFrame, fields: dict[str, Column], keep: Column | None = None) -> DataFrame:
    rows = df if keep is None else df.filter(keep)
    return rows.groupBy(*[c.alias(n) for n, c in fields.items()]).agg(F.count("*").alias("n"))


def fact_counts(facts: DataFrame, subject: str, obj: str) -> DataFrame:
    """n, and distinct subjects and objects; empty values do not count."""
    real = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(c))
    return facts.agg(F.count("*").alias("n"), F.count_distinct(real(subject)).alias("n_subjects"), F.count_distinct(real(obj)).alias("n_objects"))


def health(rows: DataFrame, status: str, source: str, statuses: Sequence[str]) -> DataFrame:
    """One pass: rows by status, distinct sources, and rows whose source was seen before."""
    by = [F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses]
    return rows.agg(F.count("*").alias("n"), *by, F.count_distinct(source).alias("n_sources"), (F.count(source) - F.count_distinct(source)).alias("n_duplicate_sources"))


def usage(calls: DataFrame, stage: str, caller: str, columns: Sequence[str]) -> DataFrame:
    """Sums by stage and caller, by stage, and in total (nulls)."""
    return calls.rollup(stage, caller).agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in columns))


def phase_usage(calls: DataFrame, phase: str, phases: Sequence[str], latency: str, ok: Column) -> DataFrame:
    """Totals of some phases; the mean latency is the total over successful calls (0 if none)."""
    agg = calls.filter(F.col(phase).isin(list(phases))).agg(F.count("*").alias("calls"), F.count_if(ok).alias("ok_calls"), F.coalesce(F.sum(latency), F.lit(0.0)).alias("latency"))
    return agg.withColumn("avg_latency", _ratio(F.col("latency"), F.col("ok_calls")))


def comparison(runs: dict[str, DataFrame]) -> DataFrame:
    """One record a run."""
    parts = [df.withColumn("run", F.lit(name)) for name, df in sorted(runs.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def graph_metrics(nodes: DataFrame, edges: DataFrame, components: DataFrame) -> DataFrame:
    """nodes, edges, mean degree, density of a directed graph, components and the largest; components: (node, root)."""
    n = nodes.agg(F.count("*").alias("n_nodes"))
    e = edges.agg(F.count("*").alias("n_edges"))
    inside = nodes.join(components.withColumnRenamed("node", "id"), "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.count("*").alias("size"))
    c = inside.agg(F.count("*").alias("n_components"), F.max("size").alias("largest"))
    one = n.crossJoin(e).crossJoin(c)  # three single rows
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1)
    return one.select("n_nodes", "n_edges", _ratio(2.0 * F.col("n_edges"), F.col("n_nodes")).alias("mean_degree"), _ratio(F.col("n_edges").cast("double"), pairs).alias("density"), "n_components", "largest")


def recall_at(results: DataFrame, ks: Sequence[int], gold: str = "gold", found: str = "found") -> DataFrame:
    """Mean recall, all-recall and ndcg at each k, rounded to 4; the gain at place i >= 2 is discounted by log2(i)."""
    aggs = []
    for k in ks:
        top = F.slice(found, 1, k)
        hits = F.size(F.array_intersect(F.array_distinct(top), F.col(gold)))
        gain = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
        place = lambda i: F.when(i == 0, F.lit(1.0)).otherwise(1.0 / F.log2((i + 1).cast("double")))
        dcg = gain(F.transform(top, lambda x, i: F.when(F.array_contains(gold, x), place(i)).otherwise(0.0)))
        ideal = gain(F.transform(F.sequence(F.lit(0), F.greatest(F.least(F.size(gold), F.lit(k)), F.lit(1)) - 1), place))
        n = F.size(gold)
        aggs += [F.round(F.avg(F.when(n > 0, hits / n)), 4).alias(f"recall_{k}"), F.round(F.avg(F.when(n > 0, (hits == n).cast("double"))), 4).alias(f"all_{k}"), F.round(F.avg(F.when(n > 0, dcg / ideal)), 4).alias(f"ndcg_{k}")]
    return results.agg(*aggs)


def nested_groups(df: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """outer, inner, and the items in order."""
    return df.groupBy(outer, inner).agg(F.array_sort(F.collect_list(item)).alias("items"))


def entities(triples: DataFrame, chunk: str) -> DataFrame:
    """Distinct subjects and objects of each chunk, sorted."""
    ends = triples.select(chunk, F.explode(F.array("subject", "object")).alias("entity")).distinct()
    return ends.groupBy(chunk).agg(F.array_sort(F.collect_list("entity")).alias("entities"))


def injection_stats(rows: DataFrame, order: str, is_noise: Column, kind: str) -> DataFrame:
    """Counts, noise share, and the mean gap before a noise row (the first one's from the start)."""
    # The gaps add up to the rows before the last noise row that are no noise themselves.
    last = rows.filter(is_noise).agg(F.max(order).alias("_last"), F.count("*").alias("n_noise"), F.count_distinct(kind).alias("n_kinds"))
    both = rows.crossJoin(F.broadcast(last))  # one row
    counted = both.agg(F.count("*").alias("n"), F.first("n_noise").alias("n_noise"), F.first("n_kinds").alias("n_kinds"), F.count_if(F.col(order) <= F.col("_last")).alias("_upto"))
    return counted.withColumn("avg_gap", _ratio((F.col("_upto") - F.col("n_noise")).cast("double"), F.col("n_noise"))).drop("_upto").withColumn("noise_ratio", _ratio(F.col("n_noise").cast("double"), F.col("n")))


def balanced_partitions(lengths: list[int], k: int) -> list[list[int]]:
    """Greedy: the longest next item goes to the lightest part."""
    import heapq

    heap = [(0, i) for i in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + lengths[i], p))
    return parts


def differencing_partitions(lengths: list[int], k: int) -> list[list[int]]:
    """Largest differencing (Karmarkar-Karp): merge the two states of widest spread, heaviest part onto lightest."""
    if not lengths:
        return [[] for _ in range(k)]
    return [items for _, items in _differenced([[(0, []) for _ in range(k - 1)] + [(n, [i])] for i, n in enumerate(lengths)])]


def _differenced(states: list[list[tuple]]) -> list[tuple]:
    """One state of (sum, items) by sum out of many, each sorted likewise."""
    import heapq

    heap = [(parts[0][0] - parts[-1][0], i, parts) for i, parts in enumerate(states)]
    heapq.heapify(heap)
    fresh = len(states)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: p[0])
        heapq.heappush(heap, (merged[0][0] - merged[-1][0], fresh, merged))
        fresh += 1
    return heap[0][2]


#: Short rows that a task of a divided group leaves for the end.
HELD = 64


def balance(df: DataFrame, by: str, key: str, length: str, k: int, method: str = "greedy", rows_a_task: int = 100_000) -> DataFrame:
    """part of every row, per group, so that lengths are even.

    A group of more than `rows_a_task` rows is dealt over tasks by hash.  Each holds back its HELD shortest rows (a quarter at most) and
    splits the others into k parts, whose sums are merged like differencing merges states: the widest spread first, heaviest
    onto lightest.  Then the short rows go onto the lightest parts.  A merge sees k + HELD numbers a task.
    """
    import heapq

    import pandas as pd

    split = {"greedy": balanced_partitions, "differencing": differencing_partitions}[method]
    rows = df.select(by, key, F.col(length).cast("long").alias(length))
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    tasks = rows.groupBy(F.col(by).alias("_by")).agg(F.ceil(F.count("*") / rows_a_task).cast("int").alias("_tasks"))
    dealt = rows.join(tasks, F.col(by).eqNullSafe(F.col("_by"))).withColumn("_task", F.pmod(F.xxhash64(key, length), "_tasks").cast("int"))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held = min(HELD, len(pdf) // 4) if pdf["_tasks"].iloc[0] > 1 else 0
        pdf = pdf.sort_values([length, key] if held else [key, length]).reset_index(drop=True)
        part = [k + i for i in range(held)] + [0] * (len(pdf) - held)
        for p, items in enumerate(split(pdf[length].tolist()[held:], k)):
            for i in items:
                part[held + i] = p
        return pdf[[by, key, length, "_task"]].assign(slot=part)

    slots = cut(dealt.groupBy(by, "_task").applyInPandas(fold, f"{by} {kind[by]}, {key} {kind[key]}, {length} bigint, _task int, slot int"), "balance-slots")

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        states = [sorted([(0, [])] * (k - len(own)) + [(int(n), [(t, s)]) for s, n in zip(own["slot"], own["n"], strict=True)], key=lambda p: p[0]) for t, own in pdf[pdf["slot"] < k].groupby("_task")]
        merged = _differenced(states)
        found = [(t, s, p) for p, (_, items) in enumerate(merged) for t, s in items]
        lightest = [(n, p) for p, (n, _) in enumerate(merged)]
        heapq.heapify(lightest)
        for t, s, n in pdf[pdf["slot"] >= k].sort_values(["n", "_task", "slot"], ascending=[False, True, True])[["_task", "slot", "n"]].itertuples(index=False):
            total, p = lightest[0]
            heapq.heapreplace(lightest, (total + n, p))
            found.append((t, s, p))
        return pd.DataFrame(found, columns=["_task", "slot", "part"]).assign(_by=pdf[by].iloc[0])

    sums = slots.groupBy(by, "_task", "slot").agg(F.sum(length).alias("n"))
    merged = sums.groupBy(by).applyInPandas(merge, f"_task int, slot int, part int, _by {kind[by]}").withColumnRenamed("slot", "_slot").withColumnRenamed("_task", "_of")
    same = F.col(by).eqNullSafe(F.col("_by")) & (F.col("_task") == F.col("_of")) & (F.col("slot") == F.col("_slot"))
    return slots.join(merged, same).select(by, key, length, "part")


def imbalance(df: DataFrame, by: str, length: str, most: int) -> DataFrame:
    """Spread of group totals, and how many micro batches a group needs."""
    t = df.groupBy(by).agg(F.sum(length).alias("total"))
    return t.agg(F.min("total").alias("least"), F.max("total").alias("most"), F.avg("total").alias("mean"), F.sum(F.ceil(F.col("total") / F.lit(float(most)))).alias("batches"))
