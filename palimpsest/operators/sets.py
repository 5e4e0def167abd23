"""Set operations and deduplication, on arrays and on rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import pivots
from palimpsest.operators.ranking import ranked
from palimpsest.operators.tables import cut


def normalized_ids(ids: Column) -> Column:
    """Strings in order, each once; nulls, empty ones and booleans drop, a whole float loses its fraction."""
    clean = F.transform(ids, lambda x: F.regexp_replace(F.trim(x.cast("string")), r"^(-?\d+)\.0+$", "$1"))
    return F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != "") & ~F.lower(x).isin("true", "false", "none")))


def union_ids(*arrays: Column) -> Column:
    return normalized_ids(F.flatten(F.array(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


def predicted_vs_gold(predicted: Column, gold: Column) -> tuple[Column, Column, Column]:
    """Hits, wrong ones and missed ones, in order."""
    return F.array_intersect(predicted, gold), F.array_except(predicted, gold), F.array_except(gold, predicted)


def union_last_wins(parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Rows by key; a later part replaces an earlier one's."""
    every = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    out = every[0]
    for p in every[1:]:
        out = out.unionByName(p)
    return ranked(out, [key], [F.desc("_part")], "_place").filter("_place = 1").drop("_place", "_part")


def drop_pointed_at(rows: DataFrame, edges: DataFrame, kind: Column, relation: str = "SUMMARY") -> DataFrame:
    """Rows without those that a row of `kind` points to by `relation`."""
    sources = rows.filter(kind).select(F.col("id").alias("source_id"))
    gone = edges.filter(F.col("relation") == relation).join(sources, "source_id", "left_semi").select(F.col("target_id").alias("id"))
    return rows.join(gone, "id", "left_anti")


def second_minus_first(first: DataFrame, second: DataFrame, text: str, key: str) -> DataFrame:
    """Second's rows whose text, white space aside, is not in first; each text once (the smaller key)."""
    norm = F.trim(F.regexp_replace(text, r"\s+", " "))
    fresh = second.withColumn("_n", norm).join(first.select(norm.alias("_n")), "_n", "left_anti")
    return ranked(fresh, ["_n"], [key], "_place").filter("_place = 1").drop("_place", "_n")


def connected_only(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows that some edge starts from or leads to."""
    ends = edges.select(F.col("source_id").alias("id")).union(edges.select("target_id")).distinct()
    return rows.join(ends, "id", "left_semi")


def merge_target(task: DataFrame, rows: DataFrame, vec: str, key: str, least: float = 0.85) -> DataFrame:
    """For each task the one most similar row, if similar enough."""
    found = pivots.neighbours(task, rows, key, vec, 1, least)
    return found.select(F.col("id").alias("task"), F.col("other").alias("target"), F.col("score").alias("similarity"))


def _swept(pairs: pd.DataFrame) -> pd.DataFrame:
    """Who goes when pairs (a, b), a before b, are swept in order."""
    gone: set = set()
    for a, b in pairs.sort_values(["a", "b"]).itertuples(index=False):
        if a not in gone:
            gone.add(b)
    return pd.DataFrame({"b": pd.Series(sorted(gone), dtype=pairs["b"].dtype)})


def greedy_near_duplicates(pairs: DataFrame, items: DataFrame, key: str, least: float, few: int = 1_000_000) -> DataFrame:
    """Items kept by the sweep: i stays unless an earlier kept one is at least that similar; removed ones remove none.

    pairs: (a, b, similarity) with a before b.  In rounds: whoever has no undecided earlier neighbour is kept, its later
    neighbours go.  Every round decides the first of what is left, so the rounds end; groups of copies take one.  As soon as
    no more than `few` pairs are undecided, one task finishes them in order, so long chains take no rounds of their own.
    """
    live = cut(pairs.filter(F.col("similarity") >= least).select("a", "b"), "sweep")
    gone = []
    while n := live.count():
        if n <= few:
            gone.append(cut(live.groupBy().applyInPandas(_swept, live.select("b").schema), "sweep-gone"))
            break
        first = live.join(live.select(F.col("b").alias("a")), "a", "left_anti")
        out = cut(first.select("b").distinct(), "sweep-gone")
        gone.append(out)
        held = live.join(first.select("a").distinct(), "a", "left_anti")
        live = cut(held.join(out.select(F.col("b").alias("a")), "a", "left_anti").join(out, "b", "left_anti").select("a", "b"), "sweep")
    kept = items.select(key)
    return kept.join(reduce(DataFrame.unionByName, gone).withColumnRenamed("b", key), key, "left_anti") if gone else kept
