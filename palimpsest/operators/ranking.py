"""Ranked lists: total orders, top-k, fusion, normalisation, diversification helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """A rank from 1 in each group; `order` must be a total order, or ties fall by chance."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return df.withColumn(name, F.row_number().over(spec.orderBy(*order)))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], k: int, name: str = "rank") -> DataFrame:
    """The first k rows of each group.  Without a group it is a bounded sort, not a window over one task."""
    if k <= 0:
        return df.limit(0).withColumn(name, F.lit(0))
    if not by:
        return ranked(df.orderBy(*order).limit(k), by, order, name)
    return ranked(df, by, order, name).filter(F.col(name) <= k)


def with_threshold(df: DataFrame, score: str, least: float) -> DataFrame:
    """score >= least; a threshold of 0 or less keeps everything, a missing or odd score counts as 1."""
    if least <= 0:
        return df
    return df.filter(F.coalesce(F.col(score).try_cast("double"), F.lit(1.0)) >= least)


def reciprocal_rank_fusion(channels: Mapping[str, tuple[DataFrame, float]], by: Sequence[str], item: str, k: int = 60) -> DataFrame:
    """Sum of weight / (k + rank) over ranked channels (by, item, rank[, dense_score]); keeps the best dense score."""
    parts = []
    for name, (df, weight) in channels.items():
        dense = F.col("dense_score") if "dense_score" in df.columns else F.lit(0.0)
        parts.append(df.select(*by, item, F.lit(name).alias("channel"), (F.lit(float(weight)) / (k + F.col("rank"))).alias("part"), dense.alias("dense_score")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy(*by, item).agg(F.sum("part").alias("rrf"), F.max("dense_score").alias("dense_score"), F.count("*").alias("n_channels"))


def interleave(channels: Sequence[DataFrame], by: Sequence[str], item: str, k: int) -> DataFrame:
    """Round robin over ranked channels: by depth, then channel; an item's first place counts."""
    every = reduce(DataFrame.unionByName, [df.select(*by, item, "rank", F.lit(i).alias("channel")) for i, df in enumerate(channels)])
    first = every.groupBy(*by, item).agg(F.min(F.struct("rank", "channel")).alias("place"))
    return top_k(first.select(*by, item, "place.rank", "place.channel").withColumnRenamed("rank", "depth"), by, ["depth", "channel", item], k)


def min_max(value: Column, by: Sequence[str]) -> Column:
    """To [0, 1] within the group; a constant group is all 1."""
    over = Window.partitionBy(*by)
    low, high = F.min(value).over(over), F.max(value).over(over)
    return F.when(high <= low, F.lit(1.0)).otherwise((value - low) / (high - low))


def dedupe_max(df: DataFrame, key: Sequence[str], score: str, tie: str) -> DataFrame:
    """One row for each key: the best score, then the smaller tie."""
    return ranked(df, key, [F.desc(score), tie], "_place").filter("_place = 1").drop("_place")


def last_writer(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key: the first by order."""
    return ranked(df, key, order, "_place").filter("_place = 1").drop("_place")


def running(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The running sum of value over the whole table by a total order, without one task seeing all rows.

    Rows are range-partitioned and stored; sums inside a part run as windows, the parts' totals (a row each) are added up.
    """
    from palimpsest.operators.tables import cut

    ranged = df.withColumn(name, value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = cut(ranged, "running")
    totals = ranged.groupBy("_part").agg(F.sum(name).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("_part", before.alias("_before"))
    inside = F.sum(name).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("_inside", inside).join(offsets, "_part").withColumn(name, F.col("_inside") + F.col("_before")).drop("_part", "_inside", "_before")
