"""Order-dependent operators: unit windows, running sums, budgets, retention, sampling, boundaries."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cumulative(df: DataFrame, by: Sequence[str], order: Sequence, value: str, name: str) -> DataFrame:
    over = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(value).over(over))


def clean_units(sessions: DataFrame, by: Sequence[str], order: Sequence, is_clean: Column, interval: int) -> DataFrame:
    """unit: every interval-th clean session closes one; noise belongs to the unit that follows it.

    The trailing unit that no clean session closes is dropped.
    """
    clean = is_clean.cast("long")
    if not by:
        from palimpsest.operators.ranking import running

        whole = sessions.agg(F.sum(clean)).first()[0] or 0
        marked = running(sessions, order, clean, "_clean")
        return marked.withColumn("unit", F.floor((F.col("_clean") - clean) / interval)).filter(F.col("unit") < whole // interval).drop("_clean")
    spec = Window.partitionBy(*by)
    upto = spec.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = sessions.withColumn("_clean", F.sum(clean).over(upto)).withColumn("_all", F.sum(clean).over(spec))
    unit = F.floor((F.col("_clean") - clean) / interval)
    return marked.withColumn("unit", unit).filter(F.col("unit") < F.floor(F.col("_all") / interval)).drop("_clean", "_all")


def units_with_queries(units: DataFrame, by: Sequence[str], checkpoints: DataFrame) -> DataFrame:
    """Units whose checkpoint (by, unit) has queries, numbered anew from 0."""
    kept = units.join(checkpoints.select(*by, "unit").distinct(), [*by, "unit"], "left_semi")
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return kept.withColumn("unit_id", F.dense_rank().over(spec.orderBy("unit")) - 1)


def timestamps(df: DataFrame, by: Sequence[str], order: Sequence, base: Column, offset_ms: int) -> DataFrame:
    """The k-th row of a group gets base + k * offset."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1
    return df.withColumn("sequence", k).withColumn("stamp", base + F.make_interval(secs=k * (offset_ms / 1000.0)))


def pack_to_budget(ranked: DataFrame, by: Sequence[str], rank: str, tokens: str, budget: int, overhead: int = 0, least: int = 100) -> DataFrame:
    """Ranked rows while their running tokens fit; the first that does not is cut if over `least` tokens are left; then stop."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = spec.orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.col(tokens) + overhead).over(upto)
    before = total - F.col(tokens) - overhead
    rows = ranked.withColumn("_total", total).withColumn("_left", F.lit(budget) - before)
    first_over = F.min(F.when(F.col("_total") > budget, F.col(rank))).over(spec)
    rows = rows.withColumn("_first", first_over)
    whole, cut = F.col("_total") <= budget, (F.col(rank) == F.col("_first")) & (F.col("_left") - overhead > least)
    kept = rows.filter(whole | cut)
    return kept.withColumn("kept_tokens", F.when(F.col("_total") <= budget, F.col(tokens)).otherwise(F.col("_left") - overhead)).withColumn("is_cut", F.col("_total") > budget).drop("_total", "_left", "_first")


def fit_blocks(blocks: DataFrame, by: str, order: Sequence[str], tokens: str, budget: int) -> DataFrame:
    """Whole blocks or none: a later, smaller block may still fit.  A fold in the row, as each choice depends on the last."""
    entry = F.struct(*order, F.col(tokens).cast("long").alias("_n"))
    rows = blocks.groupBy(by).agg(F.array_sort(F.collect_list(entry)).alias("_bs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(acc, x):
        i = x["i"]
        fits = acc["used"] + x["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], F.array(i))).otherwise(acc["kept"]).alias("kept"))

    numbered = F.transform("_bs", lambda b, i: F.struct(i.alias("i"), b["_n"].alias("n")))
    folded = rows.withColumn("_f", F.aggregate(numbered, zero, step))
    return folded.select(by, F.explode("_f.kept").alias("_i"), "_bs", F.col("_f.used").alias("used")).select(by, F.get("_bs", F.col("_i")).alias("b"), "used").select(by, "b.*", "used").withColumnRenamed("_n", tokens)


def evict_oldest(rows: DataFrame, by: Sequence[str], order: str, tokens: str, limit: int) -> DataFrame:
    """The newest rows whose tokens fit the limit; where not even the newest does, it keeps its tail."""
    spec = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    back = spec.orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    got = rows.withColumn("_back", F.sum(tokens).over(back)).withColumn("_newest", F.row_number().over(spec.orderBy(F.desc(order))))
    kept = got.filter((F.col("_back") <= limit) | (F.col("_newest") == 1))
    return kept.withColumn("kept_tokens", F.least(F.col(tokens), F.lit(limit))).drop("_back", "_newest")


def latest_per_group(df: DataFrame, by: Sequence[str], order: Sequence, n: int, trigger: float = 0.0) -> DataFrame:
    """The first n rows of each group by order; a group under trigger * n rows is left alone anyway."""
    spec = Window.partitionBy(*by)
    rows = df.withColumn("_place", F.row_number().over(spec.orderBy(*order))).withColumn("_size", F.count("*").over(spec))
    return rows.filter((F.col("_place") <= n) | (F.col("_size") < trigger * n)).drop("_place", "_size")


def even_indices(n: Column, limit: int) -> Column:
    """At most limit places of 0..n-1, evenly spread: floor(i (n - 1) / (limit - 1))."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (n - 1) / (limit - 1)).cast("int"))
    return F.when(n <= limit, F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))).otherwise(spread)


def boundaries(turns: DataFrame, by: str, order: str, vec: str, coarse: Sequence[int] = (), start: float = 0.2, stop: float = 0.5, step: float = 0.05, reach: int = 3) -> DataFrame:
    """Turns where similarity to the one before is under the least threshold (raised from start by step) that cuts anywhere.

    A cut within `reach` of a coarse cut moves there.
    """
    from palimpsest.functions.vectors import cosine

    spec = Window.partitionBy(by).orderBy(order)
    sim = turns.withColumn("similarity", cosine(F.col(vec), F.lag(vec).over(spec)))
    least = F.min("similarity").over(Window.partitionBy(by))
    steps = F.greatest(F.ceil((least - start) / step + 1e-9), F.lit(0))
    threshold = F.lit(start) + steps * step
    threshold = F.when(F.round(threshold, 9) <= stop + 1e-9, threshold)
    cuts = sim.withColumn("threshold", F.round(threshold, 6)).filter(F.col("similarity") < F.col("threshold"))
    place = F.col(order)
    for c in coarse:
        place = F.when(F.abs(F.col(order) - c) <= reach, F.lit(c)).otherwise(place)
    return cuts.select(by, place.alias("cut"), "threshold").distinct()


def segments(turns: DataFrame, by: str, order: str, cuts: DataFrame) -> DataFrame:
    """A segment number: how many cuts lie at or before a turn."""
    marked = turns.join(cuts.select(by, F.col("cut").alias(order), F.lit(1).alias("_cut")), [by, order], "left")
    return marked.withColumn("segment", F.coalesce(F.sum("_cut").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("_cut")


def chunked(df: DataFrame, key: str, tokens: Column, size: int, overlap: int) -> DataFrame:
    """(key, chunk, start, n_tokens, chunk_text) of token windows that overlap; the last ends at the text's end."""
    from palimpsest.functions.text import chunk_starts

    rows = df.select(key, tokens.alias("_t")).withColumn("_s", chunk_starts(F.size("_t"), size, overlap))
    got = rows.select(key, "_t", F.posexplode("_s").alias("chunk", "start"))
    part = F.slice("_t", (F.col("start") + 1).cast("int"), F.lit(size))
    return got.select(key, "chunk", "start", part.alias("_p")).select(key, "chunk", "start", F.size("_p").alias("n_tokens"), F.array_join("_p", " ").alias("chunk_text"))


def chat_windows(turns: DataFrame, by: str, order: str, tokens: str, most: int, overlap: int) -> DataFrame:
    """Sliding windows of turns: full at `most` tokens, then the head leaves while more than `overlap` remain.  A fold per chat."""
    import pandas as pd

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        out, held, window, mass = [], deque(), 0, 0
        for place, n in zip(pdf[order], pdf[tokens], strict=True):
            held.append((place, n))
            mass += n
            if mass > most:
                out += [(pdf[by].iloc[0], window, p) for p, _ in held]
                window += 1
                while held and mass > overlap:
                    mass -= held.popleft()[1]
        out += [(pdf[by].iloc[0], window, p) for p, _ in held]
        return pd.DataFrame(out, columns=[by, "window", order])

    return turns.select(by, order, tokens).groupBy(by).applyInPandas(fold, f"{by} long, window int, {order} long")
