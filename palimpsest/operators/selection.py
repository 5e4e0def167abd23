"""Sequential selectors per group: greedy diversity, MMR variants, over groups of any size.

Picks follow one another, but few rows decide them.  greedy_diverse takes a group's next rows in order, block by block, and drops
what is too similar to the block's picks from the rest, which is spread over tasks.  The MMR variants fold the most relevant rows
of a group; what lies beyond can be picked only if its relevance allows it, so a fold that sees that no such row can win is
exact, and any other group is folded again with more rows.  A task holds a block, or a prefix, and vectors of picks; no
matrix of all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.operators.tables import cut


def unit(rows) -> np.ndarray:
    v = np.array([np.asarray(x, float) for x in rows])
    n = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(n == 0, 1, n)


#: Rows of a group that a task folds at once; the prefix of an open group grows by GROWTH.
BLOCK, PREFIX, GROWTH = 2048, 4096, 8
#: Rows of a group that are compared with a block's picks in one task.
SPREAD = 50_000


def _schema(df: DataFrame, group: str, key: str, extra: str = "") -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return f"{group} {kinds[group]}, {key} {kinds[key]}, place int{extra}"


def _same(left: DataFrame, right: DataFrame, group: str):
    return left[group].eqNullSafe(right[f"_{group}"])


def _named(df: DataFrame, group: str) -> DataFrame:
    return df.withColumnRenamed(group, f"_{group}")


def greedy_diverse(df: DataFrame, group: str, key: str, score: str, vec: str, bar: float, cap: int | None = None, block: int = BLOCK) -> DataFrame:
    """By score, then smaller key: accept what is at most `bar` similar to all accepted, up to cap.

    Rounds: as many as the blocks that a group's rows still fill after those too similar to earlier picks have gone.
    """
    kind = df.schema[vec].dataType.simpleString()
    schema = _schema(df, group, key, f", {vec} {kind}")
    order = [F.desc(score), F.asc(key)]
    rest, picks = cut(df.select(group, key, score, vec), "diverse-rest"), []
    first = Window.partitionBy(group).orderBy(*order)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        before = int(pdf["_before"].iloc[0])
        v = unit(pdf[vec])
        taken: list[int] = []
        for i in range(len(pdf)):
            if cap is not None and before + len(taken) >= cap:
                break
            if not taken or (v[taken] @ v[i]).max() <= bar:
                taken.append(i)
        return pd.DataFrame({group: pdf[group].iloc[taken], key: pdf[key].iloc[taken], "place": range(before + 1, before + len(taken) + 1), vec: pdf[vec].iloc[taken]})

    def apart(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(chosen):
            v, near = unit(chosen[vec]), np.zeros(len(rows), bool)
            for at in range(0, len(rows), BLOCK):
                near[at : at + BLOCK] = (unit(rows[vec].iloc[at : at + BLOCK]) @ v.T).max(1) > bar
            rows = rows[~near]
        return rows[[group, key, score, vec]]

    while not rest.isEmpty():
        if picks:
            so_far = reduce(DataFrame.unionByName, picks).groupBy(group).agg(F.count("*").cast("int").alias("_before"))
            so_far = _named(so_far, group)
            now = rest.join(so_far, _same(rest, so_far, group), "left").drop(f"_{group}").na.fill(0, ["_before"])
        else:
            now = rest.withColumn("_before", F.lit(0))
        head = cut(now.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= block), "diverse-block")
        picked = cut(head.groupBy(group).applyInPandas(fold, schema), "diverse-picks")
        picks.append(picked)
        # What comes after the block, in groups that want more, is compared with the block's picks.
        ends = _named(head.filter(F.col("_r") == block).select(group, F.struct((-F.col(score)).alias("s"), key).alias("_end")), group)
        later = rest.join(ends, _same(rest, ends, group)).filter(F.struct((-F.col(score)).alias("s"), F.col(key)) > F.col("_end")).drop(f"_{group}", "_end")
        if cap is not None:
            full = _named(reduce(DataFrame.unionByName, picks).groupBy(group).agg(F.count("*").alias("n")).filter(F.col("n") >= cap).select(group), group)
            later = later.join(full, _same(later, full, group), "left_anti")
        later = cut(later, "diverse-later")
        salts = max(1, -(-later.count() // SPREAD))
        of = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
        left = later.withColumn("_salt", of).groupBy(group, "_salt")
        right = picked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy(group, "_salt")
        rest = cut(left.cogroup(right).applyInPandas(apart, later.schema), "diverse-rest")
    if not picks:
        return df.sparkSession.createDataFrame([], _schema(df, group, key))
    return reduce(DataFrame.unionByName, picks).select(group, key, "place")


def _by_prefix(df: DataFrame, group: str, key: str, order: list, fold: Callable[[pd.DataFrame, bool], list[int] | None], prefix: int) -> DataFrame:
    """group, key, place of what fold picks; it gets a group's first rows by order and whether they are all, and gives None if it needs more."""
    schema, done = _schema(df, group, key, ", _open boolean"), []
    total = _named(df.groupBy(group).agg(F.count("*").alias("_total")), group)
    todo = cut(df.join(total, _same(df, total, group)).drop(f"_{group}"), "prefix-rows")
    while True:

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            whole = len(pdf) == pdf["_total"].iloc[0]
            pdf = pdf.sort_values("_r").reset_index(drop=True)
            taken = fold(pdf, whole)
            if taken is None:
                return pd.DataFrame({group: pdf[group].iloc[:1], key: pdf[key].iloc[:1], "place": [0], "_open": [True]})
            return pd.DataFrame({group: pdf[group].iloc[taken], key: pdf[key].iloc[taken], "place": range(1, len(taken) + 1), "_open": False})

        head = todo.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_r") <= prefix)
        out = cut(head.groupBy(group).applyInPandas(run, schema), "prefix-picks")
        done.append(out.filter("not _open").drop("_open"))
        again = _named(out.filter("_open").select(group), group)
        if again.isEmpty():
            return reduce(DataFrame.unionByName, done)
        todo, prefix = cut(todo.join(again, _same(todo, again, group), "left_semi"), "prefix-rows"), prefix * GROWTH


def _bigrams(s: str) -> set[str]:
    return {s[i : i + 2] for i in range(len(s) - 1)}


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a | b else 0.0


def _dice(a: str, b: str) -> float:
    x, y = set(a), set(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def _tf_cosine(a: str, b: str) -> float:
    x, y = a.split(), b.split()
    words = set(x) | set(y)
    p, q = [x.count(w) for w in words], [y.count(w) for w in words]
    n = math.sqrt(sum(i * i for i in p)) * math.sqrt(sum(i * i for i in q))
    return sum(i * j for i, j in zip(p, q, strict=True)) / n if n else 0.0


def highly_similar(a: str, b: str, bar: float = 0.92) -> bool:
    return 0.40 * _dice(a, b) + 0.25 * _jaccard(_bigrams(a), _bigrams(b)) + 0.35 * _tf_cosine(a, b) > bar


def mmr_dedupe(df: DataFrame, group: str, key: str, score: str, vec: str, text: str, k: int, prefill: int = 2, trade: float = 0.8, gate: float = 0.9, steep: float = 10.0, prefix: int = PREFIX) -> DataFrame:
    """The best `prefill` first, then by trade * relevance - (1 - trade) * penalty, where similarity over the gate is
    punished exponentially; equal texts, and near-equal ones to the most similar chosen item, are skipped; sorted by relevance."""

    def fold(pdf: pd.DataFrame, whole: bool) -> list[int] | None:
        v, rel, texts, keys = unit(pdf[vec]), pdf[score].to_numpy(float), pdf[text].tolist(), pdf[key].tolist()
        most, nearest = np.full(len(pdf), -np.inf), np.zeros(len(pdf), int)
        chosen: set = set()
        beyond = trade * rel[-1] + (1 - trade)  # the most that a row beyond the prefix is worth
        taken: list[int] = []

        def blocked(i: int) -> bool:
            return texts[i] in chosen or bool(taken) and most[i] > gate and highly_similar(texts[i], texts[nearest[i]])

        rest = list(range(len(pdf)))
        while len(taken) < k:
            rest = [i for i in rest if not blocked(i)]
            if not rest:
                if not whole:
                    return None
                break
            if len(taken) < prefill:
                best = rest[0]
            else:
                at = np.array(rest)
                m = most[at]
                values = trade * rel[at] - (1 - trade) * np.where(m > gate, m * np.exp(steep * (m - gate)), m)
                best = rest[int(values.argmax())]
                if not whole and values.max() < beyond:
                    return None
            taken.append(best)
            rest.remove(best)
            chosen.add(texts[best])
            own = v @ v[best]
            nearest = np.where(own > most, best, nearest)
            most = np.maximum(own, most)
        return sorted(taken, key=lambda i: (-rel[i], keys[i]))

    return _by_prefix(df.select(group, key, score, vec, text), group, key, [F.desc(score), F.asc(key)], fold, prefix)


def state_mmr(df: DataFrame, group: str, key: str, score: str, vec: str, k: int, trade: float = 0.7, prefix: int = PREFIX) -> DataFrame:
    """trade * relevance - (1 - trade) * the largest similarity to a chosen one; relevance is the score, min-max normalised in the
    group.  From the second pick on +0.05 if related to a chosen one, +0.02 if the kind differs from the last one's, +0.02 for a
    new source; the first pick is no turn where that is possible; ties go to the larger key.

    df: kind, source and related (array of keys; a relation holds both ways) besides.
    """

    def fold(pdf: pd.DataFrame, whole: bool) -> list[int] | None:
        v = unit(pdf[vec])
        rel, kinds, sources, keys = pdf[score].to_numpy(float), pdf["kind"].tolist(), pdf["source"].tolist(), pdf[key].tolist()
        low, high = pdf["_low"].iloc[0], pdf["_high"].iloc[0]
        rel = (rel - low) / (high - low) if high > low else np.ones(len(rel))
        beyond = trade * rel[-1] + (1 - trade) + 0.09  # the most that a row beyond the prefix is worth
        near: dict = {x: set() for x in keys}
        for x, others in zip(keys, pdf["related"], strict=True):
            for y in others if others is not None else ():
                near[x].add(y)
                near.setdefault(y, set()).add(x)
        taken: list[int] = []
        rest, most = list(range(len(pdf))), np.full(len(pdf), 0.0)
        while len(taken) < k:
            if not rest and whole:
                break
            choices = [i for i in rest if kinds[i] != "turn"] if not taken else rest
            if not choices and not whole:
                return None
            chosen, seen = {keys[i] for i in taken}, {sources[i] for i in taken}

            def value(i: int) -> float:
                out = trade * rel[i] - (1 - trade) * most[i]
                if taken:
                    out += 0.05 * bool(near[keys[i]] & chosen) + 0.02 * (kinds[i] != kinds[taken[-1]]) + 0.02 * (sources[i] not in seen)
                return round(out, 12)

            best = max(choices or rest, key=lambda i: (value(i), keys[i]))
            if taken and not whole and value(best) <= beyond:
                return None
            taken.append(best)
            rest.remove(best)
            own = v @ v[best]
            most = own if len(taken) == 1 else np.maximum(most, own)
        return taken

    ends = _named(df.groupBy(group).agg(F.min(score).cast("double").alias("_low"), F.max(score).cast("double").alias("_high")), group)
    rows = df.select(group, key, score, vec, "kind", "source", "related")
    rows = rows.join(ends, _same(rows, ends, group)).drop(f"_{group}")
    return _by_prefix(rows, group, key, [F.desc(score), F.desc(key)], fold, prefix)


def epsilon_greedy(df: DataFrame, value: str, similarity: str, key: str, k: int, epsilon: float = 0.0, least: float | None = None, seed: int = 7) -> DataFrame:
    """The k best by (value, similarity); a share epsilon of the places is drawn at random by a seeded hash."""
    rows = df if least is None else df.filter(F.col(value) >= least)
    explore = int(k * epsilon)
    best = rows.orderBy(F.desc(value), F.desc(similarity), key).limit(k - explore)
    if not explore:
        return best
    others = rows.join(best.select(key), key, "left_anti").orderBy(F.xxhash64(key, F.lit(seed)), key).limit(explore)
    return best.unionByName(others.select(*best.columns))
