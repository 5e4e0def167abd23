"""Selectors, sweeps and balanced parts over several blocks, prefixes and tasks give what one task gives."""

import random

import numpy as np
from pyspark.sql import functions as F

from palimpsest.operators import aggregates, selection, sets


def vectors(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.normal(size=3)
        rows.append((i % 3 if i % 10 else None, i, float(rng.integers(0, 40)) / 40, (v + (i % 4) * 2).tolist(), f"memory {i % 30}", "turn" if i % 3 else "claim", i % 7, [i + 3, i - 9]))
    return spark.createDataFrame(rows, "g int, k int, score double, vec array<double>, text string, kind string, source int, related array<int>")


def rows(df):
    return sorted((str(r.g), r.place, r.k) for r in df.collect())


def test_prefixes_of_any_size_give_the_same_picks(spark):
    df = vectors(spark)
    dedupe = lambda m: rows(selection.mmr_dedupe(df, "g", "k", "score", "vec", "text", 9, prefix=m))
    state = lambda m: rows(selection.state_mmr(df, "g", "k", "score", "vec", 7, prefix=m))
    assert dedupe(2) == dedupe(11) == dedupe(1000) and state(2) == state(9) == state(1000)
    assert len({g for g, *_ in state(5)}) == 4  # a null group is a group
    assert selection.mmr_dedupe(df.limit(0), "g", "k", "score", "vec", "text", 9).count() == 0


def test_sweep_in_rounds_and_in_one_task(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(90)} | {(100 + i, 101 + i) for i in range(40)}
    df = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "a int, b int, similarity double")
    items = spark.range(150).select(F.col("id").cast("int").alias("id"))
    gone = set()
    for a, b in sorted(pairs):
        if a not in gone:
            gone.add(b)
    want = [i for i in range(150) if i not in gone]
    for few in (1_000_000, 60):
        assert sorted(r.id for r in sets.greedy_near_duplicates(df, items, "id", 0.5, few).collect()) == want


def test_balance_over_several_tasks(spark):
    rng = random.Random(5)
    data = [("a" if i % 3 else None, i, rng.choice([1, 2, 7, 40, 300])) for i in range(900)]
    df = spark.createDataFrame(data, "g string, k int, n int")
    for method in ("greedy", "differencing"):
        for size in (100_000, 100):
            got = aggregates.balance(df, "g", "k", "n", 4, method, size).collect()
            assert sorted((str(r.g), r.k) for r in got) == sorted((str(g), k) for g, k, _ in data)
            for g in ("a", None):
                sums = [sum(r.n for r in got if r.g == g and r.part == p) for p in range(4)]
                assert max(sums) - min(sums) <= 300 and min(sums) > 0
            if size == 100 and method == "differencing":
                one = aggregates.balance(df, "g", "k", "n", 4, "greedy").filter("g = 'a'").groupBy("part").agg(F.sum("n").alias("n")).agg((F.max("n") - F.min("n")).alias("d")).first().d
                many = [sum(r.n for r in got if r.g == "a" and r.part == p) for p in range(4)]
                assert max(many) - min(many) <= max(one, 2)
