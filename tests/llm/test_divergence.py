"""Divergence of sources against counting by hand, and the tournament's rounds."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import divergence as D
from tests.compare import differences

SCHEMA = "doc_id long, text string, lang string, source string, item string, value long, term string, n long, slice int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, g, s, "mine", 1, "mine", 1, 0) for i, (t, g, s) in enumerate(rows)], SCHEMA)


def terms(text):
    out, now = [], ""
    for c in text + " ":
        if c >= "\x80" or "a" <= c <= "z" or "A" <= c <= "Z":
            now += chr(ord(c) + 32) if "A" <= c <= "Z" else c
        elif now:
            out.append(now)
            now = ""
    return out


def brute(rows, least, top=50):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, whole, by = Counter(), Counter(), defaultdict(Counter)
        for text, g, source in rows:
            if g == lang:
                by[source].update(terms(text))
                whole.update(terms(text))
                docs.update(set(terms(text)))
        kept = [t for t, n in docs.items() if n >= least]
        v = len(kept)

        def p(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * v) for t in kept}

        q, ps = p(whole), {s: p(c) for s, c in by.items()}
        for s in by:
            pairs = [(o, sum(abs(ps[s][t] - ps[o][t]) for t in kept)) for o in by if o != s]
            named = [(t, ps[s][t] - q[t]) for t in kept if by[s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", named)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, f, k + 1) for k, (i, f) in enumerate(items[: top if part == "term" else None])]
    return sorted(out)


def sample(seed=4):
    rng = random.Random(seed)
    words = ["The", "the", "été", "ÉTÉ", "straße", "a1b", "don't", "北京", "x", "it's_me", "zz", "İx", " "] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = []
    for lang, sources in (("en", 13), ("de", 2), ("fr", 1), (None, 5)):
        for s in range(sources):
            own = rng.sample(words, 15)
            rows += [(" ".join(rng.choice(own) for _ in range(rng.randint(0, 25))), lang, f"src{s}") for _ in range(rng.randint(1, 9))]
    rows += [(None, "en", "mute"), ("1 2 3", "en", None), ("", "es", "lone"), (None, "es", "second"), ("only once", "pt", "a"), ("x" * 200_000, "en", "src1"), ("the " * 30_000, "en", "src2")]
    return rows + rows[:9]


@pytest.mark.parametrize(("slice_terms", "block_groups", "top"), [(1 << 16, 8, 50), (3, 2, 4), (7, 3, 50), (1, 1, 2)])
def test_divergence_equals_counting_by_hand(spark, slice_terms, block_groups, top):
    rows = sample()
    got = D.divergence(table(spark, rows).repartition(5), least_documents=3, top=top, slice_terms=slice_terms, block_groups=block_groups)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 3, top)


def test_empty_table_and_early_emptying(spark):
    assert D.divergence(table(spark, [])).count() == 0
    rows = sample(9)
    got = D.counted(table(spark, rows).coalesce(1), "text", room=4)
    assert got.count() > 100
    whole = {(r.source, r.term): (r.n, r.docs) for r in got.filter("lang = 'en'").groupBy("source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).collect()}
    assert whole[("src2", "the")] == (sum(terms(t).count("the") for t, g, s in rows if t and g == "en" and s == "src2"), sum("the" in terms(t) for t, g, s in rows if t and g == "en" and s == "src2"))


def test_every_pair_of_blocks_meets_once(spark):
    for blocks in range(1, 12):
        met = Counter()
        for turn in range(13):
            df = spark.range(blocks).select(F.col("id").alias("b"), D._opponent(F.col("id").cast("int"), F.lit(blocks), turn).alias("m"))
            pairs = {r.b: r.m for r in df.collect()}
            assert all(pairs[m] == b for b, m in pairs.items())
            met.update((b, m) for b, m in pairs.items() if b < m)
        assert met == Counter({(a, b): 1 for a in range(blocks) for b in range(a + 1, blocks)})


def test_rates_are_exact_beyond_64_bits():
    counts = np.array([0, 1, 10**10, 10**13], np.int64)
    n, v = int(counts.sum()), 7
    assert D.rates(counts, n, v).tolist() == [1 + 10**9 * (int(c) + 5) // (n + 5 * v) for c in counts]


def test_blocks_stay_and_only_peers_move(spark, monkeypatch):
    """The join of a round has an exchange on the travelling side alone."""
    plans = []
    kept = D._meetings

    def seen(rows, both):
        if both:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return kept(rows, both)

    monkeypatch.setattr(D, "_meetings", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        D.divergence(table(spark, sample()), least_documents=3, block_groups=3).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(plans) == 5 and all(p.count("Exchange hashpartitioning") == 1 for p in plans)


def test_query_equals_its_sql(spark):
    from palimpsest.llm import registry

    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert differences(registry.QUERIES["op12_systolic_divergence"](spark, sf_dir), registry.ORACLES["op12_systolic_divergence"], sf_dir) == ""
