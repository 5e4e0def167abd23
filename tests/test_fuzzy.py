"""Bit-parallel distances and ratios, partial-ratio search and closest texts, against plain tables."""

import random
import uuid

import pytest
from pyspark import cloudpickle

from palimpsest.functions import edits
from palimpsest.operators import fuzzy


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] + 1 if x == y else max(before[j], row[-1]))
    return row[-1]


def plain_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b else 0.0

    def one(p, t):
        windows = {t[i : i + len(p)] for i in range(len(t) - len(p) + 1)} | {t[:k] for k in range(1, len(p))} | {t[-k:] for k in range(1, len(p))}
        return max(200 * plain_common(p, w) / (len(p) + len(w)) for w in windows)

    return max([one(a, b)] * (len(a) <= len(b)) + [one(b, a)] * (len(b) <= len(a)))


def texts(rng, n, sizes):
    return ["".join(rng.choice("abcdé😀") for _ in range(rng.choice(sizes))) for _ in range(n)]


def test_bits_equal_tables(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(edits, "WINDOWS", 700)
    for a in texts(rng, 120, [0, 1, 3, 8, 20, 64, 65, 130]):
        others = texts(rng, 4, [0, 1, 3, 8, 30, 64, 70])
        assert edits.distances(a, others).tolist() == [plain_distance(a, b) for b in others]
        ratio = edits.Partial(a)
        if len(a) < 65:
            several = [b for b in others if len(a) * len(b) < 2500]
            assert ratio.many(several * 2).tolist() == [ratio(b) for b in several * 2]
        for b in others:
            if len(a) * len(b) < 2500:
                assert ratio(b) == pytest.approx(plain_ratio(a, b)), (a, b)
    assert edits.Partial("brass")("economy polished bras") > 80 and edits.Partial("x" * 50)("y" * 3000) == 0


def test_partial_ratio_lists(spark):
    rng = random.Random(2)
    rows = list(enumerate(["Economy Brass", "BRASS", "brasserie", "", None, *texts(rng, 60, [2, 5, 30])])) + [(None, "brass"), (1, "brass")]
    q = [(1, "brass"), (2, "ECONOMY  brass"), (3, ""), (4, None), (5, "abcdé")]
    df, asked = spark.createDataFrame(rows, "id int, t string"), spark.createDataFrame(q, "query int, question string")
    want = []
    for n, s in q:
        if s is not None:
            scored = sorted((-round(plain_ratio(s.lower(), t.lower()), 6), i) for i, t in rows if t is not None and i is not None)[:4]
            want += [(n, i, -x) for x, i in scored]
    for chars in (1 << 20, 10):
        got = fuzzy.partial_ratio_top_k(df.repartition(3), "id", "t", asked, 4, chars).orderBy("query", "rank").collect()
        assert [(r["query"], r["id"], r["score"]) for r in got] == want
    assert fuzzy.partial_ratio_top_k(df.limit(0), "id", "t", asked, 4).count() == 0


def test_equal_texts_are_aligned_once(spark, tmp_path, monkeypatch):
    df = spark.range(400).selectExpr("id", "concat('Text ', id % 4) AS t").repartition(8)
    asked = spark.createDataFrame([(1, "text 2 of")], "query int, question string")
    many = edits.Partial.many

    def seen(self, texts):
        with open(tmp_path / str(uuid.uuid4()), "w") as f:
            f.write("\n".join(texts))
        return many(self, texts)

    monkeypatch.setattr(edits.Partial, "many", seen)
    cloudpickle.register_pickle_by_value(edits)  # so that the tasks count, too
    cloudpickle.register_pickle_by_value(fuzzy)
    try:
        got = fuzzy.partial_ratio_top_k(df, "id", "t", asked, 3).collect()
    finally:
        cloudpickle.unregister_pickle_by_value(edits)
        cloudpickle.unregister_pickle_by_value(fuzzy)
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [2, 6, 10]
    aligned = [t for f in tmp_path.iterdir() for t in f.read_text().split("\n")]
    assert sorted(aligned) == [f"text {i}" for i in range(4)]


def test_within_and_closest_equal_every_pair(spark):
    rng = random.Random(3)
    some = {*texts(rng, 70, [0, 1, 2, 3, 4, 6, 9, 14]), "a long text of its own, far from all others", "aaaa", "aaab"}
    some |= {t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in list(some)[:15]}
    items, candidates = sorted(some)[::2], sorted(some)[1::3] + sorted(some)[::4]
    i = spark.createDataFrame([(t,) for t in items], "item string")
    c = spark.createDataFrame([(t,) for t in set(candidates)], "candidate string")
    d = {(a, b): plain_distance(a, b) for a in items for b in set(candidates) if a != b}
    for most in (1, 2, 3, 5):
        got = [tuple(r) for r in fuzzy.within(i, c, most).collect()]
        assert sorted(got) == sorted((a, b, x) for (a, b), x in d.items() if x <= most)
    least = {a: min(x for (s, _), x in d.items() if s == a) for a in items}
    assert sorted(tuple(r) for r in fuzzy.closest_texts(i, c).collect()) == sorted((a, b, x) for (a, b), x in d.items() if x == least[a])
    assert fuzzy.closest_texts(i.limit(0), c).count() == 0
