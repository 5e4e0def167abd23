"""Retrievers, embedders, registries and text metrics against plain restatements."""

import math
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import metrics as m
from palimpsest.operators import lexical, retrievers


def common(p, g):
    if not p or not g:
        return 0
    return common(p[1:], g[1:]) + 1 if p[0] == g[0] else max(common(p[1:], g), common(p, g[1:]))


def grams(words, n):
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def overlap(a, b):
    return sum(min(a.count(x), b.count(x)) for x in set(a))


def bleu(p, g, n=4):
    if not p:
        return 0.0
    logs = sum(math.log(max(overlap(grams(p, k), grams(g, k)), 0.1) / max(len(grams(p, k)), 1)) / n for k in range(1, n + 1))
    return math.exp(logs) * (1.0 if len(p) >= len(g) else math.exp(1 - len(g) / len(p)))


def test_rouge_and_bleu_restated(spark):
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("abc") for _ in range(rng.randint(0, 7))), " ".join(rng.choice("abc") for _ in range(rng.randint(0, 7)))) for _ in range(60)]
    got = spark.createDataFrame(rows, "p string, g string").select("p", "g", m.rouge_l(F.col("p"), F.col("g")), m.rouge_n(F.col("p"), F.col("g"), 2), m.bleu(F.col("p"), F.col("g"))).collect()
    for p, g, long, two, b in got:
        x, y = p.split(), g.split()
        assert long == pytest.approx(2 * common(x, y) / (len(x) + len(y)) if x or y else 0.0)
        both = len(grams(x, 2)) + len(grams(y, 2))
        assert two == pytest.approx(2 * overlap(grams(x, 2), grams(y, 2)) / both if both else 0.0)
        assert b == pytest.approx(bleu(x, y))


def test_meteor_by_hand(spark):
    rows = [("the cat sat", "the cat sat"), ("cats sat", "the cat sat"), ("a b", "b a"), ("x", "y"), ("", "y"), (None, None), ("the a the", "the")]
    want = [1 - 0.5 / 27, (1 - 0.5 / 8) * (2 / 3) / (0.9 + 0.1 * 2 / 3), 0.5, 0.0, 0.0, 0.0, 0.5 * (1 / 3) / (0.3 + 0.1)]
    got = spark.createDataFrame(rows, "p string, g string").select(m.meteor(F.col("p"), F.col("g"))).collect()
    assert [r[0] for r in got] == pytest.approx(want)


def test_growing_index_takes_every_row_once(spark, tmp_path):
    rows = [(1, "red bolt"), (2, "blue bolt bolt"), (3, "gear"), (4, None), (5, ""), (6, "nut gear red pin")]
    df = spark.createDataFrame(rows, "doc int, text string")
    asked = spark.createDataFrame([(1, "red gear"), (2, "none such")], "query int, question string")
    growing = retrievers.GrowingIndex(spark, f"{tmp_path}/ix")
    with pytest.raises(ValueError):
        growing.index()
    for part in (df.filter("doc < 3"), df.filter("doc < 3"), df, spark.createDataFrame([(None, "red")], "doc int, text string")):
        growing.memorize(part)
    size = growing.index().size.first()
    assert (size["n"], size["avgdl"]) == (6, pytest.approx(10 / 6))
    whole = lexical.index(df.fillna(""), "doc", F.expr("filter(split(text, ' '), x -> x <> '')"))
    want = lexical.bm25_top_k(lexical.bm25_scores(whole, asked, "query", F.split("question", " ")), 3)
    assert sorted(map(tuple, growing.query(asked, 3).collect())) == sorted(map(tuple, want.collect()))
    growing.export(f"{tmp_path}/snap", 1)
    again = retrievers.GrowingIndex.load(spark, f"{tmp_path}/snap", [1])
    assert sorted(map(tuple, again.terms.collect())) == sorted(map(tuple, growing.index().terms.collect()))
    growing.reset()
    with pytest.raises(ValueError):
        growing.index()


def test_batches_of_the_index_are_merged_by_size(spark, tmp_path):
    growing = retrievers.GrowingIndex(spark, f"{tmp_path}/ix", fan=2)
    rows = [(i, f"red w{i % 3} " + "bolt " * (i % 4)) for i in range(7)]
    df = spark.createDataFrame(rows, "doc int, text string")
    for i in range(7):
        growing.memorize(df.filter(F.col("doc") <= i))  # one new row each
    assert len(growing.batches()) == 3  # 4 + 2 + 1 rows
    asked = spark.createDataFrame([(1, "red bolt w1")], "query int, question string")
    whole = lexical.index(df, "doc", F.expr("filter(split(text, ' '), x -> x <> '')"))
    want = sorted(map(tuple, lexical.bm25_top_k(lexical.bm25_scores(whole, asked, "query", F.split("question", " ")), 5).collect()))
    assert sorted(map(tuple, growing.query(asked, 5).collect())) == want
    before = growing.batches()
    spark.createDataFrame([(v,) for v in before], "version int").write.parquet(growing._path("merges", growing._next()))  # a merge that didn't come to its end
    assert growing.batches() == before and sorted(map(tuple, growing.query(asked, 5).collect())) == want
    growing.vacuum()
    again = retrievers.GrowingIndex(spark, f"{tmp_path}/ix", fan=2)
    assert again.batches() == before and sorted(map(tuple, again.query(asked, 5).collect())) == want
    again.memorize(spark.createDataFrame([(7, "new")], "doc int, text string"))
    assert len(again.batches()) == 1 and again.index().size.first()["n"] == 8
    with pytest.raises(ValueError):
        retrievers.GrowingIndex(spark, f"{tmp_path}/iy", fan=1)


def test_embedder_gives_unit_vectors_and_nulls(spark):
    embed = retrievers.Embedder(lambda texts: [[float(len(t)), 0.0 if t == "z" else 1.0] for t in texts]).embed
    got = spark.createDataFrame([("abc",), (None,), ("",), ("z",)], "t string").select("t", embed(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in got} == {"abc": pytest.approx([3 / math.sqrt(10), 1 / math.sqrt(10)]), None: None, "": None, "z": [1.0, 0.0]}


def test_names_are_known_and_taken_once(spark):
    with pytest.raises(ValueError):
        retrievers.RERANKERS.make("no such")
    with pytest.raises(ValueError):
        retrievers.RERANKERS.register("noop")(lambda: None)
    assert retrievers.RERANKERS.names() == ["concat", "concat_sources", "cosine", "cosine_local", "disabled", "none", "noop", "strategy"]
    df = spark.createDataFrame([(1, "one. two.")], "id int, text string")
    assert retrievers.SEGMENTERS.make("windows", key="id", text="text", size=4, overlap=1)(df).count() >= 2
    with pytest.raises(ValueError):
        retrievers.Search(spark, {}).run("no such", "x")


def test_cosine_distance_in_sql(spark):
    retrievers.register_functions(spark)
    row = spark.sql("SELECT cosine_distance(array(1D, 0D), array(0D, 2D)) AS a, cosine_distance(array(1D), array(3D, 4D)) AS b, cosine_distance(null, array(1D)) AS c, cosine_distance(array(0D), array(1D)) AS d").first()
    assert (row.a, row.c, row.d) == (1.0, 0.0, None) and row.b == pytest.approx(0.4)
