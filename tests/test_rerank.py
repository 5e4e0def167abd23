"""Rerank strategies, compressor, segmenter and search kinds against cases by hand and plain restatements."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import rerank, retrievers

CANDIDATES = "query long, question string, item long, memory string, background string, position int"
SOURCES = "item long, ix long, kind string, content string, chat_time string"


@pytest.fixture(scope="module")
def cases(spark):
    rows = [
        (1, "red bolt", 10, " [tag] a box", "red", 1),
        (1, "red bolt", 10, "other", "red", 2),  # repeated: the first counts
        (1, "red bolt", 11, None, None, 2),
        (1, "red bolt", 12, "copy", "x", 3),
        (2, "", 10, "[tag] a box", "red", 1),
        (3, None, 13, "none", "", 1),
    ]
    said = [
        (10, 0, "chat", "a red one", "t0"), (10, 1, "chat", "bolt", "t1"), (10, 2, "chat", "red bolt", None), (10, 3, "chat", None, None), (10, 4, "chat", "", ""), (10, 5, "chat", None, ""), (10, 6, "chat", "red", "t6"),
        (11, 0, "file", "red ", "t"), (11, 1, "file", "file", "t"), (12, 7, "file", "red ", "t"), (12, 8, "chat", "chat", "t"), (12, 9, "file", "file", "t"), (99, 0, "file", "nobody asks", "t"),
    ]
    return spark.createDataFrame(rows, CANDIDATES), spark.createDataFrame(said, SOURCES)


def got(cases, strategy, k=10, query=1):
    return [tuple(r) for r in rerank.rerank(*cases, strategy, k).filter(F.col("query") == query).orderBy("rank").select("item", "piece", "memory", "score").collect()]


def test_pairs_are_scored_one_by_one(cases):
    head = "a box\n\nsources-dialogue-pairs"
    assert got(cases, "single_turn") == [
        (10, 0, f"{head}[t0]: \nuser: a red one\nassistant: bolt", 1.0), (10, 1, f"{head}[]: \nuser: red bolt\nassistant: ", 1.0),
        (10, 3, f"{head}[t6]: \nuser: red\nassistant: ", 0.5), (11, 0, "\n\nsources-dialogue-pairs[t]: \nuser: red \nassistant: file", 0.5),
        (12, 0, "copy\n\nsources-dialogue-pairs[t]: \nuser: red \nassistant: chat", 0.5), (12, 1, "copy\n\nsources-dialogue-pairs[t]: \nuser: file\nassistant: ", 0.0),
    ]
    assert [r[:2] for r in got(cases, "single_turn", 2)] == [(10, 0), (10, 1)]
    assert got(cases, "single_turn", query=3) == []  # no sources, no pairs


def test_an_item_counts_by_its_best_pair(cases):
    assert got(cases, "singleturn_outmem") == [(10, 0, " [tag] a box", 1.0), (11, 0, "", 0.5), (12, 0, "copy", 0.5)]


def test_whole_items_with_background_sources_and_files(cases):
    assert got(cases, "concat_background") == [(10, 0, " [tag] a box\na box\nred", 0.5), (11, 0, "\n\n", 0.0), (12, 0, "copy\ncopy\nx", 0.0)]
    assert [r[3] for r in got(cases, "concat_sources")] == [1.0, 0.5, 0.5]
    assert got(cases, "concat_docsource") == [(11, 0, "\n\n\n[Sources]:\nred file", 0.5), (10, 0, " [tag] a box\na box", 0.0)]  # item 12 has the same files
    assert got(cases, "concat_background", query=2)[0][3] == 0.0 and got(cases, "concat_background", query=3)[0][3] == 0.0


def test_recent_sources_end_with_the_line_that_is_too_long(spark):
    rows = [(1, i, "chat", c * 9, "t") for i, c in enumerate("abcdef")] + [(2, 0, "chat", "z" * 5000, "t"), (2, 1, "chat", "later", "t")]
    out = {r.item: r.said for r in rerank.recent(spark.createDataFrame(rows, SOURCES), 4, 20).collect()}
    assert out[1] == "".join(f"[t]: {c * 9}\n" for c in "cd")  # 15 characters a line: the second passes 20
    assert out[2] == f"[t]: {'z' * 5000}\n"


def test_a_model_takes_the_place_of_the_score(spark, cases):
    @F.pandas_udf("double")
    def longer(question, passage):
        return passage.str.len().astype(float)

    rows = retrievers.RERANKERS.make("strategy", k=1, strategy="concat_background", score=longer)(*cases)
    assert [tuple(r) for r in rows.select("query", "item").orderBy("query").collect()] == [(1, 10), (2, 10), (3, 13)]
    with pytest.raises(ValueError):
        retrievers.RERANKERS.make("strategy", k=1, strategy="no such")
    with pytest.raises(ValueError):
        rerank.rerank(*cases, "no such", 1)
    assert rerank.rerank(cases[0].limit(0), cases[1], "single_turn", 3).count() == 0
    assert rerank.rerank(cases[0], cases[1].limit(0), "single_turn", 3).count() == 0


def test_entropy_keeps_the_rarest_words_in_order(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("abbbcccccddddddddd") for _ in range(rng.randint(1, 30))) for _ in range(80)] + ["", None, "  ", "a" * 50000 + " b", " d  d\td"]
    often = Counter(w for t in texts for w in (t or "").split())

    def kept(text, share):
        words = (text or "").split()
        first = sorted(range(len(words)), key=lambda i: (often[words[i]], i))[: max(1, int(len(words) * share))]
        return " ".join(words[i] for i in sorted(first))

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for share in (0.3, 0.7):
        out = {r.id: r.kept for r in rerank.entropy_kept(df, "id", "text", share).collect()}
        assert out == {i: kept(t, share) for i, t in enumerate(texts)}
    assert rerank.entropy_kept(df.limit(0), "id", "text", 0.5).count() == 0


def test_topics_begin_under_the_bar_and_end_when_full(spark):
    near = [None, 0.9, 0.05, 0.9, 0.9, 0.9, None, 0.0]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(near)] + [(2, 0, 0.0)], "c int, t int, s double")
    out = rerank.topic_segments(df, "c", "t", "s", 0.1, 3).orderBy("c", "t")
    assert [r.segment for r in out.collect()] == [0, 0, 1, 1, 1, 2, 2, 3, 0]


def test_search_kinds_over_a_small_graph(spark):
    over = lambda rows: (kept := retrievers.OverlapRetriever(spark), kept.memorize(spark.createDataFrame(rows, "doc string, text string")))[0]
    texts = [("t1", "red gear"), ("t2", "red bolt"), ("t3", "nut"), ("t4", None)]
    names = [("n1", "red bolt"), ("n2", "gear"), ("n3", "blue nut")]
    edges = [("n1", "fits", "n2", 1), ("n2", "holds", "n3", 2), ("n3", "fits", "n3", 3)]
    k = retrievers.Knowledge(
        spark.createDataFrame(texts, "doc string, text string"), over(texts), over([("s", "red")]), spark.createDataFrame(names, "id string, name string"),
        spark.createDataFrame(edges, "source_id string, relation string, target_id string, edge long"), over(names), lambda _: spark.createDataFrame([("fits", 0.2)], "relation string, distance double"),
        over(texts), spark.createDataFrame([("t1", "a.py"), ("t2", "a.py"), ("t3", "b.py")], "piece string, file string"),
        lambda c: c.select(F.char_length("context").alias("n")), lambda question: f"SELECT '{question}' AS q",
    )
    search = retrievers.Search(spark, k.kinds())
    assert [r.doc for r in search.run("chunks", "red bolt", 2).orderBy("rank").collect()] == ["t2", "t1"]
    assert search.run("RAG_COMPLETION", "red bolt", 2).first()[0] == "red bolt\nred gear"
    assert [r.doc for r in search.run("SUMMARIES", "red", 2).collect()] == ["s"]
    assert {tuple(r) for r in search.run("INSIGHTS", "n3", 2).collect()} == {("n2", "holds", "n3"), ("n3", "fits", "n3")}  # a loop once
    assert {tuple(r) for r in search.run("INSIGHTS", "gear", 2).collect()} == {("n1", "fits", "n2"), ("n2", "holds", "n3")}
    assert search.run("INSIGHTS", "no such", 2).count() == 0
    assert search.run("GRAPH_COMPLETION", "gear", 2).first()[0] == "gear -- holds -- blue nut\nred bolt -- fits -- gear"  # 2.0 and 1.2, the largest first
    assert search.run("GRAPH_SUMMARY_COMPLETION", "gear", 1).first()[0] == len("red bolt -- fits -- gear")
    assert [tuple(r) for r in search.run("CODE", "red bolt nut", 3).orderBy("rank").collect()] == [("a.py", 1), ("b.py", 3)]
    assert search.run("NATURAL_LANGUAGE", "why").first()[0] == "why"
    with pytest.raises(ValueError):
        search.run("FEELING", "x")
    empty = retrievers.OverlapRetriever(spark)
    with pytest.raises(ValueError):
        empty.query(spark.createDataFrame([(1, "x")], "query int, question string"), 1)


def test_texts_with_few_rare_words_need_no_join(spark, monkeypatch):
    rng = random.Random(8)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(30)], [1 / (i + 1) for i in range(30)], k=rng.randint(0, 14))) for _ in range(80)]
    texts += ["a\u00a0b  c\t d", None, " ", " ".join(f"own{i}" for i in range(9)) + " w0 w1"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    number = Counter(w for t in texts if t for w in re.split(r"[ \t]+", t) if w)

    def plain(t):
        words = [w for w in re.split(r"[ \t]+", t or "") if w]
        first = sorted(range(len(words)), key=lambda i: (number[words[i]], i))[: max(1, int(len(words) * 0.5))]
        return " ".join(words[i] for i in sorted(first))

    joined, by_join = [], rerank._kept_by_join
    monkeypatch.setattr(rerank, "_kept_by_join", lambda texts, *more: joined.append(texts.count()) or by_join(texts, *more))
    for known in (1 << 16, 8, 1, 0):
        got = {r["id"]: r["kept"] for r in rerank.entropy_kept(df, "id", "t", 0.5, known).collect()}
        assert got == {i: plain(t) for i, t in enumerate(texts)}
    assert joined[0] == 0 < joined[1] < joined[2] <= joined[3]
    two = rerank.entropy_kept(spark.createDataFrame([(1, "a b c d"), (1, None), (2, "x y")], "id int, t string"), "id", "t", 0.5).collect()
    assert sorted(map(tuple, two)) == [(1, "a b"), (2, "x")]
