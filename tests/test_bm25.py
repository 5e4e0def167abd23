"""The kept BM25 index: the same lists as scoring everything, with far fewer postings read."""

import random

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import bm25, lexical


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        own = rng.choices(words, [1 / (j + 1) for j in range(400)], k=rng.choice([3, 8, 30, 120]))
        texts.append(f"the of {' '.join(own)} rare{i % 150}" if i % 7 else None if i % 2 else "")
    return spark.createDataFrame(list(enumerate(texts)), "doc long, text string"), texts


def lists(df):
    return sorted(tuple(r) for r in df.select("query", "rank", "doc", "score").collect())


def whole(docs, q, k, distinct=False):
    ix = lexical.index(docs, "doc", tx.words(F.col("text")))
    return lexical.bm25_top_k(lexical.bm25_scores(ix, q, "query", tx.words(F.col("text")), distinct=distinct), k)


def test_pruned_lists_equal_whole_ones(spark, monkeypatch):
    docs, _ = corpus(spark)
    q = spark.createDataFrame([(1, "the of rare3 w7 w7"), (2, "the of"), (3, "nothing here"), (4, None), (5, "rare9 rare10 w1"), (6, "w300 the the the"), (7, "w0 w1 w2 w3 w4 w5")], "query int, text string")
    for block_docs, first in ((8, 1), (64, 4)):
        monkeypatch.setattr(bm25, "FIRST_BLOCKS", first)
        ix = bm25.build(docs, "doc", tx.words(F.col("text")), f"small_{block_docs}", block_docs=block_docs)
        for k, distinct in ((1, False), (5, True), (1000, False)):
            assert lists(bm25.search(ix, q, "query", tx.words(F.col("text")), k, distinct)) == lists(whole(docs, q, k, distinct))


def test_hot_terms_are_hardly_read(spark):
    docs, _ = corpus(spark, 3000)
    q = spark.createDataFrame([(i, f"the of w0 rare{i * 20}") for i in range(7)], "query int, text string")
    ix = bm25.build(docs, "doc", tx.words(F.col("text")), "hot", block_docs=16)
    counters = {}
    got = bm25.search(ix, q, "query", tx.words(F.col("text")), 3, counters=counters)
    assert lists(got) == lists(whole(docs, q, 3))
    assert 0 < counters["scored"] < counters["all"] / 10


def test_index_is_kept_while_the_files_are_the_same(spark, tmp_path, monkeypatch):
    docs, _ = corpus(spark, 50)
    docs.write.parquet(f"{tmp_path}/a")
    built = []
    real = bm25.build
    monkeypatch.setattr(bm25, "build", lambda *a, **b: built.append(1) or real(*a, **b))
    for _ in range(2):
        ix = bm25.kept(spark.read.parquet(f"{tmp_path}/a"), "doc", tx.words)
    assert built == [1] and ix.terms.count() > 10
    docs.limit(10).write.mode("append").parquet(f"{tmp_path}/a")
    bm25.kept(spark.read.parquet(f"{tmp_path}/a"), "doc", tx.words)
    assert built == [1, 1]


def test_rows_are_bounded_and_bucketed(spark):
    docs, _ = corpus(spark, 500)
    ix = bm25.build(docs, "doc", tx.words(F.col("text")), "bucketed", block_docs=16)
    assert ix.postings.agg(F.max("n")).first()[0] < 64  # blocks are drawn by hash: about block_docs
    detail = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED bucketed_postings").collect()}
    assert "term" in detail["Bucket Columns"] and "block" in detail["Bucket Columns"]


def test_empty_index_and_no_queries(spark):
    docs, _ = corpus(spark, 10)
    ix = bm25.build(docs.limit(0), "doc", tx.words(F.col("text")), "none")
    q = spark.createDataFrame([(1, "the")], "query int, text string")
    assert bm25.search(ix, q, "query", tx.words(F.col("text")), 3).count() == 0
    assert bm25.search(bm25.build(docs, "doc", tx.words(F.col("text")), "ten"), q.limit(0), "query", tx.words(F.col("text")), 3).count() == 0


def test_documents_are_counted_a_bounded_number_of_words_at_a_time():
    import pyarrow as pa

    held = [["a"] * n for n in (3, 0, 40, 2, 2, 2, 9)] + [None, []]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(held))), pa.array(held, pa.list_(pa.string()))], names=["doc", "tokens"])
    parts = list(bm25._slices(batch, 1, 10))
    assert [x for p in parts for x in p.column(1).to_pylist()] == held and [x for p in parts for x in p.column(0).to_pylist()] == list(range(len(held)))
    assert all(p.num_rows == 1 or sum(len(x or ()) for x in p.column(1).to_pylist()) <= 10 for p in parts) and len(parts) > 3
    assert list(bm25._slices(batch.slice(0, 0), 1, 10)) == []


def test_statistics_equal_the_index_without_its_postings(spark, monkeypatch):
    docs, _ = corpus(spark)
    words = tx.words(F.col("text"))
    rows = lambda df: sorted((r["term"], r["df"], round(r["idf"], 9)) for r in df.collect())
    want = rows(lexical.index(docs, "doc", words).terms)
    stored, cut = [], lexical.cut
    monkeypatch.setattr(lexical, "cut", lambda df, name: stored.append(name) or cut(df, name))
    assert rows(lexical.statistics(docs, "doc", words)) == want and "postings" not in stored
    twice = spark.createDataFrame([(1, "a b"), (1, "b c"), (2, "b"), (None, "a"), (None, "a d"), (3, None)], "doc long, text string")
    assert {r["term"]: r["df"] for r in lexical.statistics(twice, "doc", words).collect()} == {"a": 2, "b": 2, "c": 1, "d": 1}


def test_scores_are_not_shuffled_by_query(spark):
    docs, _ = corpus(spark)
    q = spark.createDataFrame([(1, "the of rare3 w7 w7"), (2, "the of")], "query int, text string")
    scores = lexical.bm25_scores(lexical.index(docs, "doc", tx.words(F.col("text"))), q, "query", tx.words(F.col("text")))
    assert scores.count() > 0 and "hashpartitioning(query" not in scores._jdf.queryExecution().executedPlan().toString()


def test_passages_over_counts_equal_whole_lists(spark, monkeypatch):
    docs, _ = corpus(spark)
    q = spark.createDataFrame([(1, "the of rare3 w7 w7"), (2, "the of"), (3, "nothing here"), (4, None), (5, "rare9 rare10 w1"), (6, "w300 the the the"), (7, "w0 w1 w2 w3 w4 w5")], "query int, text string")
    words = tx.words(F.col("text"))
    for at, (terms, at_a_time, at_once) in enumerate(((100_000, 1 << 20, 100_000), (4, 9, 50))):  # one chunk of queries, then several, a few rows and products at a time
        monkeypatch.setattr(bm25, "CHUNK_TERMS", terms)
        monkeypatch.setattr(bm25, "AT_A_TIME", at_a_time)
        monkeypatch.setattr(bm25._slices, "__defaults__", (at_once,))
        ix = bm25.count(docs, "doc", words, f"counts_{at}")
        for k, distinct in ((1, False), (5, True), (1000, False)):
            assert lists(bm25.search(ix, q, "query", words, k, distinct)) == lists(whole(docs, q, k, distinct))
    none = bm25.count(docs.limit(0), "doc", words, "no_counts")
    assert bm25.search(none, q, "query", words, 3).count() == 0 and bm25.search(ix, q.limit(0), "query", words, 3).count() == 0


def test_best_are_bounded_and_tied_by_id():
    import numpy as np
    import pyarrow as pa

    best = bm25._Best(1, 3, pa.string())
    for i in range(5):
        best.add(pa.array([f"d{j:06d}" for j in range(i * 50_000, (i + 1) * 50_000)][::-1]), np.ones((50_000, 1)))
        assert best.rows <= 2 * 3 + (1 << 16) + 50_000
    assert best.best().column("doc").to_pylist() == ["d000000", "d000001", "d000002"]


def test_queries_shuffle_neither_postings_nor_scores(spark):
    from palimpsest.plans import catalog

    plan = catalog.QUERIES["bm25_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    keys = [x.split(")")[0] for x in plan.split("hashpartitioning(")[1:]]
    assert keys and all(x.startswith("query#") and x.count("#") == 1 for x in keys)


def test_only_candidates_get_vectors(spark, monkeypatch):
    from palimpsest.plans import q_lexical

    stored, cut = {}, q_lexical.cut
    monkeypatch.setattr(q_lexical, "cut", lambda df, name: stored.setdefault(name, cut(df, name)))
    q_lexical.k3(spark, "/root/testdata/sf0.001")
    wanted = stored["candidates"].select("doc").distinct().count()
    assert 0 < stored["tfidf"].filter("doc >= 0").select("doc").distinct().count() <= wanted
    assert stored["tfidf"].filter("doc >= 0").join(stored["candidates"], "doc", "left_anti").count() == 0
