"""Pair operators over whole tables against plain restatements, in several blocks."""

import itertools
import math
import random

from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import blocks, containment, joins, lexical, sets


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def vectors(spark):
    rng = random.Random(3)
    rows = [(i, i % 7, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)]
    rows += [(60, 1, rows[3][2]), (61, 2, rows[3][2]), (62, 3, [0.0] * 4), (63, 4, [1.0, 2.0])]
    odd = [(64, 5, None), (65, 6, []), (66, 0, [float("nan")] * 4), (67, None, [1.0, 0.0, 0.0, 0.0]), (68, 1, [None, 1.0, 0.0, 0.0])]
    return rows + [odd[3]], spark.createDataFrame(rows + odd, "id int, t int, v array<double>")


def test_pairs_over_finds_every_pair_whatever_the_blocks(spark):
    rows, df = vectors(spark)
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if len(a[2]) == len(b[2]) and cosine(a[2], b[2]) > 0.6}
    for size in (1 << 20, 1000):
        got = [(r.a, r.b) for r in blocks.pairs_over(df, "id", "v", 0.6, size).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert blocks.pairs_over(df.limit(0), "id", "v", 0.6).count() == 0


def test_neighbours_keep_ties_by_id_thresholds_and_times(spark):
    rows, df = vectors(spark)
    for least, late, size in ((None, False, 1000), (0.5, True, 1000), (0.5, True, 1 << 20)):
        want = set()
        for i, t, v in rows:
            if late and t is None:
                continue
            near = [(-round(cosine(v, w), 6), j) for j, s, w in rows if j != i and len(w) == len(v) and not (late and (s is None or s > t))]
            want |= {(i, j) for s, j in sorted(x for x in near if least is None or -x[0] >= least)[:3]}
        got = blocks.neighbours(df, df, "id", "v", 3, least, "t" if late else None, size)
        assert {(r.id, r.other) for r in got.collect()} == want
    assert {(r.task, r.target) for r in sets.merge_target(df.filter("id in (3, 62)"), df, "v", "id", 0.9).collect()} == {(3, 60)}


def test_contained_in_finds_long_short_empty_and_repeated_chunks(spark):
    rng = random.Random(5)
    words = ["alpha", "βeta", "gamma", "中文", "x", "😀", "delta"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(40)]
    texts += ["", texts[0], "y" * 90, "y" * 41, None]
    cuts = [t[a : a + n] for t in texts if t for a in (0, 7) for n in (3, 39, 40, 41, 75)] + ["", "z" * 50, "z", None]
    chunks = spark.createDataFrame([(i, c if c is None or i % 2 else f"Date: today\nuser: {c}") for i, c in enumerate(cuts)], "chunk_id int, chunk string")
    originals = spark.createDataFrame(list(enumerate(texts)), "original_id int, original string")
    got = [tuple(r) for r in joins.contained_in(chunks, originals).collect()]
    pairs = [(i, j) for i, c in enumerate(cuts) if c is not None for j, t in enumerate(texts) if t is not None and c in t]
    assert sorted(got) == sorted(pairs)
    counts = {r.bare: tuple(r)[1:] for r in joins.contained_counts(chunks, originals).collect()}
    held = {}
    for i, j in pairs:
        held.setdefault(cuts[i], []).append((i, j))
    assert counts == {c: (min(i for i, _ in p), len({i for i, _ in p}), min(j for _, j in p), len({j for _, j in p})) for c, p in held.items()}
    for empty in (joins.contained_counts(chunks.limit(0), originals), joins.contained_counts(chunks, originals.limit(0))):
        assert empty.count() == 0


def test_a_common_anchor_is_dealt_over_tasks(spark):
    places = spark.createDataFrame([(str(i), 7 if i % 3 else i) for i in range(900)], "digest string, anchor long")
    wanted = spark.createDataFrame([("a", 7), ("b", 7), ("c", 3), ("d", -1)], "bare string, anchor long")
    met = containment._met(places, wanted)
    assert sorted((r.bare, r.digest) for r in met.collect()) == sorted([(b, str(i)) for b in "ab" for i in range(900) if i % 3] + [("c", "3")])
    assert met.filter("anchor = 7").select("salt").distinct().count() == containment.SALTS


def test_anchors_of_a_text_hold_those_of_its_parts():
    rng = random.Random(1)
    text = "".join(rng.choice("abc") for _ in range(300))
    for a in range(0, 260, 9):
        assert containment._hashes(text[a : a + containment.LEAST]).min() in containment._anchors(text)


def test_tfidf_pairs_and_the_sweep_equal_all_pairs(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["the", "the", "a", "red", "blue", "bolt", "nut", "gear", "cog", "pin"]) for _ in range(rng.randint(1, 6))) for _ in range(70)]
    docs = spark.createDataFrame([*enumerate(texts), (70, ""), (71, None)], "id int, text string")
    vec = lexical.tfidf_vectors(docs, "id", tx.words(F.col("text"))).persist()
    by_doc = {}
    for r in vec.collect():
        by_doc.setdefault(r.doc, {})[r.term] = r.w
    every = {(a, b): sum(w * by_doc[b].get(t, 0) for t, w in by_doc[a].items()) for a, b in itertools.combinations(sorted(by_doc), 2)}
    for least in (0.3, 0.75):
        got = {(r.a, r.b): r.similarity for r in lexical.tfidf_pairs(vec, least).collect()}
        assert {p for p, s in every.items() if s > least + 1e-9} <= set(got) <= {p for p, s in every.items() if s > least - 1e-9}
        assert all(abs(got[p] - every[p]) < 1e-9 for p in got)
    pairs, kept, gone = lexical.tfidf_pairs(vec, 0.6), [], set()
    close = {(r.a, r.b) for r in pairs.collect()}
    for i in range(72):
        if i not in gone:
            kept.append(i)
            gone |= {b for a, b in close if a == i}
    assert sorted(r.id for r in sets.greedy_near_duplicates(pairs, docs, "id", 0.6).collect()) == kept
    vec.unpersist()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_closest_takes_twins_then_the_least_distance_then_the_smaller_id(spark):
    rng = random.Random(2)
    names = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(50)]
    names += ["twin", "twin", "twin", None]
    items = spark.createDataFrame(list(enumerate(names)), "item_id int, item string")
    candidates = items.select(F.col("item_id").alias("candidate_id"), F.col("item").alias("candidate"))
    want = {}
    for i, s in enumerate(names):
        if s is not None:
            want[i] = min((edits(s, t), j) for j, t in enumerate(names) if t is not None and j != i)
    assert {r.item_id: (r.distance, r.candidate_id) for r in joins.closest(items, candidates).collect()} == want
    distinct = items.filter("item is not null").select("item").distinct()
    few = blocks.closest_texts(distinct, distinct.withColumnRenamed("item", "candidate"), 1000)
    texts = set(names) - {None}
    assert {(r.item, r.candidate) for r in few.collect()} == {(s, t) for s in texts for t in texts - {s} if edits(s, t) == min(edits(s, u) for u in texts - {s})}


def test_equal_vectors_meet_once_as_a_class_and_keep_all_their_pairs(spark):
    texts = ["red bolt", "bolt red", "red nut", "blue gear", "red bolt pin", ""]
    docs = spark.createDataFrame([((i * 7) % 120, texts[i % 6]) for i in range(120)], "id int, text string")
    vec = lexical.tfidf_vectors(docs, "id", tx.words(F.col("text")))
    of = {r.doc: r["class"] for r in lexical.same_vectors(vec).collect()}
    held = {r.id: sorted(r.text.split()) for r in docs.collect() if r.text}
    assert of == {i: min(j for j, u in held.items() if u == t) for i, t in held.items()} and len(set(of.values())) == 4
    by_doc = {}
    for r in vec.collect():
        by_doc.setdefault(r.doc, {})[r.term] = r.w
    every = {(a, b): sum(w * by_doc[b].get(t, 0) for t, w in by_doc[a].items()) for a, b in itertools.combinations(sorted(by_doc), 2)}
    want = {p for p, s in every.items() if s >= 0.4}
    for members in (3, 1000):
        got = [(r.a, r.b) for r in lexical.tfidf_pairs(vec, 0.4, members).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 2000
    kept, gone = [], set()
    for i in range(120):
        if i not in gone:
            kept.append(i)
            gone |= {b for a, b in want if a == i}
    assert sorted(r.id for r in lexical.tfidf_near_duplicates(vec, docs, "id", 0.4).collect()) == kept


def test_contained_in_gives_all_pairs_of_copies_from_rows_of_bounded_size(spark):
    long, short = "one line that is long enough for an anchor of its own", "short"
    texts = [f"{long}\nx{i % 3}" for i in range(40)] + [f"{short} {i}" for i in range(9)]
    chunks = spark.createDataFrame([(f"a{i}", long) for i in range(30)] + [(f"b{i}", short) for i in range(20)], "chunk_id string, chunk string")
    got = [tuple(r) for r in joins.contained_in(chunks, spark.createDataFrame(list(enumerate(texts)), "original_id int, original string"), 4).collect()]
    assert sorted(got) == sorted([(f"a{i}", j) for i in range(30) for j in range(40)] + [(f"b{i}", j) for i in range(20) for j in range(40, 49)])


def test_j17_gives_every_line_with_every_document_that_holds_it(spark, tmp_path):
    from palimpsest.plans import catalog

    docs = [(1, "alpha\nbeta"), (2, "alpha\nalpha"), (3, "say alpha"), (4, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["j17_contained"](spark, str(tmp_path)).collect()]
    lines = [(i, n, x) for i, t in docs for n, x in enumerate(t.split("\n")) if x]
    assert sorted(got) == sorted((f"{i}:{n}", j) for i, n, x in lines for j, t in docs if x in t)


def test_every_vector_is_asked_for_its_neighbours(spark):
    from palimpsest.plans import catalog

    d = "/root/testdata/sf0.001"
    got = catalog.QUERIES["j6_blocked_knn"](spark, d).groupBy("query").count().collect()
    assert len(got) == spark.read.parquet(f"{d}/embeddings.parquet").count() and {r["count"] for r in got} == {5}


def test_similarities_are_rounded_before_pairs_of_copies_are_made(spark):
    from palimpsest.plans import catalog

    plan = catalog.QUERIES["x2_tfidf_pairs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("round(")
