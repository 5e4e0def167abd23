"""Sequential and graph operators against plain restatements of their rules."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import chunks, stem, text
from palimpsest.operators import aggregates, bitemporal, graph, selection, windows


def test_chunkers_are_lossless():
    rng = random.Random(4)
    for _ in range(200):
        t = "".join(rng.choice(["word ", "a", ". ", "!\n", "\n\n", "é", "  "]) for _ in range(rng.randint(0, 80)))
        assert "".join(chunks.sentences(t)) == t
        assert "".join(chunks.paragraph_chunks(t, 5)) == t


def test_simple_chunks_cover_and_fit():
    t = "one two three. four five six; seven eight nine\n\nten eleven twelve " * 5
    got = chunks.simple_chunks(t, 60, 10)
    assert all(len(c) <= 60 for c in got) and set(t.split()) <= {w for c in got for w in c.split()}


def test_balanced_json():
    assert chunks.first_balanced('x {"a": "}", "b": {"c": 1}} y') == '{"a": "}", "b": {"c": 1}}'
    assert chunks.first_balanced('{"a": {"b": 1') == '{"a": {"b": 1}}'
    assert chunks.first_balanced("none") is None


def test_porter_examples():
    want = {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "vietnamization": "vietnam", "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll"}
    assert {w: stem.stem_word(w) for w in want} == want


def test_chunk_starts(spark):
    for n, size, overlap in [(0, 10, 3), (9, 10, 3), (10, 10, 3), (11, 10, 3), (50, 10, 3)]:
        got = spark.range(1).select(text.chunk_starts(F.lit(n), size, overlap).alias("s")).first().s
        want, at = [], 0
        while n:
            want.append(at)
            if at + size >= n:
                break
            at += size - overlap
        assert got == want


def test_partitions_hold_all_items():
    rng = random.Random(1)
    lengths = [rng.randint(1, 900) for _ in range(60)]
    for split in (aggregates.balanced_partitions, aggregates.differencing_partitions):
        parts = split(lengths, 4)
        assert sorted(i for p in parts for i in p) == list(range(60))
        sums = [sum(lengths[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= max(lengths)


def test_pagerank_keeps_its_mass(spark):
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 0.5), ("c", "d", 0.5)], "source_id string, target_id string, weight double")
    got = graph.pagerank(edges, spark.createDataFrame([("a", 2.0), ("x", float("nan"))], "id string, weight double"), rounds=15)
    scores = {r.id: r.ppr for r in got.collect()}
    assert abs(sum(scores.values()) - 1) < 1e-9 and scores["b"] > scores["d"] > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (103, 101)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "source_id long, target_id long")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[103] == got[101] == 100


def test_mmr_equals_naive(spark):
    rng = np.random.default_rng(3)
    rows = [(0, i, float(rng.random() * 5 - 2), rng.normal(size=4).tolist(), ["turn", "claim"][i % 2], i % 3, [(i * 7) % 24] if i % 4 == 0 else None) for i in range(24)]
    df = spark.createDataFrame(rows, "g int, k int, score double, vec array<double>, kind string, source int, related array<int>")
    got = [r.k for r in selection.state_mmr(df, "g", "k", "score", "vec", 8).orderBy("place").collect()]
    v = {r[1]: np.array(r[3]) / np.linalg.norm(r[3]) for r in rows}
    by = {r[1]: r for r in rows}
    low, high = min(r[2] for r in rows), max(r[2] for r in rows)
    pairs = {(r[1], y) for r in rows for y in r[6] or ()}
    want: list[int] = []

    def value(k):
        out = 0.7 * (by[k][2] - low) / (high - low) - 0.3 * max((float(v[k] @ v[j]) for j in want), default=0.0)
        if want:
            out += 0.05 * any((k, j) in pairs or (j, k) in pairs for j in want) + 0.02 * (by[k][4] != by[want[-1]][4]) + 0.02 * (by[k][5] not in {by[j][5] for j in want})
        return round(out, 12)

    while len(want) < 8:
        rest = [k for k in by if k not in want and (want or by[k][4] != "turn")]
        want.append(max(rest, key=lambda k: (value(k), k)))
    assert got == want


@pytest.mark.parametrize(("cap", "block"), [(None, 2048), (4, 2048), (None, 3), (4, 2)])
def test_diverse_subset_equals_naive(spark, cap, block):
    rng = np.random.default_rng(5)
    rows = [(i % 3, i, float(rng.integers(0, 9)), rng.normal(size=3).tolist()) for i in range(60)]
    got = selection.greedy_diverse(spark.createDataFrame(rows, "g int, k int, score double, vec array<double>"), "g", "k", "score", "vec", 0.4, cap, block).collect()
    for g in range(3):
        want: list = []
        for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[2], r[1])):
            near = [np.dot(r[3], w[3]) / np.linalg.norm(r[3]) / np.linalg.norm(w[3]) for w in want]
            if (cap is None or len(want) < cap) and all(x <= 0.4 for x in near):
                want.append(r)
        assert [r.k for r in sorted(got, key=lambda r: r.place) if r.g == g] == [r[1] for r in want]


def test_expansion_equals_naive(spark):
    edges = [("a", "b", "SUPERSEDES"), ("b", "c", "REFINES"), ("c", "d", "REFINES"), ("x", "a", "REFINES"), ("a", "y", "UNKNOWN"), ("b", "a", "SUPERSEDES"), ("e", "c", "CONFLICTS_WITH")]
    base, weights = {"a": 2.0, "e": 1.0, "f": 0.5}, {"SUPERSEDES": 1.2, "REFINES": 1.0, "CONFLICTS_WITH": 0.8}
    got = {r.id: r.score for r in graph.expand_scores(spark.createDataFrame(list(base.items()), "id string, score double"), spark.createDataFrame(edges, "source_id string, target_id string, relation string"), weights).collect()}
    near = {}
    for s, t, r in edges:
        if r in weights:
            near.setdefault(s, []).append((t, weights[r]))
    seen = set(base)
    for _ in range(2):
        seen |= {t for s in seen for t, _ in near.get(s, [])}
    start = {i: base.get(i, 0.0) / sum(base.values()) for i in seen}
    rank = dict(start)
    for _ in range(20):
        after, loose = {i: 0.15 * start[i] for i in seen}, 0.0
        for s in seen:
            out = [(t, w) for t, w in near.get(s, []) if t in seen]
            loose += 0 if out else rank[s]
            for t, w in out:
                after[t] += 0.85 * rank[s] * w / sum(x for _, x in out)
        after = {i: x + 0.85 * loose * start[i] for i, x in after.items()}
        change, rank = sum(abs(after[i] - rank[i]) for i in seen), after
        if change < 1e-6:
            break
    low, high = min(base.values()), max(base.values())
    want = {i: (0.65 * (base[i] - low) / (high - low) if i in base else 0) + 0.35 * rank[i] for i in seen}
    assert got.keys() == want.keys() == {"a", "b", "c", "d", "e", "f"} - ({"d"} - seen) and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def states(spark, rows):
    """rows: (id, decision, value, session, recorded day, valid_from day or None, correction)."""
    day = lambda n: None if n is None else f"2024-01-{n:02} 00:00:00"
    df = spark.createDataFrame([("me", "home", c, d, v, s, q, day(q), day(f), x) for c, d, v, s, q, f, x in rows], "subject string, slot string, claim_id int, decision string, value string, session string, seq int, recorded string, valid_from string, correction boolean")
    return {r.claim_id: r for r in bitemporal.compile_states(df.withColumn("recorded", F.col("recorded").cast("timestamp")).withColumn("valid_from", F.col("valid_from").cast("timestamp"))).collect()}


def test_state_machine(spark):
    got = states(spark, [(1, "NEW", "v1", "s1", 1, None, False), (2, "CORROBORATE", "v1", "s1", 2, None, False), (3, "CORROBORATE", "v1", "s2", 3, None, False), (4, "SUPERSEDE", "v2", "s3", 4, 4, False), (5, "CONFLICT", "v3", "s4", 5, None, False), (6, "EPISODIC", "v", "s5", 6, None, False), (7, "REFINE", "v4", "s6", 7, None, False), (8, "NEW", "v5", "s7", 8, 8, False)])
    assert got[2].operation == "DUPLICATE" and got[3].operation == "CORROBORATE" and got[1].evidence == 3 and got[2].status == "merged"
    assert got[1].status == "superseded" and str(got[1].ends_at)[:10] == "2024-01-04"
    assert got[4].status == "contested" and got[6].status == "standalone"
    assert got[5].status == "refined" and got[5].ends_at is None  # refining closes nothing
    assert got[7].status == got[8].status == "active" and got[7].ends_at is None  # nor does something new
    assert [got[i].version for i in range(1, 9)] == [1, 0, 0, 2, 3, 0, 4, 5]


@pytest.mark.parametrize(
    "old_from, new, ends",
    [
        (None, (9, None, False), None),  # no new validity: the interval stays open
        (2, (9, 7, False), 7),
        (2, (9, 4, False), 9),  # before the old one was recorded: the record time
        (2, (9, 4, True), 4),  # but for a correction
        (5, (9, 3, True), 9),  # not even a correction goes behind the beginning
        (20, (9, 3, False), None),  # nor does the record time
        (None, (9, 3, True), 3),
    ],
)
def test_closing(spark, old_from, new, ends):
    recorded, valid_from, correction = new
    got = states(spark, [(1, "NEW", "a", "s1", 5, old_from, False), (2, "SUPERSEDE", "b", "s2", recorded, valid_from, correction)])
    assert got[1].status == "superseded" and (got[1].ends_at.day if got[1].ends_at else None) == ends


def test_budget_cut_and_stop(spark):
    df = spark.createDataFrame([(1, 400), (2, 300), (3, 100)], "rank int, n int")
    got = [(r["rank"], r.kept_tokens, r.is_cut) for r in windows.pack_to_budget(df, [], "rank", "n", 650).orderBy("rank").collect()]
    assert got == [(1, 400, False), (2, 250, True)]


@pytest.mark.parametrize("local", [4096, 100])
def test_clusters_have_at_most_twenty_members(spark, local):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(1500)] + [(2000 + i, [9.0] * 8) for i in range(150)]
    got = graph.cluster(spark.createDataFrame(rows, "k long, v array<double>"), "k", "v", local=local).collect()
    sizes = Counter(r.cluster for r in got)
    assert len({r.k for r in got}) == len(got) and all(10 < n <= 20 for n in sizes.values()) and sum(r.k >= 2000 for r in got) > 100


def test_the_cluster_query_keeps_its_bound(spark):
    from palimpsest.plans import catalog

    sizes = [r["count"] for r in catalog.QUERIES["g10_clusters"](spark, "/root/testdata/sf0.1").groupBy("cluster").count().collect()]
    assert sizes and max(sizes) <= 20 and min(sizes) > 10


def test_chat_windows_equal_naive(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice([1, 5, 20, 45, 250])) for c in range(4) for t in range(40)]
    got = windows.chat_windows(spark.createDataFrame(rows, "chat long, turn long, n long"), "chat", "turn", "n", 200, 60).collect()
    for c in range(4):
        held: list = []
        want: list = []
        number = 0
        for _, t, n in (r for r in rows if r[0] == c):
            held = [*held, (t, n)]
            if sum(x for _, x in held) > 200:
                want += [(number, x) for x, _ in held]
                number += 1
                held = next(held[i:] for i in range(len(held) + 1) if sum(x for _, x in held[i:]) <= 60)
        want += [(number, x) for x, _ in held]
        assert sorted((r.window, r.turn) for r in got if r.chat == c) == want


def test_mmr_dedupe_equals_naive(spark):
    rng = np.random.default_rng(8)
    words = "red blue green river house stone".split()
    rows = [(0, i, float(rng.random()), rng.normal(size=3).tolist(), " ".join(words[j] for j in rng.integers(0, 6, 4))) for i in range(30)]
    rows += [(0, 30 + i, r[2] - 0.01, r[3], r[4] + " now" * (i % 2)) for i, r in enumerate(rows[:10])]  # near copies and copies
    df = spark.createDataFrame(rows, "g int, k int, score double, vec array<double>, text string")
    got = [r.k for r in selection.mmr_dedupe(df, "g", "k", "score", "vec", "text", 12).orderBy("place").collect()]
    by = {r[1]: r for r in rows}
    unit = {k: np.array(r[3]) / np.linalg.norm(r[3]) for k, r in by.items()}
    likeness = lambda a, b: float(unit[a] @ unit[b])
    order = sorted(by, key=lambda k: (-by[k][2], k))
    want: list[int] = []

    def allowed(k):
        if k in want or any(by[k][4] == by[j][4] for j in want):
            return False
        near = max(want, key=lambda j: likeness(k, j), default=None)
        return near is None or likeness(k, near) <= 0.9 or not selection.highly_similar(by[k][4], by[near][4])

    def value(k):
        m = max(likeness(k, j) for j in want)
        return 0.8 * by[k][2] - 0.2 * (m * np.exp(10 * (m - 0.9)) if m > 0.9 else m)

    while len(want) < 12 and (rest := [k for k in order if allowed(k)]):
        want.append(rest[0] if len(want) < 2 else max(rest, key=value))
    assert got == sorted(want, key=lambda k: (-by[k][2], k)) and len(got) == 12


def test_chunks_leave_a_task_in_frames_of_bounded_size():
    import pandas as pd

    from palimpsest.functions import chunks

    texts = pd.DataFrame({"id": range(30), "text": ["word " * (i * 7) for i in range(29)] + [None]})
    cut = lambda t: chunks.simple_chunks(t, 60, 10)
    frames = list(chunks._frames([texts], "id", "text", cut, 2000))
    rows = [tuple(r) for f in frames for r in f[["id", "chunk", "chunk_text"]].itertuples(index=False)]
    assert rows == [(k, i, c) for k, t in zip(texts["id"], texts["text"]) for i, c in enumerate(cut(t or ""))]
    assert len(frames) > 5 and all(len(f) <= 11 for f in frames)


def test_nearest_neighbours_score_a_few_queries_at_a_time(spark):
    import random

    from palimpsest.operators import joins

    rng = random.Random(4)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, v array<double>").coalesce(2)
    want = set()
    for i, v in rows:
        near = sorted((-round(sum(a * b for a, b in zip(v, w)), 6), j) for j, w in rows if j != i)[:4]
        want |= {(i, j, r, -s) for r, (s, j) in enumerate(near, 1)}
    for at_once in (1, 7, 500):
        got = joins.knn(df, df, "id", "v", 4, block=16, at_once=at_once).collect()
        assert {(r.query, r.candidate, r["rank"], r.score) for r in got} == want


def test_existing_edges_makes_only_the_graphs_edges_and_types_distinct(spark):
    from palimpsest.operators import joins

    nodes = spark.createDataFrame([("c1", "n1", "t"), ("c1", "n1", "t"), ("c2", "n2", None)], "chunk_id string, node_id string, type_id string")
    relations = spark.createDataFrame([("n1", "n2", "knows"), ("n2", "n1", "knows")], "source_id string, target_id string, relation string")
    edges = [("n1", "c1", "exists_in"), ("n1", "c1", "exists_in"), ("n1", "t", "is_a"), ("n2", None, "is_a"), ("n2", "n1", "knows"), ("n9", "c1", "exists_in")]
    got = joins.existing_edges(nodes, relations, spark.createDataFrame(edges, "source_id string, target_id string, relation string"))
    assert sorted(map(tuple, got.collect())) == [("n1", "c1", "exists_in"), ("n1", "t", "is_a"), ("n2", "n1", "knows")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 2
