"""Expansion by priority, cheapest paths and version chains against plain searches."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import graph


def search(edges, seeds, concepts):
    """The rule as a priority queue: a node leads on if it has a concept not seen before."""
    best, queue, path, seen = {}, [], [], set()
    for n, s in seeds:
        best[n] = min(best.get(n, 1e99), 1 / s)
    queue = [(c, n) for n, c in best.items()]
    heapq.heapify(queue)
    done = set()
    while queue:
        cost, n = heapq.heappop(queue)
        if n in done or cost > best[n]:
            continue
        done.add(n)
        leads = not concepts.get(n, set()) <= seen
        path.append((n, round(cost, 9), leads))
        if leads:
            seen |= concepts[n]
            for a, b, w in edges:
                if a == n and (c := cost + 1 / max(w, 1e-10)) < best.get(b, 1e99):
                    best[b] = c
                    heapq.heappush(queue, (c, b))
    return path


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_expansion_equals_the_queue(spark, seed):
    rng = random.Random(seed)
    edges = [(a, b, rng.choice([0.5, 0.25, 1.0, 0.1])) for a in range(40) for b in rng.sample(range(40), 3) if a != b]
    concepts = {n: {f"c{rng.randint(0, 25)}" for _ in range(rng.randint(0, 3))} for n in range(40)}
    seeds = [(0, 0.5), (7, 0.25), (0, 0.8)]
    e = spark.createDataFrame(edges, "source_id long, target_id long, weight double")
    c = spark.createDataFrame([(n, x) for n, s in concepts.items() for x in s], "id long, concept string")
    got = graph.expansion(e, spark.createDataFrame(seeds, "id long, similarity double"), c).orderBy("place").collect()
    assert [(r.id, round(r.cost, 9), r.expands) for r in got] == search(edges, seeds, concepts)
    assert [r.place for r in got] == list(range(1, len(got) + 1))


def test_long_chains_end_where_they_end(spark):
    e = spark.createDataFrame([(i, i + 1, 0.5) for i in range(12)], "source_id long, target_id long, weight double")
    start = spark.createDataFrame([(0, 1.0)], "id long, similarity double")
    c = spark.range(13).select("id", F.concat(F.lit("own "), F.col("id")).alias("concept"))
    assert [r.id for r in graph.expansion(e, start, c).orderBy("place").collect()] == list(range(13))
    assert {r.id: r.cost for r in graph.cheapest_paths(e, start).collect()} == {i: 1 + 2.0 * i for i in range(13)}
    assert graph.cheapest_paths(e, start, 4).count() == 5
    assert sorted(r.at for r in graph.version_chain(start, e, 20).collect()) == list(range(1, 13))
    assert sorted(r.at for r in graph.version_chain(start, e, 3).collect()) == [1, 2, 3]
    assert graph.expansion(e, start.limit(0), c).count() == 0 and graph.version_chain(start.limit(0), e).count() == 0
