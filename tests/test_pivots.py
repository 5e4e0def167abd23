"""Similarity joins by pivots against every pair, and what their bounds skip."""

import itertools
import random

import pytest
from test_pairs import cosine, vectors

from palimpsest.operators import pivots


@pytest.mark.parametrize(("size", "n"), [(1 << 20, 256), (1000, 6), (400, 2)])
def test_pairs_equal_every_pair(spark, size, n):
    rows, df = vectors(spark)
    for least in (0.6, 0.95, 1e-6):
        want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if len(a[2]) == len(b[2]) and cosine(a[2], b[2]) > least}
        got = [(r.a, r.b) for r in pivots.pairs_over(df, "id", "v", least, size, n).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pivots.pairs_over(df.limit(0), "id", "v", 0.6).count() == 0
    with pytest.raises(ValueError):
        pivots.pairs_over(df, "id", "v", 0.0)


@pytest.mark.parametrize("size", [1 << 20, 500])
def test_neighbours_equal_every_pair(spark, size):
    rows, df = vectors(spark)
    for least, late in ((0.5, False), (0.9, True)):
        want = set()
        for i, t, v in rows:
            if late and t is None:
                continue
            near = [(-round(cosine(v, w), 6), j) for j, s, w in rows if j != i and len(w) == len(v) and not (late and (s is None or s > t))]
            want |= {(i, j) for s, j in sorted(x for x in near if -x[0] >= least)[:3]}
        got = pivots.neighbours(df, df, "id", "v", 3, least, "t" if late else None, size, 5)
        assert {(r.id, r.other) for r in got.collect()} == want


def clustered(rng, n, centres, dims, spread):
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, spread) for x in middles[i % centres]]) for i in range(n)]


def test_clusters_are_hardly_visited_and_copies_do_no_harm(spark):
    rng = random.Random(4)
    rows = clustered(rng, 600, 30, 12, 0.05) + [(600 + i, [1.0] * 12) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    n, seen, cells = pivots.visits(df, "id", "v", 0.9, 64)
    assert n == 750 and cells >= 30 and seen < n * cells / 2 / 10
    want = sum(cosine(a[1], b[1]) > 0.9 for a, b in itertools.combinations(rows, 2))
    assert pivots.pairs_over(df, "id", "v", 0.9, 4000, 64).count() == want


def test_spread_vectors_visit_most_cells(spark):
    """Where the bounds can't help, `visits` says so."""
    df = spark.createDataFrame(clustered(random.Random(5), 300, 300, 48, 1.0), "id int, v array<double>")
    n, seen, cells = pivots.visits(df, "id", "v", 0.3, 32)
    assert seen > n * cells / 2 / 2


def test_blocks_are_a_fixed_part_of_the_table(spark):
    """So a row's copies don't grow with the table: spread vectors visit all cells, of which there are as many."""
    most = []
    for n in (2000, 8000):
        df = spark.createDataFrame(clustered(random.Random(6), n, n, 24, 1.0), "id int, v array<double>")
        cells, _, size = pivots._cells(pivots._units(pivots.blocks._unit(df, "id", "v")), 0.3, None)
        most.append((len(cells.radius), -(-n * (8 * 24 + 64) // size)))
    assert all(c <= 2 * pivots.BLOCKS and b <= pivots.BLOCKS for c, b in most)
