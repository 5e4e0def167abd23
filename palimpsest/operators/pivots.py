"""Similarity joins with a threshold that skip what lies too far apart, by pivots.

Vectors of length 1 with a cosine of at least s are at most r = sqrt(2 - 2 s) apart.  Each row belongs to the cell of its
nearest pivot.  A row y can have a partner in another cell c only if it lies within r of the cell's bisector,

    (|y - p_c|^2 - |y - p_own|^2) / (2 |p_c - p_own|) <= r,

and within the cell's radius plus r of its pivot; both follow from the triangle inequality, so no pair is lost.  It visits those
cells, of two tables all, within one table only those of smaller number, so every pair meets once.  Large cells are cut into blocks
that meet in tasks of their own (operators.blocks), so neither copies nor a crowded cell fill a task.

How much is skipped depends on the data: with clusters, a row visits a few cells; where r reaches across most of the space
(low thresholds, or vectors spread evenly over many dimensions, where all are about as far apart) it visits nearly all, and the join costs
what comparing all blocks costs.  `visits` tells which it is before anything is compared.

A table has BLOCKS blocks, more only where one would be over MOST_BYTES, so what is shuffled grows with the table, not with its square.
Pivots are at most MOST_PIVOTS, chosen farthest-first from about SAMPLE rows drawn evenly from the table, fewer where the sample would visit many cells: the bounds hold for
any choice.  Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do zero vectors,
whose cosine is 0 (thresholds are above 0); vectors of other lengths are never similar; equal rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators import blocks
from palimpsest.operators.ranking import top_k
from palimpsest.operators.tables import cut

MOST_PIVOTS, SAMPLE = 256, 2048
#: Blocks of a table, whatever its size, until a block has MOST_BYTES: a row's copies are as many for a large table as for a small one.
BLOCKS, LEAST_BYTES, MOST_BYTES = 8, 1 << 18, 64 << 20
_EPS = 1e-7


def _drawn(rows: DataFrame) -> dict[int, np.ndarray]:
    """A bounded sample of the vectors by length."""
    n = rows.count()
    drawn = [np.array(r.v) for r in rows.select("v").sample(min(1.0, SAMPLE / max(1, n)), seed=7).limit(2 * SAMPLE).collect()]
    return {length: np.stack([v for v in drawn if len(v) == length]) for length in {len(v) for v in drawn}}


def _pivots(drawn: dict[int, np.ndarray], most: int) -> dict[int, np.ndarray]:
    """Pivots by vector length, farthest-first among a sample: fewer are the first of more."""
    out = {}
    for length, of in drawn.items():
        chosen, gap = [0], np.full(len(of), np.inf)
        while len(chosen) < min(most, len(of)):
            gap = np.minimum(gap, np.linalg.norm(of - of[chosen[-1]], axis=1))
            if gap.max() < _EPS:
                break
            chosen.append(int(gap.argmax()))
        out[length] = of[chosen]
    return out


def _chosen(drawn: dict[int, np.ndarray], reach: float) -> dict[int, np.ndarray]:
    """As many pivots as leave a row of the sample with about 2 BLOCKS visits, and 2 BLOCKS at least."""
    every, most = _pivots(drawn, MOST_PIVOTS), MOST_PIVOTS
    while True:
        pivots = {length: p[:most] for length, p in every.items()}
        cells, seen = Cells(pivots, reach), 0
        for of in drawn.values():
            cell, far = cells.own(of)
            np.maximum.at(cells.radius, cell, far)
            seen += len(cells.visits(of, None)[0])
        if most <= 2 * BLOCKS or seen <= 2 * BLOCKS * sum(map(len, drawn.values())):
            return pivots
        most //= 2


class Cells:
    """Cells by number: those of one vector length follow each other; a length without pivots is one cell, numbered below 0."""

    def __init__(self, pivots: dict[int, np.ndarray], reach: float):
        self.pivots, self.reach, self.first, n = pivots, reach, {}, 0
        for length, p in sorted(pivots.items()):
            self.first[length] = n
            n += len(p)
        self.radius = np.zeros(n)
        self.apart = {length: np.linalg.norm(p[:, None] - p[None, :], axis=2) for length, p in pivots.items()}

    def _distances(self, v: np.ndarray) -> np.ndarray:
        p = self.pivots[v.shape[1]]
        return np.sqrt(np.maximum((v**2).sum(1)[:, None] + (p**2).sum(1)[None, :] - 2 * v @ p.T, 0))

    def own(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its pivot of rows of one length."""
        if v.shape[1] not in self.pivots:
            return np.full(len(v), -1 - v.shape[1]), np.zeros(len(v))
        d = self._distances(v)
        best = d.argmin(1)
        return best + self.first[v.shape[1]], d[np.arange(len(v)), best]

    def visits(self, v: np.ndarray, below: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of every visit; below: a row's own cell, and only smaller ones are visited; without it, its nearest one too."""
        length = v.shape[1]
        if length not in self.pivots:
            return (np.empty(0, int), np.empty(0, int)) if below is not None else (np.arange(len(v)), np.full(len(v), -1 - length))
        d, first = self._distances(v), self.first[length]
        own = d.argmin(1)
        nearest = d[np.arange(len(v)), own]
        bisector = (d**2 - nearest[:, None] ** 2) / (2 * np.maximum(self.apart[length][own], _EPS))
        meets = (bisector <= self.reach + _EPS) & (d <= self.radius[first : first + d.shape[1]] + self.reach + _EPS)
        if below is not None:
            meets &= np.arange(d.shape[1])[None, :] < (below - first)[:, None]
        row, cell = np.nonzero(meets)
        return row, cell + first


def _by_length(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for _, some in pdf.groupby(pdf["v"].map(len), sort=False):
        yield some, np.stack(some["v"].to_numpy())


def _celled(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with cell and far (the distance to the cell's pivot), stored."""
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for some, v in _by_length(pdf):
                cell, far = cells.own(v)
                yield some.assign(cell=cell.astype(np.int32), far=far)

    return cut(rows.mapInPandas(run, schema), "cells")


def _visiting(rows: DataFrame, cells: Cells, own: bool) -> DataFrame:
    """rows (of cell, if own) once for each cell they visit."""
    names = [c for c in rows.columns if c not in ("cell", "far")]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("cell", T.IntegerType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for some, v in _by_length(pdf):
                for at in range(0, len(some), blocks.ROWS):  # a few rows with all their cells at a time
                    part = some.iloc[at : at + blocks.ROWS]
                    row, cell = cells.visits(v[at : at + blocks.ROWS], part["cell"].to_numpy() if own else None)
                    yield part[names].iloc[row].assign(cell=cell.astype(np.int32))

    return rows.mapInPandas(run, schema)


def _met(members: DataFrame, visitors: DataFrame, alone: bool, compare: Callable, schema: str, block_bytes: int) -> DataFrame:
    """compare() over each cell's members and visitors and, if alone, over its members themselves, block by block."""
    weight = F.sum(8 * F.size("v") + 64)
    count = lambda df, name: df.groupBy("cell").agg(F.ceil(weight / block_bytes).cast("int").alias(name))
    sizes = cut(count(members, "_m").join(count(visitors, "_n"), "cell", "left").na.fill(0, ["_n"]), "cell-blocks")  # a row a cell
    deal = lambda df, n: df.join(F.broadcast(sizes), "cell").withColumn("_own", F.floor(F.rand() * F.col(n)).cast("int"))
    m, v = cut(deal(members.drop("far"), "_m"), "cell-members"), cut(deal(visitors, "_n"), "cell-visitors")
    upto = lambda n: F.explode(F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)))
    # _j below 0 numbers the blocks of visitors, so these never meet a block of members by the same key.
    parts = [
        m.withColumn("_k", upto("_n")).select("*", F.col("_own").alias("_i"), (-1 - F.col("_k")).alias("_j"), F.lit(False).alias("_right")),
        v.withColumn("_k", upto("_m")).select("*", F.col("_k").alias("_i"), (-1 - F.col("_own")).alias("_j"), F.lit(True).alias("_right")),
    ]
    if alone:
        parts.append(m.withColumn("_k", upto("_m")).select("*", F.least("_own", "_k").alias("_i"), F.greatest("_own", "_k").alias("_j"), (F.col("_own") > F.col("_k")).alias("_right")))
    met = parts[0]
    for p in parts[1:]:
        met = met.unionByName(p)

    def run(key: tuple, pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(pdfs), ignore_index=True)
        _, i, j = key
        if i == j:
            yield from compare(rows, rows, True)
        elif j >= 0:
            yield from compare(rows[~rows["_right"]], rows[rows["_right"]], False)
        else:  # visitors ask, members answer
            yield from compare(rows[rows["_right"]], rows[~rows["_right"]], False)

    return met.select("cell", "_i", "_j", "_right", *[c for c in members.columns if c not in ("cell", "far")]).groupBy("cell", "_i", "_j").applyInPandas(run, schema)


def _cells(rows: DataFrame, least: float, most: int | None, block_bytes: int | None = None) -> tuple[Cells, DataFrame, int]:
    """Cells, rows in cells, bytes of a block.  most: pivots; by default as many as the sample's visits allow; blocks are by default a fixed part of the table."""
    if not 0 < least <= 1:
        raise ValueError("a threshold must be over 0 and at most 1")
    rows = cut(rows.repartition(rows.sparkSession.sparkContext.defaultParallelism), "unit-vectors")
    if block_bytes is None:
        size = rows.agg(F.sum(8 * F.size("v") + 64)).first()[0] or 0
        block_bytes = min(MOST_BYTES, max(LEAST_BYTES, -(-size // BLOCKS)))
    # A pair of similarity `least` is `reach` apart.
    reach = float(np.sqrt(2 - 2 * least))
    drawn = _drawn(rows)
    cells = Cells(_chosen(drawn, reach) if most is None else _pivots(drawn, most), reach)
    members = _celled(rows, cells)
    for r in members.groupBy("cell").agg(F.max("far").alias("far")).filter("cell >= 0").collect():  # a row a cell
        cells.radius[r.cell] = r.far
    return cells, members, block_bytes


def _units(rows: DataFrame) -> DataFrame:
    """Rows that can be similar to any: zero vectors are not."""
    return rows.filter(F.exists("v", lambda x: x != 0))


def visits(df: DataFrame, key: str, vec: str, least: float, pivots: int | None = None) -> tuple[int, int, int]:
    """(rows, visits, cells) of a join within df: visits near rows x cells / 2 mean that the bounds skip next to nothing."""
    cells, members, _ = _cells(_units(blocks._unit(df, key, vec)), least, pivots)
    return members.count(), _visiting(members, cells, True).count(), len(cells.radius)


def pairs_over(df: DataFrame, key: str, vec: str, least: float, block_bytes: int | None = None, pivots: int | None = None) -> DataFrame:
    """(a, b, similarity) for a < b with cosine over `least`, over the whole table."""
    rows = _units(blocks._unit(df, key, vec))
    kind = rows.schema["id"].dataType.simpleString()
    cells, members, block_bytes = _cells(rows, least, pivots, block_bytes)
    return _met(members, _visiting(members, cells, True), True, blocks.pair_compare(least), f"a {kind}, b {kind}, similarity double", block_bytes)


def neighbours(left: DataFrame, right: DataFrame, key: str, vec: str, k: int, least: float, not_after: str | None = None, block_bytes: int | None = None, pivots: int | None = None) -> DataFrame:
    """blocks.neighbours() for a threshold: left rows visit the cells of right."""
    a, b, schema = blocks.near_sides(left, right, key, vec, not_after)
    # Scores are rounded before they are compared.
    cells, members, block_bytes = _cells(_units(b), max(least - 5e-7, 1e-9), pivots, block_bytes)
    compare = blocks.near_compare(k, least, bool(not_after))
    return top_k(_met(members, _visiting(_units(a), cells, False), False, compare, schema, block_bytes), ["id"], [F.desc("score"), "other"], k)
