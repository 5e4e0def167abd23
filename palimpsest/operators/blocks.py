"""Comparisons of whole tables in blocks: every block of one side meets every block of the other in a task of its own.

Block numbers are drawn at random and stored, so no key or repeated row can fill a block, and a lost task finds the same
blocks again.  A task holds two blocks, whose bytes are bounded; what it finds leaves it in batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import edits, vectors
from palimpsest.operators.ranking import top_k
from palimpsest.operators.tables import cut

BLOCK_BYTES = 4 << 20
ROWS = 512
#: Scores of rows of one block with another's that a task holds at a time.
SCORES = 1 << 21
#: Texts whose edit distances from one text are computed at a time.
AT_ONCE = 256


def _blocked(df: DataFrame, weight: Column, block_bytes: int) -> tuple[DataFrame, int]:
    """df with a stored block number `own`, and the number of blocks."""
    n = max(1, -(-int(df.agg(F.sum(weight)).first()[0] or 0) // block_bytes))
    return cut(df.withColumn("own", F.floor(F.rand() * n).cast("int")), "blocks"), n


def grid(left: DataFrame, right: DataFrame | None, weight: Column, compare: Callable[[pd.DataFrame, pd.DataFrame, bool], Iterator[pd.DataFrame]], schema: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """compare(x, y, same) of every block x of left and y of right (of the same columns).

    Without right, left meets itself: each two blocks once, and a block itself with same = True.  weight: bytes of a row.
    """
    a, n = _blocked(left, weight, block_bytes)
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    if right is None:
        met = a.withColumn("_other", numbers(n)).withColumn("_i", F.least("own", "_other")).withColumn("_j", F.greatest("own", "_other")).withColumn("_right", F.col("own") > F.col("_i")).drop("_other")
    else:
        b, m = _blocked(right, weight, block_bytes)
        met = a.withColumn("_i", F.col("own")).withColumn("_j", numbers(m)).withColumn("_right", F.lit(False))
        met = met.unionByName(b.withColumn("_i", numbers(n)).withColumn("_j", F.col("own")).withColumn("_right", F.lit(True)))
    alone = right is None

    def run(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        same = alone and key[0] == key[1]
        yield from compare(rows if same else rows[~rows["_right"]], rows if same else rows[rows["_right"]], same)

    return met.groupBy("_i", "_j").applyInPandas(run, schema)


def _unit(df: DataFrame, key: str, vec: str, *more: Column) -> DataFrame:
    """(id, v, ...) of vectors that are not null and hold finite components only; v has length 1 (or 0)."""
    v = F.col(vec).cast("array<double>")
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    return df.filter(fine).select(F.col(key).alias("id"), vectors.normalized(v).alias("v"), *more)


def _weight() -> Column:
    return 8 * F.size("v") + 64


def _by_length(x: pd.DataFrame, y: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, pd.DataFrame, np.ndarray]]:
    """Rows of both with vectors of one length, which alone can be compared, left ones a few at a time."""
    long_x, long_y = x["v"].map(len), y["v"].map(len)
    for n in sorted(set(long_x) & set(long_y) - {0}):
        p, q = x[long_x == n], y[long_y == n]
        of_q = np.stack(q["v"].to_numpy())
        step = max(1, min(ROWS, SCORES // len(q)))
        for at in range(0, len(p), step):
            some = p.iloc[at : at + step]
            yield some, np.stack(some["v"].to_numpy()), q, of_q


def pair_compare(least: float) -> Callable:
    """Pairs (a, b, similarity), a < b, of two blocks, or of one with itself."""

    def compare(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        for p, of_p, q, of_q in _by_length(x, y):
            scores = of_p @ of_q.T
            r, c = np.nonzero(scores > least)
            a, b, s = p["id"].to_numpy()[r], q["id"].to_numpy()[c], scores[r, c]
            if same:
                keep = a < b
            else:
                keep, a, b = a != b, np.where(a < b, a, b), np.where(a < b, b, a)
            yield pd.DataFrame({"a": a[keep], "b": b[keep], "similarity": s[keep]})

    return compare


def pairs_over(df: DataFrame, key: str, vec: str, least: float, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, similarity) for a < b with cosine over `least`, over the whole table."""
    rows = _unit(df, key, vec)
    kind = rows.schema["id"].dataType.simpleString()
    return grid(rows, None, _weight(), pair_compare(least), f"a {kind}, b {kind}, similarity double", block_bytes)


def _first(p: pd.DataFrame, q: pd.DataFrame, r: np.ndarray, c: np.ndarray, score: np.ndarray, k: int) -> pd.DataFrame:
    """Of the hits (row, column, score), rows in order, the k best of each row, ties to the smaller column."""
    order = np.lexsort((c, -score, r))
    r, c, score = r[order], c[order], score[order]
    first = np.arange(len(r)) - np.searchsorted(r, r) < k
    return pd.DataFrame({"id": p["id"].to_numpy()[r[first]], "other": q["id"].to_numpy()[c[first]], "score": score[first]})


def near_compare(k: int, least: float | None, timed: bool) -> Callable:
    """The k best of block y for each row of block x, as far as they can be among its k best."""

    def compare(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        for p, of_p, q, of_q in _by_length(x, y.sort_values("id", kind="stable")):
            if least is not None:  # hits are few: only they are rounded and ordered
                scores = of_p @ of_q.T
                r, c = np.nonzero(scores >= least - 1e-6)
                score = np.round(scores[r, c], 6)
                a, b = p["id"].to_numpy()[r], q["id"].to_numpy()[c]
                keep = (score >= least) & (a != b)
                if timed:
                    keep &= ~(q["t"].to_numpy()[c] > p["t"].to_numpy()[r])
                yield _first(p, q, r[keep], c[keep], score[keep], k)
                continue
            scores = np.round(of_p @ of_q.T, 6)
            scores[p["id"].to_numpy()[:, None] == q["id"].to_numpy()[None, :]] = -np.inf
            if timed:
                scores[q["t"].to_numpy()[None, :] > p["t"].to_numpy()[:, None]] = -np.inf
            enough = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k] if k < scores.shape[1] else -np.inf
            r, c = np.nonzero((scores >= enough) & np.isfinite(scores))
            yield _first(p, q, r, c, scores[r, c], k)

    return compare


def near_sides(left: DataFrame, right: DataFrame, key: str, vec: str, not_after: str | None) -> tuple[DataFrame, DataFrame, str]:
    """Both sides as (id, v[, t]), and the schema of what near_compare finds."""
    more = [F.col(not_after).alias("t")] if not_after else []
    a, b = _unit(left, key, vec, *more), _unit(right, key, vec, *more)
    if not_after:
        a, b = a.filter("t is not null"), b.filter("t is not null")
    kind = a.schema["id"].dataType.simpleString()
    return a, b, f"id {kind}, other {kind}, score double"


def neighbours(left: DataFrame, right: DataFrame, key: str, vec: str, k: int, least: float | None = None, not_after: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, other, score, rank): the k rows of right most similar to each row of left, rows of its own id left out.

    score is the cosine to six digits, ties go to the smaller id; with `least`, only scores of at least that; with
    `not_after`, only rows whose value there is not later than the left row's (unknown ones are left out).
    """
    a, b, schema = near_sides(left, right, key, vec, not_after)
    return top_k(grid(a, b, _weight(), near_compare(k, least, bool(not_after)), schema, block_bytes), ["id"], [F.desc("score"), "other"], k)


def _letters(texts: pd.Series, alphabet: dict[str, int]) -> np.ndarray:
    counts = np.zeros((len(texts), len(alphabet)), np.int32)
    for i, s in enumerate(texts):
        for ch in s:
            counts[i, alphabet[ch]] += 1
    return counts


def closest_texts(items: DataFrame, candidates: DataFrame, block_bytes: int = 1 << 18) -> DataFrame:
    """(item, candidate, distance): for each text of items (item) the other texts of candidates (candidate) at the least edit distance, all of them.

    Both are distinct.  Letters that one text has more of than the other bound the distance from below, so few are computed.
    """
    x = items.select(F.col("item").alias("text"))
    y = candidates.select(F.col("candidate").alias("text"))

    def compare(x: pd.DataFrame, y: pd.DataFrame, same: bool) -> Iterator[pd.DataFrame]:
        alphabet = {ch: i for i, ch in enumerate(sorted(set("".join(x["text"])) | set("".join(y["text"]))))}
        of_y = _letters(y["text"], alphabet)
        texts = y["text"].to_numpy()
        for s, own in zip(x["text"], _letters(x["text"], alphabet), strict=True):
            gap = own - of_y
            floor = np.maximum(np.maximum(gap, 0).sum(1), np.maximum(-gap, 0).sum(1))
            best, found = None, []
            order = np.argsort(floor, kind="stable")
            for at in range(0, len(order), AT_ONCE):
                some = [i for i in order[at : at + AT_ONCE] if (best is None or floor[i] <= best) and texts[i] != s]
                if some:
                    d = edits.distances(s, [texts[i] for i in some])
                    if best is None or d.min() < best:
                        best, found = int(d.min()), []
                    found += [texts[i] for i, x in zip(some, d, strict=True) if x == best]
            yield pd.DataFrame({"item": [s] * len(found), "candidate": found, "distance": np.full(len(found), best or 0, np.int32)})

    every = grid(x, y, 4 * F.char_length("text") + 64, compare, "item string, candidate string, distance int", block_bytes)
    least = every.groupBy("item").agg(F.min("distance").alias("distance"))
    return every.join(least, ["item", "distance"])
