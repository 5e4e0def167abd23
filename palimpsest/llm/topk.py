"""Exact inner-product top-k by columnar branch-and-bound.

Vectors are turned to integers, floor(1024 x), of any size.  A task stacks its candidates into vertical blocks
(one row a dimension).  For a query it adds up the inner product one block of dimensions at a time;
after each, a candidate stays only if its sum so far, plus the product of what is left of both
norms (Cauchy-Schwarz), can still reach the query's k-th best; survivors are compacted.  The bound
starts from the k-th best among a bounded set of candidates, which is a true bound for all of them.

Queries go over the candidates in chunks of about `chunk_bytes`, each chunk broadcast (so bounded by
construction) to one pass over all candidates, whose results are written before the next chunk begins;
neither side has to fit anywhere.  A task sends at most k rows for each query of the chunk.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without an id; vectors of other lengths than the query's are no candidates; rows that repeat a
query's id are its own row, and of those the least vector is the query; candidates that repeat an id or
a row each count; ties go to the smaller id; scores beyond a long are held at its ends; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import written

SCALE = 1024.0
_ROW = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())])
_EXACT = float(1 << 53)


def cut(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) / 1024, which every finite double has; from 2^53 on doubles are integers, and stay."""
    values = values.astype(np.float64)
    small = np.abs(values) < _EXACT
    return np.where(small, np.floor(SCALE * np.where(small, values, 0.0)) / SCALE, values)


def _whole(x: float) -> int:
    """1024 x as an integer, of any size."""
    return int(x * SCALE) if abs(x) < _EXACT else int(x) * int(SCALE)


def _clamped(scores: list) -> np.ndarray:
    return np.array([min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in scores], np.int64)


class Best:
    """The k best (score, id) of each query that were seen, and the score to reach."""

    def __init__(self, n: int, k: int, bounds: np.ndarray | None):
        self.k = k
        self.ids = [np.empty(0, np.int64)] * n
        self.scores = [np.empty(0, np.int64)] * n
        self.bound = np.full(n, -np.inf) if bounds is None else bounds.astype(np.float64)

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores.astype(object) if len(scores) and scores.min() == -(1 << 63) else -scores))
        ids, scores = ids[order], scores[order]
        self.ids[q], self.scores[q] = ids[: self.k], scores[: self.k]
        if len(ids) >= self.k:
            self.bound[q] = max(self.bound[q], float(scores[self.k - 1]))


def _search_whole(best: Best, at: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> int:
    if not len(queries) or not len(rows):
        return 0
    big = [[_whole(x) for x in r] for r in rows.tolist()]
    for p, qid, q in zip(at, query_ids, queries, strict=True):
        whole, own = [_whole(x) for x in q.tolist()], ids != qid
        best.add(p, ids[own], _clamped([sum(a * b for a, b in zip(whole, r, strict=True)) for r, o in zip(big, own, strict=True) if o]))
    return queries.size * len(rows)


def search_block(best: Best, at: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, step: int = 8) -> int:
    """Update best with cut candidates (ids, rows) for cut queries (their places in best: at); returns the products computed."""
    dims = rows.shape[1]
    most = np.sqrt(_EXACT / max(1, dims)) / 2 / SCALE
    if dims and len(rows) and len(queries) and max(np.abs(queries).max(), np.abs(rows).max()) > most:
        # Some products may be too large for exact doubles: those of few and huge components, which meet all others as whole Python integers.
        few_q, few_r = np.abs(queries).max(1) > most, np.abs(rows).max(1) > most
        work = _search_whole(best, at[few_q], query_ids[few_q], queries[few_q], ids, rows)
        work += _search_whole(best, at[~few_q], query_ids[~few_q], queries[~few_q], ids[few_r], rows[few_r])
        return work + search_block(best, at[~few_q], query_ids[~few_q], queries[~few_q], ids[~few_r], rows[~few_r], step)
    columns, queries = np.ascontiguousarray(rows.T * SCALE), queries * SCALE
    left = np.sqrt(np.cumsum((columns**2)[::-1], axis=0)[::-1])
    left = np.vstack([left, np.zeros((1, len(rows)))])
    work = 0
    for p, qid, q in zip(at, query_ids, queries, strict=True):
        mass = np.append(np.sqrt(np.cumsum((q**2)[::-1])[::-1]), 0.0)
        bound = best.bound[p]
        alive = np.flatnonzero((ids != qid) & (mass[0] * left[0] * (1 + 1e-9) + 1e-6 >= bound))
        total = np.zeros(len(alive))
        for d in range(0, dims, step):
            e = min(d + step, dims)
            total += q[d:e] @ (columns[d:e] if len(alive) == len(ids) else columns[d:e, alive])
            work += (e - d) * len(alive)
            keep = total + mass[e] * left[e, alive] * (1 + 1e-9) + 1e-6 >= bound
            if not keep.all():
                alive, total = alive[keep], total[keep]
            if not len(alive):
                break
        if len(alive):
            best.add(p, ids[alive], total.astype(np.int64))
    return work


def _vectors(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(ids, integer rows) by length."""
    lists = batch.column(1)
    lengths = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    out = {}
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        out[int(n)] = ids[own], cut(flat[starts[own, None] + np.arange(n)])
    return out


def _pass(candidates: DataFrame, shared, k: int, block: int) -> DataFrame:
    """A task's best rows for each query of the broadcast chunk {length: (place, ids, rows)}, bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, bounds = shared.value
        best = Best(sum(len(x[0]) for x in queries.values()), k, bounds)
        held: dict[int, list] = {}

        def work(n: int) -> None:
            ids, rows = (np.concatenate(x) for x in zip(*held.pop(n), strict=True))
            for i in range(0, len(ids), block):
                search_block(best, *queries[n], ids[i : i + block], rows[i : i + block])

        for b in batches:
            for n, part in _vectors(b).items():
                if n in queries:
                    held.setdefault(n, []).append(part)
                    if sum(len(x[0]) for x in held[n]) >= block:
                        work(n)
        for n in list(held):
            work(n)
        for places, ids, _ in queries.values():
            for p, qid in zip(places, ids, strict=True):
                if len(best.ids[p]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best.ids[p]), qid)), pa.array(best.ids[p]), pa.array(best.scores[p])], names=_ROW.names)

    return candidates.mapInArrow(run, _ROW)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id long, vec array<double>) of the rows that take part."""
    vec = F.col(vec_col).cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    got = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
    return got.filter(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", odd))


def top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", chunk_bytes: int = 16 << 20, block: int = 4096, first: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every row of df for which is_query (over id) holds."""
    spark = df.sparkSession
    candidates = usable(df, id_col, vec_col)
    queries = candidates.filter(is_query)
    size = queries.agg(F.sum(8 * F.size("vec") + 64)).first()[0] or 0
    n_chunks = max(1, -(-size // chunk_bytes))
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    parts = []
    for c in range(n_chunks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(n_chunks)) == c).groupBy("id").agg(F.min("vec").alias("vec")).orderBy("id").collect()
        by: dict[int, tuple[list, list, list]] = {}
        for place, r in enumerate(rows):
            for to, x in zip(by.setdefault(len(r["vec"]), ([], [], [])), (place, r["id"], r["vec"]), strict=True):
                to.append(x)
        arrays = {n: (np.array(p), np.array(i, np.int64), cut(np.array(v, np.float64)).reshape(len(p), n)) for n, (p, i, v) in by.items()}
        some = _pass(candidates.limit(first).coalesce(1), spark.sparkContext.broadcast((arrays, None)), k, block)
        reached = {r[0]: r[1] for r in some.withColumn("r", ranked).filter(F.col("r") == k).select("query_id", "score").collect()}
        bounds = np.array([reached.get(r["id"], -np.inf) for r in rows], np.float64)
        shared = spark.sparkContext.broadcast((arrays, bounds))
        found = _pass(candidates, shared, k, block)
        if n_chunks > 1:
            found = written(found.withColumn("rank", ranked).filter(F.col("rank") <= k).select(*_ROW.names), "topk-chunk")
            shared.unpersist()
        parts.append(found)
    found = reduce(DataFrame.unionByName, parts)
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_columnar_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


#: For finite vectors of one length with unique ids, as in the tables.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
