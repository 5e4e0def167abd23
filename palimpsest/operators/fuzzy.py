"""Fuzzy text: the best partial ratios of queries, and closest texts by segments.

*Partial ratio.*  Queries are a stated set and go over the table's distinct texts in chunks of bounded size; a task keeps the k best of each.

*Closest texts.*  Two texts within t edits share one of t + 1 segments into which either is cut, at places that differ by at
most t.  For t = 1 and then 3, texts join on (length, segment, its characters) and what meets is measured; a text that has found a
partner within t has found all its closest ones.  What is left after that is far from everything, and is compared in blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import edits
from palimpsest.operators import blocks
from palimpsest.operators.ranking import top_k
from palimpsest.operators.tables import cut

QUERY_CHARS = 1 << 20
THRESHOLDS = (1, 3)
#: Texts that are aligned with a query at a time, the most promising first.
AT_ONCE = 256
#: Parts of the distinct texts for each core.
SPREAD = 2


class _Letters:
    """What letters allow: with c letters in common and s letters in the shorter text, no window's ratio is over 2 c / (s + c)."""

    def __init__(self, texts: list[str]):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.alphabet, at = np.unique(edits.codes("".join(texts)), return_inverse=True)
        self.counts = np.zeros((len(texts), len(self.alphabet)), np.int32)
        np.add.at(self.counts, (np.repeat(np.arange(len(texts)), self.sizes), at), 1)

    def bound(self, query: str) -> np.ndarray:
        chars, n = np.unique(edits.codes(query), return_counts=True)
        own = np.zeros(len(self.alphabet), np.int32)
        known = np.isin(chars, self.alphabet)
        own[np.searchsorted(self.alphabet, chars[known])] = n[known]
        shared = np.minimum(self.counts, own).sum(1)
        out = 200 * shared / np.maximum(np.minimum(self.sizes, len(query)) + shared, 1)
        return np.where((self.sizes == 0) & (not query), 100.0, out)


def _scores(ratio: edits.Partial, texts: list[str], bound: np.ndarray, best: list[float], k: int) -> np.ndarray:
    """The ratios of the texts that can be among the k best, given the best so far; -inf for the others."""
    out, order = np.full(len(texts), -np.inf), np.argsort(-bound, kind="stable")
    best = heapq.nlargest(k, best)
    for at in range(0, len(order), AT_ONCE):
        some = order[at : at + AT_ONCE]
        if len(best) == k:
            some = some[bound[some] + 1e-5 >= best[-1]]
        if not len(some):
            break
        out[some] = np.round(ratio.many([texts[i] for i in some]), 6)
        best = heapq.nlargest(k, best + out[some].tolist())
    return out


def partial_ratio_top_k(rows: DataFrame, key: str, text: str, queries: DataFrame, k: int, query_chars: int = QUERY_CHARS) -> DataFrame:
    """(query, id, score, rank): the k best partial ratios (0 to 100) of each query (query, question), lower-cased, ties to the smaller id.

    A null text or question takes no part; repeated rows count each.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    context = rows.sparkSession.sparkContext
    asked = queries.filter("question is not null").select("query", "question")
    kinds = f"query {asked.schema['query'].dataType.simpleString()}, id {rows.schema[key].dataType.simpleString()}, score double"
    n = max(1, -(-int(asked.agg(F.sum(F.char_length("question") + 64)).first()[0] or 0) // query_chars))
    narrow = rows.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))

    # Equal texts are aligned once: a text goes with the k smallest of its ids, more can't be among the k best.
    of = top_k(narrow, ["text"], ["id"], k).groupBy("text").agg(F.collect_list("id").alias("ids"))
    texts = cut(of.repartition(SPREAD * context.defaultParallelism), "distinct-texts")  # aligning costs far more than moving

    def best(shared):
        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            chunk = [(q, edits.Partial(t.lower())) for q, t in shared.value]
            kept: list[list] = [[] for _ in chunk]
            for pdf in parts:
                lows, at = np.unique(pdf["text"].str.lower().to_numpy(dtype=object), return_inverse=True)
                ids = [i.tolist() for i in pdf["ids"]]
                lows = lows.tolist()
                letters = _Letters(lows)
                for q, (_, ratio) in enumerate(chunk):
                    scores = _scores(ratio, lows, letters.bound(ratio.query), [-s for s, _ in kept[q]], k)[at]
                    enough = np.partition(scores, -k)[-k] if k <= len(scores) else -np.inf
                    rows = np.flatnonzero((scores >= enough) & np.isfinite(scores))
                    kept[q] = heapq.nsmallest(k, kept[q] + [(-float(scores[i]), x) for i in rows for x in ids[i]])
            found = [(q, i, -s) for (q, _), own in zip(chunk, kept, strict=True) for s, i in own]
            yield pd.DataFrame(found, columns=["query", "id", "score"])

        return run

    parts = []
    for c in range(n):
        some = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("query"), F.lit(n)) == c).collect()]
        if some:
            parts.append(texts.mapInPandas(best(context.broadcast(some)), kinds))
    if not parts:
        return rows.sparkSession.createDataFrame([], f"{kinds}, rank int")
    return top_k(reduce(DataFrame.unionByName, parts), ["query"], [F.desc("score"), "id"], k)


def _segments(length: int, most: int) -> list[tuple[int, int]]:
    """(start, end) of most + 1 segments of nearly equal length."""
    short, longer = divmod(length, most + 1)
    out, at = [], 0
    for i in range(most + 1):
        end = at + short + (i >= most + 1 - longer)
        out.append((at, end))
        at = end
    return out


_KEY = "text string, size int, segment int, part string"


def _indexed(most: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t in pdf["text"]:
                if len(t) <= most:
                    out.append((t, len(t), -1, ""))  # too short to be cut: meets every text of such a length
                else:
                    out += [(t, len(t), i, t[a:b]) for i, (a, b) in enumerate(_segments(len(t), most))]
            yield pd.DataFrame(out, columns=["text", "size", "segment", "part"])

    return run


def _probing(most: int):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for t in pdf["text"]:
                for size in range(max(0, len(t) - most), len(t) + most + 1):
                    if size <= most:
                        out.append((t, size, -1, ""))
                        continue
                    for i, (a, b) in enumerate(_segments(size, most)):
                        starts = range(max(0, a - most), min(len(t) - (b - a), a + most) + 1)
                        out += [(t, size, i, p) for p in {t[s : s + b - a] for s in starts}]
            yield pd.DataFrame(out, columns=["text", "size", "segment", "part"])

    return run


def within(items: DataFrame, candidates: DataFrame, most: int) -> DataFrame:
    """(item, candidate, distance): different texts of items (item) and candidates (candidate) within `most` edits; both are distinct."""
    probes = items.select(F.col("item").alias("text")).mapInPandas(_probing(most), _KEY).withColumnRenamed("text", "item")
    index = candidates.select(F.col("candidate").alias("text")).mapInPandas(_indexed(most), _KEY).withColumnRenamed("text", "candidate")
    pairs = probes.join(index, ["size", "segment", "part"]).select("item", "candidate").filter("item <> candidate").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for item, some in pdf.groupby("item", sort=False):
                d = edits.distances(item, list(some["candidate"]))
                near = d <= most
                yield pd.DataFrame({"item": item, "candidate": some["candidate"].to_numpy()[near], "distance": d[near].astype("int32")})

    return pairs.mapInPandas(run, "item string, candidate string, distance int")


def closest_texts(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """(item, candidate, distance): for each text of items the other texts of candidates at the least edit distance, all of them; both are distinct."""
    left, found = items.select("item"), []
    for most in THRESHOLDS:
        near = within(left, candidates, most)
        least = near.groupBy("item").agg(F.min("distance").alias("distance"))
        found.append(cut(near.join(least, ["item", "distance"]).select("item", "candidate", "distance"), "closest-found"))
        left = cut(left.join(found[-1].select("item").distinct(), "item", "left_anti"), "closest-left")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
    far = blocks.closest_texts(left, candidates).select("item", "candidate", "distance")
    return reduce(DataFrame.unionByName, [*found, far])
