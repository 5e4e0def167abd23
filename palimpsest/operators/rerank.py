"""Reranking of memories together with the dialogue they come from.

A strategy turns candidates into passages, any function of (question, passage) scores them, and the strategy makes
items of the scores again.  All of it is joins and windows by query or item, so any number of queries is reranked at once.

* candidates: (query, question, item, memory, background, position); position is the place in the first list.
* sources: (item, ix, kind, content, chat_time), a row a message in the order of ix.

A leading [tag] of a memory is left out of passages.  Null memories, backgrounds, contents and times are empty; messages with
equal ix are ordered by content; an item without sources has no pair, hence no row in the strategies by pairs.  Repeated candidates
of a query count once.  Equal scores are ordered by item, then by pair.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.functions import text as tx
from palimpsest.operators.ranking import ranked, top_k
from palimpsest.operators.tables import cut

Scorer = Callable[[Column, Column], Column]
RECENT, MOST = 10, 2048
#: Most frequent words that every task of the compressor knows.
KNOWN = 1 << 16
#: White space as in Spark's patterns.
_SPACES = re.compile(r"[ \t\n\x0b\f\r]+")


def overlap(question: Column, passage: Column) -> Column:
    """Share of the question's distinct tokens that the passage has; a model takes its place as a Pandas UDF of both."""
    asked = F.array_distinct(tx.ascii_tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, tx.ascii_tokens(passage))), F.size(asked)), F.lit(0.0))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _candidates(rows: DataFrame) -> DataFrame:
    first = ranked(rows, ["query", "item"], ["position"], "_p").filter("_p = 1")
    tagless = F.regexp_replace(_text("memory"), r"^\s*\[[^\]]*\]\s*", "")
    return first.select("query", "question", "item", "position", _text("memory").alias("memory"), tagless.alias("bare"), _text("background").alias("background"))


def _said(sources: DataFrame) -> DataFrame:
    return sources.select("item", "ix", "kind", _text("content").alias("content"), _text("chat_time").alias("chat_time"))


def pairs(sources: DataFrame) -> DataFrame:
    """(item, piece, said): the messages of an item two by two, the last one alone if their number is odd; pairs without a text are left out."""
    at = ranked(_said(sources), ["item"], ["ix", "content"], "_n").withColumn("_n", F.col("_n") - 1)
    side = lambda name, odd: F.coalesce(F.max(F.when(F.col("_n") % 2 == odd, F.col(name))), F.lit(""))
    two = at.groupBy("item", F.floor(F.col("_n") / 2).alias("piece")).agg(side("chat_time", 0).alias("time"), side("content", 0).alias("user"), side("content", 1).alias("assistant"))
    said = F.concat(F.lit("["), "time", F.lit("]: \nuser: "), "user", F.lit("\nassistant: "), "assistant")
    return two.filter("user <> '' OR assistant <> ''").select("item", "piece", said.alias("said"))


def recent(sources: DataFrame, last: int = RECENT, most: int = MOST) -> DataFrame:
    """(item, said): lines of an item's last messages, in order, up to the one with which they get longer than `most` characters."""
    line = F.concat(F.lit("["), "chat_time", F.lit("]: "), "content", F.lit("\n"))
    tail = ranked(_said(sources), ["item"], [F.desc("ix"), F.desc("content")], "_r").filter(F.col("_r") <= last)
    lines = tail.filter("content <> ''").withColumn("line", line)
    before = F.sum(F.char_length("line")).over(Window.partitionBy("item").orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, -1))
    kept = lines.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") <= most)
    in_order = F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("at"), "line")))  # `last` of them at most
    return kept.groupBy("item").agg(F.array_join(F.transform(in_order, lambda x: x["line"]), "").alias("said"))


def files(sources: DataFrame) -> DataFrame:
    """(item, said): the contents of an item's file sources, one behind the other."""
    held = _said(sources).filter("kind = 'file'")
    in_order = F.array_sort(F.collect_list(F.struct("ix", "content")))  # one passage, which is what is scored
    return held.groupBy("item").agg(F.array_join(F.transform(in_order, lambda x: x["content"]), "").alias("said")).filter("said <> ''")


@dataclass(frozen=True)
class Strategy:
    """passages: (candidates, sources) to rows with piece, passage and, as `rebuilt`, the memory to give back; by_item: an item's best passage counts."""

    passages: Callable[[DataFrame, DataFrame], DataFrame]
    by_item: bool = False


def _by_pair(c: DataFrame, sources: DataFrame) -> DataFrame:
    rows = c.join(pairs(sources), "item").withColumn("passage", F.concat("bare", F.lit("\n\n"), "said"))
    return rows.withColumn("rebuilt", F.concat("bare", F.lit("\n\nsources-dialogue-pairs"), "said"))


def _pairs_outside(c: DataFrame, sources: DataFrame) -> DataFrame:
    return _by_pair(c, sources).withColumn("rebuilt", F.col("memory"))


def _with_recent(c: DataFrame, sources: DataFrame) -> DataFrame:
    rows = c.join(recent(sources), "item", "left").withColumn("passage", F.concat("bare", F.lit("\n"), _text("said")))
    return rows.withColumn("piece", F.lit(0).cast("long")).withColumn("rebuilt", F.col("memory"))


def _with_background(c: DataFrame, _: DataFrame) -> DataFrame:
    rows = c.withColumn("passage", F.concat("bare", F.lit("\n"), "background"))
    return rows.withColumn("piece", F.lit(0).cast("long")).withColumn("rebuilt", F.concat("memory", F.lit("\n"), "passage"))


def _with_files(c: DataFrame, sources: DataFrame) -> DataFrame:
    """Of a query's candidates with the same file text only the first is scored."""
    rows = c.join(files(sources), "item", "left")
    with_text = ranked(rows.filter("said IS NOT NULL").withColumn("_d", F.sha2("said", 256)), ["query", "_d"], ["position", "item"], "_f").filter("_f = 1").drop("_d", "_f")
    rows = with_text.unionByName(rows.filter("said IS NULL"))
    passage = F.when(F.col("said").isNull(), F.col("bare")).otherwise(F.concat("bare", F.lit("\n\n[Sources]:\n"), "said"))
    rows = rows.withColumn("passage", passage).withColumn("piece", F.lit(0).cast("long"))
    return rows.withColumn("rebuilt", F.concat("memory", F.lit("\n"), "passage"))


STRATEGIES = {
    "single_turn": Strategy(_by_pair),
    "singleturn_outmem": Strategy(_pairs_outside, by_item=True),
    "concat_sources": Strategy(_with_recent),
    "concat_background": Strategy(_with_background),
    "concat_docsource": Strategy(_with_files),
}


def rerank(candidates: DataFrame, sources: DataFrame, strategy: str, k: int, score: Scorer = overlap) -> DataFrame:
    """(query, item, piece, memory, score, rank): the k best of each query."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    plan = STRATEGIES[strategy]
    rows = plan.passages(_candidates(candidates), sources)
    scored = rows.select("query", "item", "piece", F.col("rebuilt").alias("memory"), F.round(score(F.col("question"), F.col("passage")), 6).alias("score"))
    if plan.by_item:
        scored = top_k(scored, ["query", "item"], [F.desc("score"), "piece"], 1).drop("rank")
    return top_k(scored, ["query"], [F.desc("score"), "item", "piece"], k)


def entropy_kept(df: DataFrame, key: str, text: str, share: float, known: int = KNOWN) -> DataFrame:
    """(key, kept): the int(share x n) words of a text, at least one, that tell most under the table's word frequencies, in order.

    Rare words tell most; of equally frequent ones the earlier stays.  A text without words, or a null one, gives ''.

    The `known` most frequent words go to every task.  Where no more of a text's words are rarer than those than may stay, all the
    rarer ones stay whatever their numbers, and the text is done where it is read; only words of the other texts meet their numbers in a join.
    """
    rows = df.select(F.col(key).alias("_k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    often = cut(rows.select(F.explode(_words(F.col("_t"))).alias("_word")).groupBy("_word").agg(F.count("*").alias("_often")), "word-counts")
    most = often.orderBy(F.desc("_often")).limit(known + 1).collect()  # `known` rows, whatever the table
    bar = most[known]["_often"] if len(most) > known else 0
    shared = df.sparkSession.sparkContext.broadcast({r["_word"]: r["_often"] for r in most if r["_often"] > bar})

    def kept(t: str, numbers: dict[str, int]) -> str | None:
        words = [w for w in _SPACES.split(t) if w]
        counts = np.fromiter((numbers.get(w, 0) for w in words), np.int64, len(words))
        n = max(1, math.floor(len(words) * share))
        if np.count_nonzero(counts == 0) > n:
            return None
        return " ".join(words[i] for i in np.sort(np.argsort(counts, kind="stable")[:n]))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            pdf["kept"] = [kept(t, shared.value) for t in pdf["_t"]]
            pdf["_t"] = pdf["_t"].where(pdf["kept"].isna(), None)
            yield pdf

    again = cut(rows.groupBy(F.col("_k").alias("_same")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_same"), "repeated-texts")
    if again.isEmpty():
        once, open_texts = rows, []
    else:  # texts of one key are one text
        same = F.col("_k").eqNullSafe(F.col("_same"))
        once, open_texts = rows.join(again, same, "left_anti"), [rows.join(again, same, "left_semi")]
    schema = T.StructType([T.StructField("_k", rows.schema["_k"].dataType), T.StructField("_t", T.StringType()), T.StructField("kept", T.StringType())])
    done = cut(once.mapInPandas(run, schema), "kept-words")
    undecided = reduce(DataFrame.unionByName, [done.filter("kept IS NULL").select("_k", "_t"), *open_texts])
    every = done.filter("kept IS NOT NULL").select("_k", "kept").unionByName(_kept_by_join(undecided, often, share))
    return every.withColumnRenamed("_k", key)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _kept_by_join(texts: DataFrame, often: DataFrame, share: float) -> DataFrame:
    """(_k, kept) of texts (_k, _t) by the numbers of all their words (_word, _often)."""
    rows = texts.select("_k", F.posexplode_outer(_words(F.col("_t"))).alias("_at", "_word"))
    total = often.agg(F.sum("_often")).first()[0] or 0
    hot = often.filter(F.col("_often") * 1000 >= total)  # a thousand words at most, so that no frequent word fills a task
    met = rows.join(F.broadcast(hot), "_word", "left")
    rare = met.filter("_word IS NOT NULL AND _often IS NULL").drop("_often").join(often, "_word")
    each = met.filter("_word IS NULL OR _often IS NOT NULL").unionByName(rare)
    n = F.count("_word").over(Window.partitionBy("_k"))
    placed = ranked(each.withColumn("_n", n), ["_k"], [F.asc_nulls_last("_often"), "_at"], "_r").filter(F.col("_r") <= F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(share))))
    in_order = F.array_sort(F.collect_list(F.struct("_at", "_word")))  # words of one text
    return placed.groupBy("_k").agg(F.array_join(F.transform(in_order, lambda x: x["_word"]), " ").alias("kept"))


def topic_segments(df: DataFrame, by: str, order: str, similarity: str, bar: float, most: int) -> DataFrame:
    """df with `segment`: a turn whose similarity to the one before is under the bar begins a topic; one of more than `most` turns is cut into pieces of that many."""
    seen = Window.partitionBy(by).orderBy(order)
    begins = (F.coalesce(F.col(similarity) < bar, F.lit(False)) & F.lag(F.lit(1)).over(seen).isNotNull()).cast("int")
    topics = df.withColumn("_b", begins).withColumn("_topic", F.sum("_b").over(seen.rowsBetween(Window.unboundedPreceding, 0)))
    within = F.row_number().over(Window.partitionBy(by, "_topic").orderBy(order)) - 1
    pieces = topics.withColumn("_piece", F.floor(within / most))
    return pieces.withColumn("segment", F.dense_rank().over(Window.partitionBy(by).orderBy("_topic", "_piece")) - 1).drop("_b", "_topic", "_piece")
