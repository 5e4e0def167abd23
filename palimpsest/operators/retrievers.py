"""What can be plugged in: retrievers, embedders, rerankers and other parts by name, search kinds, datasets, SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.operators import blocks, joins, lexical, rerank, topk
from palimpsest.sources import ingest


class Retriever(Protocol):
    """memorize rows (doc, text, ...); query rows (query, question) for (query, doc, score, rank); reset forgets all."""

    def memorize(self, rows: DataFrame) -> None: ...

    def query(self, questions: DataFrame, k: int) -> DataFrame: ...

    def reset(self) -> None: ...


class GrowingIndex:
    """A BM25 index under a folder that takes rows batch by batch: only new rows are tokenised, statistics are sums over batches.

    A batch is postings/vN, frequencies/vN and sizes/vN; it counts once sizes/vN, written last, is complete.  Rows whose
    doc is known, null or repeated in the batch (the least text stays) add nothing, so a batch may come again.  One writer
    at a time: what a crash left incomplete is overwritten.

    As soon as `fan` batches of about the same size (within a factor of `fan`) are there, they are merged into one, so a row is
    rewritten a logarithmic number of times and few batches are open at a time.  A merge is a batch with merges/vN, the numbers that it
    replaces; that is written first, so the merge takes their place in the moment in which it counts.  Replaced batches stay
    for those who read them until `vacuum`.
    """

    PARTS = ("merges", "postings", "frequencies", "sizes")

    def __init__(self, spark: SparkSession, root: str, tokens: Callable[[Column], Column] = tx.words, fan: int = 8):
        if fan < 2:
            raise ValueError("fan must be at least 2")
        self.spark, self.root, self.tokens, self.fan = spark, root.rstrip("/"), tokens, fan

    def _path(self, part: str, version: int) -> str:
        return f"{self.root}/{part}/v{version}"

    def batches(self) -> list[int]:
        """Numbers of the batches that count: complete ones that no complete merge replaces."""
        done = set(ingest._versions(self.spark, f"{self.root}/sizes"))
        merges = [self._path("merges", v) for v in ingest._versions(self.spark, f"{self.root}/merges") if v in done]
        replaced = {r[0] for r in self.spark.read.parquet(*merges).collect()} if merges else set()  # a number a batch
        return sorted(done - replaced)

    def _of(self, part: str, versions: Sequence[int]) -> DataFrame:
        return self.spark.read.parquet(*[self._path(part, v) for v in versions])

    def _read(self, part: str) -> DataFrame | None:
        live = self.batches()
        return self._of(part, live) if live else None

    def _next(self) -> int:
        return max(ingest._newest(self.spark, f"{self.root}/{part}") for part in self.PARTS) + 1

    def merge(self, versions: Sequence[int]) -> None:
        """These batches as one."""
        n = self._next()
        self.spark.createDataFrame([(v,) for v in versions], "version int").coalesce(1).write.mode("overwrite").parquet(self._path("merges", n))
        self._of("postings", versions).repartition("doc").write.mode("overwrite").parquet(self._path("postings", n))
        self._of("frequencies", versions).groupBy("term").agg(F.sum("df").alias("df")).write.mode("overwrite").parquet(self._path("frequencies", n))
        self._of("sizes", versions).agg(F.sum("n").alias("n"), F.sum("length").alias("length")).coalesce(1).write.mode("overwrite").parquet(self._path("sizes", n))

    def _full_tier(self) -> list[int] | None:
        tiers: dict[int, list[int]] = {}
        for v in self.batches():
            n, tier = self._of("sizes", [v]).first()["n"], 0
            while n >= self.fan:
                n, tier = n // self.fan, tier + 1
            tiers.setdefault(tier, []).append(v)
        return next((found for _, found in sorted(tiers.items()) if len(found) >= self.fan), None)

    def vacuum(self) -> None:
        """Deletes what merges have replaced, and what was left incomplete; nobody may be reading it."""
        live = set(self.batches())
        for part in ("sizes", "frequencies", "postings"):  # sizes first: without them a batch doesn't count; merges stay
            for v in range(1, self._next()):
                if v not in live:
                    ingest._remove(self.spark, self._path(part, v))

    def memorize(self, rows: DataFrame) -> None:
        n = self._next()
        new = rows.filter("doc is not null").groupBy("doc").agg(F.min("text").alias("text"))
        if (known := self._read("postings")) is not None:
            new = new.join(known.select("doc"), "doc", "left_anti")
        words = new.select("doc", F.coalesce(self.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens")).withColumn("dl", F.size("tokens"))
        counted = words.select("doc", "dl", F.explode_outer("tokens").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
        counted.write.mode("overwrite").parquet(self._path("postings", n))  # a document without words keeps a row of a null term
        stored = self.spark.read.parquet(self._path("postings", n))
        stored.filter("term is not null").groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(self._path("frequencies", n))
        once = stored.groupBy("doc").agg(F.first("dl").alias("dl"))
        once.agg(F.count("*").alias("n"), F.sum("dl").alias("length")).coalesce(1).write.mode("overwrite").parquet(self._path("sizes", n))
        while (full := self._full_tier()) is not None:
            self.merge(full)

    def index(self) -> lexical.Index:
        if (sizes := self._read("sizes")) is None:
            raise ValueError(f"{self.root} holds no batch")
        size = sizes.agg(F.sum("n").alias("n"), (F.sum("length") / F.sum("n")).alias("avgdl"))
        df = self._read("frequencies").groupBy("term").agg(F.sum("df").alias("df"))
        return lexical.Index(self._read("postings").filter("term is not null"), lexical.idf_of(df, size), size)

    def query(self, questions: DataFrame, k: int) -> DataFrame:
        return lexical.bm25_top_k(lexical.bm25_scores(self.index(), questions, "query", self.tokens(F.col("question"))), k)

    def export(self, path: str, version: int) -> None:
        """The merged index as a snapshot of a schema version."""
        ix = self.index()
        ingest.save_snapshot({"postings": ix.postings, "terms": ix.terms, "size": ix.size}, path, version)

    @staticmethod
    def load(spark: SparkSession, path: str, versions: Sequence[int]) -> lexical.Index:
        t = ingest.load_snapshot(spark, path, versions)
        return lexical.Index(t["postings"], t["terms"], t["size"])

    def reset(self) -> None:
        ingest._remove(self.spark, self.root)


@dataclass(frozen=True)
class Embedder:
    """Texts to vectors by encode(list of texts), in Arrow batches; vectors get length 1, a null or empty text a null."""

    encode: Callable[[list[str]], Sequence[Sequence[float]]]

    def embed(self, text: Column) -> Column:
        encode = self.encode

        @F.pandas_udf("array<double>")
        def run(texts: pd.Series) -> pd.Series:
            real = [t for t in texts if t]
            vectors = iter(())
            if real:
                found = np.asarray(encode(real), dtype=float)
                length = np.linalg.norm(found, axis=1, keepdims=True)
                vectors = iter(found / np.where(length == 0, 1.0, length))
            return pd.Series([next(vectors) if t else None for t in texts], dtype=object)

        return run(text)


class VectorRetriever:
    """Dense retrieval over a VectorTable; texts become vectors once, when they are memorised."""

    def __init__(self, spark: SparkSession, root: str, name: str, embedder: Embedder):
        self.table, self.embedder = ingest.VectorTable(spark, root, name), embedder

    def memorize(self, rows: DataFrame) -> None:
        new = rows.select(F.col("doc").cast("string").alias("id"), F.col("text").alias("payload"))
        new = new.join(self.table.rows.select("id"), "id", "left_anti")
        self.table.insert(new.select("id", self.embedder.embed(F.col("payload")).alias("vector"), "payload"))

    def query(self, questions: DataFrame, k: int) -> DataFrame:
        q = questions.select(F.concat(F.lit("?"), F.col("query").cast("string")).alias("id"), self.embedder.embed(F.col("question")).alias("vector"))
        found = blocks.neighbours(q, self.table.rows, "id", "vector", k)
        return found.select(F.substring("id", 2, 1 << 30).alias("query"), F.col("other").alias("doc"), "score", "rank")

    def reset(self) -> None:
        self.table.drop()


class OverlapRetriever:
    """Retrieval by the share of the question's tokens that a text has, over the rows themselves; known docs come in once."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows = spark, None

    def memorize(self, rows: DataFrame) -> None:
        new = rows.filter("doc IS NOT NULL").groupBy("doc").agg(F.min("text").alias("text"))
        self.rows = new if self.rows is None else self.rows.unionByName(new.join(self.rows.select("doc"), "doc", "left_anti"))

    def query(self, questions: DataFrame, k: int) -> DataFrame:
        if self.rows is None:
            raise ValueError("nothing is memorised")
        return lexical.overlap_top_k(questions, "query", "question", self.rows, "doc", "text", k)

    def reset(self) -> None:
        self.rows = None


class Parts:
    """Makers by name, of one sort: an unknown name is an error, and no name is taken twice."""

    def __init__(self, sort: str):
        self.sort, self._makers = sort, {}

    def register(self, *names: str) -> Callable:
        def keep(maker: Callable) -> Callable:
            for name in names:
                if name in self._makers:
                    raise ValueError(f"{self.sort} {name} exists")
                self._makers[name] = maker
            return maker

        return keep

    def make(self, name: str | None, **options) -> Callable:
        key = (name or "none").lower()
        if key not in self._makers:
            raise ValueError(f"unknown {self.sort}: {name}")
        return self._makers[key](**options)

    def names(self) -> list[str]:
        return sorted(self._makers)


RERANKERS, SEGMENTERS, COMPRESSORS = Parts("reranker"), Parts("segmenter"), Parts("compressor")


@RERANKERS.register("noop", "none", "disabled")
def _as_it_is(**_) -> Callable[[DataFrame], DataFrame]:
    return lambda scored: scored


@RERANKERS.register("cosine", "cosine_local")
def _by_level(level: str, weights: Mapping[str, float], k: int, tie: str) -> Callable[[DataFrame], DataFrame]:
    return lambda scored: topk.weighted_rerank(scored, level, weights, k, tie)


@RERANKERS.register("concat", "concat_sources")
def _by_sources(k: int, score: rerank.Scorer = rerank.overlap) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda candidates, sources: rerank.rerank(candidates, sources, "concat_sources", k, score)


@RERANKERS.register("strategy")
def _by_strategy(k: int, strategy: str = "single_turn", score: rerank.Scorer = rerank.overlap) -> Callable[[DataFrame, DataFrame], DataFrame]:
    if strategy not in rerank.STRATEGIES:
        raise ValueError(f"unknown strategy: {strategy}")
    return lambda candidates, sources: rerank.rerank(candidates, sources, strategy, k, score)


@SEGMENTERS.register("topics")
def _topics(by: str, order: str, similarity: str, bar: float, most: int) -> Callable[[DataFrame], DataFrame]:
    return lambda df: rerank.topic_segments(df, by, order, similarity, bar, most)


@SEGMENTERS.register("paragraphs")
def _paragraphs(key: str, text: str, most: int) -> Callable[[DataFrame], DataFrame]:
    from palimpsest.functions import chunks

    return lambda df: chunks.paragraphs(df, key, text, most)


@SEGMENTERS.register("windows")
def _simple(key: str, text: str, size: int, overlap: int) -> Callable[[DataFrame], DataFrame]:
    from palimpsest.functions import chunks

    return lambda df: chunks.simple(df, key, text, size, overlap)


@COMPRESSORS.register("informative")
def _informative(word: str, score: str, share: float) -> Callable[[Column], Column]:
    from palimpsest.functions import chunks

    return lambda words: chunks.keep_informative(words, word, score, share)


@COMPRESSORS.register("entropy")
def _entropy(key: str, text: str, share: float) -> Callable[[DataFrame], DataFrame]:
    return lambda df: rerank.entropy_kept(df, key, text, share)


@dataclass(frozen=True)
class Knowledge:
    """What the search kinds look into; each kind takes a question and k.

    texts (doc, text) stand behind `chunks`; nodes (id, name) behind `names`, whose docs are node ids; edges (source_id, relation,
    target_id, edge), edge being unique.  relations ranks edges by their relation, as (relation, distance).  summarize
    maps a context to a shorter one, translate a question to SQL; both may be a language model's.  A retriever's score is a
    similarity, its distance 1 - score.  code: (piece, file) of the pieces that `pieces` retrieves, whose docs are pieces.
    """

    texts: DataFrame
    chunks: Retriever
    summaries: Retriever
    nodes: DataFrame
    edges: DataFrame
    names: Retriever
    relations: Callable[[str], DataFrame]
    pieces: Retriever
    code: DataFrame
    summarize: Callable[[DataFrame], DataFrame] = lambda context: context
    translate: Callable[[str], str] = lambda question: question
    near: float = 0.5

    def _ask(self, retriever: Retriever, question: str, k: int) -> DataFrame:
        return retriever.query(self.nodes.sparkSession.createDataFrame([(0, question)], "query long, question string"), k).drop("query")

    def find_chunks(self, question: str, k: int) -> DataFrame:
        return self._ask(self.chunks, question, k)

    def find_summaries(self, question: str, k: int) -> DataFrame:
        return self._ask(self.summaries, question, k)

    def context(self, question: str, k: int) -> DataFrame:
        """One row: the k chunks, best first, as the text that an answer is made from."""
        best = self._ask(self.chunks, question, k).join(self.texts, "doc")
        in_order = F.array_sort(F.collect_list(F.struct("rank", "text")))  # k texts
        return best.agg(F.array_join(F.transform(in_order, lambda x: x["text"]), "\n").alias("context"))

    def insights(self, question: str, k: int) -> DataFrame:
        """Edges of the node with that id; if there is none, of the k nodes whose names are nearer than `near`.  Each edge once."""
        exact = self.nodes.filter(F.col("id") == question).select("id")
        if exact.isEmpty():
            exact = self._ask(self.names, question, k).filter(1 - F.col("score") < self.near).select(F.col("doc").alias("id"))
        touched = [self.edges.join(F.broadcast(exact.limit(k)), self.edges[end] == exact["id"], "left_semi") for end in ("source_id", "target_id")]  # k ids
        return touched[0].unionByName(touched[1]).select("source_id", "relation", "target_id").distinct()

    def triplets(self, question: str, k: int) -> DataFrame:
        """The k edges with the least sum of the distances of both nodes and the relation, what isn't found counting as 1."""
        found = self._ask(self.names, question, 2 * k).select(F.col("doc").alias("id"), (1 - F.col("score")).alias("distance"))
        return topk.best_triplets(joins.triplet_distances(self.edges, found, self.relations(question)), k, "edge")

    def graph_context(self, question: str, k: int) -> DataFrame:
        """One row: the triplets as lines `source -- relation -- target` by name."""
        name = lambda end: self.nodes.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(f"{end}_name"))
        lines = self.triplets(question, k).join(name("source"), "source_id").join(name("target"), "target_id")
        in_order = F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" -- ", "source_name", "relation", "target_name").alias("line"))))  # k lines
        return lines.agg(F.array_join(F.transform(in_order, lambda x: x["line"]), "\n").alias("context"))

    def graph_summary(self, question: str, k: int) -> DataFrame:
        return self.summarize(self.graph_context(question, k))

    def files(self, question: str, k: int) -> DataFrame:
        """Files of the k best pieces, by their best piece."""
        best = self._ask(self.pieces, question, k).join(self.code, F.col("doc") == F.col("piece"))
        return best.groupBy("file").agg(F.min("rank").alias("rank"))

    def natural_language(self, question: str, _: int) -> DataFrame:
        return self.nodes.sparkSession.sql(self.translate(question))

    def kinds(self) -> dict[str, Callable[[str, int], DataFrame]]:
        return {
            "SUMMARIES": self.find_summaries, "INSIGHTS": self.insights, "CHUNKS": self.find_chunks, "RAG_COMPLETION": self.context, "GRAPH_COMPLETION": self.graph_context,
            "GRAPH_SUMMARY_COMPLETION": self.graph_summary, "CODE": self.files, "NATURAL_LANGUAGE": self.natural_language,
        }


class Search:
    """Search kinds by name; each takes (question, k) and gives a DataFrame.  The kind `sql` runs the question as it stands."""

    def __init__(self, spark: SparkSession, kinds: Mapping[str, Callable[[str, int], DataFrame]]):
        self.spark = spark
        self._kinds = {name.upper(): fn for name, fn in kinds.items()}
        self._kinds.setdefault("SQL", lambda question, _: spark.sql(question))

    def run(self, kind: str, question: str, k: int = 10) -> DataFrame:
        if (fn := self._kinds.get(kind.upper())) is None:
            raise ValueError(f"unsupported search type: {kind}")
        return fn(question, k)


@dataclass(frozen=True)
class Dataset:
    """Sessions and queries (both with context_id) by the name of their benchmark."""

    name: str
    sessions: DataFrame
    queries: DataFrame

    def units(self) -> DataFrame:
        """Per context how many sessions are memorised before how many queries are asked."""
        s = self.sessions.groupBy("context_id").agg(F.count("*").alias("n_sessions"))
        q = self.queries.groupBy("context_id").agg(F.count("*").alias("n_queries"))
        return s.join(q, "context_id", "full_outer").fillna(0, ["n_sessions", "n_queries"])

    def info(self) -> DataFrame:
        totals = self.units().agg(F.count("*").alias("n_units"), F.coalesce(F.sum("n_sessions"), F.lit(0)).alias("n_sessions"), F.coalesce(F.sum("n_queries"), F.lit(0)).alias("n_queries"))
        return totals.select(F.lit(self.name).alias("name"), "*")


def register_functions(spark: SparkSession) -> None:
    """cosine_distance(a, b) in SQL, as an expression that Catalyst inlines: 0 where a side is null; missing components count as 0."""
    product = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> coalesce(p, 0D) * coalesce(q, 0D)), 0D, (s, p) -> s + p)"
    body = f"CASE WHEN a IS NULL OR b IS NULL THEN 0D ELSE 1D - {product('a', 'b')} / nullif(sqrt({product('a', 'a')}) * sqrt({product('b', 'b')}), 0D) END"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION cosine_distance(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")
