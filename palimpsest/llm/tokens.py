"""Token counts by a map-side two-tier lookup.

A text is cut where no pre-token can cross: into runs without white space (each with the one space
before it) and the white space between.  A cut's token count is looked up, first in a broadcast hash
table of frequent cuts, then in the worker's cache; a miss is encoded by the library and cached.
Nothing but the counts leaves the task, so no pre-token is ever shuffled.

The broadcast table holds at most `table_size` cuts, the most frequent ones of about `sample_rows`
documents drawn evenly from the whole table; it only saves work, and every count is what the library
gives for the whole text.  A text that holds a
special token's string goes through the library whole, as white space beside it is cut otherwise.

Defined cases: a null or empty text has 0 bytes and 0 tokens; equal rows each get a result row; a
null id is passed through; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_pass, documents, worker_state, written

#: Unicode White_Space; Python's \s holds four separators more.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CUT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

#: Entries of a worker's cache; it starts anew when full.
CACHE = 300_000
#: Longer cuts are rare and not worth a place in a table.
LONGEST = 64


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counts(dict):
    """Token counts by cut: the broadcast tier under the worker's own cache."""

    def __init__(self, path: str, table: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(table)
        self.table = table
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def __missing__(self, cut: str) -> int:
        n = self.whole(cut)
        if len(cut) <= LONGEST:
            self[cut] = n
        return n

    def whole(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if any(s in text for s in self.specials):
            return self.whole(text)
        if len(self) > CACHE + len(self.table):
            self.clear()
            self.update(self.table)
        return sum(map(self.__getitem__, _CUT.findall(text)))


def frequent_cuts(df: DataFrame, path: str, text_col: str = "text", sample_rows: int = 2000, table_size: int = 32_768) -> dict[str, int]:
    """Token counts of the most frequent cuts of about sample_rows documents, drawn from all of df: at most table_size entries."""

    def make():
        def fn(columns):
            seen = Counter()
            for t in columns[0]:
                seen.update(_CUT.findall(t or ""))
            # A batch gives a row; the rest of its rows stay empty.
            top = [{"cut": c, "n": n} for c, n in seen.most_common(table_size) if len(c) <= LONGEST]
            return [[top] + [[] for _ in columns[0][1:]]]

        return fn

    cut = T.StructType([T.StructField("cut", T.StringType()), T.StructField("n", T.LongType())])
    share = min(1.0, sample_rows / max(1, df.count()))
    sample = df.select(F.col(text_col).cast("string").alias("tok_text")).sample(share, seed=42)
    got = arrow_pass(sample, ["tok_text"], [], [T.StructField("cuts", T.ArrayType(cut))], make).select(F.explode("cuts").alias("c")).groupBy("c.cut").agg(F.sum("c.n").alias("n"))
    # Cut down on the cluster: collecting a sorted limit sends table_size rows of every partition to the driver.
    top = written(got.orderBy(F.desc("n"), "cut").limit(table_size), "frequent-cuts").collect()
    counts = Counts(path, {})
    return {r[0]: counts.whole(r[0]) for r in top}


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, table_size: int = 32_768) -> DataFrame:
    """id, n_bytes and n_tokens of every row."""
    table = df.sparkSession.sparkContext.broadcast(frequent_cuts(df, path, text_col, sample_rows, table_size))

    def make():
        counts = worker_state(("counts", path), lambda: Counts(path, {}))  # outlives the task
        if counts.table is not table.value:
            counts.table = table.value
            counts.update(table.value)
        return lambda columns: [[len((t or "").encode("utf-8", "surrogatepass")) for t in columns[0]], [counts.count(t) for t in columns[0]]]

    narrow = df.select(F.col(id_col).alias("tok_id"), F.col(text_col).cast("string").alias("tok_text"))
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return arrow_pass(narrow, ["tok_text"], ["tok_id"], fields, make).withColumnRenamed("tok_id", id_col)


def op7_two_tier_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = token_counts(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
    return got.withColumn("over_limit", F.col("n_tokens") > 512)
