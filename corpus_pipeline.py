"""A training corpus in five stages: toxicity, near-duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's docs.  In all of them a null text is empty, extra columns are carried
along whatever their names, repeated rows are kept as such (but for near_duplicates, which keeps one), and an empty
table gives an empty result.  A null id is scored like any other; near_duplicates and mixture keep rows without an id once, as
they are; packing passes it through.  Of equal ids near_duplicates takes the least text hash.  All but the last return the columns of
documents:

1. toxicity drops the documents that score 0.7 or more;
2. near_duplicates keeps one document (the smallest id) of each SimHash component;
3. secrets replaces secrets inside the texts and keeps every document;
4. mixture keeps each document as often as its rate says: rates of about 1 keep it once;
5. packing returns the pieces of the token sequences, which name their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import common, mixing, packing, secrets, simhash, tokens, toxicity

#: Shares of tokens after the mixture; the first stage has left next to nothing toxic.
TARGETS = {"good": 0.94, "low": 0.06, "toxic": 0.0}

#: SQL can't express the learned, hashed and tokenised stages; tests/llm holds each of them against brute force.
ORACLE_SQL: str | None = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, common.labels(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the text where a secret was replaced."""
    before = common.fresh(docs, "n_chars_before")
    marked = docs.withColumn(before, F.char_length("text"))
    done = secrets.redact(marked, words=secrets.vocabulary_words(tokens.tokenizer_path("word_bpe_49k.json")))
    changed = F.char_length("text") != F.col(before)
    return done.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs, mixing.labelled_domains(spark, sf_dir), TARGETS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, tokens.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
