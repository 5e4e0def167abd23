"""Lexical retrieval: BM25, TF-IDF, token overlap, field-weighted full text.

Statistics are one pass: term frequencies by (document, term), from which document frequency, size
and average length follow.  Only terms of the queries reach the scoring join, so the postings that
are shuffled are those that can score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.functions import text as tx
from palimpsest.operators import sets
from palimpsest.operators.ranking import min_max, top_k
from palimpsest.operators.tables import MEMBERS, cut, members


@dataclass(frozen=True)
class Index:
    """postings (doc, term, tf, dl), terms (term, df, idf) and one row of (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    size: DataFrame


def index(docs: DataFrame, key: str, tokens: Column, epsilon: float = 0.25) -> Index:
    """The index as tables of the shared folder, made once for any number of queries.

    Okapi idf: ln(n - df + .5) - ln(df + .5); where negative, epsilon times the mean idf of all terms."""
    rows = docs.select(F.col(key).alias("doc"), tokens.alias("tokens")).withColumn("dl", F.size("tokens"))
    size = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    postings = rows.select("doc", "dl", F.explode("tokens").alias("term")).groupBy("doc", "dl", "term").agg(F.count("*").alias("tf"))
    postings, size = cut(postings, "postings"), cut(size, "postings-size")
    return Index(postings, cut(idf_of(postings.groupBy("term").agg(F.count("*").alias("df")), size, epsilon), "terms"), size)


def statistics(docs: DataFrame, key: str, tokens: Column, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) as of index(), without its postings: a document's words are made distinct where it is read, so only terms are shuffled.

    Documents that come with one key in several rows are one document; only their words meet by key.
    """
    rows = docs.select(F.col(key).alias("doc"), tokens.alias("tokens"))
    words = lambda df: df.select("doc", F.explode(F.array_distinct("tokens")).alias("term"))
    again = cut(docs.groupBy(F.col(key).alias("_doc")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_doc"), "repeated-documents")
    if again.isEmpty():
        each = words(rows)
    else:
        same = F.col("doc").eqNullSafe(F.col("_doc"))
        each = words(rows.join(again, same, "left_anti")).unionByName(words(rows.join(again, same, "left_semi")).distinct())
    df = cut(each.groupBy("term").agg(F.count("*").alias("df")), "document-frequencies")
    return idf_of(df, rows.agg(F.count("*").alias("n")), epsilon)


def idf_of(df: DataFrame, size: DataFrame, epsilon: float = 0.25) -> DataFrame:
    """(term, df, idf) from document frequencies and the row of (n, avgdl)."""
    raw = df.crossJoin(F.broadcast(size))  # size is one row
    raw = raw.withColumn("raw_idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("raw_idf") * epsilon).alias("floor_idf"))
    return raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw_idf") < 0, F.col("floor_idf")).otherwise(F.col("raw_idf")).alias("idf"))


def bm25_scores(ix: Index, queries: DataFrame, key: str, tokens: Column, k1: float = 1.5, b: float = 0.75, distinct: bool = False) -> DataFrame:
    """(query, doc, score) of every document with a query term; repeated query terms count repeatedly unless distinct."""
    q = queries.select(F.col(key).alias("query"), F.explode(F.array_distinct(tokens) if distinct else tokens).alias("term")).groupBy("query", "term").agg(F.count("*").alias("qtf"))
    q = cut(q.join(ix.terms.select("term", "idf"), "term"), "query-terms")  # Catalyst sees its size then
    hits = ix.postings.join(q.select("term", "idf").distinct(), "term").crossJoin(F.broadcast(ix.size))  # size is one row
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    # Postings meet by document before they meet the queries: a posting is moved once, not once for each query with its term.
    weighted = hits.select("term", "doc", part.alias("part")).repartition("doc")
    return weighted.join(q.select("query", "term", "qtf"), "term").groupBy("query", "doc").agg(F.sum(F.col("part") * F.col("qtf")).alias("score"))


def bm25_top_k(scores: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """k best by (-score, doc); the cut comes first, then only positive scores stay."""
    rounded = scores.withColumn("score", F.round("score", digits))
    return top_k(rounded, ["query"], [F.desc("score"), "doc"], k).filter(F.col("score") > 0)


def tfidf_vectors(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """(doc, term, w): smooth idf, rows of unit length."""
    rows = docs.select(F.col(key).alias("doc"), tokens.alias("tokens"))
    n = rows.agg(F.count("*").alias("n"))
    tf = rows.select("doc", F.explode("tokens").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    return tfidf_weights(tf, tf.groupBy("term").agg(F.count("*").alias("df")), n)


def tfidf_weights(tf: DataFrame, df: DataFrame, n: DataFrame) -> DataFrame:
    """tfidf_vectors of counted terms (doc, term, tf), which may be some documents' only; df (term, df) and the row n are those of all."""
    idf = df.crossJoin(F.broadcast(n)).select("term", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    raw = tf.join(idf, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("w"))
    length = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    return raw.join(length, "doc").select("doc", "term", (F.col("w") / F.col("len")).alias("w"))


def same_vectors(vectors: DataFrame) -> DataFrame:
    """(doc, class): documents of equal unit vectors (doc, term, w), to twelve digits, bear the smallest of their keys as class."""
    content = F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("term", F.round("w", 12).alias("w"))))), 256)
    marked = cut(vectors.groupBy("doc").agg(content.alias("content")), "vector-contents")
    return marked.join(marked.groupBy("content").agg(F.min("doc").alias("class")), "content").select("doc", "class")


def class_pairs(vectors: DataFrame, least: float) -> DataFrame:
    """(a, b, similarity) for a < b of unit vectors (doc, term, w), all different, whose cosine is at least `least` (over 0).

    A document's most frequent terms, as long as their part of the vector is shorter than `least`, can't make a pair by
    themselves: two similar documents share a term among the rest, so only those terms are joined on; then the pair's
    cosine is summed over all terms.
    """
    df = vectors.groupBy("term").agg(F.count("*").alias("df"))
    up_to = Window.partitionBy("doc").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, 0)
    marked = cut(vectors.join(df, "term").select("doc", "term", "w", F.sum(F.col("w") * F.col("w")).over(up_to).alias("mass")), "tfidf")
    rest = marked.filter(F.col("mass") >= least * least - 1e-9)
    x, y = rest.select(F.col("doc").alias("a"), "term"), rest.select(F.col("doc").alias("b"), "term")
    pairs = x.join(y, "term").filter(F.col("a") < F.col("b")).select("a", "b").distinct()
    whole = pairs.join(marked.select(F.col("doc").alias("a"), "term", F.col("w").alias("wa")), "a").join(marked.select(F.col("doc").alias("b"), "term", F.col("w").alias("wb")), ["b", "term"])
    return whole.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("similarity")).filter(F.col("similarity") >= least)


def tfidf_pairs(vectors: DataFrame, least: float, most: int = MEMBERS, digits: int | None = None) -> DataFrame:
    """(a, b, similarity) for a < b of unit vectors (doc, term, w) whose cosine is at least `least` (over 0), over the whole table.

    With digits, similarity is rounded, once for each pair of classes.

    Equal vectors meet others once, as a class; pairs of classes then give all pairs of their documents, where they are
    made: rows of about `most` documents meet, and the pairs themselves are never shuffled.
    """
    vectors = cut(vectors, "tfidf-vectors")
    of = cut(same_vectors(vectors), "vector-classes")
    own = vectors.join(of.filter("doc = class").select("doc"), "doc", "left_semi")
    alone = own.groupBy(F.col("doc").alias("a")).agg(F.sum(F.col("w") * F.col("w")).alias("similarity")).filter(F.col("similarity") >= least)
    pairs = class_pairs(own, least).unionByName(alone.select("a", F.col("a").alias("b"), "similarity"))
    if digits is not None:
        pairs = pairs.withColumn("similarity", F.round("similarity", digits))
    held = members(of, "class", "doc", most)
    side = lambda key, docs: held.select(F.col("class").alias(key), F.col("docs").alias(docs))
    met = pairs.join(side("a", "of_a"), "a").join(side("b", "of_b"), "b")
    each = met.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity", "of_b", F.explode("of_a").alias("p")).select("x", "y", "similarity", "p", F.explode("of_b").alias("q"))
    each = each.filter((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return each.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "similarity")


def tfidf_near_duplicates(vectors: DataFrame, items: DataFrame, key: str, least: float) -> DataFrame:
    """Items kept by the sweep of sets.greedy_near_duplicates over the pairs of tfidf_pairs, without making the pairs of copies.

    Of equal vectors the first document goes or stays as it would among all; the others are as similar to whatever removed
    it, or to itself if it stays, so they go.  Items without a vector stay.
    """
    vectors = cut(vectors, "tfidf-vectors")
    of = cut(same_vectors(vectors), "vector-classes")
    first = of.filter("doc = class")
    own = vectors.join(first.select("doc"), "doc", "left_semi")
    later = of.filter("doc <> class").select(F.col("doc").alias(key))
    if least > 1 - 1e-9:  # rounding decides then whether copies are similar enough
        return sets.greedy_near_duplicates(tfidf_pairs(vectors, least), items, key, least)
    return sets.greedy_near_duplicates(class_pairs(own, least), items.join(later, key, "left_anti"), key, least)


def key_tag_search(scores: DataFrame, second: DataFrame, k: int, weight: float = 0.7) -> DataFrame:
    """The 2k best by BM25, re-scored as weight * bm25 + (1 - weight) * tf-idf (query, doc, similarity), then the k best."""
    first = bm25_top_k(scores, 2 * k).drop("rank")
    both = first.join(second, ["query", "doc"], "left").withColumn("score", F.round(weight * F.col("score") + (1 - weight) * F.coalesce("similarity", F.lit(0.0)), 6))
    return top_k(both.drop("similarity"), ["query"], [F.desc("score"), "doc"], k)


def hybrid(bm25: DataFrame, dense: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """alpha * normalised bm25 + (1 - alpha) * cosine over the documents of either list."""
    both = bm25.select("query", "doc", F.col("score").alias("lexical")).join(dense.select("query", "doc", F.col("score").alias("dense")), ["query", "doc"], "full_outer").fillna(0.0, ["lexical", "dense"])
    over = Window.partitionBy("query")
    low, high = F.min("lexical").over(over), F.max("lexical").over(over)
    norm = (F.col("lexical") - low) / (high - low + 1e-6)
    scored = both.withColumn("score", F.round(alpha * norm + (1 - alpha) * F.col("dense"), 6))
    return top_k(scored, ["query"], [F.desc("score"), "doc"], k)


def overlap_top_k(queries: DataFrame, q_key: str, q_text: str, docs: DataFrame, d_key: str, d_text: str, k: int) -> DataFrame:
    """Share of the query's distinct tokens that a document has; an inverted join, so only pairs that share one are made."""
    q = queries.select(F.col(q_key).alias("query"), F.array_distinct(tx.ascii_tokens(F.col(q_text))).alias("ts"))
    d = docs.select(F.col(d_key).alias("doc"), F.explode(F.array_distinct(tx.ascii_tokens(F.col(d_text)))).alias("term"))
    hits = q.select("query", F.size("ts").alias("n"), F.explode("ts").alias("term")).join(d, "term").groupBy("query", "doc", "n").agg(F.count("*").alias("shared"))
    return top_k(hits.select("query", "doc", F.round(F.col("shared") / F.col("n"), 6).alias("score")), ["query"], [F.desc("score"), "doc"], k)


def full_text(queries: DataFrame, docs: DataFrame, fields: dict[str, float], k: int) -> DataFrame:
    """Terms of two letters or more must all be in a document (prefixes of three letters or more count);
    a query without such a document takes those with any term.  A hit scores its field's weight.

    Terms first meet the dictionary, each word once, by the words' whole prefixes of the lengths that terms have; documents then
    join on whole words, and only once for each query, term and document.
    """
    q = queries.select("query", F.array_distinct(F.filter(tx.ascii_tokens(F.col("question")), lambda t: F.char_length(t) >= 2)).alias("ts"))
    words = [docs.select("doc", F.explode(F.array_distinct(tx.ascii_tokens(F.col(f)))).alias("word"), F.lit(w).alias("weight")) for f, w in fields.items()]
    posts = words[0]
    for w in words[1:]:
        posts = posts.unionByName(w)
    posts = posts.groupBy("doc", "word").agg(F.max("weight").alias("weight"))
    term = q.select("query", F.size("ts").alias("n"), F.explode("ts").alias("term"))
    known = term.select("term").distinct()
    sizes = known.select(F.char_length("term").alias("size")).filter("size >= 3").distinct()
    lengths = F.array(*(F.lit(r["size"]) for r in sizes.collect()), F.lit(0))  # a number for each length that terms have
    prefixes = posts.select("word").distinct().select("word", F.explode(F.filter(lengths, lambda n: (n > 0) & (n < F.char_length("word")))).alias("size"))
    longer = prefixes.select("word", F.expr("substring(word, 1, size)").alias("term")).join(known, "term")
    meant = longer.unionByName(known.select(F.col("term").alias("word"), "term"))
    hits = term.join(meant, "term").join(posts, "word").groupBy("query", "doc", "n", "term").agg(F.max("weight").alias("w"))
    scored = hits.groupBy("query", "doc", "n").agg(F.count("*").alias("found"), F.sum("w").alias("score"))
    any_full = F.max((F.col("found") == F.col("n")).cast("int")).over(Window.partitionBy("query")) == 1
    kept = scored.withColumn("any_full", any_full).filter(~F.col("any_full") | (F.col("found") == F.col("n")))
    return top_k(kept.select("query", "doc", F.round("score", 6).alias("score")), ["query"], [F.desc("score"), "doc"], k)


__all__ = ["Index", "bm25_scores", "bm25_top_k", "full_text", "hybrid", "index", "key_tag_search", "min_max", "overlap_top_k", "tfidf_near_duplicates", "tfidf_pairs", "tfidf_vectors"]
