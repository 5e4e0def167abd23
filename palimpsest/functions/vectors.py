"""Vector and string similarity as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """In double precision; null if either is null."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    # The norm stands in an array of its own, as a lambda would compute it again for each component.
    unit = lambda n: F.when(n == 0, a.cast("array<double>")).otherwise(F.transform(a, lambda x: x.cast("double") / n))
    return F.get(F.transform(F.array(norm(a)), unit), 0)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ, a vector is empty, or a norm is 0."""
    product = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (product == 0), F.lit(0.0)).otherwise(dot(a, b) / product)


def guarded_cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + F.lit(1e-10))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda acc, x: acc + x))


def mean_vector(vectors: Column, dims: int) -> Column:
    """Componentwise mean of an array of vectors."""
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.transform(vectors, lambda v: F.get(v, i).cast("double")), F.lit(0.0), lambda acc, x: acc + x) / F.size(vectors))


def _chars(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))


def dice(a: Column, b: Column) -> Column:
    """Over character sets."""
    x, y = _chars(a), _chars(b)
    total = F.size(x) + F.size(y)
    return F.when(total == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(x, y)) / total)


def bigrams(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2)))))


def bigram_jaccard(a: Column, b: Column) -> Column:
    x, y = bigrams(a), bigrams(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def token_overlap(query: Column, doc: Column) -> Column:
    """Share of the query's distinct tokens that the document has."""
    q = F.array_distinct(query)
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, doc)) / F.size(q))
