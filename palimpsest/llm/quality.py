"""Quality rules with adaptive thresholds from mergeable quantile sketches; DataFrame operations only.

One pass computes each document's counts and writes them (a few numbers a row).  Quantile sketches of four
ratios are then built per language and source with map-side partial sums, stored, and merged per
language.  A sketch counts values in buckets of geometrically growing width and keeps each bucket's
largest value, so a quantile is a value of the group at most `accuracy` (relative) over the exact one;
merging adds counts, in any order, so thresholds are the same in every run.  A group's threshold is its upper quartile plus `fences` spreads.  The spread is the
interquartile range, but at least what one count (a symbol, a line, a repeated window) makes out in
the group's median document, known from sketches of the denominators: where most ratios are zero, a
range of zero only says that the spread is below that resolution, and a clean group does not reject
its own mild outliers.  Groups with fewer than `least_rows` documents use their language's merged
sketches.  The thresholds are joined back
and a document stays if it passes the base rules and lies within all four.

Repeated eight-word windows are found inside the row: words are hashed, then pairs of words, of pairs and
of fours; if
any window hash occurs twice, windows are sorted by hash and neighbours compared, and the words that
the repeated windows cover are counted by the gaps between their starts.

Defined cases: a null, empty or blank text has no word and fails the base rule; a null language or
source is a group of its own; equal rows each get a result row; other columns are ignored; an empty
table gives an empty result; a ratio equal to its threshold passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import documents, written

WINDOW = 8
SPACE = r"[\x20\x09-\x0D]+"
#: Upper fences apply to these ratios; of each the denominator, and what its numerator grows by at once (a repeated window covers both places).
RATIOS = {"symbol_ratio": ("word_chars", 1), "shout_ratio": ("word_chars", 1), "dup_line_ratio": ("n_lines", 1), "repeat_ratio": ("n_words", 2 * WINDOW)}


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, as a lambda's variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(hashes: Column, n: Column) -> Column:
    """Words in windows that occur twice or more; hashes: one long for each of n words."""

    def covered(windows: Column) -> Column:
        at = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def flagged(s: Column) -> Column:
            same = lambda p, k: (p["h"] == F.get(s, k - 1)["h"]) | (p["h"] == F.get(s, k + 1)["h"])
            starts = F.transform(F.filter(s, lambda p, k: F.coalesce(same(p, k), F.lit(False))), lambda p: p["i"])
            return _let(F.sort_array(starts), gaps)

        return _let(F.sort_array(at), flagged)

    def gaps(starts: Column) -> Column:
        following = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.lit(2**31 - 1)))
        parts = F.zip_with(starts, following, lambda a, b: F.least(b - a, F.lit(WINDOW)))
        return F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def count(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(covered(windows))

    def paired(h: Column, apart: int) -> Column:
        """Hashes of twice the words: each with the one `apart` places on."""
        left = F.slice(h, 1, F.greatest(F.size(h) - apart, F.lit(0)))
        return F.zip_with(left, F.slice(h, apart + 1, F.greatest(F.size(h) - apart, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    inside = _let(_let(_let(hashes, lambda h: paired(h, 1)), lambda h: paired(h, 2)), lambda h: paired(h, 4))
    return F.when(n < WINDOW, F.lit(0).cast("long")).otherwise(_let(inside, count))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, lang, source, the base counts and the four ratios."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = df.select(F.col(id_col).alias("id"), F.col(lang_col).alias("q_lang"), F.col(source_col).alias("q_source"), text.alias("t"))
    got = got.withColumn("w", F.filter(F.split("t", SPACE), lambda x: x != ""))

    def of(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(hashes, F.size(w)).alias("n_repeat_words"),
        )

    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    line_counts = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    removed = lambda pattern: F.char_length("t") - F.char_length(F.regexp_replace("t", pattern, ""))
    got = got.select("id", "q_lang", "q_source", _let(F.col("w"), of).alias("c"), line_counts.alias("l"), removed(r"[#*$%&|<>]").cast("long").alias("n_symbols"), removed(r"[A-Z!]+").cast("long").alias("n_shout"))
    got = got.select("id", "q_lang", "q_source", "c.*", "l.*", "n_symbols", "n_shout")
    chars, words = F.greatest("word_chars", F.lit(1)), F.greatest("n_words", F.lit(1))
    return got.select(
        "*",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / chars).alias("symbol_ratio"), (F.col("n_shout") / chars).alias("shout_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_ratio"), (F.col("n_repeat_words") / words).alias("repeat_ratio"),
    )


def sketches(rows: DataFrame, values: Sequence[str], groups: Sequence[str], accuracy: float = 0.01) -> DataFrame:
    """(groups..., value, bucket, n, top): values from zero on; value is a place in values, bucket null for zero."""
    bucket = lambda v: F.when(F.col(v) > 0, F.ceil(F.log(F.col(v).cast("double")) / math.log1p(accuracy)).cast("int"))
    cells = F.array(*(F.struct(F.lit(i).alias("value"), bucket(v).alias("bucket"), F.col(v).cast("double").alias("top")) for i, v in enumerate(values)))
    cells = rows.select(*groups, F.explode(cells).alias("c")).select(*groups, "c.*")
    return cells.groupBy(*groups, "value", "bucket").agg(F.count("*").alias("n"), F.max("top").alias("top"))


def merged(sketch: DataFrame, groups: Sequence[str]) -> DataFrame:
    return sketch.groupBy(*groups, "value", "bucket").agg(F.sum("n").alias("n"), F.max("top").alias("top"))


def quantiles(sketch: DataFrame, groups: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(groups..., value, n, q array): the smallest kept value up to which each share of the rows lies."""
    of = [*groups, "value"]
    order = Window.partitionBy(*of).orderBy(F.asc_nulls_first("bucket"))  # a few thousand buckets at most
    ranked = sketch.withColumn("below", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(Window.partitionBy(*of)))
    at = [F.min(F.when(F.col("below") >= s * F.col("all"), F.col("top"))) for s in shares]
    return ranked.groupBy(*of).agg(F.max("all").alias("n"), F.array(*at).alias("q"))


def thresholds(rows: DataFrame, fences: float = 3.0, least_rows: int = 50, accuracy: float = 0.01) -> DataFrame:
    """(q_lang, q_source, max_<ratio>...) of every group, from stored sketches."""
    values = [*RATIOS, *sorted({base for base, _ in RATIOS.values()})]
    shares = (0.25, 0.5, 0.75)
    stored = written(sketches(rows, values, ["q_lang", "q_source"], accuracy), "quality-sketches")
    wide = lambda q, name: [F.max(F.when(F.col("value") == i, F.col(q))).alias(f"{name}{i}") for i in range(len(values))]
    own = quantiles(stored, ["q_lang", "q_source"], shares).groupBy("q_lang", "q_source").agg(F.max("n").alias("n"), *wide("q", "own"))
    whole = quantiles(merged(stored, ["q_lang"]), ["q_lang"], shares).groupBy("q_lang").agg(*wide("q", "lang"))
    both = own.join(whole.withColumnRenamed("q_lang", "l"), F.col("q_lang").eqNullSafe(F.col("l")))

    def limit(ratio: str, base: str, unit: int) -> Column:
        q = lambda v, i: F.get(F.when(F.col("n") >= least_rows, F.col(f"own{values.index(v)}")).otherwise(F.col(f"lang{values.index(v)}")), i)
        spread = F.greatest(q(ratio, 2) - q(ratio, 0), unit / F.greatest(q(base, 1), F.lit(1.0)))
        return (q(ratio, 2) + fences * spread).alias(f"max_{ratio}")

    return both.select("q_lang", "q_source", *(limit(r, base, unit) for r, (base, unit) in RATIOS.items()))


def judged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fences: float = 3.0, least_rows: int = 50) -> DataFrame:
    """id, the base counts, base_failed, the ratios with their thresholds, and kept."""
    rows = written(features(df, id_col, text_col, lang_col, source_col), "quality-features")
    limits = thresholds(rows.filter(~F.col("base_failed")), fences, least_rows)
    limits = limits.select(F.col("q_lang").alias("l"), F.col("q_source").alias("s"), *(f"max_{r}" for r in RATIOS))
    joined = rows.join(limits, rows["q_lang"].eqNullSafe(limits["l"]) & rows["q_source"].eqNullSafe(limits["s"]), "left").drop("l", "s", "q_lang", "q_source")
    within = [F.coalesce(F.col(r) <= F.col(f"max_{r}"), F.lit(True)) for r in RATIOS]  # without thresholds: none of the group passes the base rules
    verdict = ~F.col("base_failed")
    for w in within:
        verdict = verdict & w
    return joined.withColumn("kept", verdict).withColumnRenamed("id", id_col)


def op10_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = judged(documents(spark, sf_dir))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
