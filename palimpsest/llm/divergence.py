"""Divergence of sources by systolic rotation.

Terms are runs of letters (anything but ASCII non-letters), A-Z lower-cased.  A language keeps the terms that stand
in at least `least_documents` of its documents; V of them.  A group (language and source) and the language itself give
each kept term the smoothed rate p = 1 + floor(10^9 (count + 5) / (N + 5 V)), N being the counts' sum.  Two groups of a
language differ by the sum of |p - q| over its kept terms; a group's leading terms are those it has and gives more
weight than its language.

*Vectors.*  A language's terms are dealt into slices of about `slice_terms`.  In a slice a group is one compressed
vector: the numbers of the terms it has, and how far their p lies above that of a term it has not (its floor).
*Rotation.*  `block_groups` groups of a language make a block.  A slice's blocks stay where they are, in a table
bucketed by language, slice and block; in each round of a round-robin tournament (circle method) half of the blocks travel to the
bucket of the block they meet, compressed, and every pair of their groups is evaluated once for both directions.  Each round is a job that
writes its sums, so what moves at a time is at most one copy of the vectors, whatever the number of groups.
*Heaps.*  The task that packs a vector also ranks the group's terms in that slice and keeps the best `top`.

All arithmetic is in integers (products of more than 63 bits in Python's).  Each task holds a slice of two blocks:
2 x block_groups x slice_terms entries at most.

Defined cases: a null text, language or source is empty; a group without terms has the floor everywhere; a language
without kept terms has pairs of value 0 and no term rows; a lone source has no pair; equal rows count as often as they occur, null ids included;
other columns are ignored; an empty table gives an empty result; ties go by the item's UTF-8 bytes.
"""

from __future__ import annotations

import heapq
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import documents, shared_dir, small_batches, written

SCALE = 1_000_000_000
SMOOTH = 5
LEAST_DOCUMENTS = 30
TOP = 50
#: Terms of a slice, groups of a block; entries of a task's table of counts before it is emptied.
SLICE_TERMS = 1 << 16
BLOCK_GROUPS = 8
ROOM = 400_000

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOW))


def rates(counts: np.ndarray, n: int, v: int) -> np.ndarray:
    """p of each count, exactly."""
    below = n + SMOOTH * v
    if len(counts) and (int(counts.max()) + SMOOTH) * SCALE >= 1 << 63:
        return np.array([1 + SCALE * (int(c) + SMOOTH) // below for c in counts], np.int64)
    return 1 + SCALE * (counts.astype(np.int64) + SMOOTH) // max(1, below)


def counted(df: DataFrame, text_col: str, room: int = ROOM) -> DataFrame:
    """lang, source, term, n, docs: counts of what a task has read; an empty term stands for the group itself."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("lang", "source", "term")] + [T.StructField(c, T.LongType()) for c in ("n", "docs")])
    narrow = df.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("div_text"))
    small_batches(df.sparkSession)

    def emptied(held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(n)
            for k in range(0, len(terms), 10_000):
                part = terms[k : k + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(part)), pa.array([source] * len(part)), pa.array(part), pa.array([n[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())],
                    names=schema.names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter({"": 0}), Counter()))
                before = len(n)
                terms = terms_of(text)
                n.update(terms)
                docs.update(set(terms))
                size += len(n) - before
            if size > room:
                yield from emptied(held)
                held, size = {}, 0
        yield from emptied(held)

    return narrow.mapInArrow(run, schema)


def numbered(counts: DataFrame, least_documents: int, slice_terms: int) -> DataFrame:
    """Kept terms with lang, term, total, slice, number (in the slice, in UTF-8 order)."""
    kept = written(counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents), "divergence-kept")
    slices = kept.groupBy("lang").agg(F.ceil(F.count("*") / slice_terms).alias("slices"))
    dealt = kept.join(slices, "lang").withColumn("slice", F.pmod(F.xxhash64("term"), "slices").cast("int"))
    dealt = dealt.repartition("lang", "slice")  # else all terms of a language would be numbered where the join left them
    return written(dealt.withColumn("number", F.row_number().over(Window.partitionBy("lang", "slice").orderBy("term")) - 1).select("lang", "term", "total", "slice", "number"), "divergence-terms")


_MEMBER = T.StructType([T.StructField("source", T.StringType()), T.StructField("floor", T.LongType()), T.StructField("vector", T.BinaryType())])


def packed_vector(numbers: np.ndarray, above: np.ndarray) -> bytes:
    """Numbers as gaps, and values; 32 bits each, compressed."""
    gaps = np.diff(numbers, prepend=0).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(gaps.tobytes() + above.astype("<u4").tobytes())


def unpacked(vector: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zstandard.ZstdDecompressor().decompress(vector), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


def distances(left: list[dict], right: list[dict] | None, width: int) -> list[tuple[str, str, int]]:
    """(source, source, sum over the slice's width terms) of each pair between two blocks, or within one."""

    def opened(members: list[dict]) -> list[tuple[str, np.ndarray]]:
        out = []
        for m in members:
            dense = np.full(width, m["floor"], np.int64)
            at, above = unpacked(m["vector"])
            dense[at] += above
            out.append((m["source"], dense))
        return out

    mine = opened(left)
    theirs = mine if right is None else opened(right)
    pairs = ((a, b) for i, a in enumerate(mine) for b in (theirs if right is not None else mine[i + 1 :]))
    return [(a[0], b[0], int(np.abs(a[1] - b[1]).sum())) for a, b in pairs]


_SUM = T.StructType([T.StructField("lang", T.StringType()), T.StructField("a", T.StringType()), T.StructField("b", T.StringType()), T.StructField("f", T.LongType())])


def _meetings(rows: DataFrame, both: bool) -> DataFrame:
    """Sums of every meeting in rows: lang, width, members and, if both, peers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = b.slice(r, 1).to_pylist()[0]
                got = distances(row["members"], row["peers"] if both else None, row["width"])
                if got:
                    a, c, f = zip(*got, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["lang"]] * len(a)), pa.array(a), pa.array(c), pa.array(f, pa.int64())], names=_SUM.names)

    return rows.select("lang", "width", "members", *(["peers"] if both else [])).mapInArrow(run, _SUM)


def _opponent(block: Column, blocks: Column, turn: int) -> Column:
    """The block that a block meets in a round of the circle method, or itself.

    Of an even number n of seats the last stays; those that meet besides add up to 2 turn, modulo n - 1.  An odd number leaves one out.
    """
    n = blocks + blocks % 2
    other = F.pmod(2 * turn - block, n - 1)
    seat = turn % (n - 1)
    met = F.when(block == n - 1, seat).when(block == seat, n - 1).otherwise(other)
    return F.when((turn < n - 1) & (met < blocks), met).otherwise(block)


def divergence(
    df: DataFrame, text_col: str = "text", least_documents: int = LEAST_DOCUMENTS, top: int = TOP, slice_terms: int = SLICE_TERMS, block_groups: int = BLOCK_GROUPS
) -> DataFrame:
    """lang, source, part (`pair` or `term`), item, value, rank; df has lang and source."""
    spark = df.sparkSession
    counts = counted(df, text_col).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counts = written(counts, "divergence-counts")
    terms = numbered(counts, least_documents, slice_terms)
    langs = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    entries = written(counts.filter("term <> ''").join(terms, ["lang", "term"]).select("lang", "source", "slice", "number", "n", "total"), "divergence-entries")

    groups = counts.filter("term = ''").select("lang", "source").join(entries.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["v", "lang_n", "group_n"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    seated = groups.withColumn("block", F.floor(place / block_groups).cast("int")).withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1)
    seated = written(seated, "divergence-groups")

    widths = seated.select("lang").distinct().select("lang", F.lit(0).alias("slice"), F.lit(0).alias("more")).unionByName(terms.select("lang", "slice", F.lit(1).alias("more")))
    widths = widths.groupBy("lang", "slice").agg(F.sum("more").cast("int").alias("width"))
    rows = seated.join(widths, "lang").join(
        entries.groupBy("lang", "source", "slice").agg(F.collect_list(F.struct("number", "n", "total")).alias("entries")), ["lang", "source", "slice"], "left"
    )
    vectors = written(_packed(rows, top), "divergence-vectors")
    sums = _rotated(spark, vectors)

    one = sums.groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    pairs = one.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("d"), "value")
    pairs = pairs.select("lang", "d.source", F.lit("pair").alias("part"), "d.item", "value")
    best = vectors.select("lang", "source", "slice", F.explode("best").alias("b")).select("lang", "source", "slice", "b.number", "b.value")
    # Of the slices' heaps only the best stay, before their names are looked up; ties at the cut go by name.
    least = best.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).filter(F.col("place") <= top)
    named = least.join(terms, ["lang", "slice", "number"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    ranked = lambda d: d.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(pairs).unionByName(ranked(named).filter(F.col("rank") <= top))


_PACKED = T.StructType(
    [T.StructField(c, t) for c, t in (("lang", T.StringType()), ("source", T.StringType()), ("slice", T.IntegerType()), ("width", T.IntegerType()), ("block", T.IntegerType()), ("blocks", T.IntegerType()))]
    + [T.StructField("floor", T.LongType()), T.StructField("vector", T.BinaryType())]
    + [T.StructField("best", T.ArrayType(T.StructType([T.StructField("number", T.IntegerType()), T.StructField("value", T.LongType())])))]
)


def _packed(rows: DataFrame, top: int) -> DataFrame:
    """A group's vector in a slice, and its best terms there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(_PACKED)
        for b in batches:
            done = []
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("lang", "source", "slice", "width", "block", "blocks", "v", "lang_n", "group_n")}
                cell = b.column("entries")[i].values
                numbers, n, total = (cell.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)) if cell is not None else (np.empty(0, np.int64),) * 3
                order = np.argsort(numbers)
                numbers, n, total = numbers[order], n[order], total[order]
                floor = int(rates(np.zeros(1, np.int64), r["group_n"], r["v"])[0]) if r["v"] else 0
                p = rates(n, r["group_n"], r["v"])
                ahead = p - rates(total, r["lang_n"], r["v"])
                leading = np.flatnonzero(ahead > 0)
                best = heapq.nsmallest(top, zip((-ahead[leading]).tolist(), numbers[leading].tolist(), strict=True))
                done.append({c: r[c] for c in ("lang", "source", "slice", "width", "block", "blocks")} | {"floor": floor, "vector": packed_vector(numbers, p - floor), "best": [{"number": k, "value": -f} for f, k in best]})
            yield pa.RecordBatch.from_pylist(done, out)

    return rows.mapInArrow(run, _PACKED)


def _rotated(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """Sums of all pairs: first within blocks, then round by round between them."""
    blocks = vectors.groupBy("lang", "slice", "block").agg(F.first("width").alias("width"), F.first("blocks").alias("blocks"), F.collect_list(F.struct("source", "floor", "vector")).alias("members"))
    stored = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/divergence-blocks-{uuid.uuid4().hex}"
    home = f"divergence_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks.repartition(buckets, "lang", "slice", "block").write.bucketBy(buckets, "lang", "slice", "block").option("path", stored).saveAsTable(home)
    resident = spark.table(home)
    most = resident.agg(F.max("blocks")).first()[0] or 1
    done = [written(_meetings(resident, False), "divergence-sums")]
    for turn in range(most + most % 2 - 1):
        met = _opponent(F.col("block"), F.col("blocks"), turn)
        travelling = resident.select("lang", "slice", met.cast("int").alias("seat"), F.col("block").alias("from"), F.col("members").alias("peers")).filter("seat < from")
        here = resident.withColumnRenamed("block", "seat").join(travelling, ["lang", "slice", "seat"])
        done.append(written(_meetings(here, True), "divergence-sums"))
    spark.sql(f"DROP TABLE {home}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
           FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
size AS (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n,
             1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (coalesce(s.n, 0) + 5 * l.v)::HUGEINT AS p,
             1 + (1000000000 * (k.total + 5)::HUGEINT) // (l.n + 5 * l.v)::HUGEINT AS q
      FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
      LEFT JOIN size s ON g.lang = s.lang AND g.source = s.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.f, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def op12_systolic_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))
