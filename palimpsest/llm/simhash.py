"""SimHash near-duplicates by anchor-point covering, and their connected components.

Fingerprints are 64 bits; two link at `distance` (4) or fewer differing bits.  The bits lie in two
blocks of 31 (and two bits beside them), so a linked pair differs in at most 2 bits in one of the
blocks.  In each block the anchors are the codewords of the perfect Hamming code [31, 26]: every
point lies within its covering radius 1 of exactly one anchor.  A pair at block distance 2 has a
point half-way, at distance 1 from both, so both lie within 1 + 1 of that point's anchor: every
fingerprint is replicated to all anchors within covering radius plus the half threshold (16 of them,
or one where it is itself an anchor), and pairs are compared in full per anchor.

Only different fingerprints are compared (copies were pre-aggregated), and per anchor only a
spanning forest of the links leaves the task: at most members - 1 edges, so a large near-copy group
costs no quadratic output.  An anchor with more than `cap` members is handed on to a second, exact
step that deals its members over pairs of chunks.  Components come from large-star/small-star
rounds, each written to the shared folder.

Defined cases: no words (null, empty or blank text) gives fingerprint zero, linked like any other;
fewer than four words form one shingle; equal rows each get a result row; a null id takes no part in
the smallest id of its component (null if all are null); other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_pass, documents, fresh, spread_join, written

SEED = 42
SHINGLE = 4
DISTANCE = 4
#: Members of one anchor that one task compares; more are dealt over pairs of chunks.
CAP = 4096


def shingle_hashes(text: str | None, words: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included; words are split at ASCII white space, A-Z lower-cased."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, "<u8")
    digest = xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(b" ".join(w), SEED)], "<u8")
    parts = [w[i:] for i in range(words)]
    return np.fromiter((digest(b" ".join(x), SEED) for x in zip(*parts, strict=False)), "<u8", len(w) - words + 1)


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """A bit is set if it is set in over half of the shingle hashes."""
    h = shingle_hashes(text, words)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] | None = None, name: str = "fp", words: int = SHINGLE) -> DataFrame:
    """The keep columns (all by default) and the fingerprint as a signed long."""

    def make():
        return lambda columns: [np.array([fingerprint(t, words) for t in columns[0]], np.uint64).view(np.int64)]

    return arrow_pass(df, [text_col], df.columns if keep is None else keep, [T.StructField(name, T.LongType())], make)


def anchors(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, anchor key) of every replica; a key holds the block in bit 31."""
    at, keys = [], []
    x64 = fps.view(np.uint64)
    for block in (0, 1):
        x = (x64 >> np.uint64(32 * block)).astype(np.int64) & 0x7FFFFFFF
        # The syndrome of a Hamming code is the XOR of the (one-based) positions of the set bits.
        s = np.zeros(len(x), np.int64)
        for p in range(1, 32):
            s ^= np.where(x >> (p - 1) & 1, p, 0)
        tag = block << 31
        flip = lambda p: np.where(p > 0, np.left_shift(1, np.maximum(p - 1, 0)), 0)
        at.append(np.arange(len(x)))
        keys.append((x ^ flip(s)) | tag)
        for p in range(1, 32):
            q = s ^ p
            own = np.flatnonzero((q > p) & (s != 0))
            at.append(own)
            keys.append((x[own] ^ flip(np.int64(p)) ^ flip(q[own])) | tag)
    return np.concatenate(at), np.concatenate(keys)


_REPLICA = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("fp", T.LongType())])
_EDGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
_FOUND = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        at, keys = anchors(fps)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(fps[at], pa.int64())], names=["anchor", "fp"])


def forest(left: np.ndarray, right: np.ndarray | None = None, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges that connect what links within left (and right) connect: at most members - 1 of them."""
    members = left if right is None else np.concatenate([left, right])
    first = len(left)
    bits = members.view(np.uint64)
    parent = np.arange(len(members))
    out = []
    for i in range(first if right is not None else len(members) - 1):
        rest = slice(first, None) if right is not None else slice(i + 1, None)
        near = np.bitwise_count(bits[rest] ^ bits[i]) <= distance
        # Only members of other trees are news; each new tree is joined by one edge.
        other = np.flatnonzero(near & (parent[rest] != parent[i])) + rest.start
        while len(other):
            j = int(other[0])
            out.append((int(members[i]), int(members[j])))
            parent[parent == parent[j]] = parent[i]
            other = other[parent[other] != parent[i]]
    return out


def _compare(cap: int, distance: int):
    """Over rows ordered by anchor; an anchor over the cap goes on row by row as (anchor, fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, over = None, [], False

        def flush(out: list) -> None:
            if held and not over:
                fps = np.concatenate(held)
                if len(fps) > 1:
                    out.extend((None, a, b) for a, b in forest(fps, None, distance))

        def made(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(3)], names=["anchor", "a", "b"])

        for b in batches:
            keys, fps = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(keys)]])
            out: list = []
            edge = {0, len(starts) - 1}
            # Most anchors have one member and lie inside a batch: those need no work.
            for g in [*np.flatnonzero(ends - starts > 1), *edge]:
                edge.add(int(g))
            for g in sorted(edge):
                k, part = int(keys[starts[g]]), fps[starts[g] : ends[g]]
                if k != key:
                    flush(out)
                    key, held, over = k, [], False
                held.append(part)
                if over or sum(map(len, held)) > cap:
                    over = True
                    out.extend((key, int(f), None) for p in held for f in p)
                    held.clear()
            yield made(out)
        out = []
        flush(out)
        yield made(out)

    return run


def links(fps: DataFrame, cap: int = CAP, distance: int = DISTANCE) -> DataFrame:
    """Edges (a, b) between different fingerprints of column fp that connect exactly what all links connect."""
    if distance > 4:
        raise ValueError("two blocks cover up to four differing bits")
    replicas = fps.select("fp").mapInArrow(_replicate, _REPLICA)
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = written(dealt.mapInArrow(_compare(cap, distance), _FOUND), "simhash-links")
    edges = found.filter("anchor is null").select("a", "b")
    large = found.filter("anchor is not null").select("anchor", F.col("a").alias("fp"))
    # Members of a large anchor: chunk c meets every chunk from itself on, so each pair meets once.
    sizes = large.groupBy("anchor").agg(F.ceil(F.count("*") / F.lit(cap / 2)).cast("int").alias("n"))
    chunked = large.join(sizes, "anchor").withColumn("c", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    pairs = chunked.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pairs = pairs.select("anchor", F.least("c", "d").alias("i"), F.greatest("c", "d").alias("j"), (F.col("c") <= F.col("d")).alias("first"), "fp")

    def block(pdf):
        import pandas as pd

        left, right = pdf.fp[pdf["first"]].to_numpy(), pdf.fp[~pdf["first"]].to_numpy()
        same = len(pdf) and pdf.i.iloc[0] == pdf.j.iloc[0]
        return pd.DataFrame(forest(left, None if same else right, distance), columns=["a", "b"], dtype="int64")

    more = pairs.groupBy("anchor", "i", "j").applyInPandas(block, _EDGE)
    return edges.unionByName(more).distinct()


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of edges (a, b) reaches; by alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components-0")
    before = None
    for r in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(low, "u")
        small = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.filter("u <> v").distinct(), f"components-{r + 1}")
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(fingerprints: DataFrame, id_col: str = "doc_id", cap: int = CAP) -> DataFrame:
    """(fp, root, component_id, n_rows) of every fingerprint; component_id is the smallest non-null id that it reaches, root names the component."""
    firsts = fingerprints.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count("*").alias("n_rows"))
    firsts = written(firsts, "simhash-firsts")
    roots = components(links(firsts, cap))
    rooted = firsts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", "n_rows", F.coalesce("root", "fp").alias("root"))
    rooted = written(rooted, "simhash-rooted")
    least = written(rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count("*").alias("n_fps")), "simhash-least")
    return spread_join(rooted, least, "root", "n_fps").select("fp", "root", "component_id", "n_rows")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """A row for each row of df: id, fp (signed long) and component_id."""
    fps = written(with_fingerprint(df, text_col, (id_col,)), "simhash-fingerprints")
    near = written(groups(fps, id_col, cap), "simhash-groups")
    return spread_join(fps, near, "fp", "n_rows").select(id_col, "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cap: int = CAP) -> DataFrame:
    """One row of each component: a row of its smallest id, and of those the one with the smallest text hash.

    Rows with a null id have nothing to stand for them and all stay.
    """
    digest = fresh(df, "keep_text")
    marked = df.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    narrow = marked.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("keep_id"), F.col(text_col).alias("text"), F.col(digest).alias("keep_text"))
    fps = written(with_fingerprint(narrow, "text", ("keep_id", "keep_text")), "simhash-fingerprints")
    known = written(groups(fps, "keep_id", cap), "simhash-groups")
    near = spread_join(fps, known, "fp", "n_rows").filter(F.col("keep_id") == F.col("component_id"))
    stay = near.groupBy("root", "keep_id").agg(F.min("keep_text").alias("keep_text")).select("keep_id", "keep_text")
    kept = marked.join(stay, (marked[id_col] == stay["keep_id"]) & (marked[digest] == stay["keep_text"]), "left_semi").dropDuplicates([id_col, digest])
    return kept.select(*df.columns).unionByName(df.filter(F.col(id_col).isNull()))


def op4_anchor_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
