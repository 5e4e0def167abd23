"""Shards of equal bytes by a k-d tree over document metadata; DataFrame operations only.

Dimensions, all functions of the text alone, so that its copies share them: log2 of the size, bytes per
character (the script), characters per word (the kind of text) and CRC-32.  A node is cut along its widest dimension (width relative to the whole table's)
at the weighted median, the weight being bytes; 16 leaves come from four levels.

A median is found by distributed radix selection: a document's place along a dimension is a 62-bit
key (31 bits of the value, 31 bits of a tie-break that keeps equal texts side by side); each round
sums the bytes in at most 4096 bins for each node (an aggregate of a bounded number of rows) and goes
on inside the bin that holds the median, until that bin is too light to matter.

Equal texts have equal keys, so they stay in one shard, unless their bytes exceed 1/20 of a shard: such a
group is dealt by id into parts of about 1/200 of a shard (more from 21 shards on: there are at most 4095
parts in all), which lie side by side in key order.  There are at most shards x 20 such groups, so their
broadcast table has a proven bound.

Defined cases: a null text weighs one byte and has CRC-32 zero, like an empty one; rows without an id are
dealt by a number that is written with them; equal rows are sharded as often as they occur; other columns
are ignored; an empty table gives an empty result; slots follow the order of id, then CRC-32, in each of
the parts that a shard's rows are numbered in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from palimpsest.llm.common import documents, written

BINS = 12  # bits
PARTS = 200
#: Of a shard, what copies must weigh to be parted.
HEAVY = 1 / 20
MOST_PARTS = (1 << BINS) - 1
DIMENSIONS = ("d_size", "d_width", "d_word", "d_crc")


def _deal(id_: Column) -> Column:
    """A number to deal rows by, also those of one id; the rows are written with it, as their number is mixed in."""
    return F.xxhash64(id_, F.monotonically_increasing_id())


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, size, crc, a number to deal by, and the dimensions' 31-bit values of each row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = df.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        F.char_length(text).alias("chars"), F.xxhash64(text).alias("hash"), F.char_length(F.replace(text, F.lit(" "), F.lit(""))).alias("inked"),
    )
    mask = F.lit((1 << 31) - 1)
    return got.select(
        "id", "size", "crc", "hash", _deal(F.col("id")).alias("deal"),
        F.floor(F.log2("size") * (1 << 26)).cast("long").bitwiseAND(mask).alias("d_size"),
        F.floor((F.col("size") - 1) / F.greatest("chars", F.lit(1)) * (1 << 28)).cast("long").bitwiseAND(mask).alias("d_width"),
        F.floor(F.log2(F.col("inked") / (F.col("chars") - F.col("inked") + 1) + 1) * (1 << 26)).cast("long").bitwiseAND(mask).alias("d_word"),
        F.shiftright("crc", 1).alias("d_crc"),
    )


def _key(dimension: Column) -> Column:
    tie = F.shiftleft(F.col("hash").bitwiseAND(F.lit(0x7FFFF)), 12) + F.col("part")
    return F.shiftleft(dimension, 31) + tie


class Tree:
    """Cuts by node: (dimension, key, left, right); a row goes left if its key is smaller."""

    def __init__(self):
        self.cuts: dict[int, tuple[str, int, int, int]] = {}

    def value(self, leaf: Callable[[int], Column], node: int = 0) -> Column:
        """leaf(n) for the node n where a row ends; each cut occurs once in the expression."""
        if node not in self.cuts:
            return leaf(node)
        d, key, left, right = self.cuts[node]
        if key >= 1 << 62:
            return self.value(leaf, left)
        return F.when(_key(F.col(d)) < F.lit(key), self.value(leaf, left)).otherwise(self.value(leaf, right))


def _medians(units: DataFrame, tree: Tree, dims: dict[int, str], goals: dict[int, float], slack: float) -> dict[int, int]:
    """For each node the key up to which (exclusive) rows go left, so that they weigh about its goal."""
    lo, before, cuts = dict.fromkeys(dims, 0), dict.fromkeys(dims, 0), {}
    shift, width = 62 - BINS, 1 << BINS
    while len(cuts) < len(dims):
        open_ = [n for n in dims if n not in cuts]
        away = tree.value(lambda n, lo=lo: _key(F.col(dims[n])) - F.lit(lo[n]) if n in open_ else F.lit(-1).cast("long"))
        rows = units.select(tree.value(F.lit).alias("node"), away.alias("away"), "weight")
        bin_ = F.when((F.col("away") >= 0) & (F.col("away") < F.lit(width << shift)), F.shiftright("away", shift)).otherwise(F.lit(-1).cast("long"))
        binned = rows.select("node", bin_.alias("bin"), "weight").groupBy("node", "bin").agg(F.sum("weight").alias("w")).collect()
        for n in open_:
            at, chosen = before[n], None
            for b, w in sorted((r["bin"], r["w"]) for r in binned if r["node"] == n and r["bin"] >= 0):
                if at + w >= goals[n]:
                    chosen = b, w
                    break
                at += w
            if chosen is None:  # what is left of rounding
                cuts[n] = lo[n] + (width << shift)
                continue
            b, w = chosen
            if shift == 0 or w <= slack:
                cuts[n] = lo[n] + (b << shift) + ((1 << shift) if at + w - goals[n] < goals[n] - at else 0)
            lo[n], before[n] = lo[n] + (b << shift), at
        shift = max(0, shift - BINS)
    return cuts


def kd_shards(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, size, crc and shard (0 to shards - 1) of every row; shards: at most 4095."""
    if not 1 <= shards <= MOST_PARTS:
        raise ValueError(f"shards must be 1 to {MOST_PARTS}")
    docs = written(measured(df, id_col, text_col), "kd-documents")
    total = docs.agg(F.sum("size")).first()[0] or 0
    part_weight = max(total / min(shards * PARTS, MOST_PARTS), 1.0)
    texts = docs.groupBy("hash", "crc", "size").agg(F.sum("size").alias("weight"))
    heavy = texts.filter(F.col("weight") > max(part_weight, total / shards * HEAVY)).select("hash", "crc", "size", F.ceil(F.col("weight") / part_weight).cast("int").alias("parts"))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("deal", F.col("parts")))
    docs = docs.join(F.broadcast(heavy), ["hash", "crc", "size"], "left").withColumn("part", part.cast("long")).drop("parts")
    units = docs.groupBy("hash", "part", *DIMENSIONS).agg(F.sum("size").alias("weight"))
    units = written(units, "kd-units")

    tree = Tree()
    leaves = {0: shards}  # shards still to come from a node
    first = {0: 0}  # its first shard
    whole: dict[str, int] = {}
    ends = [f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
    while any(n > 1 for n in leaves.values()):
        spread = units.withColumn("node", tree.value(F.lit)).groupBy("node").agg(F.sum("weight").alias("w"), *ends).collect()
        stats = {r["node"]: r for r in spread}
        whole = whole or {d: max(1, stats[0][f"max_{d}"] - stats[0][f"min_{d}"]) for d in DIMENSIONS if stats}
        cut = [n for n, k in leaves.items() if k > 1 and n in stats]
        for n in [n for n, k in leaves.items() if k > 1 and n not in stats]:
            leaves[n] = 1  # nothing lies there
        widest = {n: max(DIMENSIONS, key=lambda d, r=stats[n]: ((r[f"max_{d}"] - r[f"min_{d}"]) / whole[d], -DIMENSIONS.index(d))) for n in cut}
        goals = {n: stats[n]["w"] * (leaves[n] // 2) / leaves[n] for n in cut}
        for n, key in _medians(units, tree, widest, goals, total / shards / 2000).items():
            left = 2 * len(tree.cuts) + 1
            tree.cuts[n] = widest[n], key, left, left + 1
            k, at = leaves.pop(n), first.pop(n)
            leaves |= {left: k // 2, left + 1: k - k // 2}
            first |= {left: at, left + 1: at + k // 2}
    shard = tree.value(lambda n: F.lit(first[n])).cast("int")
    return docs.select(F.col("id").alias(id_col), "size", "crc", shard.alias("shard"))


def with_slots(sharded: DataFrame, id_col: str = "doc_id", rows_per_part: int = 50_000) -> DataFrame:
    """A gapless slot in each shard: counts by (shard, part) give offsets, row numbers only run inside a part."""
    rows = written(sharded.withColumn("slot_deal", _deal(F.col(id_col))), "kd-sharded")
    parts = max(1, rows.count() // rows_per_part)
    ranged = rows.withColumn("slot_part", F.pmod("slot_deal", F.lit(parts))).drop("slot_deal")
    counts = ranged.groupBy("shard", "slot_part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("slot_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "slot_part", before.alias("slot_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "slot_part").orderBy(id_col, "crc")) - 1
    numbered = ranged.withColumn("slot_inside", inside)
    return numbered.join(offsets, ["shard", "slot_part"]).withColumn("slot", F.col("slot_before") + F.col("slot_inside")).drop("slot_part", "slot_inside", "slot_before")


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = with_slots(kd_shards(documents(spark, sf_dir)))
    return got.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
