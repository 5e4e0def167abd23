"""Conversation structure repair by a rank-compressed dynamic program.

A conversation is repaired if its roles read: perhaps one system turn, then pairs of a user and an
assistant turn.  Turns are kept (0), get another role (1) or are deleted (2; blank and repeated turns
must be), empty turns are inserted (5); a truncated turn that stays costs 5 more.  The cheapest edits
win, and among those the ones whose initials D, I, K, R come first in ASCII.

*Macro edits.*  A layer is a turn; its edit is a run of inserts and then what becomes of the turn, as in
IIK.  Runs of up to two suffice, as two inserts more lead back to the same state.  The nine codes are
prefix-free and numbered in ASCII order, so audits of the same turns compare like their code numbers.
*Ranks.*  A state (nothing yet, system, user, assistant) keeps its least cost and, for its audit, only the
rank among the states of the layer: comparing (rank of the state before, code) compares whole audits.
Parent pointers give the audit afterwards.  Costs relative to the cheapest state, ranks and pointers form few
layers, which are remembered: a turn takes one look-up.
*Long conversations* (more than `most_rows` turns or `most_bytes` of text) are cut into segments, each task solves a
segment from each of the four states it could begin in, a fold over these summaries (costs and ranks, a constant
size a segment) settles the states at the cuts, and the segments are walked back in parallel.  Only the digest of
such a conversation, which is sequential by nature, is streamed by one task.

Defined cases: a null role or text is one space, so such a turn is blank, or has a role that can't stay; a null
conversation id is a conversation of its own; null turn numbers come first; equal turn numbers go by role, then text; an empty
role has no initial and can't stay; a conversation none of whose rows are left has zeros and an empty audit; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import small_batches, written

SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
RUN = 2
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
CODES = sorted("I" * r + e for r in range(RUN + 1) for e in "DKR")
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
_LEGAL = frozenset(("su", "ua", "au"))
#: What a state's next turn must be if it is inserted or gets another role.
_WANTED = ("user", "user", "assistant", "user")
_AFTER = (USER, USER, ASSISTANT, USER)

#: Turns and text of a conversation that one task takes whole, and of a segment of a longer one.
MOST_ROWS = 20_000
MOST_BYTES = 16 << 20


def kind_of(role: str, must_go: bool, truncated: bool) -> int:
    """A turn's class: 0 must be deleted, else by initial and truncation."""
    return 0 if must_go else 1 + 2 * ("sua".find(role[0]) if role and role[0] in "sua" else 3) + truncated


def _moves(kind: int) -> list[list[tuple[int, int, int]]]:
    """For each state: (code, cost, next state)."""
    initial, extra = ("", 0) if not kind else (("s", "u", "a", "")[(kind - 1) // 2], TRUNCATED * ((kind - 1) % 2))
    out = []
    for state in range(4):
        got, at = [], state
        for run in range(RUN + 1):
            edits = [("D", DELETE, at)]
            if kind:
                edits.append(("R", REROLE + extra, _AFTER[at]))
                if (at, initial) in _NEXT:
                    edits.append(("K", KEEP + extra, _NEXT[at, initial]))
            got += [(CODES.index("I" * run + e), INSERT * run + cost, to) for e, cost, to in edits]
            at = _AFTER[at]
        out.append(got)
    return out


MOVES = [_moves(k) for k in range(9)]
#: For each state (cost above the base, rank of its audit), or None where it can't be or can't win.
Layer = tuple


def first(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


@lru_cache(maxsize=200_000)
def step(layer: Layer, kind: int) -> tuple[Layer, int, tuple]:
    """The next layer, what the base grows by, and each state's (parent state, code)."""
    best: list = [None] * 4
    for state, here in enumerate(layer):
        if here:
            for code, cost, to in MOVES[kind][state]:
                got = (here[0] + cost, here[1], code, state)
                if best[to] is None or got < best[to]:
                    best[to] = got
    # Whatever follows the assistant's turn may follow these at the cost of one deletion at most.
    if best[ASSISTANT]:
        for state, slack in ((START, DELETE), (SYSTEM, 0)):
            if best[state] and best[state][0] > best[ASSISTANT][0] + slack:
                best[state] = None
    base = min(b[0] for b in best if b)
    order = sorted((b[1], b[2]) for b in best if b)
    layer = tuple(b and (b[0] - base, order.index((b[1], b[2]))) for b in best)
    return layer, base, tuple(b and (b[3], b[2]) for b in best)


def forward(kinds: list[int], state: int = START) -> tuple[Layer, int, list[tuple]]:
    layer, total, parents = first(state), 0, []
    for k in kinds:
        layer, more, back = step(layer, k)
        total += more
        parents.append(back)
    return layer, total, parents


def last(layer: Layer) -> tuple[int, int, int]:
    """(cost, state, inserts at the end) of the cheapest finish, then the least audit."""
    got = []
    for state, here in enumerate(layer):
        at = state
        for run in range(RUN + 1):
            if here and at in ENDS:
                got.append((here[0] + INSERT * run, here[1], run, state))
            at = _AFTER[at]
    cost, _, run, state = min(got)
    return cost, state, run


def backward(parents: list[tuple], state: int) -> list[int]:
    """The codes that lead to state."""
    codes = []
    for back in reversed(parents):
        state, code = back[state]
        codes.append(code)
    return codes[::-1]


def applied(codes: list[str], rows: list[tuple[str, str]], state: int) -> list[tuple[str, str]]:
    """The repaired turns (role, text) from the audit's parts; a part without a row's edit stands for inserts at the end."""
    out, at = [], 0
    for code in codes:
        for edit in code:
            if edit == "I":
                out.append((_WANTED[state], ""))
                state = _AFTER[state]
                continue
            role, text = rows[at]
            at += 1
            if edit == "R":
                role = _WANTED[state]
            if edit != "D":
                out.append((role, text))
                state = _NEXT[state, role[0]]
    return out


def faults(rows: list[tuple[str, str]], seen: set | None = None, repeated: list[bool] | None = None) -> tuple[list[int], list[int]]:
    """Each turn's class, and the counts of blank, duplicate, truncated and illegal ones; repeated says which are duplicates, if known."""
    seen = set() if seen is None else seen
    kinds, n = [], [0, 0, 0, 0]
    before = None
    for i, row in enumerate(rows):
        role, text = row
        bare = text.strip(SPACE)
        fault = None
        if not bare:
            fault = 0
        elif repeated[i] if repeated is not None else row in seen:
            fault = 1
        elif bare[-1] not in ".!?":
            fault = 2
        if fault is not None:
            n[fault] += 1
        if repeated is None:
            seen.add(row)
        kinds.append(kind_of(role, fault in (0, 1), fault == 2))
        n[3] += before is not None and before + role[:1] not in _LEGAL
        before = role[:1]
    return kinds, n


def mended(rows: list[tuple[str, str]]) -> tuple[list[int], int, str, list[tuple[str, str]]]:
    """Counts, cost, audit and turns of a whole conversation."""
    kinds, n = faults(rows)
    layer, total, parents = forward(kinds)
    more, state, run = last(layer)
    codes = [CODES[c] for c in backward(parents, state)] + ["I" * run]
    return n, total + more, "".join(codes), applied(codes, rows, START)


# --- Spark -----------------------------------------------------------------------------------------------------------

_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _result(kind: T.DataType) -> T.StructType:
    fields = [T.StructField("conv", kind), T.StructField("piece", T.LongType()), T.StructField("pieces", T.LongType())]
    fields += [T.StructField(c, T.LongType()) for c in COUNTS]
    return T.StructType([*fields, T.StructField("audit", T.StringType()), T.StructField("turns", T.ArrayType(_TURN))])


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _gaps(turns) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _short(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """Conversations that fit a task: one exchange by id, then each is mended as it passes by."""
    out = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        held: list[tuple] = []
        weight = 0

        def close() -> int:
            there = [(r, t) for _, n, r, t in held for _ in range(n)]
            n, cost, audit, turns = mended(there)
            gaps = _gaps(h[0] for h in held if h[1])
            done.append({"conv": conv, "piece": 0, "pieces": 1, "gaps": gaps, "blank": n[0], "duplicate": n[1], "truncated": n[2], "illegal": n[3], "cost": cost, "audit": audit, "turns": [{"role": r, "text": t} for r, t in turns]})
            return sum(len(t) for _, t in turns)

        conv = None
        for b in batches:
            for key, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and key != conv:
                    weight += close()
                    held = []
                    if len(done) >= 1000 or weight > MOST_BYTES // 4:
                        yield pa.RecordBatch.from_pylist(done, out)
                        done, weight = [], 0
                conv = key
                held.append(tuple(row))
        if held:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done, out)

    return rows.select("conv", "turn", "copies", "role", "text").repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, schema)


def _cut(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Long conversations' rows in order, with seg (ascending in each conversation) and pos; stored, so that cuts never move."""
    names = ["conv", "turn", "role", "text", "uid", "again"]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField("seg", T.LongType()), T.StructField("pos", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, n, weight, conv, began = TaskContext.get().partitionId() << 40, 0, 0, None, False
        for b in batches:
            segs, at = [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True):
                if began and (key != conv or n >= most_rows or weight >= most_bytes):
                    seg, n, weight = seg + 1, 0, 0
                began, conv, n, weight = True, key, n + 1, weight + len(text)
                segs.append(seg)
                at.append(n)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(segs, pa.int64()), pa.array(at, pa.int64())], names=[*names, "seg", "pos"])

    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["conv", "turn", "role", "text", "uid"]
    return written(rows.select(names).repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema), "conversation-segments")


_SUMMARY = "seg long, blank long, duplicate long, truncated long, illegal long, head string, tail string, cost array<int>, rank array<int>, base array<long>"


def _summarise(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each state a segment may begin in: cost and audit rank of each state at its end (-1: can't be)."""
    pdf = pdf.sort_values("pos")
    rows = list(zip(pdf["role"], pdf["text"], strict=True))
    kinds, n = faults(rows, repeated=list(pdf["again"]))
    cost, rank, base = [], [], []
    for state in range(4):
        layer, total, _ = forward(kinds, state)
        base.append(total)
        cost += [x[0] if x else -1 for x in layer]
        rank += [x[1] if x else -1 for x in layer]
    return pd.DataFrame([[int(pdf["seg"].iloc[0]), *n, rows[0][0][:1], rows[-1][0][:1], cost, rank, base]], columns=[f.split()[0] for f in _SUMMARY.split(", ")])


def fold(parts: list[tuple[list[int], list[int], list[int]]]) -> tuple[int, list[tuple[int, int]], int]:
    """Summaries (cost, rank, base) of consecutive segments: the whole cost, each segment's first and last state, inserts at the end."""
    layer, total, parents = first(START), 0, []
    for cost, rank, base in parts:
        best: list = [None] * 4
        for s, here in enumerate(layer):
            if here:
                for t in range(4):
                    if cost[4 * s + t] >= 0:
                        got = (here[0] + base[s] + cost[4 * s + t], here[1], rank[4 * s + t], s)
                        if best[t] is None or got < best[t]:
                            best[t] = got
        least = min(b[0] for b in best if b)
        total += least
        order = sorted((b[1], b[2]) for b in best if b)
        layer = tuple(b and (b[0] - least, order.index((b[1], b[2]))) for b in best)
        parents.append([b and b[3] for b in best])
    more, state, run = last(layer)
    spans = []
    for back in reversed(parents):
        spans.append((back[state], state))
        state = back[state]
    return total + more, spans[::-1], run


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One conversation's summaries: what each of its segments needs to be walked back."""
    pdf = pdf.sort_values("seg")
    cost, spans, run = fold(list(zip(pdf["cost"], pdf["rank"], pdf["base"], strict=True)))
    n = len(pdf)
    seams = sum(a + b not in _LEGAL for a, b in zip(pdf["tail"][:-1], pdf["head"][1:], strict=True))
    out = pd.DataFrame({"seg": pdf["seg"].to_numpy(), "piece": range(n), "pieces": n})
    for c in ("blank", "duplicate", "truncated", "illegal"):
        out[c] = int(pdf[c].sum()) + (seams if c == "illegal" else 0)
    out["cost"] = cost
    out["from_state"], out["to_state"] = [s for s, _ in spans], [t for _, t in spans]
    out["inserts"] = [0] * (n - 1) + [run]
    return out


def _long(rows: DataFrame, schema: T.StructType, most_rows: int, most_bytes: int) -> DataFrame:
    """Conversations over several tasks.  A fold sees one record for each segment of a conversation."""
    there = written(rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).withColumn("uid", F.monotonically_increasing_id()), "conversation-rows")
    same = [F.col(f"b.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("conv", "role", "text")]
    earliest = there.groupBy("conv", "role", "text").agg(F.min(F.struct("turn", "uid"))["uid"].alias("first_uid"))
    marked = there.alias("b").join(earliest.alias("f"), same).select("b.*", (F.col("uid") != F.col("first_uid")).alias("again"))
    cut = _cut(marked, most_rows, most_bytes)
    sums = written(cut.groupBy("seg").applyInPandas(_summarise, _SUMMARY), "conversation-summaries")
    whose = cut.filter("pos = 1").select("seg", "conv")
    settled = "seg long, piece long, pieces long, blank long, duplicate long, truncated long, illegal long, cost long, from_state int, to_state int, inserts int"
    ends = written(sums.join(whose, "seg").groupBy("conv").applyInPandas(_settle, settled), "conversation-ends")
    turns = there.groupBy("conv").agg((F.max("turn") - F.min("turn") + 1).alias("width"), F.countDistinct("turn").alias("turns"))
    gaps = turns.select(F.col("conv").alias("g_conv"), F.coalesce(F.col("width") - F.col("turns"), F.lit(0)).alias("gaps"))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        one = pdf.iloc[0]
        told = list(zip(pdf["role"], pdf["text"], strict=True))
        kinds, _ = faults(told, repeated=list(pdf["again"]))
        _, _, parents = forward(kinds, int(one["from_state"]))
        codes = [CODES[c] for c in backward(parents, int(one["to_state"]))] + ["I" * int(one["inserts"])]
        fixed = [{"role": r, "text": t} for r, t in applied(codes, told, int(one["from_state"]))]
        return pd.DataFrame({"seg": [int(one["seg"])], "audit": ["".join(codes)], "turns": [fixed]})

    walked = cut.join(ends.select("seg", "from_state", "to_state", "inserts"), "seg").groupBy("seg").applyInPandas(walk, T.StructType([T.StructField("seg", T.LongType()), *schema.fields[-2:]]))
    return walked.join(ends, "seg").join(whose, "seg").join(gaps, F.col("conv").eqNullSafe(F.col("g_conv"))).select(*schema.names)


def repaired(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    copies_col: str | None = None, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """Each conversation's repair: conv_id, piece, pieces, gaps, blank, duplicate, truncated, illegal, cost, audit, turns<role,text>.

    A conversation has one row; a long one a row for each segment, whose counts and cost are those of the whole.
    copies_col, if given, says how often a row occurs; a conversation all of whose rows occur 0 times still has its row.
    """
    copies = F.lit(1) if copies_col is None else F.col(copies_col).cast("int")
    text = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col)]
    rows = df.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), copies.alias("copies"), text[0].alias("role"), text[1].alias("text"))
    rows = rows.withColumns({c: F.when(F.col("copies") > 0, F.col(c)).otherwise("") for c in ("role", "text")})
    schema = _result(rows.schema["conv"].dataType)
    small_batches(df.sparkSession)
    size = rows.groupBy("conv").agg(F.sum("copies").alias("n"), F.sum(F.col("copies") * F.octet_length("text")).alias("bytes"))
    large = written(size.filter((F.col("n") > most_rows) | (F.col("bytes") > most_bytes)).select(F.col("conv").alias("large_conv")), "long-conversations")
    found = F.col("conv").eqNullSafe(F.col("large_conv"))
    if large.isEmpty():
        out = _short(rows, schema)
    else:
        out = _short(rows.join(large, found, "left_anti"), schema).unionByName(_long(rows.join(large, found, "left_semi").filter("copies > 0"), schema, most_rows, most_bytes))
    return out.withColumnRenamed("conv", conv_col)


def damaged(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: dropped) by the checksum of conv_id:turn."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    return df.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(text("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text")).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"),
    )


def digests(pieces: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row a conversation, with the whole audit and the SHA-256 of its repaired role:text lines."""
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    keep = [conv_col, *COUNTS, "audit"]
    single = pieces.filter("pieces = 1").select(*keep, F.sha2(lines, 256).alias("repaired_sha256"))
    several = pieces.filter("pieces > 1").select(conv_col, "piece", "pieces", *COUNTS, "audit", lines.alias("lines"), (F.size("turns") > 0).alias("any"))
    schema = single.schema
    out = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, state, begun = [], hashlib.sha256(), False
        for b in batches:
            for r in b.to_pylist():
                audit.append(r["audit"])
                if r["any"]:
                    state.update((("\n" if begun else "") + r["lines"]).encode())
                    begun = True
                if r["piece"] == r["pieces"] - 1:
                    yield pa.RecordBatch.from_pylist([{**{c: r[c] for c in (conv_col, *COUNTS)}, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}], out)
                    audit, state, begun = [], hashlib.sha256(), False

    streamed = several.repartition(conv_col).sortWithinPartitions(conv_col, "piece").mapInArrow(run, schema)
    return single.unionByName(streamed)


def op13_rank_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), copies_col="copies")
    return digests(written(got, "conversation-repairs"))
