"""Personal data by bootstrapped contextual extraction.

Seeds are what four base rules find (email, ip, card, phone).  Every seed, and every other token
that looks like an identifier, is a node "instance" of a graph; the one and two words before it (an
identifier right before it counts as one) are its "patterns".  Scores flow from seed instances to patterns (a smoothed precision per kind) and
back to unlabelled instances, for a few rounds of Spark joins; an instance that is believed in counts
like a seed in the next round, so it can bring in patterns that met no seed.  Patterns that end above
a threshold then mark further identifiers of their kind.  Documents are read once: what the graph needs is
written to the shared folder, and everything after works on that.

Defined cases: a null or empty text has no span; equal rows each get their own result row; a null
id is passed through; columns other than id and text are ignored, so their names cannot clash; an
empty table gives an empty result.  Ties between patterns go to the better score, then the
lower-numbered kind.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from palimpsest.llm.common import arrow_pass, documents, written

KINDS = ("email", "ip", "card", "phone")
SALTS = 16

_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile(r"[0-9@]")
_RUN = re.compile(r"\S+")
_DIGITS = re.compile("[0-9]+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start; in code points, end exclusive; linear in the text."""
    if not text or not _DIGIT_OR_AT.search(text):
        return []
    out = []
    if "@" in text:
        # The part before "@" holds no "@", so its leftmost start is where its run begins or the last match ended.
        free = 0
        for m in _AT.finditer(text):
            at = begin = m.start()
            while begin > free and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                out.append((0, begin, m.end()))
                free = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, *m.span()))
    return out


def looks_like(token: str) -> list[int]:
    """The kinds that an unlabelled token could be of, by its characters alone."""
    n = sum(c in "0123456789" for c in token)
    out = []
    if "@" in token and len(token) > 4:
        out.append(0)
    if token.count(".") >= 3 and n >= 4:
        out.append(1)
    if 13 <= n <= 19:
        out.append(2)
    if 7 <= n <= 15:
        out.append(3)
    return out


def _key(s: str) -> str:
    """s, or where it is long what stands for it."""
    return s if len(s) <= 96 else "#" + hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def _contexts(text: str, found: list[tuple[int, int, int]]) -> Iterator[tuple[str, str]]:
    """The last and the last but one word before each of found (ordered); digits count alike, an identifier between is <kind>.

    Identifiers that overlap share a context.  The words of one lie behind the one before, so the whole is linear in the text.
    """
    behind, end, last = [], 0, None
    i = 0
    while i < len(found):
        j, reach = i + 1, found[i][1]
        while j < len(found) and found[j][0] < reach:
            reach = max(reach, found[j][1])
            j += 1
        words = [_DIGITS.sub("0", w.lower()) for w in text[end : found[i][0]].rsplit(None, 2)[-2:]]
        words = ([*behind, last] if last else []) + words if len(words) < 2 else words
        one, two = (words[-1] if words else ""), (words[-2] if len(words) > 1 else "")
        for _ in range(i, j):
            yield one, two
        behind, last, end = words[-1:], f"<{KINDS[found[i][2]] if found[i][2] >= 0 else 'other'}>", reach
        i = j


def graph_rows(text: str | None, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Instances of one text with their patterns; `meets`, at the first instance after a word, counts the word's places in the text, else 0."""
    if not text or not _DIGIT_OR_AT.search(text):
        return []
    found = [(s, e, k) for k, s, e in spans]
    covered = sorted((s, e) for _, s, e in spans)
    reach = 0
    at = 0
    for m in _RUN.finditer(text):
        s, e = m.span()
        if not _DIGIT_OR_AT.search(text, s, e):
            continue
        while s < e and text[s] in _EDGE:
            s += 1
        while e > s and text[e - 1] in _EDGE:
            e -= 1
        while at < len(covered) and covered[at][0] < e:
            reach = max(reach, covered[at][1])
            at += 1
        if s < e and reach <= s and looks_like(text[s:e]):
            found.append((s, e, -1))
    if not found:
        return []
    found.sort()
    words = Counter(_DIGITS.sub("0", text.lower()).split())
    contexts = list(_contexts(text, found))
    followed = Counter(one for one, _ in contexts)  # a word that touches what follows is no token
    rows = []
    for (s, e, k), (one, two) in zip(found, contexts, strict=True):
        if not one:
            continue
        item = text[s:e]
        rows.append({"kind": k, "start": s, "end": e, "fits": looks_like(item) if k < 0 else [], "item": _key(item.lower()), "one": _key(one), "two": f"{_key(two)} {_key(one)}", "meets": max(words.get(one, 0), followed.pop(one)) if one in followed else 0})
    return rows


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("kind", "start", "end")])
_NODE = T.StructType([
    T.StructField("kind", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("fits", T.ArrayType(T.IntegerType())), T.StructField("item", T.StringType()), T.StructField("one", T.StringType()), T.StructField("two", T.StringType()), T.StructField("meets", T.IntegerType()),
])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One pass over the texts: id, base spans and graph nodes of every row."""

    def make():
        def fn(columns):
            spans = [base_spans(t) for t in columns[0]]
            nodes = [graph_rows(t, s) for t, s in zip(columns[0], spans, strict=True)]
            return [[[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans], nodes]

        return fn

    fields = [T.StructField("base_found", T.ArrayType(_SPAN)), T.StructField("nodes", T.ArrayType(_NODE))]
    out = arrow_pass(df.select(F.col(id_col).alias("pii_id"), F.col(text_col).cast("string").alias("pii_text")), ["pii_text"], ["pii_id"], fields, make)
    return out.withColumn("row", F.monotonically_increasing_id())


def patterns(nodes: DataFrame, rounds: int = 3, least_score: float = 0.6, least_items: int = 3) -> DataFrame:
    """Patterns with (pattern, kind, score) that end above the threshold.

    nodes: kind (-1: unlabelled), fits, item, one, two, meets.  A pattern's score for a kind is the mass of
    that kind among its occurrences, over all places where its words stand in those documents, with
    one more place as smoothing.  A pattern counts in a round only if it met `least_items` different seeds
    or instances whose belief has reached `least_score` by then.
    """
    edges = nodes.select("kind", "fits", "item", "meets", F.explode(F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), "two"))).alias("pattern"))
    edges = edges.groupBy("pattern", "item", "kind").agg(F.count("*").alias("n"), F.sum("meets").alias("meets"), F.max("fits").alias("fits"))
    # A pattern of fewer instances than least_items, seeds or not, can never count.
    totals = edges.groupBy("pattern").agg(
        F.sum(F.when(F.col("pattern").startswith("1 "), F.col("meets")).otherwise(F.col("n"))).alias("places"),
        F.count("*").alias("items"),
    ).filter(F.col("items") >= least_items)
    edges = written(edges.join(totals.select("pattern"), "pattern", "left_semi"), "pii-edges")
    totals = written(totals.select("pattern", "places"), "pii-places")
    links = edges.groupBy("pattern", "item").agg(F.sum("n").alias("n"), F.max("fits").alias("fits"))
    links = written(links.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(SALTS)).cast("int")), "pii-links")
    belief = edges.filter("kind >= 0").select("item", "kind").distinct().withColumn("belief", F.lit(1.0))
    seeds = belief
    scored = None
    for r in range(rounds):
        mass = links.join(belief, "item").groupBy("pattern", "kind").agg(
            F.sum(F.col("n") * F.col("belief")).alias("mass"), F.count_if(F.col("belief") >= least_score).alias("sure")
        )
        mass = mass.withColumn("sure", F.sum("sure").over(Window.partitionBy("pattern"))).filter(F.col("sure") >= least_items)
        scored = mass.join(totals, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("places") + 1)).alias("score"))
        scored = written(scored.filter(F.col("score") >= least_score / 2), f"pii-patterns-{r}")
        # A pattern may have any number of instances: its links are spread over the salts.
        salted = scored.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        spread = links.join(salted, ["pattern", "salt"]).filter(F.array_contains("fits", F.col("kind")))
        spread = spread.groupBy("item", "kind").agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("belief"))
        belief = seeds.unionByName(spread.join(seeds, "item", "left_anti"))
    return scored.filter(F.col("score") >= least_score)


def extract(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, least_score: float = 0.6, least_items: int = 3) -> DataFrame:
    """id, base array<kind,start,end> and found array<kind,start,end>: what the patterns add outside the base spans."""
    rows = written(scan(df, id_col, text_col), "pii-rows")
    nodes = rows.select("row", F.explode("nodes").alias("x")).select("row", "x.*")
    good = patterns(nodes, rounds, least_score, least_items)
    open_ = nodes.filter("kind = -1").select("row", "start", "end", "fits", F.explode(F.array(F.concat(F.lit("1 "), "one"), F.concat(F.lit("2 "), "two"))).alias("pattern"))
    # A pattern may stand before any number of open identifiers: those are dealt over the salts.
    open_ = open_.withColumn("salt", F.pmod(F.xxhash64("row", "start"), F.lit(SALTS)).cast("int"))
    good = good.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    hits = open_.join(good, ["pattern", "salt"]).filter(F.array_contains("fits", F.col("kind")))
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("score", -F.col("kind"))).alias("best"))
    added = best.select("row", F.struct((-F.col("best.col2")).cast("int").alias("kind"), "start", "end").alias("s")).groupBy("row").agg(F.collect_list("s").alias("found"))
    out = rows.select("row", "pii_id", "base_found").join(added, "row", "left")
    empty = F.array().cast(T.ArrayType(_SPAN))
    return out.select(F.col("pii_id").alias(id_col), F.col("base_found").alias("base"), F.coalesce("found", empty).alias("found"))


def _joined(spans):
    text = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(text, ",")


def _count(kind: int):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")


def op1_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = extract(documents(spark, sf_dir))
    counts = [_count(k) for k in range(len(KINDS))]
    return got.select(
        "doc_id", *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "found"))).alias("spans"),
        F.size("found").cast("long").alias("n_found"),
    )
