"""Secrets: three base rules, and a guess-cost dynamic program for values in credential contexts.

A credential context is a keyword (password, pin, secret key, ...) with "=", ":" or "is" before a
value.  The value is cut into words, dates, repeats, keyboard walks and brute-force spans so that the
sum of the cuts' log10 guesses is least; a value whose cheapest cut still costs many guesses is a
secret even where the base rules are silent (too short, other characters), and a value that is
cheap (a placeholder such as "passwordpassword") adds nothing.

The program looks at every start for words (bounded by the longest word), dates (at most 10
characters) and single brute-force characters.  Repeats and keyboard walks may begin and end anywhere
in a run; a run's cost is concave in its length, so the starts that can still win form a stack (Starts),
and the program takes linear time for them, too.  Words come ranked, most common first: WORDS, or those
of a tokenizer's vocabulary (vocabulary_words), whose ids follow frequency.

Defined cases: a null or empty text has no span; equal rows each get a result row; a null id is
passed through; other columns are ignored or, in redact(), carried along; an empty table gives an
empty result.  On equal cost the cut with fewer parts wins.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_pass, documents
from palimpsest.llm.tokens import tokenizer_path

KINDS = ("assign", "access", "hex", "guess")

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credential|login|(?<![a-z])(?:pass|pin))["']?(?:\x20*+[:=]\x20*+|\x20is\x20)["'`]?([^\s"'`<>,;]+)""",
    re.A | re.I,
)
_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "login", "pin")

#: Common words of passwords, most common first; a parameter of the cost function.
WORDS = (
    "password admin welcome login master dragon monkey letmein qwerty shadow sunshine princess football baseball "
    "superman batman trustno iloveyou hello secret access user test guest root default changeme example sample "
    "token key pass pwd love angel summer winter spring autumn monday friday january march april june july august "
    "michael jordan charlie thomas george robert daniel andrew jessica ashley jennifer hunter ranger killer soccer "
    "hockey tiger eagle flower cookie coffee chocolate computer internet server system network database oracle "
    "company office house money freedom diamond silver golden purple orange yellow black white green blue red the "
    "and for you your with this that not null none true false string value here placeholder xxx abc foo bar baz"
).split()

_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> dict[str, set[str]]:
    """Keys that touch on a staggered keyboard, either hand way; alphabet and digit order count as walks, too."""
    near: dict[str, set[str]] = {}
    for r, row in enumerate(_ROWS):
        for i, c in enumerate(row):
            for rr, j in ((r, i - 1), (r, i + 1), (r - 1, i), (r - 1, i + 1), (r + 1, i), (r + 1, i - 1)):
                if 0 <= rr < len(_ROWS) and 0 <= j < len(_ROWS[rr]):
                    near.setdefault(c, set()).add(_ROWS[rr][j])
    for run in ("abcdefghijklmnopqrstuvwxyz", "0123456789"):
        for a, b in zip(run, run[1:], strict=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


_NEAR = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
_LEET = str.maketrans("013457@$!", "oieastasi")


@lru_cache(maxsize=8)
def _ranks(words: tuple[str, ...]) -> tuple[dict[str, float], int, int]:
    """log10 guesses of each word, length of the shortest and of the longest."""
    return {w: math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}, min(map(len, words), default=1), max(map(len, words), default=0)


def _alphabet(value: str) -> float:
    size = 26 * any("a" <= c <= "z" for c in value) + 26 * any("A" <= c <= "Z" for c in value) + 10 * any("0" <= c <= "9" for c in value)
    size += 33 * any(not c.isalnum() for c in value) + 100 * any(ord(c) > 127 for c in value)
    return math.log10(max(size, 10))


def vocabulary_words(path: str, first: Iterable[str] = WORDS) -> tuple[str, ...]:
    """first, and then the words of a tokenizer's vocabulary (three letters or more) by their ids."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end = model.get("end_of_word_suffix") or ""
    words = (w.removesuffix(end) for w in sorted(model["vocab"], key=model["vocab"].get) if w.endswith(end))
    return tuple(dict.fromkeys([*first, *(w for w in words if len(w) > 2 and w.isascii() and w.isalpha())]))


class Starts:
    """The start of a part that makes cost + log10(length) least, as its end moves on.

    Of two starts the earlier one gains on the later one all the time, so a later start is worth keeping
    while it is ahead; the stack holds starts by when they fall behind, the best one on top.
    """

    def __init__(self):
        self.stack: list[tuple[float, int, float]] = []  # cost, start, the end from which the one beneath is better

    def clear(self) -> None:
        self.stack.clear()

    def add(self, cost: float, start: int, end: int) -> None:
        """A start that parts ending at `end` or later may have."""
        stack = self.stack
        if stack and cost + math.log10(end - start) >= self.least(end):
            return
        while stack:
            until = self._overtaken(cost, start, *stack[-1][:2])
            if len(stack) > 1 and until >= stack[-1][2]:
                stack.pop()
                continue
            stack.append((cost, start, until))
            return
        stack.append((cost, start, math.inf))

    @staticmethod
    def _overtaken(cost: float, start: int, before_cost: float, before: int) -> float:
        gap = before_cost - cost  # at an end e the earlier one wins if gap < log10((e - start) / (e - before))
        if gap >= 0:
            return math.inf
        ratio = 10**gap
        return (start - ratio * before) / (1 - ratio) if ratio < 1 else math.inf

    def least(self, end: int) -> float:
        stack = self.stack
        while len(stack) > 1 and end >= stack[-1][2]:
            stack.pop()
        return stack[-1][0] + math.log10(end - stack[-1][1]) if stack else math.inf


def guess_cost(value: str, words: Iterable[str] = WORDS) -> float:
    """log10 of the guesses that the cheapest segmentation of value needs."""
    ranks, shortest, longest = _ranks(tuple(words))
    n = len(value)
    if not n:
        return 0.0
    if len(low := value.lower()) != n:
        low = value  # some capitals get longer
    plain = low.translate(_LEET)
    one = _alphabet(value)
    joint = 0.3  # where parts meet must be guessed as well
    best = [0.0] + [math.inf] * n
    here = [0.0] * n  # a part that begins here: what is before it, and the joint
    repeats, walks = Starts(), Starts()
    run = walk = 0
    turns = [0] * n  # of the walk up to a character
    for i in range(n + 1):
        if i:
            # Brute force: a character at a time, so that longer spans cost the sum; no joint inside one.
            best[i] = min(best[i], best[i - 1] + one)
            last, start = i - 1, i - 3
            if last and low[last] != low[last - 1]:
                repeats.clear()
                run = last
            if start >= run:
                repeats.add(here[start] + one, start, i)
                best[i] = min(best[i], repeats.least(i))
            if last and low[last] not in _NEAR.get(low[last - 1], ()):
                walks.clear()
                walk = last
            elif last > walk + 1:
                turns[last] = turns[last - 1] + (ord(low[last]) - ord(low[last - 1]) != ord(low[last - 1]) - ord(low[last - 2]))
            if start >= walk:
                walks.add(here[start] + 2.0 - 0.5 * turns[start + 1], start, i)
                best[i] = min(best[i], walks.least(i) + 0.5 * turns[last])
        if i == n:
            break
        here[i] = best[i] + (joint if i else 0.0)
        for j in range(i + shortest, min(n, i + longest) + 1):
            for w, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
                if (r := ranks.get(w)) is not None:
                    upper = 0.0 if value[i:j] == low[i:j] else 0.6
                    best[j] = min(best[j], here[i] + r + extra + upper)
                    break
        if low[i].isdigit() and (m := _DATE.match(low, i, min(n, i + 10))):
            best[m.end()] = min(best[m.end()], here[i] + (2.2 if m.end() - i == 4 else 4.6))
    whole = best[n]
    # A value that repeats a shorter one costs that one, times the number of repeats.
    period = (low + low).find(low, 1)
    if period < n and n % period == 0:
        whole = min(whole, guess_cost(value[:period], words) + math.log10(n // period) + joint)
    return whole


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base rules, ordered."""
    if not text:
        return []
    out = [(*m.span(), 0) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 12] if _hinted(text) else []
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in _ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def _hinted(text: str) -> bool:
    low = text.lower() if not text.islower() else text
    return any(h in low for h in _HINTS)


def guessed_spans(text: str | None, least_cost: float = 10.0, words: Iterable[str] = WORDS) -> list[tuple[int, int, int, float]]:
    """(start, end, 3, cost) of context values that cost at least 10**least_cost guesses."""
    if not text or not _hinted(text):
        return []
    out = []
    for m in _CONTEXT.finditer(text):
        value = m.group(1).rstrip(".!?)]}|*#$%&")
        if (cost := guess_cost(value, words)) >= least_cost:
            out.append((m.start(1), m.start(1) + len(value), 3, cost))
    return out


def all_spans(text: str | None, least_cost: float = 10.0, words: Iterable[str] = WORDS) -> list[tuple[int, int, int, float]]:
    """Base spans, and guessed ones that no base span touches; by start, then kind."""
    base, more, at, reach = base_spans(text), [], 0, 0
    for g in guessed_spans(text, least_cost, words):  # both lists go by start: one sweep
        while at < len(base) and base[at][0] < g[1]:
            reach = max(reach, base[at][1])
            at += 1
        if reach <= g[0]:
            more.append(g)
    return sorted([(s, e, k, math.nan) for s, e, k in base] + more, key=lambda x: (x[0], x[2]))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("cost", T.DoubleType())])


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_cost: float = 10.0, words: Iterable[str] = WORDS) -> DataFrame:
    """id, secrets array<start,end,kind,cost>; cost is the log10 guesses of guessed spans, else null."""
    words = tuple(words)

    def make():
        def fn(columns):
            return [[[{"start": s, "end": e, "kind": KINDS[k], "cost": None if c != c else c} for s, e, k, c in all_spans(t, least_cost, words)] for t in columns[0]]]

        return fn

    narrow = df.select(F.col(id_col).alias("sec_id"), F.col(text_col).cast("string").alias("sec_text"))
    out = arrow_pass(narrow, ["sec_text"], ["sec_id"], [T.StructField("secrets", T.ArrayType(_SPAN))], make)
    return out.withColumnRenamed("sec_id", id_col)


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]", least_cost: float = 10.0, words: Iterable[str] = WORDS) -> DataFrame:
    """df with every secret in text_col replaced; rows, order of columns and clean texts stay as they are."""
    words = tuple(words)

    def clean(text: str | None) -> str | None:
        out, at = [], 0
        for s, e, _, _ in all_spans(text, least_cost, words):
            if s >= at:
                out += [text[at:s], mask]
            at = max(at, e)
        return "".join([*out, text[at:]]) if at else text

    def make():
        return lambda columns: [[clean(t) for t in columns[0]]]

    done = arrow_pass(df, [text_col], df.columns, [T.StructField(text_col, T.StringType())], make)
    return done.select(*df.columns)


def _count(kind: str):
    return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op2_guess_cost_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(documents(spark, sf_dir), words=vocabulary_words(tokenizer_path("word_bpe_49k.json")))
    base = F.filter("secrets", lambda s: s["kind"] != "guess")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [_count(k) for k in KINDS]
    return got.select("doc_id", *counts[:3], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"), counts[3], F.array_max(F.transform("secrets", lambda s: s["cost"])).alias("max_cost"))
