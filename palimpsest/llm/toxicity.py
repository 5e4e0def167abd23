"""Toxicity: a learned lexicon, matched through Levenshtein automata, scored in context windows.

The lexicon is learned from labelled rows: terms whose documents are toxic far more often than not,
in both halves of the sample.  Its trie is intersected with the Levenshtein automaton of every term
(one edit from five letters on, two from nine on): a state is the set of (trie node, edits) that a
prefix of a word reaches, and states and transitions are built when first met, so a word costs a
table step a character and most words die after a few.  A misspelled match weighs less with each
edit, and nothing if the sample knows the word from clean documents.

Matches are summed in windows of `window` words.  A match inside quotation marks, or within five
words of a reporting verb, counts as quoted and is kept apart, so that a logistic regression over
the window scores can tell a document that quotes abuse from one that is abusive.

Training reads at most `max_rows` labelled rows of each class, those with the smallest hashed ids; a
bound on the fit alone: every document is scored, whole.

Defined cases: a null or empty text has no match and the score of such a text; without a toxic row
in the sample all scores are 0; equal rows each get a result row; a null id is not held out; other
columns are ignored or, in keep_clean(), carried along; an empty table gives an empty result; a
document whose repeated labels differ is toxic.
"""

from __future__ import annotations

import logging
import math
import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_pass, documents, fewest, fresh, labels, worker_state, written

LOG = logging.getLogger(__name__)
EDGE = ".,;:!?()[]{}<>|*#$%&_~^=+-/\\\"'`«»“”„‘’‚‹›…¡¿"
_OPEN, _CLOSE = tuple("\"“„«‹"), tuple("\"”“»›")
#: Reporting words of the languages at hand; a parameter.
REPORTING = frozenset("said says wrote writes called calls quoted quotes quote reported sagte sagt schrieb zitat zitiert nannte dit écrit cité cita dijo dice escribió llamó".split())
#: Bounds of the model, parameters of train(): terms of the lexicon, and known clean words near them.
TERMS = 4096
CLEAN = 100_000
CACHE = 300_000
STATES = 60_000


def allowed_edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class FuzzyTrie:
    """The product of a lexicon's trie with its terms' Levenshtein automata, determinised on demand."""

    def __init__(self, terms: dict[str, float], clean: frozenset[str] = frozenset(), fade: float = 0.6):
        self.terms, self.clean, self.fade = terms, clean, fade
        self.children: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        self.limit = [0]  # most edits that a term below a node allows
        self.own = [0]
        for term, w in terms.items():
            k, node = allowed_edits(term), 0
            self.limit[0] = max(self.limit[0], k)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.weight.append(0.0)
                    self.limit.append(0)
                    self.own.append(0)
                node = self.children[node][c]
                self.limit[node] = max(self.limit[node], k)
            self.weight[node], self.own[node] = w, k
        self._fresh()

    def _fresh(self) -> None:
        self.ids: dict[frozenset, int] = {frozenset(): 0}
        self.sets: list[frozenset] = [frozenset()]
        self.steps: list[dict[str, int]] = [{}]
        self.value: list[float] = [0.0]
        self.start = self._state({0: 0}) if self.terms else 0

    def _state(self, least: dict[int, int]) -> int:
        """The state for the least edits by node, closed over skipped letters of a term."""
        queue = list(least)
        while queue:
            node = queue.pop()
            e = least[node] + 1
            for child in self.children[node].values():
                if e <= self.limit[child] and e < least.get(child, 99):
                    least[child] = e
                    queue.append(child)
        key = frozenset(least.items())
        if (got := self.ids.get(key)) is None:
            got = self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.value.append(max((self.weight[n] * self.fade**e for n, e in key if self.weight[n] and e <= self.own[n]), default=0.0))
        return got

    def _step(self, state: int, c: str) -> int:
        least: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.children[node].items():
                cost = e + (letter != c)
                if cost <= self.limit[child] and cost < least.get(child, 99):
                    least[child] = cost
            if e < self.limit[node] and e + 1 < least.get(node, 99):
                least[node] = e + 1  # an extra letter in the word
        return self._state(least) if least else 0

    def match(self, word: str) -> tuple[float, bool]:
        """(weight, exact) of the best term within its edits; 0 if there is none."""
        if (w := self.terms.get(word)) is not None:
            return w, True
        if len(word) < 4:  # one edit from a term of five letters at least
            return 0.0, False
        if len(self.sets) > STATES:
            self._fresh()
        state, steps = self.start, self.steps
        for c in word:
            after = steps[state].get(c)
            if after is None:
                after = self._step(state, c)
                steps[state][c] = after
            if not after:
                return 0.0, False
            state = after
        if self.value[state] and word not in self.clean:
            return self.value[state], False
        return 0.0, False


class Matches(dict):
    """(weight, exact) by raw word, or None; cached."""

    def __init__(self, trie: FuzzyTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, raw: str):
        w, exact = self.trie.match(raw.strip(EDGE))
        got = (w, exact) if w else None
        if len(self) > CACHE:
            self.clear()
        if len(raw) <= 64:
            self[raw] = got
        return got


FEATURES = ("plain", "misspelled", "quoted", "window", "density", "count")


def _quotations(words: list[str]) -> list[bool]:
    """Which words stand in a quotation, of any length; one that is never closed is none."""
    inside, begun = [False] * len(words), -1
    for i, w in enumerate(words):
        opened = w.startswith(_OPEN)
        if opened and begun < 0:
            begun = i
        if begun >= 0 and w.rstrip(".,;:!?)").endswith(_CLOSE) and (len(w) > 1 or begun < i):
            inside[begun : i + 1] = [True] * (i + 1 - begun)
            begun = -1
    return inside


def window_features(text: str | None, matches: Matches, window: int = 20) -> list[float]:
    """The scores that the regression sees, from the matches of a whole text."""
    words = (text or "").lower().split()
    hits = [(i, m) for i, w in enumerate(words) if (m := matches[w])]
    if not hits:
        return [0.0] * len(FEATURES)
    quoted_at = _quotations(words)
    flags = {i: quoted_at[i] or any(x.strip(EDGE) in REPORTING for x in words[max(0, i - 5) : i + 6]) for i, _ in hits}
    plain = sum(w for i, (w, _) in hits if not flags[i])  # misspelled ones with what their edits leave of the weight
    fuzzy = sum(w for i, (w, exact) in hits if not exact and not flags[i])
    quoted = sum(w for i, (w, _) in hits if flags[i])
    most = now = 0.0
    first = 0
    for i, (w, _) in hits:
        now += w * (0.25 if flags[i] else 1.0)
        while hits[first][0] <= i - window:
            j, (v, _) = hits[first]
            now -= v * (0.25 if flags[j] else 1.0)
            first += 1
        most = max(most, now)
    loud = sum(1 for i, _ in hits if not flags[i])
    return [math.log1p(plain), math.log1p(fuzzy), math.log1p(quoted), math.log1p(most), min(1.0, 10 * loud / len(words)), min(1.0, loud / 4)]


@dataclass(frozen=True)
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    clean: frozenset[str] = frozenset()
    coefficients: tuple[float, ...] = ()

    def score(self, features: list[float]) -> float:
        if not self.coefficients:
            return 0.0
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(labelled: DataFrame, id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = 6000) -> DataFrame:
    """(id, label, half) of at most max_rows training rows of each class."""
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("train_id")).agg(F.max(label_col).cast("int").alias("label"))
    order = F.xxhash64("train_id", F.lit("toxicity"))
    parts = [fewest(rows.filter(F.col("label") == y), [order, "train_id"], max_rows) for y in (0, 1)]
    return parts[0].unionByName(parts[1]).withColumn("half", F.pmod(F.xxhash64("train_id", F.lit("half")), F.lit(2)).cast("int"))


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression with intercept by Newton's method; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def train(df: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 6000, least_support: int = 5, max_terms: int = TERMS, max_clean: int = CLEAN) -> Model:
    """Lexicon, known clean words and regression from a bounded sample of df's labelled rows.

    A sample with more terms or clean words than the bounds gives the strongest terms and the most frequent
    words, and a warning.
    """
    chosen = written(sample(labelled, id_col, label_col, max_rows), "toxicity-sample")
    # The broadcast side has at most two times max_rows small rows.
    docs = df.select(F.col(id_col).alias("train_id"), F.col(text_col).cast("string").alias("train_text")).join(F.broadcast(chosen), "train_id")
    # Copies and near copies would make their rare words look like evidence: one row for each least shingle hash.
    words = F.split(F.coalesce("train_text", F.lit("")), r"\s+")
    least_hash = F.transform(F.array(words), lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 3, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, 4)))))
    # Of rows that share an id, and of copies, the least is taken: always the same one.
    docs = docs.groupBy("train_id", "label", "half").agg(F.min("train_text").alias("train_text")).withColumn("alike", F.get(least_hash, 0))
    docs = docs.groupBy("label", "alike").agg(F.min(F.struct("train_id", "half", "train_text")).alias("d")).select("d.*", "label")
    docs = written(docs, "toxicity-train")
    sizes = {(r["label"], r["half"]): r["n"] for r in docs.groupBy("label", "half").agg(F.count("*").alias("n")).collect()}
    if not any(y == 1 for y, _ in sizes):
        return Model()
    count = T.StructType([T.StructField("term", T.StringType())] + [T.StructField(n, T.LongType()) for n in ("n00", "n01", "n10", "n11")])

    def make_counts():
        def fn(columns):
            seen: dict[str, list[int]] = {}
            for text, label, half in zip(*columns, strict=True):
                for w in {w.strip(EDGE) for w in (text or "").lower().split()}:
                    if len(w) > 3:
                        seen.setdefault(w, [0, 0, 0, 0])[2 * label + half] += 1
            top = [{"term": t, "n00": n[0], "n01": n[1], "n10": n[2], "n11": n[3]} for t, n in seen.items()]
            return [[top] + [[] for _ in columns[0][1:]]]

        return fn

    counts = arrow_pass(docs, ["train_text", "label", "half"], [], [T.StructField("terms", T.ArrayType(count))], make_counts)
    counts = counts.select(F.explode("terms").alias("c")).groupBy("c.term").agg(*(F.sum(f"c.{n}").alias(n) for n in ("n00", "n01", "n10", "n11")))
    counts = written(counts.filter(F.col("n00") + F.col("n01") + F.col("n10") + F.col("n11") > 1), "toxicity-terms")

    def odds(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
        return F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))

    n = lambda y, h: sizes.get((y, h), 0)
    weight = odds(F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01"), n(1, 0) + n(1, 1), n(0, 0) + n(0, 1))
    by_half = [odds(F.col(f"n1{h}"), F.col(f"n0{h}"), n(1, h), n(0, h)) for h in (0, 1)]
    good = (F.col("n10") + F.col("n11") >= least_support) & (weight >= 2.5) & (by_half[0] >= 1.2) & (by_half[1] >= 1.2)
    terms = {r[0]: float(r[1]) for r in counts.select("term", weight.alias("w"), good.alias("g")).filter("g").orderBy(F.desc("w"), "term").limit(max_terms).select("term", "w").collect()}
    if not terms:
        return Model()
    if len(terms) == max_terms:
        LOG.warning("the lexicon holds the %d strongest terms only", max_terms)

    def make_near():
        trie = FuzzyTrie(terms)
        return lambda columns: [[t not in terms and trie.match(t)[0] > 0 for t in columns[0]]]

    known = counts.filter(F.col("n00") + F.col("n01") > 0)
    near = arrow_pass(known, ["term"], ["term", "n00", "n01"], [T.StructField("near", T.BooleanType())], make_near).filter("near")
    clean = frozenset(r[0] for r in near.orderBy(F.desc(F.col("n00") + F.col("n01")), "term").limit(max_clean).select("term").collect())
    if len(clean) == max_clean:
        LOG.warning("only the %d most frequent clean words near the lexicon are known", max_clean)

    def make_features():
        matches = Matches(FuzzyTrie(terms, clean))
        return lambda columns: [[window_features(t, matches) for t in columns[0]]]

    seen = arrow_pass(docs, ["train_text"], ["label"], [T.StructField("x", T.ArrayType(T.DoubleType()))], make_features).collect()
    beta = regression(np.array([r["x"] for r in seen]), np.array([r["label"] for r in seen]))
    return Model(terms, clean, tuple(map(float, beta)))


def scored(df: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] | None = None, name: str = "score") -> DataFrame:
    """The keep columns (all by default) and the score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def make():
        own = shared.value
        matches = worker_state(("toxicity", key), lambda: Matches(FuzzyTrie(own.terms, own.clean)))  # outlives the task
        return lambda columns: [[own.score(window_features(t, matches)) for t in columns[0]]]

    return arrow_pass(df, [text_col], df.columns if keep is None else keep, [T.StructField(name, T.DoubleType())], make)


def keep_clean(df: DataFrame, labelled: DataFrame, least_toxic: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of df whose score is under least_toxic."""
    model = train(df, labelled, id_col, text_col, label_col)
    name = fresh(df, "toxicity_score")
    return scored(df, model, text_col, None, name).filter(F.col(name) < least_toxic).select(*df.columns)


def op5_lexicon_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    got = scored(docs, train(docs, labels(spark, sf_dir)), keep=("doc_id",))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
