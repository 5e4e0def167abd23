"""Soft-membership mixing: document rates whose expected domain tokens match target weights.

Domains are the classes of a labelled table (here good, low quality and toxic).  A classifier of two
layers is fitted on a bounded sample of labelled rows: word log-ratios by class on one half (naive
Bayes over hashed words), and a softmax regression over those and a few shape features on the other.
It gives every document soft memberships p.  Rates r >= 0 then minimise, with t_i the tokens,

    sum_d w_d / 2 ((sum_i r_i t_i p_id - T_d) / T)^2 + ridge * sum_i t_i / T ((r_i - 1)^2 / 2 + still |r_i - 1|)

with w_d half the inverse of the domain's share of tokens (0.02 at least).  The small ridge picks the
solution nearest to 1; `still` keeps documents that are hardly pulled at exactly once.

Projected gradient with lazy projection: the gradient of document i is m . p_i for k numbers m (w_d times
the domain's residual), so what a pass adds up are those, and the rates, r = max(0, 1 - shrunk(m . p, still)),
stay an expression over the posteriors.  A pass is one aggregate over all documents: the expected totals,
and the k x k curvature by which the step is scaled (so in the k multipliers it is a damped Newton step);
steps that don't descend are halved.  The fit ends when the gradient settles; if it has not after `rounds` passes, the
best rates so far are taken, with a warning.  rates() logs expected and target tokens, and warns
where they differ by over one percent of all tokens (targets that no rates reach).

Defined cases: a null or empty text has no tokens and no weight, but gets a rate like any other; with
fewer than two labelled classes all rates are 1; equal rows share a rate; a null id is passed through,
and stays once in mixed(); extra columns are ignored or, in mixed(), carried along whatever their names;
an empty table gives an empty result; a document whose repeated labels differ belongs to the worst.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import arrow_pass, documents, fewest, labels, worker_state, written

LOG = logging.getLogger(__name__)
DOMAINS = ("good", "low", "toxic")
#: Target shares of tokens by domain.  Memberships are soft: every document has some toxic share, so none at all is out of reach.
TARGETS = {"good": 0.92, "low": 0.06, "toxic": 0.02}
BUCKETS = 32_768
_STRIP = ".,;:!?()[]{}<>|*#$%&\"'«»“”„"
_SHAPE = 6


def domain_of(quality: Column, toxic: Column) -> Column:
    """0 good, 1 low, 2 toxic."""
    return F.when(toxic == 1, 2).when(quality == 0, 1).when(quality == 1, 0)


class Buckets(dict):
    """Hash bucket by word as it stands, cached; case and punctuation beside it make no difference."""

    def __missing__(self, raw: str) -> int:
        got = zlib.crc32(raw.lower().strip(_STRIP).encode("utf-8", "surrogatepass")) % BUCKETS
        if len(self) > 200_000:
            self.clear()
        if len(raw) <= 64:
            self[raw] = got
        return got


def features(text: str | None, ratios: np.ndarray, buckets: Buckets) -> tuple[list[float], int]:
    """Six numbers of shape, for each class but the first the mean and the peak of its words' log-ratios; and the token count."""
    words = (text or "").split()
    if not words:
        return [0.0] * (_SHAPE + 2 * len(ratios)), 0
    n = len(words)
    seen, counts = np.unique(np.fromiter(map(buckets.__getitem__, words), np.int64, n), return_counts=True)
    x = [sum(map(text.count, "#*$%&|<>")) / n, text.count("!") / n, sum(map(str.isupper, words)) / n, len(seen) / n, np.log1p(n) / 10, len(text) / n / 10]
    for r in ratios:
        v = r[seen]
        x += [float(counts @ v) / n, float(np.partition(v, -3)[-3:].mean()) if len(v) > 3 else 0.0]
    return x, n


def softmax_regression(x: np.ndarray, y: np.ndarray, k: int, ridge: float = 1.0, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, coefficients) by gradient descent with momentum; the sample's class shares stay as they are."""
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    beta, move = np.zeros((z.shape[1], k)), 0.0
    onehot = np.eye(k)[y]
    for _ in range(rounds):
        a = z @ beta
        p = np.exp(a - a.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = z.T @ (p - onehot) / len(z) + ridge / len(z) * beta
        move = 0.9 * move - 0.5 * grad
        beta = beta + move
    return mean, scale, beta


def posteriors(
    df: DataFrame, domains: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = len(DOMAINS), max_rows: int = 12_000, keep: Sequence[str] | None = None, prefix: str = "mix_"
) -> DataFrame | None:
    """df's keep columns (its id by default) with <prefix>tokens and <prefix>p0 ... of the k domains.

    The classifier is fitted on at most max_rows rows of domains (id, domain).  None if fewer than two domains have rows.
    """
    rows = domains.select(F.col(id_col).alias("mix_id"), F.col("domain").cast("int").alias("domain")).dropna().groupBy("mix_id").agg(F.max("domain").alias("domain"))
    chosen = fewest(rows, [F.xxhash64("mix_id", F.lit("mixing")), "mix_id"], max_rows)
    chosen = written(chosen.withColumn("half", F.pmod(F.xxhash64("mix_id", F.lit("half")), F.lit(2)).cast("int")), "mixing-sample")
    narrow = df.select(F.col(id_col).alias("mix_id"), F.col(text_col).cast("string").alias("mix_text"))
    # At most max_rows small rows are broadcast.
    docs = written(narrow.join(F.broadcast(chosen), "mix_id").groupBy("mix_id", "domain", "half").agg(F.min("mix_text").alias("mix_text")), "mixing-train")
    sizes = {r["domain"]: r["n"] for r in docs.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None

    cell = T.StructType([T.StructField("i", T.IntegerType()), T.StructField("v", T.DoubleType())])

    def make_counts():
        buckets = worker_state("buckets", Buckets)

        def fn(columns):
            sums = np.zeros((k, BUCKETS))  # documents of a class with a word of the bucket
            for text, domain, half in zip(*columns, strict=True):
                if half == 0:
                    sums[domain][list({buckets[w] for w in (text or "").split()})] += 1
            own = np.flatnonzero(sums)
            return [[[{"i": int(i), "v": float(v)} for i, v in zip(own, sums.ravel()[own], strict=True)]] + [[] for _ in columns[0][1:]]]

        return fn

    got = arrow_pass(docs, ["mix_text", "domain", "half"], [], [T.StructField("sums", T.ArrayType(cell))], make_counts)
    sums = np.zeros(k * BUCKETS)
    for r in got.select(F.explode("sums").alias("c")).groupBy("c.i").agg(F.sum("c.v").alias("v")).collect():
        sums[r["i"]] = r["v"]
    sums = sums.reshape(k, BUCKETS)
    present = np.maximum(sums.max(1, keepdims=True), 1)
    rates = np.log(sums / present + 1 / present.sum())
    ratios = (rates - rates[0])[1:] * (sums.sum(0) / (sums.sum(0) + 5))  # a word that was rarely seen says little

    def make_features():
        buckets = worker_state("buckets", Buckets)
        return lambda columns: [[features(t, ratios, buckets)[0] for t in columns[0]]]

    seen = arrow_pass(docs.filter("half = 1"), ["mix_text"], ["domain"], [T.StructField("x", T.ArrayType(T.DoubleType()))], make_features).collect()
    if len({r["domain"] for r in seen}) < 2:
        return None
    mean, scale, beta = softmax_regression(np.array([r["x"] for r in seen]), np.array([r["domain"] for r in seen]), k)

    def make():
        buckets = worker_state("buckets", Buckets)

        def fn(columns):
            got = [features(t, ratios, buckets) for t in columns[0]]
            if not got:
                return [[]] * (k + 1)
            a = np.column_stack([np.ones(len(got)), (np.array([x for x, _ in got]) - mean) / scale]) @ beta
            p = np.exp(a - a.max(1, keepdims=True))
            return [[n for _, n in got], *(p / p.sum(1, keepdims=True)).T]

        return fn

    fields = [T.StructField(f"{prefix}tokens", T.LongType())] + [T.StructField(f"{prefix}p{d}", T.DoubleType()) for d in range(k)]
    return arrow_pass(df, [text_col], [id_col] if keep is None else keep, fields, make)


@dataclass
class Fit:
    """The rates as an expression over the posteriors, with the expected and the target tokens of each domain."""

    rate: Column
    expected: list[float]
    targets: list[float]
    passes: int


def fit(soft: DataFrame, targets: Sequence[float], ridge: float = 1e-3, still: float = 0.3, tolerance: float = 1e-6, rounds: int = 60, prefix: str = "mix_") -> Fit:
    """Fits the rates of soft (<prefix>tokens, <prefix>p0 ...) to the targets.

    The budget is such that the first domain's target is what it has.  Ends when no part of the gradient, in
    shares of all tokens, exceeds the tolerance, or with a warning after `rounds` passes; the last accepted step is the best.
    """
    k = len(targets)
    p = [F.col(f"{prefix}p{i}") for i in range(k)]
    t = F.col(f"{prefix}tokens").cast("double")
    have = [float(x or 0.0) for x in soft.agg(*(F.sum(t * x) for x in p)).first()]
    whole = sum(have) or 1.0
    share = sum(targets) or 1.0
    budget = have[0] / (targets[0] / share) if targets[0] else whole
    goal = [w / share * budget for w in targets]
    weights = np.array([0.5 / max(h / whole, 0.02) for h in have]) / ridge  # of multipliers in units of the ridge
    aim = np.array(goal) / whole
    pairs = [(a, b) for a in range(k) for b in range(a, k)]

    def rate_of(pull: Column) -> Column:
        shrunk = F.when(pull > still, pull - still).when(pull < -still, pull + still).otherwise(0.0)
        return F.greatest(F.lit(0.0), 1 - shrunk)

    def pull_of(multipliers: np.ndarray) -> Column:
        return reduce(lambda a, b: a + b, (F.lit(float(m)) * x for m, x in zip(multipliers, p, strict=True)))

    def state(multipliers: np.ndarray):
        """Domain totals, the value that the multipliers lower, its gradient and curvature: one aggregate."""
        rows = soft.select(t.alias("t"), pull_of(multipliers).alias("l"), *(x.alias(f"p{i}") for i, x in enumerate(p)))
        rows = rows.select("t", "l", rate_of(F.col("l")).alias("r"), *(f"p{i}" for i in range(k)))
        live = F.when((F.col("r") > 0) & (F.abs("l") > still), F.col("t")).otherwise(0.0)
        cost = (F.col("r") - 1) ** 2 / 2 + still * F.abs(F.col("r") - 1) + F.col("r") * F.col("l")
        sums = [F.sum(F.col("t") * F.col("r") * F.col(f"p{i}")) for i in range(k)] + [F.sum(live * F.col(f"p{a}") * F.col(f"p{b}")) for a, b in pairs] + [F.sum(F.col("t") * cost)]
        got = [float(x or 0.0) for x in rows.agg(*(x.alias(f"s{i}") for i, x in enumerate(sums))).first()]
        curve = np.diag(1 / weights)
        for (a, b), x in zip(pairs, got[k:-1], strict=True):
            curve[a, b] += x / whole
            curve[b, a] = curve[a, b]
        value = (multipliers**2 / weights).sum() / 2 + multipliers @ aim - got[-1] / whole
        return got[:k], value, multipliers / weights + aim - np.array(got[:k]) / whole, curve

    def scaled(slope: np.ndarray, curve: np.ndarray) -> np.ndarray:
        """The step; where the dead zone hides the curvature, it is held to 2, or to what the multipliers have come to."""
        step = np.linalg.solve(curve, -slope)
        return step * min(1.0, max(2.0, np.abs(at).max()) / max(np.abs(step).max(), 1e-300))

    at = np.zeros(k)
    now, value, slope, curve = state(at)
    step, size = scaled(slope, curve), 1.0
    for n in range(rounds):
        if np.abs(slope).max() <= tolerance:
            return Fit(rate_of(pull_of(at)), now, goal, n + 1)
        tried = state(at + size * step)
        if tried[1] <= value + 1e-4 * size * (slope @ step) or np.abs(tried[2]).max() <= tolerance:
            at, (now, value, slope, curve) = at + size * step, tried
            step, size = scaled(slope, curve), 1.0
        else:
            size /= 2
    LOG.warning("mixing rates did not settle in %d passes: gradient %.2g, expected tokens %s, targets %s", rounds, np.abs(slope).max(), now, goal)
    return Fit(rate_of(pull_of(at)), now, goal, rounds)


def _with_rates(df: DataFrame, domains: DataFrame, targets: Mapping[str, float], id_col: str, text_col: str, max_rows: int, keep: Sequence[str], prefix: str) -> DataFrame | None:
    """The keep columns, <prefix>tokens, <prefix>p0 ... and <prefix>rate; None without two labelled classes."""
    soft = posteriors(df, domains, id_col, text_col, len(targets), max_rows, keep, prefix)
    if soft is None:
        return None
    soft = written(soft, "mixing-posteriors")
    found = fit(soft, list(targets.values()), prefix=prefix)
    whole = sum(found.expected) or 1.0
    for name, got, want in zip(targets, found.expected, found.targets, strict=True):
        LOG.log(logging.WARNING if abs(got - want) > 0.01 * whole else logging.INFO, "mixing %s: %.0f tokens expected, target %.0f", name, got, want)
    return soft.withColumn(f"{prefix}rate", found.rate)


def rates(df: DataFrame, domains: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 12_000) -> DataFrame:
    """id, tokens, p and rate of every row of df; domains: (id, domain), domain a place in targets."""
    got = _with_rates(df, domains, targets, id_col, text_col, max_rows, [id_col], "mix_")
    if got is None:
        words = F.size(F.filter(F.split(F.col(text_col).cast("string"), r"\s+"), lambda w: w != ""))
        alone = F.array(*(F.lit(1.0 if i == 0 else 0.0) for i in range(len(targets))))
        return df.select(id_col, F.coalesce(words, F.lit(0)).cast("long").alias("tokens"), alone.alias("p"), F.lit(1.0).alias("rate"))
    p = F.array(*(F.col(f"mix_p{d}") for d in range(len(targets))))
    return got.select(id_col, F.col("mix_tokens").alias("tokens"), p.alias("p"), F.col("mix_rate").alias("rate"))


def copies(rate: Column, id_col: str) -> Column:
    """How often a document stays: the whole part of its rate, and once more if its hashed id falls under the rest; expected to be the rate."""
    draw = F.pmod(F.xxhash64(id_col, F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mixed(df: DataFrame, domains: DataFrame, targets: Mapping[str, float] = TARGETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, each as often as its rate says; rows with a null id stay once.

    The posteriors are written beside the rows, so that nothing has to be joined.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "_"
    got = _with_rates(df, domains, targets, id_col, text_col, 12_000, df.columns, prefix)
    if got is None:
        return df
    times = F.when(F.col(id_col).isNull(), 1).otherwise(copies(F.col(f"{prefix}rate"), id_col))
    return got.select(*df.columns, F.explode(F.array_repeat(F.lit(0), times)).alias(f"{prefix}copy")).drop(f"{prefix}copy")


def labelled_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


def op3_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rates(documents(spark, sf_dir), labelled_domains(spark, sf_dir))
    soft = [F.get("p", i).alias(f"p_{d}") for i, d in enumerate(DOMAINS)]
    return got.select("doc_id", "tokens", *soft, "rate", copies(F.col("rate"), "doc_id").alias("copies"))
