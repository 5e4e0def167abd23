"""Answer and retrieval metrics as Columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions.stem import stem_word

#: Phrases that decline to answer, negating tokens, judge levels.
DECLINES = (
    "no information available", "not mentioned", "cannot be determined", "not enough information", "no information", "not answerable",
    "cannot answer", "don't have information", "no relevant information", "not provided", "unknown", "n/a",
)
NEGATIONS = ("no", "not", "never", "cannot", "cant", "without")
QUALITY = {"excellent": 1.0, "good": 0.9, "partial": 0.7, "poor": 0.4, "none": 0.1}


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def string_contain(output: Column, answers: Column) -> Column:
    """All non-empty normalised answers are parts of the output; no answers: wrong."""
    out = tx.normalize_text(output)
    kept = F.filter(F.transform(answers, tx.normalize_text), lambda a: a != "")
    return (F.size(kept) > 0) & F.forall(kept, lambda a: out.contains(a))


def exact_match(output: Column, answers: Column) -> Column:
    out = tx.normalize_text(output)
    return F.exists(answers, lambda a: tx.normalize_text(a) == out)


def option_match(output: Column, answer: Column) -> Column:
    """Equal sets of letters; two empty sets are equal."""
    return tx.option_letters(output) == tx.option_letters(answer)


def option_score(output: Column, answer: Column) -> Column:
    """max(0, (right - wrong) / expected); 0 if none is expected."""
    a, b = tx.option_letters(output), tx.option_letters(answer)
    right, wrong = F.size(F.array_intersect(a, b)), F.size(F.array_except(a, b))
    return F.when(F.size(b) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), (right - wrong) / F.size(b)))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Multiset overlap of normalised tokens; 0 if either is empty."""
    p, g = (F.filter(F.split(tx.normalize_answer(c), " "), lambda w: w != "") for c in (prediction, gold))
    words = F.array_distinct(F.array_intersect(p, g))
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    common = _sum(F.transform(words, lambda w: F.least(count(p, w), count(g, w)).cast("double")))
    return F.when((common == 0) | (F.size(p) == 0) | (F.size(g) == 0), 0.0).otherwise(2 * common / (F.size(p) + F.size(g)))


def multi_hop_f1(prediction: Column, gold: Column) -> Column:
    """Parts at commas; the mean over gold parts of the best prediction part."""
    p, g = (F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "") for c in (prediction, gold))
    best = F.transform(g, lambda x: F.coalesce(F.array_max(F.transform(p, lambda y: token_f1(y, x))), F.lit(0.0)))
    return F.when(F.size(g) == 0, 0.0).otherwise(_sum(best) / F.size(g))


def contains_tokens(prediction: Column, gold: Column) -> Column:
    """gold's tokens, number words as digits, stand together in the prediction; a negation anywhere before them denies it."""
    p, g = (tx.words(tx.normalize_answer(tx.number_words(c))) for c in (prediction, gold))
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(p) - F.size(g) + 1, F.lit(1))), lambda i: F.slice(p, i, F.size(g)) == g)
    first = F.get(places, 0)
    denied = F.arrays_overlap(F.slice(p, 1, F.greatest(F.coalesce(first, F.lit(1)) - 1, F.lit(0))), F.array(*map(F.lit, NEGATIONS)))
    return (F.size(g) > 0) & first.isNotNull() & ~F.coalesce(denied, F.lit(False))


def floored_f1(prediction: Column, gold: Column) -> Column:
    return F.greatest(token_f1(prediction, gold), F.when(contains_tokens(prediction, gold), 0.5).otherwise(0.0))


def permissive_f1(prediction: Column, gold: Column) -> Column:
    """The older floor: containment either way, or a common start."""
    p, g = tx.normalize_answer(prediction), tx.normalize_answer(gold)
    near = (g != "") & (p != "") & (p.contains(g) | g.contains(p) | p.startswith(F.substring(g, 1, 5)))
    return F.greatest(token_f1(prediction, gold), F.when(near, 0.5).otherwise(0.0))


def declines(prediction: Column) -> Column:
    low = F.lower(prediction)
    return F.exists(F.array(*map(F.lit, DECLINES)), lambda p: low.contains(p))


def by_category(category: Column, prediction: Column, gold: Column) -> tuple[Column, Column]:
    """(score, is_correct): 1 multi-hop, 2 with date floor, 3 before the semicolon, 4 single-hop, 5 adversarial; correct from 0.5."""
    from palimpsest.functions.dates import same_day

    dated = F.greatest(token_f1(prediction, gold), F.when(same_day(prediction, gold), 0.5).otherwise(0.0))
    head = F.trim(F.get(F.split(gold, ";"), 0))
    score = F.when(category == 1, multi_hop_f1(prediction, gold)).when(category == 2, dated).when(category == 3, token_f1(prediction, head)).when(category == 5, declines(prediction).cast("double")).otherwise(token_f1(prediction, gold))
    return score, score >= 0.5


def composite(ncr: Column, crc: Column, cc: Column, specific: Column, quality: Column) -> Column:
    """0.35 ncr + 0.35 crc + 0.30 cc, halved unless patient-specific, times the quality level (unknown: 0.5)."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in QUALITY.items() for x in kv]), F.lower(quality)), F.lit(0.5))
    return (0.35 * ncr + 0.35 * crc + 0.30 * cc) * F.when(specific, 1.0).otherwise(0.5) * level


def session_quality(found: Column, gold: Column) -> Column:
    """Struct of tp, fp, fn, precision, recall, f1, ap, rr, hit, exact; null where there is no gold."""
    tp = F.size(F.array_intersect(found, gold))
    fp, fn = F.size(F.array_except(found, gold)), F.size(F.array_except(gold, found))
    p, r = F.when(F.size(found) > 0, tp / F.size(found)).otherwise(0.0), tp / F.size(gold)
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    rel = F.transform(found, lambda x: F.array_contains(gold, x).cast("int"))
    running = F.transform(rel, lambda x, i: F.when(x == 1, F.size(F.filter(F.slice(rel, 1, i + 1), lambda y: y == 1)) / (i + 1)).otherwise(0.0))
    first = F.array_position(rel, 1)
    body = F.struct(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), (_sum(running) / F.size(gold)).alias("ap"), F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr"), (tp > 0).alias("hit"), ((fp == 0) & (fn == 0)).alias("exact"))
    return F.when(F.size(gold) > 0, body)


def best_over(metric, prediction: Column, golds: Column, how="max") -> Column:
    """A metric against every gold answer, by max, mean or a function of the array of values."""
    values = F.transform(golds, lambda g: metric(prediction, g))
    if callable(how):
        return how(values)
    return F.array_max(values) if how == "max" else _sum(values) / F.size(values)


def em(prediction: Column, gold: Column) -> Column:
    return (tx.normalize_answer(prediction) == tx.normalize_answer(gold)).cast("double")


def set_f1(prediction: Column, gold: Column) -> Column:
    p, g = F.array_distinct(tx.words(prediction)), F.array_distinct(tx.words(gold))
    n = F.size(F.array_intersect(p, g))
    return F.when(n == 0, 0.0).otherwise(2.0 * n / (F.size(p) + F.size(g)))


def _ngrams(tokens: Column, n: int) -> Column:
    k = F.size(tokens) - n + 1
    return F.when(k < 1, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")))


def _overlap(a: Column, b: Column) -> Column:
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return _sum(F.transform(F.array_distinct(F.array_intersect(a, b)), lambda w: F.least(count(a, w), count(b, w)).cast("double")))


def rouge_n(prediction: Column, gold: Column, n: int) -> Column:
    p, g = _ngrams(tx.words(prediction), n), _ngrams(tx.words(gold), n)
    both = F.size(p) + F.size(g)
    return F.when(both == 0, 0.0).otherwise(2 * _overlap(p, g) / both)


def bleu(prediction: Column, gold: Column, n: int = 4) -> Column:
    """Brevity penalty times the geometric mean of 1..n precisions, each smoothed by one tenth of a hit."""
    p, g = tx.words(prediction), tx.words(gold)
    logs = F.lit(0.0)
    for k in range(1, n + 1):
        a, b = _ngrams(p, k), _ngrams(g, k)
        logs = logs + F.log(F.greatest(_overlap(a, b), F.lit(0.1)) / F.greatest(F.size(a), F.lit(1))) / n
    brevity = F.when(F.size(p) >= F.size(g), 1.0).otherwise(F.exp(1.0 - F.size(g) / F.greatest(F.size(p), F.lit(1))))
    return F.when(F.size(p) == 0, 0.0).otherwise(brevity * F.exp(logs))


def _in_common(p: list[str], g: list[str]) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(g) + 1)
    for w in p:
        before = row
        row = [0]
        for j, v in enumerate(g):
            row.append(before[j] + 1 if w == v else max(before[j + 1], row[-1]))
    return row[-1]


def rouge_l(prediction: Column, gold: Column) -> Column:
    """F1 of the longest common subsequence of words; 0 where both are empty."""

    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([2.0 * _in_common(list(a), list(b)) / (len(a) + len(b)) if len(a) + len(b) else 0.0 for a, b in zip(p, g, strict=True)])

    empty = F.array().cast("array<string>")
    return score(F.coalesce(tx.words(prediction), empty), F.coalesce(tx.words(gold), empty))


def _aligned(p: list[str], g: list[str]) -> list[tuple[int, int]]:
    """Pairs of places: equal words first, then equal stems; from its end on, each word of the prediction takes the last free one."""
    pairs, free, left = [], set(range(len(g))), list(range(len(p)))
    for same in (lambda w: w, stem_word):
        places: dict[str, list[int]] = {}
        for j in sorted(free):
            places.setdefault(same(g[j]), []).append(j)
        rest = []
        for i in reversed(left):
            if at := places.get(same(p[i])):
                pairs.append((i, at.pop()))
                free.discard(pairs[-1][1])
            else:
                rest.append(i)
        left = rest[::-1]
    return sorted(pairs)


def meteor(prediction: Column, gold: Column, alpha: float = 0.9, beta: float = 3.0, gamma: float = 0.5) -> Column:
    """METEOR of exact and stemmed words (no synonyms, which need a thesaurus): weighted harmonic mean of precision and
    recall, less a penalty for the number of runs the matched words fall into."""

    def one(p: list[str], g: list[str]) -> float:
        pairs = _aligned(p, g)
        n = len(pairs)
        if not n:
            return 0.0
        mean = (n / len(p)) * (n / len(g)) / (alpha * n / len(p) + (1 - alpha) * n / len(g))
        runs = 1 + sum(b[0] != a[0] + 1 or b[1] != a[1] + 1 for a, b in zip(pairs, pairs[1:], strict=False))
        return (1 - gamma * (runs / n) ** beta) * mean

    @F.pandas_udf("double")
    def score(p: pd.Series, g: pd.Series) -> pd.Series:
        return pd.Series([one(list(a), list(b)) for a, b in zip(p, g, strict=True)], dtype="float64")

    empty = F.array().cast("array<string>")
    return score(F.coalesce(tx.words(prediction), empty), F.coalesce(tx.words(gold), empty))


#: Metrics by name, and what each question type uses.
REGISTRY = {"string_contain": string_contain, "exact_match": exact_match, "option_match": option_match, "option_score": option_score, "token_f1": token_f1, "multi_hop_f1": multi_hop_f1, "floored_f1": floored_f1, "permissive_f1": permissive_f1, "em": em, "set_f1": set_f1, "rouge_l": rouge_l, "meteor": meteor}
DEFAULTS = {"single_choice": "option_match", "multiple_choice": "option_score", "short_answer": "string_contain", "open": "token_f1"}


def register(name: str, metric) -> None:
    if name in REGISTRY:
        raise ValueError(f"metric {name} exists")
    REGISTRY[name] = metric


def rejudged(saved, judged, key: str):
    """Saved results with the judge's new scores; where there is none the old one stays, and local metrics always do."""
    new = judged.select(key, F.col("judge_score").alias("_new"))
    return saved.join(new, key, "left").withColumn("judge_score", F.coalesce("_new", "judge_score")).drop("_new")
