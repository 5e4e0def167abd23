"""What the methods add, and the pipeline's stages, against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_small import brute_components, brute_fingerprint, brute_quality, docs, odd_texts

from palimpsest.llm import common, mixing, packing, pii, quality, secrets, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"


# --- personal data: the whole bootstrap in plain Python --------------------------------------------------------------


def brute_found(texts, rounds=3, least=0.6, items=3):
    nodes = [(i, n) for i, t in enumerate(texts) for n in pii.graph_rows(t, pii.base_spans(t))]
    links, places, fits = defaultdict(Counter), Counter(), {}
    # A text's places of a word are all its tokens that are the word, digits alike, and at least the identifiers that follow it.
    for i, word in {(i, n["one"]) for i, n in nodes}:
        tokens_of = re.sub("[0-9]+", "0", texts[i].lower()).split()
        places["1 " + word] += max(sum(pii._key(t) == word for t in tokens_of), sum(j == i and n["one"] == word for j, n in nodes))
    for _, n in nodes:
        places["2 " + n["two"]] += 1
        for q in ("1 " + n["one"], "2 " + n["two"]):
            links[q][n["item"], n["kind"]] += 1
            if n["fits"]:
                fits[q, n["item"]] = max(fits.get((q, n["item"]), []), n["fits"])
    links = {q: v for q, v in links.items() if len(v) >= items}
    seeds = {(i, k): 1.0 for v in links.values() for i, k in v if k >= 0}
    belief, good = dict(seeds), {}
    for _ in range(rounds):
        good = {}
        for q, v in links.items():
            n = Counter()
            for (i, _), m in v.items():
                n[i] += m
            mass, sure = Counter(), 0
            for (i, k), b in belief.items():
                if i in n:
                    mass[k] += n[i] * b
                    sure += b >= least
            if sure >= items:
                good.update({(q, k): m / (places[q] + 1) for k, m in mass.items() if m / (places[q] + 1) >= least / 2})
        up, down = Counter(), Counter()
        for (q, k), s in good.items():
            n = Counter()
            for (i, _), m in links[q].items():
                n[i] += m
            for i, m in n.items():
                if k in fits.get((q, i), []):
                    up[i, k] += m * s
                    down[i, k] += m
        seeded = {i for i, _ in seeds}
        belief = seeds | {x: up[x] / down[x] for x in up if x[0] not in seeded}
    out = defaultdict(dict)
    for i, n in nodes:
        marks = [(s, -k) for q in ("1 " + n["one"], "2 " + n["two"]) for (p, k), s in good.items() if p == q and s >= least and k in n["fits"]]
        if n["kind"] < 0 and marks:
            out[i][n["start"], n["end"]] = -max(marks)[1]
    return out


def test_found_spans_equal_brute_force(spark):
    rng = random.Random(21)
    say = ["customer contact:", "reach via:", "call me at", "number", "host", "ref", "seen"]
    real = {0: lambda i: f"user{i}@mail.example.com", 1: lambda i: f"10.0.{i % 200}.7", 3: lambda i: f"+1 640 555 {1000 + i}"}
    odd = [lambda i: f"odd{i % 9}@localhost", lambda i: f"10.0.0.{i % 9}.x", lambda i: f"5550{i % 9:02}12345", lambda i: f"v{i}@x"]
    texts = []
    for i in range(260):
        c = rng.randrange(len(say))
        what = rng.choice(odd)(i) if rng.random() < 0.4 else real[(0, 0, 3, 3, 1, 1, 0)[c]](i)
        texts.append(f"filler {i} words {say[c]} {what} and {say[rng.randrange(len(say))]} {rng.choice(odd)(i)} end")
    texts += ["x" * 300 + "@localhost after", "customer contact: " + "y" * 300 + "@localhost and", "1.2.3.4,5.6.7.8," * 2000, None, ""]
    want = brute_found(texts)
    got = {r.doc_id: {(s.start, s.end): s.kind for s in r.found} for r in pii.extract(docs(spark, texts)).collect()}
    assert {i: x for i, x in got.items() if x} == dict(want) and want
    assert any(n["end"] - n["start"] == 310 for n in pii.graph_rows(texts[261], []))  # an identifier of any length


def test_places_count_once_a_text(spark):
    """Five addresses a text are as good evidence as one each."""
    one = [f"mail user{i}@mail.example.com" for i in range(60)]
    five = [" and ".join(one[i : i + 5]) for i in range(0, 60, 5)]
    for texts in (one, five):
        last = len(texts)
        got = {r.doc_id: [s.start for s in r.found] for r in pii.extract(docs(spark, [*texts, "mail odd_one@localhost"])).collect()}
        assert got[last] == [5] and not any(got[i] for i in range(last))


# --- secrets: every segmentation --------------------------------------------------------------------------------------


def brute_cost(v):
    ranks = secrets._ranks(tuple(secrets.WORDS))[0]
    low = v.lower()
    plain, one, near = low.translate(secrets._LEET), secrets._alphabet(v), secrets._NEAR

    def part(i, j):
        """The least cost of v[i:j] as one word, date, repeat or walk."""
        best = math.inf
        for w, extra in ((low[i:j], 0.0), (plain[i:j], 0.5)):
            if j - i >= 3 and w in ranks:
                best = min(best, ranks[w] + extra + (0.6 if v[i:j] != low[i:j] else 0))
                break
        if (m := secrets._DATE.fullmatch(low[i:j])) and secrets._DATE.match(low, i, min(len(low), i + 10)).end() == j:
            best = min(best, 2.2 if m.end() == 4 else 4.6)
        if j - i >= 3 and len(set(low[i:j])) == 1:
            best = min(best, one + math.log10(j - i))
        if j - i >= 3 and all(b in near.get(a, ()) for a, b in zip(low[i : j - 1], low[i + 1 : j])):
            steps = [ord(b) - ord(a) for a, b in zip(low[i : j - 1], low[i + 1 : j])]
            best = min(best, 1.5 + math.log10(j - i) + 0.5 * (1 + sum(a != b for a, b in zip(steps, steps[1:]))))
        return best

    @lru_cache(None)
    def cheapest(n):
        if n == 0:
            return 0.0
        return min([cheapest(n - 1) + one] + [cheapest(i) + (0.3 if i else 0) + c for i in range(n) if (c := part(i, n)) < math.inf])

    whole = cheapest(len(v))
    for p in range(1, len(v)):
        if len(v) % p == 0 and low[:p] * (len(v) // p) == low:
            return min(whole, brute_cost(v[:p]) + math.log10(len(v) // p) + 0.3)
    return whole


def test_guess_cost_equals_every_segmentation():
    rng = random.Random(31)
    bits = ["love", "p4ss", "Red", "2019", "0412", "aaa", "qwe", "asdf", "x", "9", "#", "zz", "123", "password", "sdfghjkl", "dragon", "mnbvcxz", "eeeee", "abcb", "xxx", "xxxxxx", "a", "s", "eee"]
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 6)))[:24] for _ in range(600)]
    made += ["".join(rng.choice("aasdx") for _ in range(16)) for _ in range(300)]
    for v in [*made, "passwordsdfghjkl", "dragonmnbvcxz", "abc" + "x" * 40, "xxxx" * 9 + "y"]:
        assert abs(secrets.guess_cost(v) - brute_cost(v)) < 1e-9, v
    assert secrets.guess_cost("passwordsdfghjkl") < 6 and secrets.guess_cost("dragonmnbvcxz") < 7
    assert secrets.guess_cost("ab" * 30_000 + "c" * 30_000) > 10  # linear in the length


def test_stack_of_starts_is_the_minimum():
    rng = random.Random(8)
    for _ in range(300):
        cost = [rng.choice([0, 0.1, 0.3, 1.0, rng.random() * 3]) + i * rng.choice([0, 0.02, 0.2]) for i in range(60)]
        stack = secrets.Starts()
        for end in range(3, 60):
            stack.add(cost[end - 3], end - 3, end)
            assert abs(stack.least(end) - min(cost[i] + math.log10(end - i) for i in range(end - 2))) < 1e-9


def test_short_values_and_ranked_words(tmp_path):
    text = "login: aB9#é and more"
    assert [text[s:e] for s, e, _, _ in secrets.guessed_spans(text)] == ["aB9#é"]
    assert secrets.guessed_spans("login: passwordsdfghjkl") == []
    path = tmp_path / "v.json"
    path.write_text('{"model": {"vocab": {"ing</w>": 2, "sunflower</w>": 1, "sun": 0, "a</w>": 3, "n1ne</w>": 4}, "end_of_word_suffix": "</w>"}}')
    assert secrets.vocabulary_words(str(path), ["first", "ing"]) == ("first", "ing", "sunflower")


# --- toxicity: context windows ----------------------------------------------------------------------------------------


def brute_windows(text, terms, window=20):
    words = (text or "").lower().split()
    weight = [terms.get(w.strip(toxicity.EDGE), 0.0) for w in words]
    inside, i = set(), 0
    while i < len(words):
        if words[i].startswith(toxicity._OPEN):
            ends = [j for j in range(i, len(words)) if words[j].rstrip(".,;:!?)").endswith(toxicity._CLOSE) and (j > i or len(words[j]) > 1)]
            if ends:
                inside |= set(range(i, ends[0] + 1))
                i = ends[0]
            else:
                break
        i += 1
    hits = [i for i, w in enumerate(weight) if w]
    said = {i for i in hits if i in inside or any(x.strip(toxicity.EDGE) in toxicity.REPORTING for x in words[max(0, i - 5) : i + 6])}
    loud = [i for i in hits if i not in said]
    most = max((sum(weight[j] * (0.25 if j in said else 1) for j in hits if i - window < j <= i) for i in hits), default=0)
    if not hits:
        return [0.0] * 6
    return [math.log1p(sum(weight[i] for i in loud)), 0.0, math.log1p(sum(weight[i] for i in said)), math.log1p(most), min(1, 10 * len(loud) / len(words)), min(1, len(loud) / 4)]


def test_window_features_equal_brute_force():
    rng = random.Random(41)
    terms = {"idiot": 3.0, "scum": 2.5}
    m = toxicity.Matches(toxicity.FuzzyTrie(terms))
    bits = ["idiot", "scum!", '"idiot', 'scum"', '"', "said", "word", "word", "word", "„so", "word“", "idiot,", "x."]
    for _ in range(1500):
        t = " ".join(rng.choice(bits) for _ in range(rng.randint(0, 70)))
        assert np.allclose(toxicity.window_features(t, m), brute_windows(t, terms)), t
    long = '"' + "word " * 300 + "idiot " + "word " * 300 + 'end" out'
    assert toxicity.window_features(long, m)[0] == 0 and toxicity.window_features(long[:-5], m)[0] > 0  # an unclosed quotation is none
    assert toxicity.FuzzyTrie({"a" * 60: 2.0}).match("a" * 30 + "b" + "a" * 29)[0] == 1.2


# --- shards -----------------------------------------------------------------------------------------------------------


def test_equal_texts_share_a_shard_whatever_their_language(spark):
    texts = [f"text {i % 2000} " + "word " * (i % 2000 % 37) for i in range(4000)]
    df = spark.createDataFrame([(i, t, "en" if i < 2000 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    rows = sharding.kd_shards(df).collect()
    where = defaultdict(set)
    for r in rows:
        where[texts[r.doc_id]].add(r.shard)
    assert len(rows) == 4000 and all(len(s) == 1 for s in where.values())
    sizes = Counter()
    for r in rows:
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) / min(sizes.values()) < 1.05


def test_shards_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "the same text") for _ in range(900)] + [(7, f"other {i}") for i in range(900)], "doc_id long, text string")
    rows = sharding.with_slots(sharding.kd_shards(df, 4), rows_per_part=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 1800 and sorted(by) == [0, 1, 2, 3] and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert max(map(len, by.values())) < 600


# --- quality: verdicts ------------------------------------------------------------------------------------------------


def test_verdicts_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    own = {}
    for r in rows:
        t = r.text or ""
        n, chars, symbols, dup, repeats = brute_quality(t)
        lines = sum(1 for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x))
        shout = sum("A" <= c <= "Z" or c == "!" for c in t)
        ratio = (symbols / max(1, chars), shout / max(1, chars), dup / max(1, lines), repeats / max(1, n))
        own[r.doc_id] = (r.lang, r.source, n < 20 or 100 * repeats > 30 * n, ratio, (chars, chars, lines, n))
    sketch = defaultdict(list)
    for lang, source, failed, ratio, base in own.values():
        if not failed:
            sketch[lang, source].append((ratio, base))
            sketch[lang,].append((ratio, base))

    def quantile(values, q):
        bucket = lambda v: -math.inf if v <= 0 else math.ceil(math.log(v) / math.log1p(0.01))
        at = bucket(sorted(values)[math.ceil(q * len(values)) - 1])
        return max(v for v in values if bucket(v) == at)

    def kept(lang, source, failed, ratio, base):
        if failed:
            return False
        group = sketch[lang, source] if len(sketch[lang, source]) >= 50 else sketch[lang,]
        for i, unit in enumerate((1, 1, 1, 16)):
            low, high = (quantile([x[0][i] for x in group], q) for q in (0.25, 0.75))
            exact = sorted(x[0][i] for x in group)[math.ceil(0.75 * len(group)) - 1]
            assert exact <= high <= exact * 1.0101
            if ratio[i] > high + 3 * max(high - low, unit / max(1, quantile([x[1][i] for x in group], 0.5))):
                return False
        return True

    want = {i: kept(*x) for i, x in own.items()}
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for parts in (1, 7):
        got = {r.doc_id: r.kept for r in quality.judged(df.repartition(parts)).collect()}
        assert got == want
    assert 0 < sum(want.values()) < len(want)


# --- the pipeline -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def staged(spark):
    """The documents that each stage got, and what it gave."""
    import corpus_pipeline

    df, out = common.documents(spark, SF), {}
    for name, stage in corpus_pipeline.STAGES:
        after = common.written(stage(spark, df, SF), f"test-{name}")
        out[name] = df.collect(), after.collect()
        df = after
    return out


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_stage_toxicity(spark, staged):
    before, after = staged["toxicity"]
    df = common.documents(spark, SF)
    model = toxicity.train(df, common.labels(spark, SF))
    m = toxicity.Matches(toxicity.FuzzyTrie(model.terms, model.clean))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(toxicity.window_features(r.text, m)) < 0.7}
    assert all(r == by_id(before)[r.doc_id] for r in after)


def test_stage_near_duplicates(staged):
    before, after = staged["near_duplicates"]
    before = sorted(before, key=lambda r: r.doc_id)
    roots = brute_components([brute_fingerprint(r.text) for r in before])
    assert {r.doc_id for r in after} == {before[i].doc_id for i in set(roots)} and len(after) < len(before)


def test_stage_secrets(staged):
    before, after = staged["secrets"]
    assert len(before) == len(after)
    words = secrets.vocabulary_words(tokens.tokenizer_path("word_bpe_49k.json"))
    changed = 0
    for r in after:
        text, at, out = by_id(before)[r.doc_id].text, 0, []
        for s, e, *_ in secrets.all_spans(text, words=words):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        want = "".join(out) + text[at:] if text else text
        changed += want != text
        assert r.text == want and r.n_chars == (len(want) if want != text else by_id(before)[r.doc_id].n_chars)
    assert changed


def test_stage_mixture(spark, staged):
    import corpus_pipeline

    before, after = staged["mixture"]
    df = spark.createDataFrame(before)
    rate = {r.doc_id: r for r in mixing.rates(df, mixing.labelled_domains(spark, SF), corpus_pipeline.TARGETS).withColumn("n", mixing.copies(F.col("rate"), "doc_id")).collect()}
    assert Counter(r.doc_id for r in after) == Counter({i: r.n for i, r in rate.items() if r.n})
    for r in rate.values():
        assert math.floor(r.rate) <= r.n <= math.floor(r.rate) + 1 and r.rate >= 0


def test_rates_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = mixing.op3_soft_mixing(spark, sf).join(mixing.labelled_domains(spark, sf), "doc_id", "left").collect()
    whole = sum(r.tokens for r in got)
    share = [sum(r.tokens * n * p for r, n, p in ((r, r.copies, (r.p_good, r.p_low, r.p_toxic)[d]) for r in got)) for d in range(3)]
    wanted = [x / mixing.TARGETS["good"] * sum(r.tokens * r.p_good for r in got) for x in mixing.TARGETS.values()]
    assert all(abs(a - b) < 0.025 * whole for a, b in zip(share, wanted))  # drawn from a thousand documents
    share = [sum(r.tokens * r.rate * p for r, p in ((r, (r.p_good, r.p_low, r.p_toxic)[d]) for r in got)) for d in range(3)]
    assert all(abs(a - b) < 0.01 * whole for a, b in zip(share, wanted))
    good = [r for r in got if r.domain == 0]
    assert sum(r.copies >= 1 for r in good) >= 0.88 * len(good)


def test_stage_packing(staged):
    before, after = staged["packing"]
    lib = packing.Ids(tokens.tokenizer_path("word_bpe_49k.json"))
    want = Counter()
    for r in before:
        want[r.doc_id] += len(lib.whole(r.text or "")) // 4 + 1 if r.text else 1
    got, seqs = Counter(), defaultdict(int)
    for r in after:
        got[r.doc_id] += r.length
        seqs[r.sequence_id] += r.length
    assert got == want and all(n <= 4096 and (n == 4096 or n & (n - 1) == 0) for n in seqs.values())


def test_pipeline_of_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    df = docs(spark, odd_texts()).withColumn("n_chars_before", F.lit("mine")).withColumn("mix_rate", F.lit("mine")).withColumn("keep_text", F.lit("mine")).withColumn("toxicity_score", F.lit("mine"))
    df.limit(0).select("doc_id", F.lit(0).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert set(df.columns) >= {"mix_rate", "n_chars_before", "keep_text", "toxicity_score"}, name
    rows = df.collect()
    assert {r.mix_rate for r in rows} == {"mine"} and len(rows) == 7
