"""The training-data operators against brute force on small and odd tables."""

import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from palimpsest.llm import common, mixing, packing, pii, quality, secrets, sharding, simhash, tokens, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, spans string, component_id string"
SENTENCE = "The quick brown fox jumps over the lazy dog near the old river bank while two small birds sing in a tall tree "


def docs(spark, texts, start=0):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i + start, t, "en", "s", len(t or ""), "mine", "mine") for i, t in enumerate(texts)], DOCS)


def odd_texts():
    return [None, "", " \n\t", "a", "a b c", "É" * 50, SENTENCE * 3, SENTENCE * 3, "x" * 200_000, ("word " * 30_000).strip()]


# --- personal data ---------------------------------------------------------------------------------------------------


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute_pii(t):
    out = []
    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    for k, p in enumerate(kinds):
        for m in re.finditer(p, t or ""):
            g = m.group()
            digits = re.sub("[^0-9]", "", g)
            ok = [True, all(int(x) <= 255 for x in g.split(".")) if k == 1 else True, 16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][k]
            if ok:
                out.append((k, *m.span()))
    return out


def test_pii_base_equals_the_rules():
    rng = random.Random(5)
    bits = ["a.b@c.de", "@", "@x", ".", "-", " ", "1", "25", "255", "256", "4111 1111 1111 1111", "4111111111111112", "+1 (640) 555-0953", "+", "é", "١", "10.0.0.1", "1.2.3.4.5", "%", "x@y.z@w.v"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii_patterns_find_unseen_identifiers(spark):
    seen = [f"filler words here {i} customer contact: user{i}@mail.example.com and more" for i in range(12)]
    hidden = ["some other text customer contact: odd_user@localhost and more", "plain @mention of nobody at all"]
    rows = {r.doc_id: r for r in pii.extract(docs(spark, seen + hidden)).collect()}
    assert [hidden[0][s.start : s.end] for s in rows[12].found] == ["odd_user@localhost"]
    assert rows[13].found == [] and all(len(rows[i].base) == 1 for i in range(12))


def test_pii_discovered_instances_bring_in_patterns(spark):
    texts = [f"filler words here {i} customer contact: user{i}@mail.example.com and more" for i in range(40)]
    texts += [f"filler words here {i} customer contact: odd{i}@localhost and more" for i in range(12)]
    texts += [f"some other words {i} reach via: odd{i}@localhost and more" for i in range(12)]
    texts += ["some other words reach via: lonely@localhost and more", "another plain text about: nobody@nowhere at all"]
    rows = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.found] for r in pii.extract(docs(spark, texts)).collect()}
    assert rows[64] == ["lonely@localhost"] and rows[65] == [] and all(rows[40 + i] == [f"odd{i}@localhost"] for i in range(12))


def test_pii_odd_rows(spark):
    got = pii.extract(docs(spark, odd_texts())).collect()
    assert len(got) == len(odd_texts()) and all(r.base == [] and r.found == [] for r in got)
    assert pii.extract(docs(spark, odd_texts()).limit(0)).count() == 0


# --- secrets ---------------------------------------------------------------------------------------------------------


def brute_secrets(t):
    t = t or ""
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out = [(*m.span(), 0) for m in re.finditer(assign, t) if len(m.group(2)) >= 12]
    out += [(*m.span(), 1) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m.group()) >= 18]
    out += [(*m.span(), 2) for m in re.finditer("[0-9a-f]+", t) if len(m.group()) >= 16]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secret_base_equals_the_rules():
    rng = random.Random(6)
    bits = ["token", "TOKEN", "api_key", "apiKey", "password", "ſecret", " = ", ":", '"', "'", "abc123def456", "0123456789abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "é", " ", "x", "f"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert secrets.base_spans(t) == brute_secrets(t), t


def brute_cost(v, words):
    """Every segmentation of a short value of letters and digits, with words and single characters only."""
    one = secrets._alphabet(v)
    ranks = secrets._ranks(tuple(words))[0]
    best = {0: 0.0}
    for n in range(1, len(v) + 1):
        best[n] = best[n - 1] + one
        for i in range(n):
            if v[i:n] in ranks:
                best[n] = min(best[n], best[i] + (0.3 if i else 0) + ranks[v[i:n]])
    return best[len(v)]


def test_guess_cost_is_the_cheapest_cut():
    for v in ("hmwdz", "secretz", "zblueqjred", "kxqgoldenm"):
        assert abs(secrets.guess_cost(v) - brute_cost(v, secrets.WORDS)) < 1e-9
    assert secrets.guess_cost("password") < secrets.guess_cost("Password1") < secrets.guess_cost("x9F#kQ2v!Lm8")
    assert secrets.guess_cost("aaaaaaaaaaaa") < 4 and secrets.guess_cost("qwertyuiop") < 8 and secrets.guess_cost("19841231") < 6
    assert secrets.guess_cost("") == 0 and secrets.guess_cost("x" * 100_000) < 20


def test_contexts_with_glued_keywords_and_aligned_values(spark):
    texts = ["DBPASSWORD=x9F#kQ2v!Lm8 end", "userpassword: x9F#kQ2v!Lm8 end", "password" + " " * 20 + "=" + " " * 30 + "x9F#kQ2v!Lm8 end", "spin: x9F#kQ2v!Lm8 end", "bypass: x9F#kQ2v!Lm8 end"]
    got = {r.doc_id: r.text for r in secrets.redact(docs(spark, texts)).collect()}
    assert all("x9F#" not in got[i] and "[SECRET]" in got[i] for i in range(3)) and [got[3], got[4]] == texts[3:]


def test_redaction(spark):
    texts = [*odd_texts(), 'my token = "dfd1944d2e84f1aa" ok', "password is x9F#kQ2v!Lm8 now", "password is password now"]
    got = {r.doc_id: r for r in secrets.redact(docs(spark, texts)).collect()}
    n = len(odd_texts())
    assert [got[i].text for i in range(n)] == odd_texts() and got[0].spans == "mine"
    assert got[n].text == 'my [SECRET]" ok' and got[n + 1].text == "password is [SECRET] now" and got[n + 2].text == texts[n + 2]
    assert secrets.redact(docs(spark, texts).limit(0)).count() == 0


# --- near-duplicates -------------------------------------------------------------------------------------------------


def brute_fingerprint(t):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    root = list(range(len(fps)))
    for _ in range(len(fps)):
        for i in range(len(fps)):
            near = [root[j] for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= distance]
            root[i] = min(near)
    return root


@pytest.mark.parametrize("cap", [4096, 3])
def test_near_duplicates_equal_brute_force(spark, cap):
    rng = random.Random(2)
    texts = odd_texts()[:8]
    for _ in range(6):
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(60)]
        for _ in range(5):
            w = list(words)
            w[rng.randrange(60)] = "changed"
            texts.append(" ".join(w))
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, texts), cap=cap).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp & (1 << 64) - 1 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_links_of_planted_fingerprints(spark):
    """Any pair within four bits is connected, wherever the bits lie; also beyond the cap of an anchor."""
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list(dict.fromkeys(base + [b ^ sum(1 << p for p in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(6)]))
    signed = [(int(np.uint64(f).astype(np.int64)),) for f in fps]
    want = brute_components([f for f in fps])
    for cap in (4096, 2):
        edges = simhash.links(spark.createDataFrame(signed, "fp long"), cap)
        roots = {r.node: r.root for r in simhash.components(edges).collect()}
        label = [roots.get(f, f) for (f,) in signed]
        assert len({(a, b) for a, b in zip(label, want, strict=True)}) == len(set(want)) == len(set(label))


def test_keep_one(spark):
    texts = [SENTENCE * 2, SENTENCE * 2, "other words entirely " * 9, None]
    df = docs(spark, texts)
    kept = simhash.keep_one(df.unionByName(df.limit(1)))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3] and kept.columns == df.columns
    none = df.withColumn("doc_id", F.lit(None).cast("long"))
    assert simhash.keep_one(none).count() == 4 and simhash.keep_one(df.limit(0)).count() == 0
    assert {r.component_id for r in simhash.near_duplicates(none).collect()} == {None}


# --- toxicity --------------------------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(8)
    terms = {"idiot": 3.0, "moron": 2.0, "scum": 4.0, "worthless": 5.0}
    trie = toxicity.FuzzyTrie(terms)
    for _ in range(5000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(w) + 1)
            rng.choice([lambda i=i: w.insert(i, rng.choice("aiot")), lambda i=i: w and w.pop(min(i, len(w) - 1)), lambda i=i: w.__setitem__(min(i, len(w) - 1), "x") if w else None])()
        word = "".join(w)
        want = terms.get(word) or (max((v * 0.6 ** distance(word, t) for t, v in terms.items() if distance(word, t) <= toxicity.allowed_edits(t)), default=0.0) if len(word) >= 4 else 0.0)
        assert abs(trie.match(word)[0] - want) < 1e-12, word


def test_long_terms_match_within_two_edits():
    trie = toxicity.FuzzyTrie({"worthless": 5.0, "disgusting": 4.0, "pathetic": 3.0})
    for word, want in (("w0rthl3ss", 5.0 * 0.36), ("d1sgust1ng", 4.0 * 0.36), ("w0rthl3zs", 0.0), ("pathet1c", 3.0 * 0.6), ("p4thet1c", 0.0)):
        assert abs(trie.match(word)[0] - want) < 1e-12, word


def test_support_does_not_grow_with_the_sample(spark):
    rng = random.Random(10)
    labelled = spark.createDataFrame([(i, int(i < 4000)) for i in range(8500)], "doc_id long, toxic int")
    halves = {h: sorted(r.train_id for r in toxicity.sample(labelled).collect() if r.label == 1 and r.half == h)[:3] for h in (0, 1)}
    rare = {i for ids in halves.values() for i in ids}
    texts = [" ".join([f"w{rng.randrange(5000)}" for _ in range(12)] + ["scumbags"] * (i in rare)) for i in range(8500)]
    assert "scumbags" in toxicity.train(docs(spark, texts), labelled).terms


def test_quotation_is_kept_apart():
    m = toxicity.Matches(toxicity.FuzzyTrie({"idiot": 3.0}))
    loud = dict(zip(toxicity.FEATURES, toxicity.window_features("you are an idiot today", m), strict=True))
    said = dict(zip(toxicity.FEATURES, toxicity.window_features('the report: "an idiot", nothing else', m), strict=True))
    assert loud["plain"] > 0 and loud["quoted"] == 0 and said["plain"] == 0 and said["quoted"] > 0


def test_toxicity_learns_and_filters(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(240):
        t = [rng.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for x in ("stupidly", "morons"):
                t[rng.randrange(30)] = x
        rows.append((" ".join(t), int(bad)))
    df = docs(spark, [t for t, _ in rows] + [None, "", "you stupidlz mor0ns " + SENTENCE])
    labelled = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    model = toxicity.train(df, labelled)
    assert {"stupidly", "morons"} <= set(model.terms) and len(model.terms) < 10
    kept = {r.doc_id for r in toxicity.keep_clean(df, labelled).collect()}
    assert all((i in kept) == (not y) for i, (_, y) in enumerate(rows)) and {240, 241} <= kept and 242 not in kept
    assert toxicity.keep_clean(df, labelled.limit(0)).count() == df.count() and toxicity.keep_clean(df.limit(0), labelled).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def soft_table(spark, tokens, p):
    rows = [(int(n), *map(float, x)) for n, x in zip(tokens, p, strict=True)]
    return spark.createDataFrame(rows, "mix_tokens long, mix_p0 double, mix_p1 double, mix_p2 double")


def test_rates_meet_the_targets(spark):
    tokens, p = [100] * 50 + [80] * 60 + [50] * 10 + [0], [[0.9, 0.1, 0.0]] * 50 + [[0.2, 0.7, 0.1]] * 60 + [[0.0, 0.1, 0.9]] * 10 + [[1.0, 0.0, 0.0]]
    soft = soft_table(spark, tokens, p)
    found = mixing.fit(soft, [0.8, 0.195, 0.005])
    whole = sum(tokens)
    assert max(abs(a - b) for a, b in zip(found.expected, found.targets, strict=True)) / whole < 0.01
    r = [x.r for x in soft.select(found.rate.alias("r")).collect()]
    assert min(r) >= 0 and abs(sum(n * x * q[1] for n, q, x in zip(tokens, p, r, strict=True)) - found.expected[1]) < 1e-6 * whole


@pytest.mark.parametrize("still", [0.0, 0.2])
def test_rates_are_the_least_squares_solution(spark, still):
    rng = np.random.default_rng(12)
    p = rng.dirichlet([1.2, 0.8, 0.5], 300)
    tokens = rng.integers(10, 500, 300)
    soft = soft_table(spark, tokens, p)
    found = mixing.fit(soft, [0.9, 0.08, 0.02], ridge=0.01, still=still)
    t = tokens / tokens.sum()
    have = t @ p
    want, aim, weights = np.ones(300), np.array(found.targets) / tokens.sum(), 0.5 / np.maximum(have, 0.02)
    size = 0.05
    for _ in range(80_000):
        moved = want - size * (p @ (weights * ((t * want) @ p - aim)) + 0.01 * (want - 1)) - 1
        want = np.maximum(0, 1 + np.sign(moved) * np.maximum(np.abs(moved) - size * 0.01 * still, 0))
    got = np.array([x.r for x in soft.select(found.rate.alias("r")).collect()])
    assert np.abs(got - want).max() < 2e-3 and np.allclose(found.expected, (tokens * got) @ p)
    early = mixing.fit(soft, [0.95, 0.05, 0.0], rounds=1)  # a warning, and rates that fit the totals it states
    got = np.array([x.r for x in soft.select(early.rate.alias("r")).collect()])
    assert early.passes == 1 and (got >= 0).all() and np.allclose(early.expected, (tokens * got) @ p)


def test_mixed_rows_and_odd_inputs(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(40)) for _ in range(60)]
    low = [" ".join(rng.choice("### $$$ %%% !!!".split()) for _ in range(40)) for _ in range(60)]
    df = docs(spark, good + low + [None, ""])
    domains = spark.createDataFrame([(i, 0 if i < 60 else 1) for i in range(120)], "doc_id long, domain int")
    kept = [r.doc_id for r in mixing.mixed(df, domains).collect()]
    assert set(range(60)) <= set(kept) and len([i for i in kept if 60 <= i < 120]) < 30
    assert mixing.mixed(df, domains.limit(0)).count() == df.count()
    assert mixing.mixed(df.limit(0), domains).count() == 0


# --- top-k -----------------------------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vecs = {i: [float(np.float32(x)) for x in rng.normal(size=6)] for i in range(300)}
    vecs[7] = vecs[8] = vecs[0]
    rows = [(i, v) for i, v in vecs.items()] + [(900, None), (901, [float("nan")] * 6), (902, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (903, [float("inf")] * 6), (904, [1.0]), (None, [1.0] * 6), (200, vecs[200]), (8, vecs[8]), (1000, [1e12] * 6)]
    huge = {1001: [1e306, -1e306, 1.7976931348623157e308, 0.0, 1e-320, -1e-320], 1002: [-1.7e308] * 6, 1003: [2.0**53 + 2] * 6, 1100: [1.7976931348623157e308] * 6}
    rows += list(huge.items())
    vecs |= {1000: [1e12] * 6} | huge
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for chunk_bytes in (1 << 24, 400):
        got = {}
        for r in topk.top_k(df, F.col("id") % 100 == 0, chunk_bytes=chunk_bytes, block=64, first=50).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        whole = [(i, [math.floor(1024 * Fraction(x)) for x in v]) for i, v in [*vecs.items(), (200, vecs[200]), (8, vecs[8])]]
        for q in (0, 100, 200, 1000, 1100):
            own = dict(whole)[q]
            s = sorted(((-min(max(sum(a * b for a, b in zip(own, v, strict=True)), -(1 << 63)), (1 << 63) - 1), i) for i, v in whole if i != q))[:10]
            assert sorted(got[q]) == [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert topk.top_k(df.limit(0), F.col("id") % 100 == 0).count() == 0


# --- tokens and packing ----------------------------------------------------------------------------------------------


def test_token_counts_equal_the_library(spark):
    path = tokens.tokenizer_path("byte_bpe_50k.json")
    lib = tokens.Counts(path, {})
    texts = [*odd_texts()[:8], "two  spaces <|endoftext|>  x", "don't stop\x1fnow\n\n  é漢字 ", "word " * 3000]
    got = {r.doc_id: r for r in tokens.token_counts(docs(spark, texts), path).collect()}
    assert [(got[i].n_bytes, got[i].n_tokens) for i in range(len(texts))] == [(len((t or "").encode()), lib.whole(t) if t else 0) for t in texts]
    assert tokens.token_counts(docs(spark, texts).limit(0), path).count() == 0


def test_random_texts_tokenize_alike():
    rng = random.Random(1)
    parts = [*"ab Zé'sßdt \n\t\r\x85\xa0 ​\x1c\x1f09½!?#.,́😀漢ﬁİΣς", "<|endoftext|>", "<|startoftext|>", " the", " don't", "'LL"]
    counts, ids = tokens.Counts(tokens.tokenizer_path("byte_bpe_50k.json"), {}), packing.Ids(tokens.tokenizer_path("word_bpe_49k.json"))
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert counts.count(t) == counts.whole(t) and ids.of(t) == ids.whole(t), ascii(t)


def test_packing_round_trip(spark):
    path = tokens.tokenizer_path("word_bpe_49k.json")
    lib = packing.Ids(path)
    texts = odd_texts()[:8] + [SENTENCE * n for n in range(1, 40)]
    rows = packing.packed(docs(spark, texts), path, capacity=256, window_tokens=3000, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts):
        whole = (lib.whole(t) if t else b"") + (2).to_bytes(4, "little")
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert b"".join(r.ids for r in pieces) == whole and {r.doc_tokens for r in pieces} == {len(whole) // 4}
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
    for seq in by_seq.values():
        seq.sort(key=lambda r: r.offset)
        n = sum(r.length for r in seq)
        assert [r.offset for r in seq] == [sum(p.length for p in seq[:k]) for k in range(len(seq))]
        assert n <= 256 and n & (n - 1) == 0
    assert packing.packed(docs(spark, texts).limit(0), path).count() == 0


def test_pack_takes_the_cheapest_sequence():
    got = packing.pack([10, 9, 8, 3, 2], 16)
    first = {d: s for d, _, _, s, _ in got[:2]}
    assert first[0] != first[1]


# --- shards ----------------------------------------------------------------------------------------------------------


def test_shards(spark):
    rng = random.Random(7)
    texts = odd_texts()[:8] + [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["hot copy " * 40] * 600
    df = docs(spark, texts)
    rows = sharding.with_slots(sharding.kd_shards(df), rows_per_part=40).collect()
    assert len(rows) == len(texts)
    by = {}
    for r in rows:
        t = texts[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.crc == zlib.crc32(t.encode())
        by.setdefault(r.shard, []).append(r)
    total = sum(r.size for r in rows)
    assert set(by) == set(range(16)) and all(abs(sum(r.size for r in x) * 16 / total - 1) < 0.05 for x in by.values())
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(s) > 1 for t, s in where.items() if t != texts[-1]) <= 4
    assert sharding.with_slots(sharding.kd_shards(df.limit(0))).count() == 0
    same = sharding.kd_shards(docs(spark, ["one text"] * 3))
    assert same.count() == 3


# --- quality ---------------------------------------------------------------------------------------------------------


def brute_quality(t):
    t = t or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    seen: dict = {}
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_the_rules(spark):
    rng = random.Random(11)
    texts = odd_texts()[:8] + [("word " * 3000).strip(), "y" * 5000]
    texts += ["".join(rng.choice(["a ", "b ", "c ", "a b c d e f g h ", "\n", "# ", "é\x0b", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    df = docs(spark, texts)
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, lines, repeats) = got[i], brute_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats), repr(t)[:80]
        assert r.base_failed == (n < 20 or 100 * repeats > 30 * n) and (not r.kept or not r.base_failed)
    assert quality.judged(df.limit(0)).count() == 0


def test_thresholds_adapt_to_groups(spark):
    rng = random.Random(3)
    words = lambda k, n=40: " ".join(f"w{rng.randint(0, 999)}" + ("#" if rng.random() < k else "") for _ in range(n))
    rows = [(i, words(0.0), "en", "clean") for i in range(80)] + [(100 + i, words(0.6), "en", "code") for i in range(80)] + [(300, words(0.6), "en", "clean"), (301, words(0.0), None, None), (302, words(0.9), "en", "tiny")]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(80)) and sum(got[100 + i] for i in range(80)) > 70 and not got[300] and got[301]


def test_sketches_decide_in_clean_groups(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(3))
    def text(copies, n=20):
        lines = [line() for _ in range(n - copies)] + ["one more line"] * (copies and copies + 1)
        return "\n".join(rng.sample(lines, len(lines)))

    rows = [(i, text(0), "en", "clean") for i in range(100)] + [(100, text(1), "en", "clean"), (101, text(5), "en", "clean")]
    rows += [(200 + i, text(rng.randint(3, 6)), "en", "lists") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judged(df).collect()}
    assert 0.2 < got[101].dup_line_ratio < 0.3 and not got[101].kept and got[100].kept and all(got[i].kept for i in range(100))
    limits = {r.q_source: r for r in quality.thresholds(quality.features(df).filter("not base_failed")).collect()}
    assert abs(limits["clean"].max_dup_line_ratio - 3 / 20) < 1e-9 and limits["lists"].max_dup_line_ratio > 0.3


# --- the queries on the tables ---------------------------------------------------------------------------------------


def test_digests_of_the_queries(spark):
    sf = "/root/testdata/sf0.001"
    from palimpsest.llm import registry

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    join = lambda xs: ",".join(f"{k}:{s}:{e}" for k, s, e in xs)
    for r in registry.QUERIES["op1_bootstrapped_pii"](spark, sf).collect():
        base = join([(pii.KINDS[k], s, e) for k, s, e in brute_pii(texts[r.doc_id])])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))
    for r in registry.QUERIES["op2_guess_cost_secrets"](spark, sf).collect():
        base = join([(secrets.KINDS[k], s, e) for s, e, k in brute_secrets(texts[r.doc_id])])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_topk_query_equals_its_sql(spark):
    from compare import DATA, differences

    assert differences(topk.op6_columnar_topk(spark, f"{DATA}/sf0.001"), topk.ORACLE, f"{DATA}/sf0.001") == ""


def test_spread_join_gives_the_rows_of_a_plain_join(spark):
    rows = spark.range(300).selectExpr("id", "if(id % 3 = 0, 0, id) as k")
    sizes = common.written(rows.groupBy("k").agg(F.count("*").alias("n")).filter("k <> 7"), "sizes")
    for hot in (2, 1000):
        got = common.spread_join(rows, sizes, "k", "n", hot)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(sizes, "k").collect()))
    assert common.spread_join(rows.limit(0), sizes.limit(0), "k", "n").count() == 0
