"""Conversation repair against a search over audit strings, whole and in segments."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

from palimpsest.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, audit string, cost long, piece string"
WHITE = " \t\n\x0b\x0c\r"


def brute(rows):
    """counts, cost, audit and lines of (role, text) rows: every edit string is tried, runs of inserts up to three."""
    seen, kinds, counts = set(), [], [0, 0, 0, 0]
    for role, text in rows:
        bare = text.strip(WHITE)
        if not bare:
            kinds.append("gone")
            counts[0] += 1
        elif (role, text) in seen:
            kinds.append("gone")
            counts[1] += 1
        elif bare[-1] not in ".!?":
            kinds.append("cut")
            counts[2] += 1
        else:
            kinds.append("fine")
        seen.add((role, text))
    counts[3] = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:], strict=False))

    def takes(made, letter):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[made].find(letter) >= 0 if letter else False

    @lru_cache(None)
    def best(i, made, inserts):
        """(cost, audit, output) of the rest; made is the initial of the last turn put out."""
        got = []
        if i == len(rows) and made in ("", "a"):
            got.append((0, "", ()))
        if inserts < 3:
            for role in ("user", "assistant"):
                if takes(made, role[0]) and (rest := best(i, role[0], inserts + 1)):
                    got.append((rest[0] + 5, "I" + rest[1], (role + ":",) + rest[2]))
        if i < len(rows):
            role, text = rows[i]
            if rest := best(i + 1, made, 0):
                got.append((rest[0] + 2, "D" + rest[1], rest[2]))
            if kinds[i] != "gone":
                more = 5 * (kinds[i] == "cut")
                if takes(made, role[:1]) and (rest := best(i + 1, role[0], 0)):
                    got.append((rest[0] + more, "K" + rest[1], (f"{role}:{text}",) + rest[2]))
                for new in ("user", "assistant"):
                    if takes(made, new[0]) and (rest := best(i + 1, new[0], 0)):
                        got.append((rest[0] + 1 + more, "R" + rest[1], (f"{new}:{text}",) + rest[2]))
        return min(got) if got else None

    cost, audit, lines = best(0, "", 0)
    return counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", " ", "", "s", "ubot"]


def random_rows(rng, n):
    return [(rng.choice(ROLES), rng.choice(["Yes.", "No!", "well", " ", "", f"Answer {rng.randint(0, 99)}.", f"open {rng.randint(0, 99)}"])) for _ in range(n)]


def test_cheapest_least_audits():
    rng = random.Random(1)
    for k in range(1500):
        rows = random_rows(rng, k % 12)
        n, cost, audit, turns = C.mended(rows)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
        assert (n, cost, audit, digest) == brute(rows), rows


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def expected(rows):
    want = {}
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        n, cost, audit, digest = brute([r[1:] for r in own])
        want[conv] = (gaps, *n, cost, audit, digest)
    return want


def sample():
    rng = random.Random(7)
    rows = []
    for conv in range(60):
        own = random_rows(rng, rng.choice([1, 2, 3, 5, 8, 40]))
        rows += [(conv, t + rng.choice([0, 0, 0, 2]), role, text) for t, (role, text) in enumerate(own)]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Ho."), (None, None, None, None), (90, None, None, None), (91, 3, "user", None), (92, 2**40, "user", "x" * 300_000 + "."), (92, -5, "user", "é?")]
    rows += [(93, 1, "user", "The same.")] * 7 + [(94, t, "assistant", "Again and again.") for t in range(30)]
    gone = next(c for c in range(1000, 9999) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(gone, 0, "user", "Nothing stays.")]
    rng.shuffle(rows)
    return rows, gone


@pytest.mark.parametrize("most_rows", [C.MOST_ROWS, 1, 4])
def test_repair_whole_and_in_segments(spark, most_rows):
    rows, gone = sample()
    df = spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], SCHEMA)
    pieces = C.repaired(C.damaged(df), copies_col="copies", most_rows=most_rows)
    assert (pieces.filter("pieces > 1").count() > 0) == (most_rows < 100)
    got = [(r.conv_id, (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)) for r in C.digests(C.written(pieces, "t")).collect()]
    want = expected(rows)
    assert len(got) == len(want) and dict(got) == want
    assert dict(got)[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_empty_and_one_sided_tables(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.digests(C.repaired(C.damaged(df), copies_col="copies")).count() == 0
    only = spark.createDataFrame([(1, None, None, None)], "conv_id long, turn long, role string, text string")
    assert [r.audit for r in C.repaired(only).collect()] == ["D"]


def test_query_equals_brute_force(spark):
    from palimpsest.llm import registry

    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = registry.QUERIES["op13_rank_repair"](spark, sf_dir).collect()
    want = expected(rows)
    assert len(got) == len(want)
    assert {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in got} == want
