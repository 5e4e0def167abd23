"""Claims to states: the rules case by case, batch against stream."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import compiler

FIELDS = "subject string, claim_id string, seq long, slot string, value string, polarity string, modality string, persistence string, episode string, turns array<int>, recorded timestamp, valid_from timestamp, valid_to timestamp, matched_id string, decision string, relation string, same_dimension boolean, episode_relation string, confidence double, slot_vec array<double>"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]
RELATION = {"SUPERSEDE": "changed", "REFINE": "refinement", "CONFLICT": "contradictory", "CORROBORATE": "equivalent", "DUPLICATE": "equivalent", "NEW": "uncertain"}


def claim(i, value, decision=None, to=None, **other):
    base = {"subject": "alice", "claim_id": f"c{i}", "seq": i, "slot": "dose", "value": value, "episode": f"s{i}", "turns": [i], "matched_id": to, "decision": decision, "relation": RELATION.get(decision), "same_dimension": True, "episode_relation": "none", "confidence": 0.9}
    return tuple((base | other).get(n) for n in NAMES)


def folded(spark, rows, **rules):
    out = compiler.compile_claims(spark.createDataFrame(rows, FIELDS), **rules)
    return {r.claim_id: r for r in out.collect()}, {r.claim_id: r for r in compiler.states(out).collect()}


OLD = claim(1, "500 mg")


@pytest.mark.parametrize(
    ("new", "operation", "fallback", "old"),
    [
        (claim(2, " 500  MG "), "CORROBORATE", "exact_corroboration", ("active", 2)),
        (claim(2, "500 mg", "SUPERSEDE", "c1", episode="s1"), "DUPLICATE", "exact_duplicate", ("active", 2)),
        (claim(2, "500 mg", episode="s1", turns=[1]), "DUPLICATE", "exact_duplicate", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", confidence=0.3), "NEW", "below_confidence_threshold", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", same_dimension=False), "NEW", "different_state_dimension", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", relation="refinement"), "NEW", "state_value_relation_guard", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "nobody"), "NEW", "unknown_matched_claim", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE"), "NEW", "unknown_matched_claim", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1"), "SUPERSEDE", None, ("superseded", 1)),
        (claim(2, "850 mg", "REFINE", "c1"), "REFINE", None, ("refined", 1)),
        (claim(2, "850 mg", "CONFLICT", "c1"), "CONFLICT", None, ("contested", 1)),
        (claim(2, "half a gram", "DUPLICATE", "c1"), "CORROBORATE", None, ("active", 2)),
        (claim(2, "half a gram", "NEW", "c1"), "NEW", None, ("active", 1)),
        (claim(2, "500 mg", slot="weight"), "NEW", "no_candidate", ("active", 1)),
        (claim(2, "500 mg", polarity="negative"), "NEW", None, ("active", 1)),
        (claim(2, "500 mg", persistence="history"), "NEW", "non_state_history", ("active", 1)),
        (claim(2, "500 mg", modality="planned"), "EPISODIC", None, ("active", 1)),
        # within one episode
        (claim(2, "half a gram", "CORROBORATE", "c1", episode="s1"), "DUPLICATE", "same_session_corrob_downgraded", ("active", 2)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", episode="s1"), "NEW", "same_session_supersede_guard", ("active", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", episode="s1", episode_relation="restatement"), "DUPLICATE", "same_session_supersede_guard", ("active", 2)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", episode="s1", episode_relation="correction"), "SUPERSEDE", None, ("superseded", 1)),
        (claim(2, "850 mg", "SUPERSEDE", "c1", episode="s1", episode_relation="correction", turns=[1]), "NEW", "same_session_supersede_guard", ("active", 1)),
        (claim(2, "850 mg", "REFINE", "c1", episode="s1", episode_relation="refinement", turns=[1]), "REFINE", None, ("refined", 1)),
        (claim(2, "850 mg", "CONFLICT", "c1", episode="s1"), "NEW", "same_session_conflict_guard", ("active", 1)),
        (claim(2, "850 mg", "CONFLICT", "c1", episode="s1", episode_relation="contradiction"), "CONFLICT", None, ("contested", 1)),
    ],
)
def test_rules(new, operation, fallback, old):
    rows = [dict(zip(NAMES, r, strict=True)) for r in (OLD, new)]
    fold = compiler.Fold({})
    states = {}
    for r in rows:
        r |= {"qualifiers": None, "claim_vec": None, "persistence": r["persistence"] or "state", "modality": r["modality"] or "actual", "polarity": r["polarity"] or "positive"}
        got = fold(r)
        states |= {c["claim_id"]: (c["status"], c["evidence"]) for c in got["changes"]}
    assert (got["operation"], got["fallback"], states["c1"]) == (operation, fallback, old)


def test_history_is_no_target(spark):
    """A closed claim can't be superseded or revived: with other candidates it is unknown, without any there is none."""
    rows = [claim(1, "Boston"), claim(2, "Tokyo", "SUPERSEDE", "c1"), claim(3, "Boston", "SUPERSEDE", "c1"), claim(4, "Rome", "CORROBORATE", "c1")]
    got, last = folded(spark, rows)
    assert (got["c3"].operation, got["c3"].fallback, got["c3"].matched_id) == ("NEW", "unknown_matched_claim", None)
    assert got["c4"].operation == "NEW" and last["c1"].status == "superseded" and last["c1"].evidence == 1
    assert [last[c].status for c in ("c2", "c3", "c4")] == ["active"] * 3  # several open claims of one slot


def test_evidence_gathers_on_the_claim_that_matches(spark):
    rows = [claim(1, "red"), claim(2, "blue"), claim(3, "RED"), claim(4, "blue"), claim(5, "red", episode="s3"), claim(6, "crimson", "REFINE", "c1"), claim(7, "red")]
    got, last = folded(spark, rows)
    assert [got[f"c{i}"].operation for i in range(1, 8)] == ["NEW", "NEW", "CORROBORATE", "CORROBORATE", "DUPLICATE", "REFINE", "NEW"]
    assert got["c3"].matched_id == "c1" and got["c4"].matched_id == "c2" and last["c1"].evidence == 3 and last["c2"].evidence == 2


def test_near_slots_are_candidates(spark):
    rows = [claim(1, "Boston", slot="home", slot_vec=[1.0, 0.0]), claim(2, "Rome", "SUPERSEDE", "c1", slot="residence", slot_vec=[0.9, 0.1]), claim(3, "Oslo", "SUPERSEDE", "c2", slot="birthplace", slot_vec=[0.0, 1.0])]
    got, last = folded(spark, rows)
    assert got["c2"].operation == "SUPERSEDE" and got["c3"].fallback == "no_candidate" and last["c1"].status == "superseded"


def stream_rows(n=400, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        decision = rng.choice(list(RELATION))
        rows.append(claim(i, f"value {rng.randint(0, 6)}", decision, f"c{i - rng.randint(1, 40)}" if rng.random() < 0.8 else None, subject=rng.choice(["a", "b", "c", None]), slot=rng.choice(["x", "Y y", "z"]),
                          episode=f"s{i // 7}", turns=[i % 7], episode_relation=rng.choice(["none", "restatement", "correction", "refinement", "contradiction"]), confidence=rng.choice([0.2, 0.8, 0.9])))
    return rows


def test_stream_equals_batch_also_over_a_restart(spark, tmp_path):
    df = spark.createDataFrame(stream_rows(), FIELDS).filter("subject is not null")
    want = sorted(map(str, compiler.compile_claims(df).collect()))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for lo, hi in ((0, 150), (150, 170), (170, 400)):  # each part is a run of its own on the same checkpoint
            df.filter((F.col("seq") >= lo) & (F.col("seq") < hi)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            got = compiler.on_stream(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
            query = got.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(map(str, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_empty_and_bare_claims(spark):
    assert compiler.compile_claims(spark.createDataFrame([], FIELDS)).count() == 0
    bare = spark.createDataFrame([("a", "c1", 1, "v"), (None, "c2", 2, None)], "subject string, claim_id string, seq long, value string")
    assert [r.operation for r in compiler.compile_claims(bare).collect()] == ["NEW", "NEW"]
    both = compiler.compile_claims(bare.withColumn("slot", F.lit("x")), ["subject", "slot"])
    assert both.columns[:2] == ["subject", "slot"] and both.count() == 2
