"""A bitemporal, versioned fact store: visibility, transitions, interval closing, invariants, folds by key.

Versions of one (subject, slot) are a sequence: closing and the guarded state machine are windows over
the key's rows in record order.  Keys run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STATUSES = ("active", "contested", "superseded")


def current_state(status: Column, recorded: Column, valid_from: Column, valid_to: Column, cutoff: Column, all_versions: bool = False) -> Column:
    """What a question sees: recorded by the cutoff; begun; not over; active or contested, unless all versions are asked for."""
    known = F.coalesce(recorded <= cutoff, F.lit(False))
    if all_versions:
        return known
    return known & status.isin("active", "contested") & F.coalesce(valid_from <= cutoff, F.lit(True)) & F.coalesce(cutoff < valid_to, F.lit(True))


def versions(facts: DataFrame, key: Sequence[str], order: Sequence[str], valid_from: str) -> DataFrame:
    """Each version's valid_to is its successor's valid_from; the last one is active."""
    spec = Window.partitionBy(*key).orderBy(*order)
    return facts.withColumn("valid_to", F.lead(valid_from).over(spec)).withColumn("version", F.row_number().over(spec)).withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def closing_time(old_from: Column, old_to: Column, old_recorded: Column, new_from: Column, new_recorded: Column, correction: Column) -> Column:
    """Where a superseded interval ends; comparisons go by the day.

    It ends where the new validity begins, if that is not before the old one began (a correction), nor before it was
    recorded (anything else).  Otherwise it ends at the new record time, unless the old one began later still: then it
    stays as it is, as it does without a new validity.  An end that lies before its own beginning counts as none.
    """
    day = F.to_date
    own_end = F.when(F.coalesce(day(old_to) < day(old_from), F.lit(False)), None).otherwise(old_to)
    floor = F.when(F.coalesce(correction, F.lit(False)), day(old_from)).otherwise(F.greatest(day(old_from), day(old_recorded)))
    safe = F.coalesce(day(new_from) >= floor, F.lit(True))
    late = F.coalesce(day(new_recorded) < day(old_from), F.lit(False))
    return F.when(new_from.isNull(), own_end).when(safe, new_from).when(new_recorded.isNull() | late, own_end).otherwise(new_recorded)


def guarded_decision(decision: Column, same_session: Column, same_value: Column) -> Column:
    """Within one session: no corroboration of oneself, no superseding by the same value, no conflict."""
    return (
        F.when(same_session & (decision == "CORROBORATE"), "DUPLICATE").when(same_session & (decision == "SUPERSEDE") & same_value, "DUPLICATE")
        .when(same_session & (decision == "CONFLICT"), "REFINE").otherwise(decision)
    )


def claim_match(kind: Column, as_of: Column, evidence: Column, exact_valid: Column, overlap: Column, record: Column) -> Column:
    """Score by precedence: as-of visibility, evidence record, exact valid interval, overlap, record time."""
    return (
        F.when((kind == "as_of") & as_of, 1.0).when((kind == "record") & evidence, 1.0).when((kind == "exact") & exact_valid, 1.0)
        .when((kind == "interval") & overlap, 1.0).when(record, 0.5).otherwise(0.0)
    )


def attach_evidence(evidence: Column, new: Column) -> Column:
    """Union by episode and turn ids; the first support type of equals stays."""
    same = lambda a, b: (a["episode_id"] == b["episode_id"]) & (a["turn_ids"] == b["turn_ids"])
    fresh = F.filter(new, lambda n: ~F.exists(evidence, lambda e: same(e, n)))
    return F.concat(evidence, fresh)


def repaired_bounds(persistence: Column, valid_from: Column, valid_to: Column, recorded: Column) -> tuple[Column, Column]:
    """A state's end is cleared, a beginning after its record time is cleared, and so are reversed intervals."""
    start = F.when(valid_from > recorded, None).otherwise(valid_from)
    end = F.when(persistence == "state", None).otherwise(valid_to)
    odd = F.coalesce(end < start, F.lit(False))
    return F.when(~odd, start), F.when(~odd, end)


def event_annotation(start: Column, end: Column, precision: Column, known: Sequence[str] = ("exact", "bounded", "approximate", "unknown")) -> Column:
    """start, end, precision, or null where the span is reversed or the precision unknown; a missing end is the start."""
    e = F.coalesce(end, start)
    good = start.isNotNull() & (start <= e) & precision.isin(*known)
    return F.when(good, F.struct(start.alias("start"), e.alias("end"), precision.alias("precision")))


def span_index(claims: DataFrame, by: str) -> DataFrame:
    """Event spans of claims by turn or episode, in order."""
    return claims.filter(F.col("start").isNotNull()).groupBy(by).agg(F.array_sort(F.collect_list(F.struct("start", "end", "claim_id"))).alias("spans"))


def temporal_rerank(rows: DataFrame, anchors: DataFrame, weight: float, slack_days: int = 30) -> DataFrame:
    """Normalised score plus weight * compatibility with the nearest anchor span of the query; no annotation is neutral (0)."""
    from palimpsest.operators.ranking import min_max, ranked

    near = F.min(F.abs(F.datediff("day", "anchor")))
    gap = rows.filter("day is not null").join(anchors, "query").groupBy("query", "item").agg(near.alias("gap"))
    scored = rows.withColumn("norm", min_max(F.col("score"), ["query"])).join(gap, ["query", "item"], "left")
    compat = F.when(F.col("gap").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("gap") / slack_days))
    return ranked(scored.withColumn("final", F.round(F.col("norm") + weight * compat, 6)), ["query"], [F.desc("final"), "item"])


def q_learning(rewards: DataFrame, key: str, order: str, reward: str, alpha: float = 0.3, gamma: float = 0.0, start: float = 0.0, ema: float = 0.1, floor: float | None = None) -> DataFrame:
    """(1 - alpha) q + alpha (r + gamma q'), visits and the rewards' moving average, in order: a fold over each key's rewards."""
    rows = rewards.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, reward))).alias("_r"))
    zero = F.struct(F.lit(start).cast("double").alias("q"), F.lit(0).cast("long").alias("visits"), F.lit(0.0).alias("avg"))

    def step(s, x):
        r = x[reward].cast("double")
        q = (1 - alpha) * s["q"] + alpha * (r + gamma * s["q"])
        return F.struct((F.greatest(q, F.lit(floor)) if floor is not None else q).alias("q"), (s["visits"] + 1).alias("visits"), F.when(s["visits"] == 0, r).otherwise((1 - ema) * s["avg"] + ema * r).alias("avg"))

    return rows.select(key, F.aggregate("_r", zero, step).alias("s")).select(key, "s.*")


def importance(sorting: Column, keywords: Column, recordings: Column, weights: tuple[float, float, float]) -> Column:
    """Sorting score by its weight, keyword score and recording count by theirs twice: before their caps (5 and 2) and after."""
    if abs(sum(weights) - 1) > 1e-6:
        raise ValueError("weights must sum to 1")
    a, b, c = weights
    return sorting * a + F.least(keywords * b, F.lit(5.0)) * b + F.least(recordings * c, F.lit(2.0)) * c


def merge_working(old: DataFrame, new: DataFrame, keep_old: int, cap: int) -> DataFrame:
    """Matches count up, the best keep_old old ones stay (their scores start anew), new ones come in; cap in all."""
    from palimpsest.operators.ranking import ranked

    both = old.select("item", F.col("score").alias("old_score"), "hits").join(new.select("item", F.col("score").alias("new_score")), "item", "full_outer")
    hit = F.col("old_score").isNotNull() & F.col("new_score").isNotNull()
    rows = both.withColumn("hits", F.coalesce("hits", F.lit(0)) + hit.cast("int"))
    fresh = rows.filter("new_score is not null").select("item", F.col("new_score").alias("score"), "hits", F.lit(0).alias("age"))
    stale = rows.filter("new_score is null").orderBy(F.desc("old_score"), "item").limit(keep_old).select("item", F.lit(0.0).alias("score"), "hits", F.lit(1).alias("age"))
    best = fresh.unionByName(stale).orderBy("age", F.desc("score"), "item").limit(cap)  # cap rows to number, no more
    return ranked(best, [], ["age", F.desc("score"), "item"]).drop("age")


def apply_actions(memory: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memory, history) after ADD, UPDATE, DELETE, NONE rows (id, event, text): empty texts are skipped, an UPDATE of an unknown id
    adds, a DELETE of one does nothing; of several actions on an id the last (seq) counts."""
    last = actions.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("seq")))).filter("_r = 1").drop("_r")
    useful = last.filter((F.col("event") == "DELETE") | (F.col("event").isin("ADD", "UPDATE") & (F.coalesce(F.trim("text"), F.lit("")) != "")))
    known = useful.join(memory.select("id", F.col("text").alias("old_text")), "id", "left")
    known = known.filter((F.col("event") != "DELETE") | F.col("old_text").isNotNull())
    event = F.when((F.col("event") == "UPDATE") & F.col("old_text").isNull(), "ADD").otherwise(F.col("event"))
    history = known.select("id", event.alias("event"), "old_text", F.when(F.col("event") != "DELETE", F.col("text")).alias("new_text"))
    after = memory.join(history.select("id"), "id", "left_anti").select("id", "text").unionByName(history.filter("event <> 'DELETE'").select("id", F.col("new_text").alias("text")))
    return after, history


def compile_states(claims: DataFrame, key: Sequence[str] = ("subject", "slot")) -> DataFrame:
    """The state machine over claims (claim_id, subject, slot, value, seq, recorded, valid_from, session, decision) in seq order.

    A decision is about the claim that was added last.  DUPLICATE and CORROBORATE add evidence to it; SUPERSEDE closes it by
    closing_time(); REFINE leaves its interval open; CONFLICT leaves both contested; NEW leaves it alone; EPISODIC stands beside
    the state.  Where nothing was added yet, any decision but EPISODIC is NEW.  A column `correction`, if there, marks explicit
    corrections.  One row a claim: operation, status, version, ends_at, evidence.

    All by windows: a claim that the session guard turns into a duplicate has the session and value of the one added last, so
    the guard may look at the last claim that would be added, whether or not it was.
    """
    tied = ["seq", "claim_id", "value", "recorded"]
    order = Window.partitionBy(*key).orderBy(*tied)
    back = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in tied]).rowsBetween(Window.unboundedPreceding, -1)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    correction = F.col("correction") if "correction" in claims.columns else F.lit(False)
    rows = claims.select(*key, *tied, "session", "decision", "valid_from", correction.alias("correction"))
    stateful = F.col("decision") != "EPISODIC"
    rows = rows.withColumn("first", stateful & (F.count(F.when(stateful, 1)).over(so_far) == 1))
    would_add = stateful & (F.col("first") | F.col("decision").isin("NEW", "REFINE", "SUPERSEDE", "CONFLICT"))
    rows = rows.withColumn("last", F.last(F.when(would_add, F.struct("session", "value")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    same = lambda c: F.coalesce(F.col(f"last.{c}") == F.col(c), F.lit(False))
    rows = rows.withColumn("operation", F.when(F.col("first"), "NEW").otherwise(guarded_decision(F.col("decision"), same("session"), same("value"))))
    rows = rows.withColumn("added", stateful & ~F.col("operation").isin("DUPLICATE", "CORROBORATE"))
    rows = rows.withColumn("at", F.count(F.when(F.col("added"), 1)).over(so_far).cast("int"))
    rows = rows.withColumn("next", F.last(F.when(F.col("added"), F.struct("operation", "valid_from", "recorded", "correction")), ignorenulls=True).over(back))
    merged = F.count(F.when(stateful & ~F.col("added"), 1)).over(Window.partitionBy(*key, "at")).cast("int")
    after = F.col("next.operation")
    status = (
        F.when(~stateful, "standalone").when(~F.col("added"), "merged").when(after == "SUPERSEDE", "superseded").when(after == "REFINE", "refined")
        .when((after == "CONFLICT") | (F.col("operation") == "CONFLICT"), "contested").otherwise("active")
    )
    ends = closing_time(F.col("valid_from"), F.lit(None).cast("timestamp"), F.col("recorded"), F.col("next.valid_from"), F.col("next.recorded"), F.col("next.correction"))
    return rows.select(
        *key, "claim_id", "operation", status.alias("status"), F.when(F.col("added"), F.col("at")).otherwise(0).alias("version"),
        F.when(F.col("added") & (after == "SUPERSEDE"), ends).cast("timestamp").alias("ends_at"), F.when(F.col("added"), merged + 1).otherwise(1).alias("evidence"),
    )


def invariants(claims: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, n): duplicate edges, edges to unknown claims, keys with several active versions, self-loops."""
    rule = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
    twice = edges.groupBy("source_id", "target_id", "relation").agg(F.count("*").alias("c")).filter("c > 1")
    ids = claims.select(F.col("claim_id").alias("target_id"))
    dangling = edges.join(ids, "target_id", "left_anti")
    several = claims.filter("status = 'active'").groupBy("subject", "slot").agg(F.count("*").alias("c")).filter("c > 1")
    loops = edges.filter("source_id = target_id")
    return rule("duplicate edges", twice).unionByName(rule("dangling edges", dangling)).unionByName(rule("several active versions", several)).unionByName(rule("self-loops", loops))
