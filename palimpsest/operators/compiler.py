"""Compiling observed claims into versioned states: one fold, in batch and on streams.

A claim (claim_id, slot, value, qualifiers, polarity, modality, persistence, recorded, valid_from, valid_to, episode,
turns) meets the open claims of its key: those that are active or contested, of the same slot or, where vectors are
given, of a slot whose vector is near.  The rules, in this order:

* background (`history`) and episodes or plans are only recorded;
* an open claim of the same slot with equal normalised content takes the evidence: DUPLICATE from an episode it knows, else CORROBORATE;
* without candidates the claim is NEW;
* else the given decision (operation, matched_id, relation, same_dimension, episode_relation, confidence) holds, unless its target
  is no candidate, its confidence too low, the dimension another one or the relation doesn't allow the operation: all NEW;
* within one episode, changes need their relation and later evidence; a restatement is a DUPLICATE;
* SUPERSEDE closes the old interval at a safe boundary, REFINE retires the old claim, CONFLICT leaves both contested.

Closed claims are history: they are no candidates and leave the state, so what is kept for a key is its open claims.

`compile_claims` streams each key's rows, sorted, through one task; `on_stream` keeps the open claims as map state of
`transformWithState`, so a restart goes on where it was.  Both give a row a claim with the changes it made, from which `states` takes the
last of each claim.  Defined cases: a null slot is taken from `predicate` if there is one, else empty; rows of equal seq go by claim_id; a claim id that comes
again on a key is compiled again; a null key is a key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Fixed values of the rules.
NON_OBSERVATIONS = ("planned", "recommended", "hypothetical")
ALLOWED = {
    "equivalent": ("DUPLICATE", "CORROBORATE"), "refinement": ("REFINE",), "changed": ("SUPERSEDE",), "contradictory": ("CONFLICT",), "uncertain": ("NEW",),
}
DAY = 86_400_000_000

TEXTS = ("claim_id", "slot", "value", "qualifiers", "polarity", "modality", "persistence", "episode", "matched_id", "decision", "relation", "episode_relation")
TIMES = ("recorded", "valid_from", "valid_to")
_CHANGE = "array<struct<claim_id: string, status: string, valid_to: bigint, evidence: int>>"
_RESULT = f"claim_id string, seq long, operation string, matched_id string, result_id string, confidence double, fallback string, guard string, same_session boolean, changes {_CHANGE}"


def slot_of(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def _plain(text: str | None) -> str:
    return re.sub(r"\s+", " ", (text or "").strip().casefold())


def _cosine(a, b) -> float:
    if a is None or b is None or len(a) != len(b):
        return 0.0
    top = sum(x * y for x, y in zip(a, b, strict=True))
    size = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    return top / size if size else 0.0


def _day(micros: int | None) -> int | None:
    return None if micros is None else micros // DAY


def _content(c: dict) -> list[str]:
    return [_plain(c[k]) for k in ("slot", "value", "qualifiers", "polarity", "modality")]


def _close(old: dict, new: dict, correction: bool) -> None:
    """Ends the old interval where the new one begins, if that is safe, else at the new record time, else not at all."""
    began, ended = _day(old["valid_from"]), _day(old["valid_to"])
    if began is not None and ended is not None and ended < began:
        old["valid_to"] = None
    if new["valid_from"] is None:
        return
    floors = [began] if correction else [began, _day(old["recorded"])]
    if all(f is None or _day(new["valid_from"]) >= f for f in floors):
        old["valid_to"] = new["valid_from"]
    elif new["recorded"] is not None and (began is None or _day(new["recorded"]) >= began):
        old["valid_to"] = new["recorded"]


class Fold:
    """The open claims of one key, and what happened to them."""

    def __init__(self, open_: dict[str, dict], min_confidence: float = 0.55, min_similarity: float = 0.7, top: int = 5):
        self.open, self.least, self.near, self.top = open_, min_confidence, min_similarity, top
        self.touched: set[str] = set()

    def _changed(self, c: dict) -> dict:
        self.touched.add(c["claim_id"])
        return {"claim_id": c["claim_id"], "status": c["status"], "valid_to": c["valid_to"], "evidence": len(c["seen"])}

    def _record(self, c: dict, status: str) -> dict:
        c = {k: c[k] for k in ("claim_id", "slot", *TIMES, "slot_vec", "claim_vec")} | {"content": _content(c), "status": status, "seen": [[c["episode"], c["turns"]]]}
        if status in ("active", "contested"):
            self.open[c["claim_id"]] = c
        return c

    def _attach(self, old: dict, c: dict) -> dict:
        if [c["episode"], c["turns"]] not in old["seen"]:
            old["seen"].append([c["episode"], c["turns"]])
        return self._changed(old)

    def candidates(self, c: dict) -> list[tuple]:
        found = []
        for old in self.open.values():
            exact = bool(c["slot"]) and c["slot"] == old["slot"]
            slot = _cosine(c["slot_vec"], old["slot_vec"])
            if exact or slot >= self.near:
                found.append((not exact, -slot, -_cosine(c["claim_vec"], old["claim_vec"]), old["claim_id"], old))
        return sorted(found, key=lambda x: x[:4])[: self.top]

    @staticmethod
    def _later(c: dict, old: dict, same_is_later: bool) -> bool:
        """Whether c's turns come after those of old in the episode they share."""
        before = [t for e, turns in old["seen"] if e == c["episode"] for t in turns]
        if not c["turns"] or not before:
            return False
        return min(c["turns"]) >= min(before) if same_is_later else min(c["turns"]) > max(before)

    def _guarded(self, operation: str, c: dict, old: dict) -> tuple[str, bool, str | None]:
        """(operation, whether it keeps its target, guard) within one episode."""
        relation = c["episode_relation"] or "none"
        if operation == "CORROBORATE":
            return "DUPLICATE", True, "same_session_corrob_downgraded"
        fine = {
            "SUPERSEDE": relation in ("correction", "state_change") and self._later(c, old, False),
            "REFINE": relation in ("refinement", "correction", "state_change") and self._later(c, old, True),
            "CONFLICT": relation == "contradiction",
        }
        if fine.get(operation, True):
            return operation, True, None
        guard = f"same_session_{operation.lower()}_guard"
        return ("DUPLICATE", True, guard) if relation == "restatement" else ("NEW", False, guard)

    def __call__(self, c: dict) -> dict:
        def result(operation, matched=None, made=None, confidence=1.0, fallback=None, guard=None, same=False, changes=()):
            return {"claim_id": c["claim_id"], "seq": c["seq"], "operation": operation, "matched_id": matched, "result_id": made or c["claim_id"], "confidence": confidence,
                    "fallback": fallback, "guard": guard, "same_session": same, "changes": list(changes)}

        if c["persistence"] == "history":
            return result("NEW", fallback="non_state_history", changes=[self._changed(self._record(c, "standalone"))])
        if c["persistence"] == "episode" or c["modality"] in NON_OBSERVATIONS:
            return result("EPISODIC", changes=[self._changed(self._record(c, "standalone"))])
        found = self.candidates(c)
        content = _content(c)
        for other, *_, old in found:
            if not other and old["content"] == content:
                twice = any(e == c["episode"] for e, _ in old["seen"])
                kind = "duplicate" if twice else "corroboration"
                return result("DUPLICATE" if twice else "CORROBORATE", old["claim_id"], old["claim_id"], fallback=f"exact_{kind}", same=twice, changes=[self._attach(old, c)])
        if not found:
            return result("NEW", fallback="no_candidate", changes=[self._changed(self._record(c, "active"))])

        operation, fallback, guard, same = c["decision"] or "NEW", None, None, False
        old = next((x[-1] for x in found if x[-1]["claim_id"] == c["matched_id"]), None) if operation != "NEW" else None
        if old is None and c["matched_id"] is not None and operation != "NEW":
            fallback = "unknown_matched_claim"
        if c["confidence"] < self.least:
            operation, old, fallback = "NEW", None, "below_confidence_threshold"
        elif old is None and operation != "NEW":
            operation, fallback = "NEW", "unknown_matched_claim"
        elif operation != "NEW" and not c["same_dimension"]:
            operation, old, fallback = "NEW", None, "different_state_dimension"
        elif operation not in ALLOWED.get(c["relation"] or "uncertain", ()):
            operation, old, fallback = "NEW", None, "state_value_relation_guard"
        if old is not None:
            same = any(e == c["episode"] for e, _ in old["seen"])
            if operation == "DUPLICATE" and not same:
                operation = "CORROBORATE"
            if same:
                operation, keeps, guard = self._guarded(operation, c, old)
                fallback = guard or fallback
                old = old if keeps else None
        told = {"confidence": c["confidence"], "fallback": fallback, "guard": guard, "same": same}
        if old is not None and operation in ("DUPLICATE", "CORROBORATE"):
            return result(operation, old["claim_id"], old["claim_id"], changes=[self._attach(old, c)], **told)
        changes = []
        if old is not None:
            old["status"] = {"SUPERSEDE": "superseded", "REFINE": "refined", "CONFLICT": "contested"}[operation]
            if operation == "SUPERSEDE":
                _close(old, c, c["episode_relation"] == "correction")
                if c["valid_from"] is not None and c["valid_to"] is not None and _day(c["valid_to"]) < _day(c["valid_from"]):
                    c = c | {"valid_to": None}
            if operation != "CONFLICT":
                self.open.pop(old["claim_id"])
            changes.append(self._changed(old))
        made = self._record(c, "contested" if operation == "CONFLICT" else "active")
        return result(operation, old and old["claim_id"], changes=[*changes, self._changed(made)], **told)


def prepared(claims: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key as key_0 ... and every column the fold reads, times in microseconds; missing ones get their defaults."""
    has = set(claims.columns)
    text = {c: F.col(c).cast("string") if c in has else F.lit(None).cast("string") for c in TEXTS}
    text["slot"] = slot_of(F.coalesce(text["slot"], F.col("predicate").cast("string")) if "predicate" in has else text["slot"])
    for c, default in (("persistence", "state"), ("modality", "actual"), ("polarity", "positive")):
        text[c] = F.coalesce(text[c], F.lit(default))
    times = [(F.unix_micros(F.col(c).cast("timestamp")) if c in has else F.lit(None).cast("long")).alias(c) for c in TIMES]
    vectors = [(F.col(c).cast("array<double>") if c in has else F.lit(None).cast("array<double>")).alias(c) for c in ("slot_vec", "claim_vec")]
    turns = F.col("turns").cast("array<int>") if "turns" in has else F.array().cast("array<int>")
    return claims.select(
        *(F.col(k).alias(f"key_{i}") for i, k in enumerate(key)), F.col("seq").cast("long").alias("seq"), *(v.alias(c) for c, v in text.items()), *times, *vectors, F.coalesce(turns, F.array().cast("array<int>")).alias("turns"),
        (F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in has else F.lit(1.0)).alias("confidence"),
        (F.coalesce(F.col("same_dimension"), F.lit(False)) if "same_dimension" in has else F.lit(True)).alias("same_dimension"),
    )


def _claims(pdf: pd.DataFrame) -> Iterator[dict]:
    names = list(pdf.columns)
    for row in pdf.itertuples(index=False):
        c = dict(zip(names, row, strict=True))
        for t in TIMES:
            c[t] = None if pd.isna(c[t]) else int(c[t])
        for t in TEXTS:
            c[t] = None if c[t] is None or c[t] is pd.NA or c[t] != c[t] else c[t]
        for v in ("slot_vec", "claim_vec", "turns"):
            c[v] = None if c[v] is None else [x.item() if hasattr(x, "item") else x for x in c[v]]
        yield c | {"seq": int(c["seq"])}


def _schema(rows: DataFrame, key: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(k, rows.schema[f"key_{i}"].dataType) for i, k in enumerate(key)] + T.StructType.fromDDL(_RESULT).fields)


def compile_claims(claims: DataFrame, key: Sequence[str] = ("subject",), **rules) -> DataFrame:
    """One row a claim, in the order of (seq, claim_id) in its key; a task holds the open claims of one key at a time.

    Vectors compare slots of a subject with each other; without them the key may be (subject, slot).
    """
    rows = prepared(claims, key)
    schema, keys = _schema(rows, key), [f"key_{i}" for i in range(len(key))]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, fold = object(), None
        for pdf in parts:
            out = []
            for own, c in zip(pdf[keys].itertuples(index=False), _claims(pdf), strict=True):
                own = tuple(None if x is None or x != x else x for x in own)
                if own != at:
                    at, fold = own, Fold({}, **rules)
                out.append((*own, *fold(c).values()))
            yield pd.DataFrame(out, columns=schema.names).astype({name: pdf[k].dtype for name, k in zip(key, keys, strict=True)})

    return rows.repartition(*keys).sortWithinPartitions(*keys, "seq", "claim_id").mapInPandas(run, schema)


class Compiler(StatefulProcessor):
    """The fold over micro-batches; the open claims of a key are a map of its state."""

    def __init__(self, names: list[str], rules: dict):
        self.names, self.rules = names, rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getMapState("open", "claim_id string", "claim string")

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["seq", "claim_id"], kind="stable")
        fold = Fold({k[0]: json.loads(v[0]) for k, v in self.kept.iterator()}, **self.rules)
        before = set(fold.open)
        out = [(*key, *fold(c).values()) for c in _claims(pdf)]
        for k in fold.touched & set(fold.open):
            self.kept.updateValue((k,), (json.dumps(fold.open[k]),))
        for k in before - set(fold.open):
            self.kept.removeKey((k,))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def on_stream(claims: DataFrame, key: Sequence[str] = ("subject",), **rules) -> DataFrame:
    """compile_claims over a stream (or a table): rows of a micro-batch are taken in the order of seq, later ones come after them.

    Needs a state store that knows several column families, such as the RocksDB provider.
    """
    rows = prepared(claims, key)
    schema = _schema(rows, key)
    grouped = rows.groupBy(*(f"key_{i}" for i in range(len(key))))
    return grouped.transformWithStateInPandas(Compiler(schema.names, rules), schema, "Append", "None")


def states(compiled: DataFrame, key: Sequence[str] = ("subject",)) -> DataFrame:
    """The last change of every claim: status, valid_to and pieces of evidence."""
    each = compiled.select(*key, "seq", F.col("claim_id").alias("by"), F.posexplode("changes").alias("pos", "c"))
    last = each.groupBy(*key, F.col("c.claim_id").alias("claim_id")).agg(F.max_by("c", F.struct("seq", "by", "pos")).alias("c"))
    return last.select(*key, "claim_id", "c.status", F.timestamp_micros("c.valid_to").alias("valid_to"), "c.evidence")
