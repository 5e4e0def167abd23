"""Filter languages compiled to Columns, so that Catalyst pushes, prunes and folds them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Resolver = Callable[[str], Column]


def plain(name: str) -> Column:
    return F.col(name)


def json_field(column: str) -> Resolver:
    """Fields of a JSON string column."""
    return lambda name: F.get_json_object(column, f"$.{name}")


def every(parts: Sequence[Column]) -> Column:
    return reduce(and_, parts, F.lit(True)) if parts else F.lit(True)


def some(parts: Sequence[Column]) -> Column:
    return reduce(or_, parts, F.lit(False)) if parts else F.lit(False)


_COMPARE: dict[str, Callable[[Column, Any], Column]] = {
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}


def condition(spec: Mapping[str, Any], field: Resolver = plain, arrays: frozenset[str] = frozenset()) -> Column:
    """One condition of the dict language: {field: value} or {field: {op: value}}, all of which must hold.

    gt/gte/lt/lte compare numbers, or timestamps where the field's name ends in _at; contains is array
    membership, else a case-insensitive substring; in is overlap for arrays, else membership; like is
    a case-insensitive substring.
    """
    parts: list[Column] = []
    for name, want in spec.items():
        c = field(name)
        if not isinstance(want, Mapping):
            parts.append(c == F.lit(want) if name in arrays or not isinstance(want, (int, float)) or isinstance(want, bool) else c.try_cast("double") == float(want))
            continue
        for op, value in want.items():
            if op in _COMPARE:
                stamp = name.endswith("_at")
                parts.append(_COMPARE[op](c.cast("timestamp"), F.lit(value).cast("timestamp")) if stamp else _COMPARE[op](c.try_cast("double"), float(value)))
            elif op == "contains":
                parts.append(F.array_contains(c, value) if name in arrays else c.ilike(f"%{value}%"))
            elif op == "in":
                parts.append(F.arrays_overlap(c, F.array(*map(F.lit, value))) if name in arrays else c.isin([str(v) for v in value]))
            elif op == "like":
                parts.append(c.ilike(f"%{value}%"))
            else:
                raise ValueError(f"unknown operator {op!r}")
    return every(parts)


def combined(spec: Mapping[str, Any] | None, field: Resolver = plain, arrays: frozenset[str] = frozenset()) -> Column:
    """{"and": [...]} or {"or": [...]} of conditions, one level; "and" wins where both are given."""
    if not spec:
        return F.lit(True)
    if "and" in spec:
        return every([condition(s, field, arrays) for s in spec["and"]])
    if "or" in spec:
        return some([condition(s, field, arrays) for s in spec["or"]])
    return condition(spec, field, arrays)


def listed(filters: Sequence[Mapping[str, Any]], field: Resolver = plain, arrays: frozenset[str] = frozenset()) -> Column:
    """The list language: [{"field", "op", "value"}, ...], all of which must hold."""
    parts = []
    for f in filters:
        c, op, value = field(f["field"]), f.get("op", "="), f["value"]
        number = isinstance(value, (int, float)) and not isinstance(value, bool)
        left = c.try_cast("double") if number else c
        if op == "=":
            parts.append(left == value)
        elif op == "in":
            parts.append(c.isin([str(v) for v in value]))
        elif op in (">", ">=", "<", "<="):
            parts.append({">": left > value, ">=": left >= value, "<": left < value, "<=": left <= value}[op])
        elif op == "contains":
            parts.append(F.array_contains(c, value) if f["field"] in arrays else c.contains(value))
        else:
            raise ValueError(f"unknown operator {op!r}")
    return every(parts)


RESERVED_TAGS = ("scope", "read_scopes")


def tags(spec: Mapping[str, Any] | None, field: Resolver, scopes: Sequence[str] | None = None, scope: Column | None = None, arrays: frozenset[str] = frozenset(), deny_on_no_scope: bool = True) -> Column:
    """The tag language: value, $contains, $exists, $in (an empty list holds nowhere); reserved keys are skipped.

    scopes are alternatives; an empty list denies everything, unless the flavour does not deny.
    """
    parts = []
    for name, want in (spec or {}).items():
        if name in RESERVED_TAGS:
            continue
        c = field(name)
        if not isinstance(want, Mapping):
            parts.append(c == str(want))
            continue
        if "$exists" in want:
            parts.append(c.isNotNull() if want["$exists"] else c.isNull())
        if "$contains" in want:
            parts.append(F.array_contains(c, want["$contains"]) if name in arrays else c.contains(str(want["$contains"])))
        if "$in" in want:
            parts.append(c.isin([str(v) for v in want["$in"]]) if want["$in"] else F.lit(False))
    if scopes is not None and scope is not None:
        if scopes:
            parts.append(some([scope == s for s in scopes]))
        elif deny_on_no_scope:
            parts.append(F.lit(False))
    return every(parts)


def payload(spec: Mapping[str, Any], one_sided: bool = False) -> Column:
    """Equality or range by field; a dict is a range with both gte and lte, or with either if one_sided."""
    parts = []
    for name, want in spec.items():
        c = F.col(name)
        if isinstance(want, Mapping) and ("gte" in want and "lte" in want or one_sided):
            parts += [c >= want["gte"]] if "gte" in want else []
            parts += [c <= want["lte"]] if "lte" in want else []
        elif not isinstance(want, Mapping):
            parts.append(c == want)
    return every(parts)


def after_fetch(df: DataFrame, spec: Mapping[str, Any], k: int, order: Sequence[Column]) -> DataFrame:
    """Approximate mode: the filter sees only the 2k best rows, so fewer than k may remain."""
    near = df.orderBy(*order).limit(2 * k)
    keep = [F.col(n).isNotNull() & (F.col(n).isin(list(v)) if isinstance(v, (list, tuple)) else F.col(n) == v) for n, v in spec.items()]
    return near.filter(every(keep)).orderBy(*order).limit(k)


def tagged_all(df: DataFrame, pairs: DataFrame, key: str, tag: str, wanted: Sequence[str], match_all: bool) -> DataFrame:
    """Rows of df whose key has any, or all, of the wanted tags in pairs (key, tag)."""
    hits = pairs.filter(F.col(tag).isin(list(wanted))).groupBy(key).agg(F.count_distinct(tag).alias("_n"))
    if match_all:
        hits = hits.filter(F.col("_n") == len(set(wanted)))
    return df.join(hits, key, "left_semi")


def subgraph(nodes: DataFrame, edges: DataFrame, keep: Column, node: str = "id", source: str = "source_id", target: str = "target_id") -> tuple[DataFrame, DataFrame]:
    """Nodes that pass, and edges both of whose ends pass."""
    good = nodes.filter(keep)
    for end in (source, target):
        edges = edges.join(good.select(F.col(node).alias(end)), end, "left_semi")
    return good, edges


def isolated(nodes: DataFrame, edges: DataFrame, node: str = "id", source: str = "source_id", target: str = "target_id") -> DataFrame:
    for end in (source, target):
        nodes = nodes.join(edges.select(F.col(end).alias(node)), node, "left_anti")
    return nodes


def long_enough(text: Column, least: int = 20) -> Column:
    """ASCII texts count words, others count characters."""
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), words >= least).otherwise(F.char_length(text) >= least)


def soft_deleted(df: DataFrame, batch: Column, restore: bool = False) -> DataFrame:
    """status, deleted_at and deleted_by of a batch set, or blanked on restore."""
    state = ("activated", "", "") if restore else ("deleted", "now", "batch")
    for name, value in zip(("status", "deleted_at", "deleted_by"), state, strict=True):
        df = df.withColumn(name, F.when(batch, F.lit(value)).otherwise(F.col(name)))
    return df
