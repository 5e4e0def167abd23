"""Dates and temporal predicates as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, fixed order: the first format that reads the text wins; month-first before day-first.
DATE_FORMATS = (
    "h:mm a 'on' d MMMM, yyyy", "h:mma 'on' d MMMM, yyyy", "yyyy-MM-dd", "yyyy-MM", "yyyy-MM-dd HH:mm", "MMMM d yyyy, h:mm a", "MMM d yyyy, h:mm a",
    "MM/dd/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd/MM/yyyy", "d MMMM yyyy", "d MMM yyyy", "d MMMM yyyy, h:mm a", "d MMM yyyy, h:mm a",
)
STAMP_FORMATS = ("h:mm a 'on' d MMMM, yyyy", "h:mm a 'on' d MMMM yyyy")
FULL_DATE = r"(\d{4}[-/](?:0?[1-9]|1[0-2])[-/](?:0?[1-9]|[12]\d|3[01]))"


def _first(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats])


def session_stamp(c: Column) -> Column:
    """8:05 pm on 7 May, 2023."""
    low = F.regexp_replace(F.regexp_replace(c, r"(?i)\bam\b", "AM"), r"(?i)\bpm\b", "PM")
    return _first(low, STAMP_FORMATS)


def flexible_date(c: Column) -> Column:
    """By the listed formats (or a stamp with its weekday), else a bare year from 1900 to 2100 as its first day."""
    marked = F.regexp_replace(F.regexp_replace(F.trim(c), r"(?i)\bam\b|(?<=\d)am\b", "AM"), r"(?i)\bpm\b|(?<=\d)pm\b", "PM")
    year = F.regexp_extract(c, r"\b(\d{4})\b", 1).try_cast("int")
    return F.coalesce(_first(marked, DATE_FORMATS).cast("date"), weekday_stamp(c).cast("date"), F.when(year.between(1900, 2100), F.make_date(year, F.lit(1), F.lit(1))))


def weekday_stamp(c: Column) -> Column:
    """2023/05/20 (Sat) 02:21."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*\([A-Za-z]+\)\s*", " "), "/", "-"))
    return _first(bare, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd"))


def spoken_day(c: Column) -> Column:
    """A day, or "N days before|after" one."""
    n = F.regexp_extract(c, r"(?i)^\s*(\d+)\s+days?\s+(?:before|after)\s+", 1)
    back = F.regexp_extract(c, r"(?i)^\s*\d+\s+days?\s+(before|after)\s+", 1)
    base = F.regexp_replace(F.regexp_replace(c, r"(?i)^\s*\d+\s+days?\s+(?:before|after)\s+", ""), ",", "")
    day = F.coalesce(_first(F.trim(base), ("d MMMM yyyy", "MMMM d yyyy", "yyyy-MM-dd")).cast("date"))
    shift = F.when(n == "", 0).when(F.lower(back) == "before", -n.try_cast("int")).otherwise(n.try_cast("int"))
    return F.date_add(day, shift)


def same_day(a: Column, b: Column) -> Column:
    return F.coalesce(spoken_day(a) == spoken_day(b), F.lit(False))


_SPOKEN = r"[a-z]+ \d{1,2},? \d{4}|\d{1,2} [a-z]+,? \d{4}"
_ANY_DATE = r"(?:(?<!\d)" + FULL_DATE[1:-1] + r"(?!\d)|" + _SPOKEN + ")"


def full_dates(c: Column) -> Column:
    """Days of the full dates in a text, in order, numeric or with a month's name; partial dates are never guessed."""
    found = F.regexp_extract_all(F.lower(c), F.lit(f"({_ANY_DATE})"), F.lit(1))

    def day(s: Column) -> Column:
        plain = F.initcap(F.regexp_replace(F.regexp_replace(s, "/", "-"), ",", ""))
        return _first(plain, ("yyyy-M-d", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")).cast("date")

    return F.filter(F.transform(found, day), lambda x: x.isNotNull())


def temporal_query(c: Column) -> Column:
    """kind, start, end of a question: interval, as_of, before, after, record, exact; null where there is no usable date.

    A cue counts right before its date; a reversed interval, or several dates that form none, give nothing.
    """
    low = F.regexp_replace(F.lower(c), r"\s+", " ")
    days = full_dates(low)
    n, first, second = F.size(days), F.get(days, 0), F.get(days, 1)
    cue = lambda words: low.rlike(rf"\b(?:{words}) {_ANY_DATE}")
    interval = low.rlike(rf"\b(?:between|from) {_ANY_DATE} (?:and|to) {_ANY_DATE}")
    kind = (
        F.when(interval & (n >= 2), F.when(first <= second, "interval")).when(n != 1, None).when(cue("as of|by"), "as_of").when(cue("before"), "before")
        .when(cue("after"), "after").when(cue("record dated|record on|discuss(?:ed)? on"), "record").otherwise("exact")
    )
    return F.struct(kind.alias("kind"), F.when(kind.isNotNull(), first).alias("start"), F.when(kind == "interval", second).when(kind.isNotNull(), first).alias("end"))


def date_matches(value: Column, kind: Column, start: Column, end: Column) -> Column:
    hit = F.when(kind == "interval", (value >= start) & (value <= end)).when(kind == "as_of", value <= start).when(kind == "before", value < start).when(kind == "after", value > start).otherwise(value == start)
    return F.coalesce(hit, F.lit(False))


def episode_match(recorded: Column, kind: Column, start: Column, end: Column, valid_time: Column) -> Column:
    """Score of an episode: nothing where the question is about valid time, a half for as-of, else one."""
    hit = date_matches(recorded, kind, start, end)
    return F.when(valid_time | ~hit, F.lit(0.0)).when(kind == "as_of", F.lit(0.5)).otherwise(F.lit(1.0))


_OPS = {"lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "gt": lambda a, b: a > b, "ge": lambda a, b: a >= b, "eq": lambda a, b: a == b}


def qualifier_filter(q: dict[str, Column], start: Column | None = None, start_op: str = "ge", end: Column | None = None, end_op: str = "le") -> Column:
    """Facts by qualifiers start_time, end_time, point_in_time, reference_time, record_time.

    A range fact compares its own ends, and is dropped where a compared end is null; others compare the
    first of point, reference and record time; a fact without any qualifier stays.
    """
    names = ("start_time", "end_time", "point_in_time", "reference_time", "record_time")
    none = reduce(lambda a, b: a & b, [q[n].isNull() for n in names])
    is_range = q["start_time"].isNotNull() | q["end_time"].isNotNull()
    point = F.coalesce(q["point_in_time"], q["reference_time"], q["record_time"])
    own = lambda which: F.when(is_range, q[which]).otherwise(point)
    parts = [F.coalesce(_OPS[op](own(which), limit), F.lit(False)) for which, op, limit in (("start_time", start_op, start), ("end_time", end_op, end)) if limit is not None]
    return none | (reduce(lambda a, b: a & b, parts) if parts else F.lit(True))
