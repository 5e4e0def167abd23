"""Operators that timers drive on streams: data-anchored windows closed by event time, periodic updates by processing time.

Both keep their state in `transformWithState`, so a restarted run goes on where the last one ended; they need a state store
that knows several column families, such as the RocksDB provider.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def _fields(df: DataFrame, *cols: str) -> list[T.StructField]:
    return [T.StructField(c, df.schema[c].dataType) for c in cols]


class Windows(StatefulProcessor):
    """Rows wait, by time, until the watermark has passed the end of the open window; then the window is put out."""

    def __init__(self, names: list[str], width_us: int):
        self.names, self.width = names, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "clock long, window int")
        self.waiting = handle.getMapState("waiting", "at long, item string", "row string")

    def _end_ms(self, clock: int) -> int:
        return -(-(clock + self.width) // 1000)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for at, item in zip(pdf["at_us"], pdf[self.names[1]], strict=True):
                text = json.dumps(item.item() if hasattr(item, "item") else item)
                self.waiting.updateValue((int(at), text), (text,))
        if not any(True for _ in self.handle.listTimers()):
            first = min(k[0] for k in self.waiting.keys())
            clock, window = self.clock.get() if self.clock.exists() else (None, 0)
            if clock is None or first > clock + self.width:
                clock = first
            self.clock.update((clock, window))
            self.handle.registerTimer(self._end_ms(clock))
        elif self.clock.get()[1] == 0:  # an earlier first row moves the first window, as long as it is open
            first = min(k[0] for k in self.waiting.keys())
            clock, _ = self.clock.get()
            if first < clock:
                self.handle.deleteTimer(self._end_ms(clock))
                self.clock.update((first, 0))
                self.handle.registerTimer(self._end_ms(first))
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clock, window = self.clock.get()
        rows = sorted((k[0], json.loads(v[0]), k) for k, v in self.waiting.iterator())
        mark, out = timerValues.getCurrentWatermarkInMs(), []
        while rows:
            if rows[0][0] > clock + self.width:
                clock = rows[0][0]
            if self._end_ms(clock) > mark:
                break
            inside = [r for r in rows if r[0] <= clock + self.width]
            out += [(*key, item, window) for _, item, _ in inside]
            for r in inside:
                self.waiting.removeKey(r[2])
            rows, clock, window = rows[len(inside) :], inside[-1][0], window + 1
        self.clock.update((clock, window))
        if rows:
            self.handle.registerTimer(self._end_ms(clock))
        yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


def stream_windows(df: DataFrame, by: str, key: str, ts: str, seconds: float, late: str) -> DataFrame:
    """(by, key, window): maintenance.time_windows on a stream.

    A window is put out when the watermark (so far behind the latest time: `late`) has passed its end; rows later than that are
    dropped.  Keys of rows are unique in their group.  What is open when the stream ends stays in the state.
    """
    rows = df.select(by, key, F.unix_micros(F.col(ts).cast("timestamp")).alias("at_us"), F.col(ts).cast("timestamp").alias("at")).withWatermark("at", late)
    schema = T.StructType([*_fields(rows, by, key), T.StructField("window", T.IntegerType())])
    return rows.groupBy(by).transformWithStateInPandas(Windows(schema.names, int(seconds * 1e6)), schema, "Append", "EventTime")


class Periodic(StatefulProcessor):
    """Items gather; an update goes out with the first ones and then at most once an interval, with what came since."""

    def __init__(self, names: list[str], interval_ms: int):
        self.names, self.interval = names, interval_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, updates int")
        self.items = handle.getMapState("items", "item string", "score double")
        self.fresh = handle.getValueState("fresh", "n long")

    def _update(self, key, now: int) -> pd.DataFrame:
        n = self.last.get()[1] + 1 if self.last.exists() else 1
        self.last.update((now, n))
        (fresh,) = self.fresh.get()
        self.fresh.update((0,))
        held = sorted(((v[0], k[0]) for k, v in self.items.iterator()), key=lambda x: (-x[0], x[1]))
        return pd.DataFrame([(*key, n, now, fresh, [i for _, i in held])], columns=self.names)

    def handleInputRows(self, key, rows: Iterable[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now, n = timerValues.getCurrentProcessingTimeInMs(), self.fresh.get()[0] if self.fresh.exists() else 0
        for pdf in rows:
            for item, score in zip(pdf["item"], pdf["score"], strict=True):
                held = self.items.getValue((item,))
                self.items.updateValue((item,), (float(score) if held is None else max(held[0], float(score)),))
                n += 1
        self.fresh.update((n,))
        due = self.last.get()[0] + self.interval if self.last.exists() else now
        if due <= now:
            yield self._update(key, now)
        else:
            if not any(True for _ in self.handle.listTimers()):
                self.handle.registerTimer(due)
            yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fresh = self.fresh.get()[0]
        yield self._update(key, timerValues.getCurrentProcessingTimeInMs()) if fresh else pd.DataFrame(columns=self.names)

    def close(self) -> None:
        pass


def periodic_updates(df: DataFrame, by: str, item: str, score: str, seconds: float) -> DataFrame:
    """(by, update, at_ms, fresh, items): each key's activation memory, put out again at most every so many seconds, if anything came.

    items are all so far, best score first, an item with its best score; fresh counts the rows since the last update.
    """
    rows = df.select(by, F.col(item).cast("string").alias("item"), F.col(score).cast("double").alias("score")).filter("item is not null and score is not null")
    more = [("update", T.IntegerType()), ("at_ms", T.LongType()), ("fresh", T.LongType()), ("items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*_fields(rows, by), *(T.StructField(n, t) for n, t in more)])
    return rows.groupBy(by).transformWithStateInPandas(Periodic(schema.names, int(seconds * 1000)), schema, "Append", "ProcessingTime")
