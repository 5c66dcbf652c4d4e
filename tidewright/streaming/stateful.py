"""Live state of users' aggregates and machines, by transformWithState: state lives in the state store (RocksDB), windows end by event-time timers.

A row's watermark is the one of record-at-a-time processing, as in a replay: the largest event time before it in its source partition, less the
lateness. `Clock` adds it, with one number for each source partition as state. What is late and which sessions touch is decided by it alone, whichever
micro-batch a row comes in, so a live query gives what a replay of the same rows gives. Spark's own watermark, which trails it by a
window's length (or a session's gap) so that it drops no row that isn't late, only says when a window is emitted and its state freed.

A key's rows of one micro-batch are sorted in memory: bound a batch by its source (files or records for each trigger). With several source partitions
Spark's watermark is that of the fastest one: rows of a slower one that are older than it, by a window's length and the lateness, are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..functions import codecs
from ..operators.state import passes
from ..operators.windows import END, START, WM, session_step
from ..sources.events import PARTITION, SEQ, TIME

STAMP = "_event_time"
#: Added to times on the way to Spark's watermark, which begins at 1970 and drops rows that aren't after it.
SHIFT_MS = 10**14


def timer(micros: int) -> int:
    """The millisecond of Spark's shifted clock at which a time has come."""
    return -(-micros // 1000) + SHIFT_MS


def in_order(rows: Iterator[Row]) -> list[dict]:
    """By ordinal; those without one first, in the order that they come."""
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: (r[SEQ] is not None, r[SEQ] or 0))


class Clock(StatefulProcessor):
    """Adds to each row of a source partition the largest event time before it, less the lateness."""

    def __init__(self, names: list[str], lateness_us: int):
        self.names, self.lateness_us = names, lateness_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        latest = self.latest.get()[0] if self.latest.exists() else None
        for row in sorted(rows, key=lambda r: (r[SEQ] is not None, r[SEQ] or 0)):
            yield Row(**{n: row[n] for n in self.names}, **{WM: None if latest is None else latest - self.lateness_us})
            if row[TIME] is not None:
                latest = row[TIME] if latest is None else max(latest, row[TIME])
        if latest is not None:
            self.latest.update((latest,))

    def close(self) -> None:
        pass


def with_clock(df: DataFrame, lateness_us: int) -> DataFrame:
    schema = StructType([*df.schema.fields, StructField(WM, LongType())])
    return df.groupBy(PARTITION).transformWithState(Clock(df.columns, lateness_us), schema, "Append", "None")


class _Fold(StatefulProcessor):
    """What windows and sessions share: the user's functions, and the output's columns."""

    def __init__(self, key: str, names: list[str], init: Callable, add: Callable, emit: Callable, merge: Callable | None):
        self.key, self.names, self.begin, self.add, self.emit, self.merge = key, names, init, add, emit, merge

    def out(self, key: Any, start: int, end: int, state: Any) -> Row:
        at = {self.key: key[0], START: start, END: end}
        row = at | self.emit(at, state)
        return Row(**{n: row.get(n) for n in self.names})

    def close(self) -> None:
        pass


class Windows(_Fold):
    """Tumbling windows, and sliding ones, which may leave gaps. State: a map of open windows by their start."""

    def __init__(self, *fold: Any, size_us: int, slide_us: int | None):
        super().__init__(*fold)
        self.size_us, self.slide_us = size_us, slide_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getMapState("open", "start bigint", "state string")

    def starts(self, t: int) -> range:
        if self.slide_us is None:
            return range(t - t % self.size_us, t + 1, self.size_us)
        last = t - t % self.slide_us
        if t - last >= self.size_us:
            return range(0)
        first = last - (self.size_us - 1 - (t - last)) // self.slide_us * self.slide_us
        return range(max(first, 0), last + 1, self.slide_us)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        states: dict[int, Any] = {}
        for row in in_order(rows):
            for start in self.starts(row[TIME]) if row[TIME] is not None else ():
                if row[WM] is not None and start + self.size_us <= row[WM]:
                    continue  # it has ended
                if start not in states:
                    known = self.open.containsKey((start,))
                    states[start] = codecs.loads(self.open.getValue((start,))[0]) if known else self.begin()
                    if not known:
                        # Spark's watermark is a window's length behind, so it comes to the window's start as the record's comes to its end
                        self.handle.registerTimer(timer(start))
                states[start] = self.add(states[start], row)
        for start, state in states.items():
            self.open.updateValue((start,), (codecs.dumps(state),))
        yield from ()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        # windows may be less than a millisecond apart, and then share a timer
        for (start,) in sorted(tuple(k) for k in self.open.keys()):
            if timer(start) <= at:
                yield self.out(key, start, start + self.size_us, codecs.loads(self.open.getValue((start,))[0]))
                self.open.removeKey((start,))


class Sessions(_Fold):
    """Sessions that a row extends or bridges, as operators.windows.fold_sessions has them. State: a list of open sessions."""

    def __init__(self, *fold: Any, gap_us: int):
        super().__init__(*fold)
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getListState("open", "start bigint, till bigint, state string")

    def _load(self) -> list[list]:
        return [[s[0], s[1], codecs.loads(s[2])] for s in self.open.get()] if self.open.exists() else []

    def _save(self, sessions: list[list]) -> None:
        if sessions:
            self.open.put([(s, e, codecs.dumps(state)) for s, e, state in sessions])
        else:
            self.open.clear()

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        open_ = self._load()
        had = {e for _, e, _ in open_}
        for row in in_order(rows):
            open_, closed = session_step(open_, row, row[TIME], row[WM], self.gap_us, self.begin, self.add, self.merge)
            for s in closed:
                yield self.out(key, *s)
        for end in {e for _, e, _ in open_} - had:
            self.handle.registerTimer(timer(end + 1))
        self._save(open_)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        at, open_ = expiredTimerInfo.getExpiryTimeInMs(), self._load()
        for s in sorted((s for s in open_ if timer(s[1] + 1) <= at), key=lambda s: s[0]):
            yield self.out(key, *s)
        self._save([s for s in open_ if timer(s[1] + 1) > at])


def fold_windows(
    df: DataFrame, key: str, shape: str, size_us: int, slide_us: int, lateness_us: int,
    init: Callable, add: Callable, emit: Callable, schema: str, merge: Callable | None = None,
) -> DataFrame:
    """A streaming df with PARTITION, SEQ and TIME to the user's rows of each window: keys and bounds, then `schema`."""
    from pyspark.sql.types import _parse_datatype_string

    out = StructType([df.schema[key], StructField(START, LongType()), StructField(END, LongType()), *_parse_datatype_string(schema).fields])
    fold = (key, out.names, init, add, emit, merge)
    processor = Sessions(*fold, gap_us=size_us) if shape == "session" else Windows(*fold, size_us=size_us, slide_us=slide_us if shape == "sliding" else None)
    delay = -(-(lateness_us + size_us) // 1000)
    stamped = with_clock(df, lateness_us).withColumn(STAMP, F.timestamp_micros(F.col(TIME) + SHIFT_MS * 1000)).withWatermark(STAMP, f"{delay} milliseconds")
    return stamped.groupBy(key).transformWithState(processor, out, "Append", "EventTime")


class Retention(StatefulProcessor):
    """Rows of a key that pass, as operators.state.dedupe_within has them. State: the time of the last that did, forgotten once Spark's watermark is past its span."""

    def __init__(self, names: list[str], within_us: int):
        self.names, self.within_us = names, within_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "at bigint")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.last.exists()
        last, moved = self.last.get()[0] if known else None, False
        for row in sorted(rows, key=lambda r: (r[SEQ] is not None, r[SEQ] or 0)):
            if known and not passes(last, row[TIME], self.within_us):
                continue
            known, moved, last = True, True, row[TIME] if row[TIME] is not None else last
            yield Row(**{n: row[n] for n in self.names})
        if moved:
            self.last.update((last,))
            if last is not None:
                self.handle.registerTimer(timer(last + self.within_us + 1))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        # a later pass has a timer of its own
        if self.last.exists() and self.last.get()[0] is not None and timer(self.last.get()[0] + self.within_us + 1) <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
        yield from ()

    def close(self) -> None:
        pass


def dedupe_within(df: DataFrame, key: str, within_us: int) -> DataFrame:
    """As the replay, for rows out of order by `within_us` at most: Spark drops rows that are further behind."""
    stamped = df.withColumn(STAMP, F.timestamp_micros(F.col(TIME) + SHIFT_MS * 1000)).withWatermark(STAMP, f"{-(-within_us // 1000)} milliseconds")
    return stamped.groupBy(key).transformWithState(Retention(df.columns, within_us), df.schema, "Append", "EventTime")


class Machine(StatefulProcessor):
    """step(state, row) -> (state, output row or None) for each row of a key, in the order of the source within a micro-batch. State: one value, of lossless JSON."""

    def __init__(self, names: list[str], init: Callable[[], Any], step: Callable, ttl_ms: int | None):
        self.names, self.begin, self.step, self.ttl_ms = names, init, step, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("state", "state string", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = codecs.loads(self.held.get()[0]) if self.held.exists() else self.begin()
        for row in in_order(rows):
            state, emitted = self.step(state, row)
            if emitted is not None:
                yield Row(**{n: emitted.get(n) for n in self.names})
        self.held.update((codecs.dumps(state),))

    def close(self) -> None:
        pass


def process(df: DataFrame, key: str, init: Callable[[], Any], step: Callable, schema: str, ttl_us: int | None = None) -> DataFrame:
    """With a ttl, the state of a key that no row has come for in so long (by the clock on the wall) is forgotten; Spark then has no last batch, so give the
    query another trigger than availableNow."""
    from pyspark.sql.types import _parse_datatype_string

    out = _parse_datatype_string(schema)
    machine = Machine(out.names, init, step, None if ttl_us is None else max(1, ttl_us // 1000))
    return df.groupBy(key).transformWithState(machine, out, "Append", "None" if ttl_us is None else "ProcessingTime")
