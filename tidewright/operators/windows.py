"""Event-time windows over replayed rows, with the watermark of record-at-a-time processing.

A row's watermark is the largest event time before it in its source partition, less the allowed lateness; a row is late when
every window it belongs to has ended by then. That is a running maximum, so late rows fall to a filter and windows are
ordinary groups. Times are microseconds (bigint).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import state
from .spread import heavy_keys, running, unused, with_index

WM, START, END, STALE = "_watermark", "window_start_us", "window_end_us", "_stale_seq"


def micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp with or without zone (taken as UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def with_watermark(df: DataFrame, time: str, seq: str, lateness_us: int = 0, partition: Sequence[str] = ()) -> DataFrame:
    out = running(df, seq, {WM: ("max", F.col(time))}, partition, inclusive=False)
    return out.withColumn(WM, F.col(WM) - lateness_us)


def assign_tumbling(df: DataFrame, time: str, size_us: int) -> DataFrame:
    start = F.col(time) - F.pmod(F.col(time), F.lit(size_us))
    return df.withColumn(START, start).withColumn(END, F.col(START) + size_us)


def assign_sliding(df: DataFrame, time: str, size_us: int, slide_us: int) -> DataFrame:
    """A row for each window; slides longer than windows leave gaps, windows that start before 0 are skipped."""
    t = F.col(time)
    last = t - F.pmod(t, F.lit(slide_us))
    first = last - F.floor((F.lit(size_us - 1) - (t - last)) / slide_us) * slide_us
    first = F.greatest(first, F.lit(0))
    out = df.withColumn("_first", first.cast("bigint")).withColumn("_last", last).where("_first <= _last").where((t - last) < size_us)
    return out.withColumn(START, F.explode(F.sequence("_first", "_last", F.lit(slide_us).cast("bigint")))).withColumn(END, F.col(START) + size_us).drop("_first", "_last")


def open_windows(assigned: DataFrame, reference: bool = False, seq: str | None = None) -> DataFrame:
    """Drops (row, window) pairs of windows that had ended. `reference` keeps those of rows that still have an open window, each as a
    group of its own (marked by STALE), as a record-at-a-time runner emits them a second time."""
    ended = F.col(WM).isNotNull() & (F.col(END) <= F.col(WM))
    if not reference:
        return assigned.where(~ended)
    if seq is None:
        raise ValueError("reference mode needs the ordinal")
    from pyspark.sql import Window

    some_open = F.max((~ended).cast("int")).over(Window.partitionBy(seq)) == 1
    return assigned.withColumn("_some", some_open).where("_some").withColumn(STALE, F.when(ended, F.col(seq))).drop("_some")


def late_rows(assigned: DataFrame, seq: str) -> DataFrame:
    """Ordinals of rows all of whose windows had ended."""
    ended = F.col(WM).isNotNull() & (F.col(END) <= F.col(WM))
    return assigned.groupBy(seq).agg(F.min(ended.cast("int")).alias("late")).where("late = 1").select(seq)


CLOSED, RANK = "closed_seq", "emitted"


def with_closing(found: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, seq: str, opened: str, lateness_us: int = 0, gap_us: int | None = None) -> DataFrame:
    """Adds to windows the ordinal of the record at which each is emitted, null if only the input's end closes it, and its place among those emitted there, from 0.

    `found` has the keys, START, END and `opened`, the ordinal of the window's first record; `rows` are all records; gap_us is for sessions, which close once the watermark is more
    than it beyond their end. A record moves the watermark if its time is the greatest so far, and among those records both time and ordinal ascend: windows are merged
    with them by time, and the next one closes. Windows that close together go by key, in the order in which the keys' windows began (a
    key begins anew once all of its windows have closed), and by their start.

    Times are cut into ranges by `rows`, of which each window has one at least; windows with their ordinals are written to the shared folder once, where heavy keys are counted."""
    tag = unused(found, "_c")
    marked = running(rows.select(F.col(time).alias("t"), F.col(seq).alias("s")).where("t is not null"), "s", {"before": ("max", F.col("t"))}, inclusive=False)
    moves = marked.where("before is null or t > before").select((F.col("t") - lateness_us).alias("x"), F.lit(1).alias("kind"), F.col("s"))
    bound = F.col(END) if gap_us is None else F.col(END) + gap_us + 1
    ends = found.select(bound.alias("x"), F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("s"), F.struct(*found.columns).alias("row"))
    merged = running(ends.unionByName(moves, allowMissingColumns=True), ["x", "kind"], {"next": ("last", F.col("s"))}, back=True, like=(rows, time))
    closing = cut(merged.where("kind = 0").select("row.*", F.col("next").alias(CLOSED)), "closing")
    heavy = heavy_keys(closing, keys)
    never = F.lit((1 << 63) - 1)
    until = running(closing, [opened, START], {f"{tag}u": ("max", F.coalesce(CLOSED, never))}, keys, inclusive=False, heavy=heavy)
    anew = F.col(f"{tag}u").isNull() | (F.col(opened) > F.col(f"{tag}u"))
    stint = running(until.withColumn(f"{tag}a", F.when(anew, F.col(opened))), [opened, START], {f"{tag}s": ("max", F.col(f"{tag}a"))}, keys, heavy=heavy)
    return with_index(stint, [f"{tag}s", START], RANK, [CLOSED], heavy_keys(closing, [CLOSED])).select(*found.columns, CLOSED, RANK)


def sessions(df: DataFrame, keys: Sequence[str], time: str, gap_us: int, aggregates: Sequence[Column], drop_late: bool = True) -> DataFrame:
    """Sessions that merge at gaps up to and including `gap_us`; the end is the last event's time. Late rows (watermark - t > gap) are
    dropped first, which is exact for input in order, or lateness that covers the disorder."""
    rows = df.where(F.col(WM).isNull() | (F.col(WM) - F.col(time) <= gap_us)) if drop_late and WM in df.columns else df
    w = F.session_window(F.timestamp_micros(time), f"{gap_us} microseconds").alias("_w")
    out = rows.groupBy(*keys, w).agg(F.min(time).alias(START), F.max(time).alias(END), *aggregates)
    return out.drop("_w")


def needs_scan(df: DataFrame, time: str, gap_us: int) -> bool:
    """Whether some kept row came after its watermark, so that early-closed sessions may matter. Runs a job."""
    return not df.where((F.col(time) < F.col(WM)) & (F.col(WM) - F.col(time) <= gap_us)).isEmpty()


def session_step(open_: list[list], row: dict, t: int | None, mark: int | None, gap_us: int, init: Callable, add: Callable, merge: Callable | None) -> tuple[list[list], list[list]]:
    """Open sessions (start, end, state) after one more row, and those that its watermark closes. A row without a time, or a late one, is in none."""
    closed = [s for s in open_ if mark is not None and mark - s[1] > gap_us]
    open_ = [s for s in open_ if mark is None or mark - s[1] <= gap_us]
    if t is None or (mark is not None and mark - t > gap_us):
        return open_, closed
    touched = sorted((s for s in open_ if s[0] - gap_us <= t <= s[1] + gap_us), key=lambda s: s[0])
    touched = touched if merge else touched[:1]
    value = touched[0][2] if len(touched) == 1 else init()
    for s in touched if len(touched) > 1 else ():
        value = merge(value, s[2])
    open_ = [s for s in open_ if not any(s is x for x in touched)]
    open_.append([min([t, *(s[0] for s in touched)]), max([t, *(s[1] for s in touched)]), add(value, row)])
    return open_, closed


def fold_sessions(
    df: DataFrame, keys: Sequence[str], time: str, seq: str, gap_us: int, init: Callable[[], Any], add: Callable[[Any, dict], Any],
    emit: Callable[[dict, Any], dict], schema: str, merge: Callable[[Any, Any], Any] | None = None,
) -> DataFrame:
    """Sessions record by record, by the watermark that each row carries: a session takes rows until the watermark is more than the gap
    past its end. A row that touches several sessions joins them by `merge`, or without one extends only the earliest. emit() gets a
    dict of the keys and bounds. Exact for any disorder; a key's open sessions are all that is held."""

    def begin(first: dict) -> state.Scan:
        named, open_ = {k: first[k] for k in keys}, []

        def put(session: list) -> dict:
            at = named | {START: session[0], END: session[1]}
            return at | emit(at, session[2])

        def take(row: dict) -> list[dict]:
            nonlocal open_
            open_, closed = session_step(open_, row, row[time], row[WM], gap_us, init, add, merge)
            return list(map(put, closed))

        return take, lambda: list(map(put, open_))

    return state.scan(df, keys, seq, schema, begin)
