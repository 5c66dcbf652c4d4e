"""Keyed state machines, capped dedupe and operators that only a scan of a key's rows can express.

These are the slow path, by row in Python: rows are dealt out by key, sorted by Spark (which spills), and stream through a task in
Arrow batches, so a key's rows are never held together. Where a closed form exists (counters, sums, latest values), use
operators.spread or windows in its place: a key's states follow one another, so its rows stay in one task here.
"""

from __future__ import annotations

from collections import OrderedDict, deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby, repeat
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType

from .spread import listed, running

Step = Callable[[Any, dict], tuple[Any, dict | None]]
#: What a key's scan is made of: rows in order to output rows, and what is left at its end.
Scan = tuple[Callable[[dict], Iterable[dict]], Callable[[], Iterable[dict]]]
BATCH = 10_000


def scan(df: DataFrame, keys: Sequence[str], order: str | Sequence[str], schema: str | StructType, begin: Callable[[dict], Scan]) -> DataFrame:
    """For each key, begin(its first row) gives (take, end): take(row) for each row in order, end() after the last, both to output rows.
    Null and NaN are keys like others; without keys all rows are one sequence."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out_type = to_arrow_schema(schema if isinstance(schema, StructType) else _parse_datatype_string(schema))
    columns = df.columns

    def key_of(row: dict) -> tuple:
        return tuple("NaN" if isinstance(v, float) and v != v else (v,) for v in (row[k] for k in keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, take, end, out = None, None, None, []
        for batch in batches:
            for key, rows in groupby(batch.rename_columns(columns).to_pylist(), key_of):
                for row in rows:
                    if end is None or key != now:
                        out += end() if end else ()
                        now, (take, end) = key, begin(row)
                    out += take(row)
                    if len(out) >= BATCH:
                        yield pa.RecordBatch.from_pylist(out, out_type)
                        out = []
        out += end() if end else ()
        if out:
            yield pa.RecordBatch.from_pylist(out, out_type)

    return _dealt(df, keys, order).mapInArrow(run, schema)


def _dealt(df: DataFrame, keys: Sequence[str], order: str | Sequence[str]) -> DataFrame:
    along = [f"`{c}`" for c in [*keys, *listed(order)]]
    dealt = df.repartition(*(f"`{k}`" for k in keys)) if keys else df.repartition(1)
    return dealt.sortWithinPartitions(*along)


def scan_column(df: DataFrame, keys: Sequence[str], order: str, column: str, name: str, kind: DataType, begin: Callable[[], Callable[[Any], Any]]) -> DataFrame:
    """Adds to each row of a key in order what begin()'s function gives for one column's value. As in scan(), but rows pass through as Arrow columns, of which only that one and the keys become Python's."""
    from pyspark.sql.pandas.types import to_arrow_type

    columns, made = df.columns, to_arrow_type(kind)
    at, own = columns.index(column), [columns.index(k) for k in keys]

    def values(c: pa.Array) -> list:
        return ["NaN" if v != v else v for v in c.to_pylist()] if pa.types.is_floating(c.type) else c.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, take = None, None
        for batch in batches:
            keyed, found = zip(*(values(batch.column(i)) for i in own), strict=True) if own else repeat((), len(batch)), []
            for key, v in zip(keyed, batch.column(at).to_pylist(), strict=True):
                if take is None or key != now:
                    now, take = key, begin()
                found.append(take(v))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, made)], [*columns, name])

    return _dealt(df, keys, order).mapInArrow(run, StructType([*df.schema.fields, StructField(name, kind)]))


def _nothing() -> tuple:
    return ()


def _filter(df: DataFrame, keys: Sequence[str], order: str, begin: Callable[[], Callable[[dict], bool]]) -> DataFrame:
    """Rows of which the key's predicate holds, asked in order."""

    def start(_: dict) -> Scan:
        keep = begin()
        return lambda row: (row,) if keep(row) else (), _nothing

    return scan(df, keys, order, df.schema, start)


def process(df: DataFrame, keys: Sequence[str], order: str, init: Callable[[], Any], step: Step, schema: str) -> DataFrame:
    """For each row of a key in order: step(state, row) -> (state, output row or None)."""

    def begin(_: dict) -> Scan:
        state = init()

        def take(row: dict) -> tuple:
            nonlocal state
            state, emitted = step(state, row)
            return () if emitted is None else (emitted,)

        return take, _nothing

    return scan(df, keys, order, schema, begin)


def counter(df: DataFrame, keys: Sequence[str], order: str, name: str = "n") -> DataFrame:
    """The running count of each key: the closed form of a counting state machine. Heavy keys are cut into ranges of the order."""
    return running(df, order, {name: ("count", F.lit(1))}, keys).withColumn(name, F.col(name).cast("bigint"))


def dedupe_capped(df: DataFrame, key: str, order: str, partition: str, most: int = 100_000) -> DataFrame:
    """First rows of each key within a source partition; the oldest of more than `most` keys are forgotten, and pass again. What is
    forgotten depends on all keys of the partition, so a partition is one task, which holds `most` keys."""

    def begin() -> Callable[[dict], bool]:
        seen: OrderedDict = OrderedDict()

        def new(row: dict) -> bool:
            if row[key] in seen:
                return False
            seen[row[key]] = None
            if len(seen) > most:
                seen.popitem(last=False)
            return True

        return new

    return _filter(df, [partition], order, begin)


def passes(last: int | None, t: int | None, within: int) -> bool:
    """Whether a copy passes after one of time `last` has: its time is more than `within` later. One without a time doesn't."""
    return t is not None and (last is None or t > last + within)


def dedupe_within(df: DataFrame, keys: Sequence[str], order: str, time: str, within: int) -> DataFrame:
    """The first row of each key, and again the first one after its identifier was forgotten, `within` after the last that passed: passes form chains."""

    def begin() -> Callable[[dict], bool]:
        last, any_ = None, False

        def new(row: dict) -> bool:
            nonlocal last, any_
            if any_ and not passes(last, row[time], within):
                return False
            last, any_ = row[time] if row[time] is not None else last, True
            return True

        return new

    return _filter(df, keys, order, begin)


def aggregate_windows(df: DataFrame, keys: Sequence[str], order: str, init: Callable[[], Any], add: Callable[[Any, dict], Any], emit: Callable[[dict, Any], dict], schema: str) -> DataFrame:
    """A user's aggregate over each group of keys, which include the window's bounds: add(state, row) in order, then emit(keys, state)."""

    def begin(row: dict) -> Scan:
        state, named = init(), {k: row[k] for k in keys}

        def take(row: dict) -> tuple:
            nonlocal state
            state = add(state, row)
            return ()

        return take, lambda: (named | emit(named, state),)

    return scan(df, keys, order, schema, begin)


def exhaust_map(df: DataFrame, keys: Sequence[str], time: str, busy: str) -> DataFrame:
    """Rows that arrive while no earlier kept one is active: each is active for `busy` (same unit) from `time`."""

    def begin() -> Callable[[dict], bool]:
        until = None

        def idle(row: dict) -> bool:
            nonlocal until
            if until is not None and row[time] < until:
                return False
            until = row[time] + row[busy]
            return True

        return idle

    return _filter(df, keys, time, begin)


def audit(df: DataFrame, keys: Sequence[str], time: str, every: int) -> DataFrame:
    """A span opens at the first row and lasts `every`; its latest row is kept, the next row after it opens a new one."""

    def begin(_: dict) -> Scan:
        end, latest = None, None

        def take(row: dict) -> tuple:
            nonlocal end, latest
            closed = () if end is None or row[time] < end else (latest,)
            if end is None or closed:
                end = row[time] + every
            latest = row
            return closed

        return take, lambda: (latest,)

    return scan(df, keys, time, df.schema, begin)


def group_within(df: DataFrame, keys: Sequence[str], time: str, size: int, ms: int, name: str = "batch") -> DataFrame:
    """Adds the number of a row's batch: a batch closes at `size` rows, or `ms` after its first."""

    def begin() -> Callable[[Any], int]:
        number, n, first = -1, 0, None

        def take(t: Any) -> int:
            nonlocal number, n, first
            if first is None or n == size or t >= first + ms:
                number, n, first = number + 1, 0, t
            n += 1
            return number

        return take

    return scan_column(df, keys, time, time, name, LongType(), begin)


def limiter(kind: str, limit: int, window: float) -> Callable[[float], bool]:
    """Whether a rate limiter admits a request at a time: sliding (a request leaves at now - window), fixed (a window starts at the first
    request after the last ended), or bucket (`limit` tokens, refilled evenly over the window)."""
    recent: deque = deque()
    start, used, tokens, at = None, 0, float(limit), None

    def sliding(t: float) -> bool:
        while recent and recent[0] <= t - window:
            recent.popleft()
        if len(recent) < limit:
            recent.append(t)
            return True
        return False

    def fixed(t: float) -> bool:
        nonlocal start, used
        if start is None or t >= start + window:
            start, used = t, 0
        used += 1
        return used <= limit

    def bucket(t: float) -> bool:
        nonlocal tokens, at
        tokens, at = min(limit, tokens + (0 if at is None else (t - at) * limit / window)), t
        if tokens < 1:
            return False
        tokens -= 1
        return True

    return {"sliding": sliding, "fixed": fixed}.get(kind, bucket)


def admitted(times: Iterable[float], kind: str, limit: int, window: float) -> list[bool]:
    return list(map(limiter(kind, limit, window), times))


def rate_limit(df: DataFrame, keys: Sequence[str], time: str, kind: str, limit: int, window: int) -> DataFrame:
    """Rows that the limiter of their key admits."""

    def begin() -> Callable[[dict], bool]:
        admits = limiter(kind, limit, window)
        return lambda row: admits(row[time])

    return _filter(df, keys, time, begin)
