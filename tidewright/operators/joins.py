"""Keyed joins of streams: interval, latest value, lookup."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from heapq import heappop, heappush
from time import monotonic

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import running, unused
from .state import scan

SLOT = "_slot"
#: Most rows of a lookup side that is sent to every task.
LOOKUP_ROWS, LOOKUP_BYTES = 200_000, 64 << 20


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, window_us: int, bound: str = "strict") -> DataFrame:
    """Pairs of equal key less than window_us apart (`strict`: rows in order), or up to it (`inclusive`), as structs left, right.

    Time is cut into slots of the window's length and joined on with the key, so a hot key is spread over its slots: each left
    row meets its own slot and both neighbours.
    """
    near = F.abs(F.col("left")[time] - F.col("right")[time])
    fits = near < window_us if bound == "strict" else near <= window_us
    slot = lambda t: F.floor(F.col(t) / max(1, window_us))
    a = left.select(F.col(key).alias("_ka"), slot(time).alias("_s"), F.struct(*left.columns).alias("left")).withColumn(SLOT, F.explode(F.array(F.col("_s") - 1, F.col("_s"), F.col("_s") + 1)))
    b = right.select(F.col(key).alias("_kb"), slot(time).alias("_sb"), F.struct(*right.columns).alias("right"))
    return a.join(b, (F.col("_ka") == F.col("_kb")) & (F.col(SLOT) == F.col("_sb")) & fits).select("left", "right")


def interval_join_evicting(left: DataFrame, right: DataFrame, key: str, time: str, seq: str, window_us: int) -> DataFrame:
    """Pairs at most window_us apart, as buffers that forget give them: a row that comes (by `seq`, distinct over both sides) makes its key's
    buffers forget all rows that are window_us or more older than it, before it looks for partners. So a pair meets unless a row that far ahead comes
    between the two. Which row makes each one forgotten is found in a scan of a key that holds what its buffers would; the pairs follow from an interval join."""
    columns = [F.col(f"`{key}`").alias("key"), F.col(time).alias("t"), F.col(seq).alias("seq")]
    both = left.select(*columns).unionByName(right.select(*columns)).where("key is not null and t is not null")

    def begin(_: dict) -> tuple:
        held: list[tuple] = []

        def take(row: dict) -> list[dict]:
            out = []
            while held and held[0][0] <= row["t"] - window_us:
                out.append({"seq": heappop(held)[1], "forgotten": row["seq"]})
            heappush(held, (row["t"], row["seq"]))
            return out

        return take, lambda: ()

    dead = scan(both, ["key"], "seq", "seq bigint, forgotten bigint", begin).withColumnRenamed("seq", "gone")
    name = unused(left, unused(right, "_forgotten"))
    sides = [x.join(dead, F.col(seq) == F.col("gone"), "left").select(*x.columns, F.col("forgotten").alias(name)) for x in (left, right)]
    pairs = interval_join(*sides, key, time, window_us, "inclusive")
    before = F.col("left")[seq] < F.col("right")[seq]
    forgotten, later = F.when(before, F.col("left")[name]).otherwise(F.col("right")[name]), F.greatest(F.col("left")[seq], F.col("right")[seq])
    met = pairs.where(forgotten.isNull() | (later < forgotten))
    return met.select(F.col("left").dropFields(name).alias("left"), F.col("right").dropFields(name).alias("right"))


def _tagged(main: DataFrame, side: DataFrame, order: str) -> DataFrame:
    a = main.select(F.col(order).alias("_o"), F.lit(1).alias("_kind"), F.struct(*main.columns).alias("_main"), F.lit(None).cast(side.select(F.struct(*side.columns).alias("s")).schema["s"].dataType).alias("_side"))
    b = side.select(F.col(order).alias("_o"), F.lit(0).alias("_kind"), F.lit(None).cast(a.schema["_main"].dataType).alias("_main"), F.struct(*side.columns).alias("_side"))
    return a.unionByName(b)


#: At equal order, the side comes first.
_ORDER = ("_o", "_kind")


def with_latest(main: DataFrame, side: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """Each main row with the latest side row at or before it, of the same keys if given; none yet: the row is dropped. main, side."""
    rows = _tagged(main, side, order)
    names = [f"_k{i}" for i in range(len(keys))]
    rows = rows.withColumns({n: F.coalesce(F.col("_main")[k], F.col("_side")[k]) for n, k in zip(names, keys, strict=True)})
    out = running(rows, _ORDER, {"_latest": ("last", F.col("_side"))}, names)
    return out.where("_kind = 1 and _latest is not null").select(F.col("_main").alias("main"), F.col("_latest").alias("side"))


def combine_latest(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """On every change of either, the latest of both, once both have a value: order, left, right."""
    rows = _tagged(a, b, order)
    out = running(rows, _ORDER, {"_l": ("last", F.col("_main")), "_r": ("last", F.col("_side"))})
    return out.where("_l is not null and _r is not null").select(F.col("_o").alias(order), F.col("_l").alias("left"), F.col("_r").alias("right"))


def small(df: DataFrame, most: int, most_bytes: int = LOOKUP_BYTES) -> bool:
    """Whether df has at most `most` rows, and `most_bytes` of them as JSON; runs a job that reads no more rows than that."""
    n, size = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))), F.lit(0))).first()
    return n <= most and size <= most_bytes


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str, most: int = LOOKUP_ROWS) -> DataFrame:
    """Left join to a table of one row per key: the columns of df, then those of the table that df has not. The table is broadcast if it
    is counted to be small, in rows and by the size of their values."""
    side = table.select(F.col(table_key).alias(unused(df, "_lookup")), *(c for c in table.columns if c not in df.columns))
    on = F.col(f"`{key}`") == F.col(side.columns[0])
    return df.join(F.broadcast(side) if small(side, most) else side, on, "left").drop(side.columns[0])


def lookup_remote(df: DataFrame, key: str, load: Callable[[list], dict], name: str, kind: str, batch: int = 1000, most: int = 100_000, ttl_s: float | None = None) -> DataFrame:
    """Left join to what `load(keys)` returns; in each task distinct keys are loaded once, at most `batch` at a time. A task remembers
    `most` keys, the oldest ones go first, each for ttl_s seconds if that is given."""

    @F.pandas_udf(kind)
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict = {}  # in the order of loading: value and time
        for s in batches:
            now, wanted = monotonic(), s.dropna().unique().tolist()
            fresh = {k: known[k][0] for k in wanted if k in known and (ttl_s is None or now - known[k][1] < ttl_s)}
            new = [k for k in wanted if k not in fresh]
            for i in range(0, len(new), batch):
                part = new[i : i + batch]
                for k, v in (dict.fromkeys(part) | load(part)).items():
                    known.pop(k, None)
                    known[k], fresh[k] = (v, now), v
            for k in list(known)[: max(0, len(known) - most)]:
                del known[k]
            yield s.map(fresh.get)

    return df.withColumn(name, f(F.col(key)))


def already_processed(df: DataFrame, processed: DataFrame, ids: Sequence[str], keep: bool = False) -> DataFrame:
    """Rows whose id isn't among the processed ones, or with `keep` those that are."""
    return df.join(processed.select(*ids), list(ids), "left_semi" if keep else "left_anti")


def cross(df: DataFrame, table: DataFrame, most: int = 10_000) -> DataFrame:
    """Every row with every row of a fixed table, which is broadcast where it is counted to be small; Spark's product of partitions beyond."""
    return df.crossJoin(F.broadcast(table) if small(table, most) else table)


def same_value(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)
