"""Timing operators in their event-time form. Times are numbers in one unit; `keys` give each key its own timeline."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import with_latest
from .ordered import place
from .spread import COUNTED, heavy_keys, running, unused, with_next, with_previous
from .state import group_within


def debounce(df: DataFrame, order: str, time: str, quiet: int, keys: Sequence[str] = ()) -> DataFrame:
    """Rows followed by `quiet` of silence; the last one always."""
    name = unused(df, "_next")
    out = with_next(df, order, {name: F.col(time)}, keys)
    return out.where(F.col(name).isNull() | (F.col(name) - F.col(time) >= quiet)).select(*df.columns)


def sample(df: DataFrame, order: str, time: str, every: int, keys: Sequence[str] = ()) -> DataFrame:
    """The latest row of each interval; what the last, open interval holds is dropped."""
    slot = F.floor(F.col(time) / every).cast("bigint")
    latest = df.groupBy(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), slot.alias("slot")).agg(F.max_by(F.struct(*df.columns), place(order)).alias("row"))
    open_ = F.broadcast(df.agg(F.max(slot).alias("open"))) if not keys else df.groupBy(*(F.col(k).alias(f"o{i}") for i, k in enumerate(keys))).agg(F.max(slot).alias("open"))
    on = F.lit(True)
    for i in range(len(keys)):
        on = on & F.col(f"k{i}").eqNullSafe(F.col(f"o{i}"))
    return latest.join(open_, on).where("slot < open").select("row.*")


def offset_islands(df: DataFrame, partition: str, offset: str) -> DataFrame:
    """The committable offset of each partition: one beyond the run without gaps from its smallest completed offset."""
    rows = running(df.select(partition, offset).distinct(), offset, {"_n": ("count", F.lit(1))}, [partition])
    runs = rows.withColumn("_run", F.col(offset) - F.col("_n"))
    first = runs.groupBy(partition).agg(F.min("_run").alias("_run"))
    return runs.join(first, [partition, "_run"], "left_semi").groupBy(partition).agg((F.max(offset) + 1).alias("committable"))


def commit_frontier(df: DataFrame, partition: str, offset: str, done: str, name: str = "committable", heavy: Any = COUNTED) -> DataFrame:
    """For each completion the offset that is committable after it: one beyond the longest run of completed offsets that begins at the partition's least one; null
    while there is none. `done` orders completions; those that tie are taken together. Rows without it haven't completed.

    An offset becomes committable at the greatest `done` of those up to it. From these times the frontier at any completion is the greatest offset whose time has come:
    two running maxima, along offsets and along time. Heavy partitions are counted once, in df: no later step has more rows of a partition than twice as many."""
    tag = unused(df, "_f")
    heavy = heavy_keys(df, [partition]) if heavy is COUNTED else heavy
    # the least completion of a redelivered offset counts, and comes first
    late, same, new, reached, at, kind = (f"{tag}{n}" for n in ("late", "same", "new", "reached", "at", "kind"))
    along = [offset, late, done]
    rows = with_previous(df.withColumn(late, F.col(done).isNull()), along, {same: F.struct(F.col(offset).alias("v"))}, [partition], heavy)
    rows = rows.withColumn(new, F.col(same).isNull() | ~F.col(same)["v"].eqNullSafe(F.col(offset))).drop(same)
    first = lambda c: F.when(F.col(new), c)
    folds = {"n": ("count", first(F.lit(1))), "ready": ("max", first(F.col(done))), "open": ("max", first(F.col(late).cast("int"))), "least": ("min", F.col(offset))}
    rows = running(rows, along, {f"{tag}{n}": fold for n, fold in folds.items()}, [partition], heavy=heavy)
    # a gap, or an offset that never completes, ends the run
    run = F.col(new) & (F.col(offset) - F.col(f"{tag}least") + 1 == F.col(f"{tag}n")) & (F.col(f"{tag}open") == 0)
    # a row gives the time its offset becomes committable (kind 0) and its own completion (kind 1), and stays in its partition for that
    kinds = F.array_compact(F.array(F.when(run, 0), F.when(~F.col(late), 1)))
    both = rows.withColumn(kind, F.explode(kinds)).withColumns({at: F.when(F.col(kind) == 0, F.col(f"{tag}ready")).otherwise(F.col(done)), reached: F.when(F.col(kind) == 0, F.col(offset))})
    both = both.select(*(F.col(f"`{c}`") for c in df.columns), at, kind, reached)
    out = running(both, [at, kind], {f"{tag}frontier": ("max", F.col(reached))}, [partition], heavy=heavy)
    return out.where(F.col(kind) == 1).select(*(F.col(f"`{c}`") for c in df.columns), (F.col(f"{tag}frontier") + 1).alias(name))


def commits(df: DataFrame, partition: str, offset: str, done: str, size: int, within: int) -> DataFrame:
    """What a consumer commits that acknowledges in batches, closed at `size` completions or `within` after a batch's first: partition, batch, committed_at
    (the last completion in it) and the offset, for batches after which it has moved."""
    number, moved, heavy = unused(df, "_batch"), unused(df, "_moved"), heavy_keys(df, [partition])
    # offsets that never complete hold the frontier back, so it comes first
    front = group_within(commit_frontier(df, partition, offset, done, moved, heavy), [partition], done, size, within, number)
    ends = front.groupBy(F.col(partition).alias("partition"), F.col(number).alias("batch")).agg(F.max(done).alias("committed_at"), F.max(moved).alias("committed"))
    before = with_previous(ends, "batch", {"before": F.col("committed")}, ["partition"], heavy)
    return before.where("committed is not null and (before is null or committed > before)").drop("before")


def timeout(df: DataFrame, order: str, time: str, most: int) -> DataFrame:
    """The rows before the first gap of more than `most` between two of them."""
    before, fails = unused(df, "_before"), unused(df, "_fails")
    gaps = with_previous(df, order, {before: F.col(time)})
    first = F.broadcast(gaps.where(F.col(time) - F.col(before) > most).agg(F.min(place(order)).alias(fails)))
    return df.join(first, F.col(fails).isNull() | (place(order) < F.col(fails))).select(*df.columns)


def pause_when(df: DataFrame, time: str, signals: DataFrame, signal_time: str, paused: str, name: str = "delivered_at") -> DataFrame:
    """Adds when each row is delivered: at its own time, or, if the latest signal at or before it says `paused`, at the next one that doesn't;
    null if none does. A signal is the start of a pause or its end."""
    changed = signals.select(F.col(signal_time).alias(time), F.col(paused).alias("_paused"))
    ends = running(changed, time, {"_resumes": ("last", F.when(~F.col("_paused"), F.col(time)))}, back=True)
    met = with_latest(df, ends.unionByName(_never(ends, df, time)), time)
    state = F.col("side")
    return met.select("main.*", F.when(F.coalesce(state["_paused"], F.lit(False)), state["_resumes"]).otherwise(F.col("main")[time]).alias(name))


def _never(signals: DataFrame, df: DataFrame, time: str) -> DataFrame:
    """A first signal, at the least time of the rows, that pauses nothing, where none is as early."""
    first = df.agg(F.min(time).alias(time)).where(F.col(time).isNotNull())
    early = F.broadcast(signals.agg(F.min(time).alias("_early")))
    return first.join(early, F.col("_early").isNull() | (F.col("_early") > F.col(time))).select(time, F.lit(False).alias("_paused"), F.lit(None).cast(signals.schema["_resumes"].dataType).alias("_resumes"))
