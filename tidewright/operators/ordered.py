"""Operators whose result depends on the order of rows. `order` is a column with distinct values: files have no arrival
order, so a source must declare its ordinal. Rows without one come first, everywhere. No name of a column clashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import LOOKUP_ROWS, small
from .spread import running, unused, with_index, with_neighbours, with_next, with_previous


def place(order: str) -> Column:
    """A row's order as a struct, which min_by, max_by and comparisons don't skip where the order is null: nulls come first."""
    return F.struct(F.col(f"`{order}`").alias("o"))


def truthy(p: Column) -> Column:
    """A predicate's value with null as false."""
    return F.coalesce(p, F.lit(False))


def keep(df: DataFrame, p: Column) -> DataFrame:
    return df.where(truthy(p))


def drop_where(df: DataFrame, p: Column) -> DataFrame:
    return df.where(~truthy(p))


def filter_map(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value).where(F.col(name).isNotNull())


def take(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(max(0, n))


def drop(df: DataFrame, n: int, order: str) -> DataFrame:
    """All but the first n, any n of rows that tie there; nulls come first. The n-th row's order is a bound, so the rest is a filter,
    except for rows that tie with it, of which positions tell."""
    if n <= 0:
        return df
    bound, count, go, tie = (unused(df, x) for x in ("_bound", "_count", "_go", "_tie"))
    first = df.select(place(order).alias("o")).orderBy("o").limit(n)
    last = first.agg(F.max("o").alias(bound), F.count(F.lit(1)).alias(count))
    rest = df.join(F.broadcast(last), F.col(count) == n)
    after = rest.where(place(order) > F.col(bound)).select(*df.columns)
    # of the tied rows, as many go as the first n have
    same = first.join(F.broadcast(last), F.col("o") == F.col(bound)).agg(F.count(F.lit(1)).alias(go))
    tied = with_index(rest.where(place(order) == F.col(bound)).select(*df.columns), order, tie).join(F.broadcast(same), F.col(tie) >= F.col(go))
    return after.unionByName(tied.select(*df.columns))


def _first_failing(df: DataFrame, p: Column, order: str, name: str) -> DataFrame:
    return F.broadcast(df.where(~truthy(p)).agg(F.min(place(order)).alias(name)))


def take_while(df: DataFrame, p: Column, order: str) -> DataFrame:
    """The prefix before the first row that fails: one aggregate, then a filter."""
    fails = unused(df, "_fails")
    return df.join(_first_failing(df, p, order, fails), F.col(fails).isNull() | (place(order) < F.col(fails))).select(*df.columns)


def drop_while(df: DataFrame, p: Column, order: str) -> DataFrame:
    fails = unused(df, "_fails")
    return df.join(_first_failing(df, p, order, fails), place(order) >= F.col(fails)).select(*df.columns)


def take_until(df: DataFrame, time: str, signal: DataFrame, signal_time: str) -> DataFrame:
    """Rows before the first signal; an empty signal has no effect."""
    name = unused(df, "_signal")
    first = F.broadcast(signal.agg(F.min(signal_time).alias(name)))
    return df.join(first, F.col(name).isNull() | (F.col(time) < F.col(name))).select(*df.columns)


def interrupt_after(df: DataFrame, time: str, ms: float) -> DataFrame:
    """Rows less than ms after the first."""
    name = unused(df, "_first")
    first = F.broadcast(df.agg(F.min(time).alias(name)))
    return df.join(first, F.unix_micros(time) < F.unix_micros(name) + int(ms * 1000)).select(*df.columns)


def head(df: DataFrame, order: str) -> DataFrame:
    return df.groupBy().agg(F.min_by(F.struct(*df.columns), place(order)).alias("r")).where("r is not null").select("r.*")


def last(df: DataFrame, order: str) -> DataFrame:
    return df.groupBy().agg(F.max_by(F.struct(*df.columns), place(order)).alias("r")).where("r is not null").select("r.*")


def collect_first(df: DataFrame, p: Column, order: str) -> DataFrame:
    return head(keep(df, p), order)


def zip_with_index(df: DataFrame, order: str, name: str = "index") -> DataFrame:
    return with_index(df, order, name)


def zip_with_previous(df: DataFrame, order: str, column: str, name: str = "previous", partition: Sequence[str] = ()) -> DataFrame:
    return with_previous(df, order, {name: F.col(column)}, partition)


def zip_with_next(df: DataFrame, order: str, column: str, name: str = "next", partition: Sequence[str] = ()) -> DataFrame:
    return with_next(df, order, {name: F.col(column)}, partition)


def zip_with_neighbours(df: DataFrame, order: str, column: str, previous: str = "previous", next: str = "next", partition: Sequence[str] = ()) -> DataFrame:  # noqa: A002
    """Both neighbours' values, by one exchange."""
    return with_neighbours(df, order, {previous: F.col(column)}, {next: F.col(column)}, partition)


def changes(df: DataFrame, order: str, column: str, partition: Sequence[str] = ()) -> DataFrame:
    """Drops rows equal to their predecessor."""
    name = unused(df, "_before")
    before = running(df, order, {name: ("last", F.struct(F.col(column).alias("v")))}, partition, inclusive=False)
    return before.where(F.col(name).isNull() | ~F.col(column).eqNullSafe(F.col(name)["v"])).select(*df.columns)


def scan(df: DataFrame, order: str, kind: str, value: Column, seed: Any, name: str = "state") -> DataFrame:
    """Running fold that emits its seed first: position -1 is the seed, n + 1 rows in all."""
    folded = map_accumulate(with_index(df, order, "position"), order, kind, value, seed, name).select("position", name)
    return folded.unionByName(df.sparkSession.range(1).select(F.lit(-1).cast("bigint").alias("position"), F.lit(seed).cast(dict(folded.dtypes)[name]).alias(name)))


def map_accumulate(df: DataFrame, order: str, kind: str, value: Column, seed: Any = None, name: str = "state", partition: Sequence[str] = ()) -> DataFrame:
    """Running fold of an associative kind (see spread.FOLDS) from a seed."""
    out = running(df, order, {name: (kind, value)}, partition)
    if seed is None:
        return out
    with_seed = {"sum": lambda c: F.coalesce(c, F.lit(0)) + seed, "count": lambda c: c + seed, "min": lambda c: F.least(c, F.lit(seed)), "max": lambda c: F.greatest(c, F.lit(seed))}
    return out.withColumn(name, with_seed[kind](F.col(name)))


def fold(df: DataFrame, order: str, init: Column, step: Callable[[Column, Column], Column], value: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Ordered left fold of each key by Catalyst's aggregate(); a key's values meet in one row, so keys must be bounded."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v"))))
    return df.groupBy(*keys).agg(F.aggregate(rows, init, lambda a, x: step(a, x["v"])).alias("result"))


def grouped(df: DataFrame, n: int, order: str, column: str) -> DataFrame:
    """Consecutive batches of n, the last one shorter: batch, items."""
    if n < 1:
        raise ValueError("a batch has one row or more")
    i = unused(df, "_i")
    at = with_index(df, order, i).select(F.floor(F.col(i) / n).cast("bigint").alias("batch"), F.col(i).alias("_i"), F.col(column).alias("v"))
    return at.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("_i", "v"))).alias("s")).select("batch", F.col("s")["v"].alias("items"))


def count_sliding(df: DataFrame, size: int, order: str, column: str, step: int = 1) -> DataFrame:
    """Full windows of `size` rows every `step` rows: first (position), items. Each row goes to its windows, size / step at most."""
    if size < 1 or step < 1:
        raise ValueError("size and step are one or more")
    i = unused(df, "_i")
    at = with_index(df, order, i).select(F.col(i).alias("_i"), F.col(column).alias("v"))
    low, high = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0)), F.floor(F.col("_i") / step)
    spread = at.where(low <= high).select("_i", "v", F.explode(F.sequence(low, high)).alias("_w"))
    out = spread.groupBy((F.col("_w") * step).cast("bigint").alias("first")).agg(F.array_sort(F.collect_list(F.struct("_i", "v"))).alias("s")).where(F.size("s") == size)
    return out.select("first", F.col("s")["v"].alias("items"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row of each key: a minimum by order, combined before the shuffle."""
    return df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(F.min_by(F.struct(*df.columns), place(order)).alias("r")).select("r.*")


def zip_rows(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Positional pairs as structs left and right, up to the shorter side."""
    i, j = unused(a, "_i"), unused(b, "_j")
    x = with_index(a, order_a, i).select(F.col(i).alias("_i"), F.struct(*a.columns).alias("left"))
    y = with_index(b, order_b, j).select(F.col(j).alias("_j"), F.struct(*b.columns).alias("right"))
    return x.join(y, F.col("_i") == F.col("_j")).select(F.col("_i").alias("index"), "left", "right")


def interleave(a: DataFrame, b: DataFrame, order_a: str, order_b: str, column: str) -> DataFrame:
    """a0, b0, a1, b1, ... while both last: position, column."""
    a, b = (x.select(F.col(o).alias("_order"), F.col(column).alias(column)) for x, o in ((a, order_a), (b, order_b)))
    pairs = zip_rows(a, b, "_order", "_order")
    both = pairs.select("index", F.posexplode(F.array(F.col("left")[column], F.col("right")[column])).alias("_side", column))
    return both.select((F.col("index") * 2 + F.col("_side")).alias("position"), column)


def concat(a: DataFrame, b: DataFrame, order: str) -> DataFrame:
    """All of a, then all of b; the order columns are _src and `order`."""
    return a.withColumn("_src", F.lit(0)).unionByName(b.withColumn("_src", F.lit(1)))


def repeat_n(df: DataFrame, n: int) -> DataFrame:
    """n runs, numbered by _run: a row is exploded in place."""
    return df.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(int(n) - 1)))) if n >= 1 else df.withColumn("_run", F.lit(0)).limit(0)


def flat_map(df: DataFrame, values: Column, name: str, position: str = "pos") -> DataFrame:
    return df.select("*", F.posexplode(values).alias(position, name))


def value_counts(df: DataFrame, keys: Sequence[str], values: Column, name: str, count: str = "n") -> DataFrame:
    """How often each value is in a key's arrays: keys, value, count. A row's values are sorted and counted in place, so only rows whose keys come again meet by an exchange, of rows before their
    values are told apart. Runs a job over the keys."""
    s, e = unused(df, "_sorted"), unused(df, "_ends")
    rows = df.select(*keys, values.alias(s))
    again = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(f"{s}n")).where(F.col(f"{s}n") > 1).select(*(F.col(k).alias(f"{s}{i}") for i, k in enumerate(keys)))

    def counted(part: DataFrame) -> DataFrame:
        # each step is a column of its own, as what a lambda contains is worked out for each element
        in_order = part.select(*keys, F.sort_array(s).alias(s)).where(F.size(s) > 0)
        last = lambda i: (i == F.size(s)) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1))
        ends = in_order.select(*keys, s, F.filter(F.sequence(F.lit(1), F.size(s)), last).alias(e))
        run = F.transform(e, lambda end, i: F.struct(F.get(s, end - 1).alias("v"), (end - F.coalesce(F.get(e, i - 1), F.lit(0))).cast("bigint").alias("n")))
        return flat_map(ends, run, f"{s}v", f"{s}p").select(*keys, F.col(f"{s}v")["v"].alias(name), F.col(f"{s}v")["n"].alias(count))

    if again.isEmpty():
        return counted(rows)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{s}{i}"))
    side = F.broadcast(again) if small(again, LOOKUP_ROWS) else again
    met = counted(rows.join(side, same, "left_semi").repartition(*keys)).groupBy(*keys, name).agg(F.sum(count).alias(count))
    return counted(rows.join(side, same, "left_anti")).unionByName(met)


def switch_map(outer: DataFrame, inner: DataFrame, order: str, outer_time: str, inner_time: str, on: str) -> DataFrame:
    """Inner rows of an outer row, until the next outer row arrives."""
    own, end, key = unused(outer, "_until"), unused(inner, "_until"), unused(inner, "_on")
    until = with_next(outer, order, {own: F.col(outer_time)}).select(F.col(on).alias(key), F.col(own).alias(end))
    return inner.join(until, F.col(on) == F.col(key)).where(F.col(end).isNull() | (F.col(inner_time) < F.col(end))).select(*inner.columns)


def merge_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df)
    return out


def broadcast_through(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every branch sees all rows; their outputs are united."""
    return merge_all(*(branch(df) for branch in branches))


def map_chunks(df: DataFrame, f: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    return df.mapInPandas(f, schema)


def map_async(df: DataFrame, f: Callable[[Any], Any], column: str, name: str, kind: str, concurrency: int = 8) -> DataFrame:
    """f over a column with up to `concurrency` calls at a time in each task; rows keep their order."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(concurrency) as pool:
            for s in batches:
                yield pd.Series(list(pool.map(f, s)), index=s.index)

    return df.withColumn(name, run(F.col(column)))
