"""Running values over a whole ordered table without sending it through one task.

Rows are cut into ranges of the order by quantiles. A window runs inside each range; the totals of the ranges, one row
each, are prefixed and joined back by broadcast: their number is the number of ranges, whatever the data.
With a `partition`, only heavy keys are cut so: those with more than their share of HEAVY / ranges of all rows, of which there are at
most ranges / HEAVY.

`order` is one column or several, of any type that can be sorted, nulls first; tied rows follow one another in any order, but never
fall into two ranges. An empty table, one row, orders without a value and a single range are all served alike, and no name of
a column clashes.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

HEAVY = 8


def listed(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def range_key(df: DataFrame, order: str) -> Column:
    """What rows are cut by: a double that never decreases along the column (exact for numbers, by seconds for timestamps without zone), bytes for texts;
    of a struct its first field, of an array its first element."""
    kind, c = df.schema[order].dataType, F.col(f"`{order}`")
    while isinstance(kind, (StructType, ArrayType)):
        if isinstance(kind, StructType):
            if not kind.fields:
                return F.lit(0.0)
            kind, c = kind.fields[0].dataType, c[kind.fields[0].name]
        else:
            kind, c = kind.elementType, F.get(c, F.lit(0))
    match kind.typeName():
        case "string":
            return F.encode(c, "UTF-8")
        case "binary":
            return c
        case "timestamp":
            c = F.unix_micros(c)
        case "timestamp_ntz":
            c = F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)
        case "date":
            c = F.unix_date(c)
    return F.nanvl(c.cast("double"), F.lit(float("inf")))


def unused(df: DataFrame, name: str) -> str:
    """The name, with as many strokes as no column of df begins with it."""
    while any(c.lower().startswith(name) for c in df.columns):
        name += "_"
    return name


def _search(cuts: Sequence[str], key: str) -> str:
    """SQL for the number of cuts (as literals) that are at most the key, by bisection; nulls are before all."""

    def part(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {key} < {cuts[middle]} THEN {part(low, middle)} ELSE {part(middle + 1, high)} END"

    return f"CASE WHEN {key} IS NULL THEN 0 ELSE {part(0, len(cuts))} END"


#: Sampled values of texts for each range.
SAMPLES = 32


def _text_cuts(df: DataFrame, key: str, n: int) -> list[bytes]:
    """Quantiles of bytes: values fall into SAMPLES * n buckets by a hash, of each of which one value, whichever has the least other hash, stands for all of its rows."""
    bucket = F.pmod(F.xxhash64(key), F.lit(SAMPLES * n))
    found = df.where(F.col(key).isNotNull()).groupBy(bucket.alias("b")).agg(F.min_by(key, F.xxhash64(F.lit(7), key)).alias("v"), F.count(F.lit(1)).alias("n"))
    rows = sorted((bytes(r["v"]), r["n"]) for r in found.collect())
    share, so_far, cuts = sum(c for _, c in rows) / n, 0, []
    for v, c in rows:
        if so_far >= share * (len(cuts) + 1):
            cuts.append(v)
        so_far += c
    return cuts


#: Cuts of the latest columns, by the column's identity in its plan and the number of ranges. A column keeps that through filters and added columns, so calls on
#: one source search for cuts once; any cuts give right results, only the ranges' sizes follow from them.
_known_cuts: OrderedDict[tuple, list[str]] = OrderedDict()
MOST_KNOWN = 64


def _identity(df: DataFrame, order: str, n: int) -> tuple:
    output = df._jdf.queryExecution().analyzed().output()
    found = [output.apply(i) for i in range(output.size())]
    return (df.sparkSession.sparkContext.applicationId, next(a.exprId().toString() for a in found if a.name().lower() == order.lower()), n)


def _cuts(df: DataFrame, order: str, key: str, n: int) -> list[str]:
    if dict(df.dtypes)[key] == "binary":
        return [f"X'{v.hex()}'" for v in sorted(set(_text_cuts(df.select(key), key, n)))]
    found = sorted(set(df.approxQuantile(key, [i / n for i in range(1, n)], 0.5 / n)))
    return [f"{c!r}D" for c in found if abs(c) != float("inf")]


def ranged(df: DataFrame, order: str, name: str, ranges: int | None = None, among: Column | None = None, like: tuple[DataFrame, str] | None = None) -> DataFrame:
    """Adds `name`, the number of a row's range, which never decreases along the order; runs a job. With `among`, other rows have range 0. Cuts may be those of a
    column that is distributed `like` the order, of a frame that is cheaper to make; it has the order's type."""
    n, key = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"{name}key"
    keyed = df.withColumn(key, range_key(df, order))
    if n < 2:
        cuts = []
    elif among is not None:
        cuts = _cuts(keyed.where(among), order, key, n)
    else:
        source, column = like or (df, order)
        place = _identity(source, column, n)
        cuts = _known_cuts.pop(place, None)
        _known_cuts[place] = cuts = _cuts(source.withColumn(key, range_key(source, column)), column, key, n) if cuts is None else cuts
        while len(_known_cuts) > MOST_KNOWN:
            _known_cuts.popitem(last=False)
    found = F.expr(_search(cuts, f"`{key}`"))
    return keyed.withColumn(name, found if among is None else F.when(among, found).otherwise(0)).drop(key)


@dataclass(frozen=True)
class Fold:
    """An associative fold: over a window, over a range, and of two neighbours."""

    inside: Callable[[Column], Column]
    total: Callable[[Column, Callable[[Column], Column], Callable[[Column], Column]], Column]
    join: Callable[[Column, Column], Column]


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


#: total(v, latest, earliest): the last two pick the value of the last and of the first row that has one.
FOLDS = {
    "sum": Fold(F.sum, lambda v, *_: F.sum(v), lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(_zero(a) + _zero(b))),
    "count": Fold(F.count, lambda v, *_: F.count(v), lambda a, b: _zero(a) + _zero(b)),
    "min": Fold(F.min, lambda v, *_: F.min(v), F.least),
    "max": Fold(F.max, lambda v, *_: F.max(v), F.greatest),
    "last": Fold(lambda v: F.last(v, ignorenulls=True), lambda v, latest, _: latest(v), lambda a, b: F.coalesce(b, a)),
    "first": Fold(lambda v: F.first(v, ignorenulls=True), lambda v, _, earliest: earliest(v), lambda a, b: F.coalesce(a, b)),
}


#: Heavy keys are to be counted.
COUNTED = object()


def heavy_keys(df: DataFrame, keys: Sequence[str], ranges: int | None = None) -> DataFrame | None:
    """Keys with more than HEAVY / ranges of all rows, ranges / HEAVY of them at most; None if there is none. Runs a job."""
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    found = n.join(F.broadcast(total), F.col("n") * ranges > F.col("total") * HEAVY).select(*keys).collect() if ranges > HEAVY else []
    return df.sparkSession.createDataFrame(found, df.select(*keys).schema) if found else None


def running(
    df: DataFrame, order: str | Sequence[str], outputs: dict[str, tuple[str, Column]], partition: Sequence[str] = (), inclusive: bool = True, ranges: int | None = None, back: bool | Collection[str] = False, heavy: Any = COUNTED, like: tuple[DataFrame, str] | None = None
) -> DataFrame:
    """Adds for each name the fold (a key of FOLDS) of a column over all rows up to this one, or before it; with `back`, from the end, or those outputs that it names.

    `heavy` is what heavy_keys() gave for a frame with as many rows of each key or more, so that df isn't made once more to count its keys; any keys give right results.
    `like` is as in ranged(), for rows without keys."""
    order, end = listed(order), 0 if inclusive else -1
    backward = [back if isinstance(back, bool) else o in back for o in outputs]

    def window(down: bool, *parts: str) -> Window:
        return Window.partitionBy(*parts).orderBy(*(F.col(f"`{o}`").desc() if down else F.col(f"`{o}`").asc() for o in order)).rowsBetween(Window.unboundedPreceding, end)

    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = None if not partition else heavy_keys(df, partition, n) if heavy is COUNTED else heavy
    if partition and heavy is None:
        return df.withColumns({o: _none_is_zero(k, FOLDS[k].inside(v).over(window(down, *(f"`{p}`" for p in partition)))) for (o, (k, v)), down in zip(outputs.items(), backward, strict=True)})
    tag = unused(df, "_run_")
    keys, rows = [], df
    if heavy is not None:
        keys = [f"{tag}k{i}" for i in range(len(partition))]
        heavy = heavy.toDF(*keys).withColumn(f"{tag}heavy", F.lit(True))
        same = [F.col(f"`{c}`").eqNullSafe(F.col(k)) for c, k in zip(partition, keys, strict=True)]
        rows = df.join(F.broadcast(heavy), same, "left")  # its size is bounded
    at = f"{tag}range"
    cut = ranged(rows, order[0], at, n, F.col(f"{tag}heavy").isNotNull() if keys else None, like)
    cut = cut.withColumns({f"{tag}v{i}": v for i, (_, v) in enumerate(outputs.values())})
    kinds = [k for k, _ in outputs.values()]

    place = F.struct(*(F.col(f"`{o}`") for o in order))
    pick = {late: (lambda v, f=F.max_by if late else F.min_by: f(v, F.when(v.isNotNull(), place))) for late in (True, False)}
    totals = cut.where(F.col(f"{tag}heavy").isNotNull()) if keys else cut
    totals = totals.groupBy(at, *keys).agg(*(FOLDS[k].total(F.col(f"{tag}v{i}"), pick[not down], pick[down]).alias(f"{tag}t{i}") for i, (k, down) in enumerate(zip(kinds, backward, strict=True))))
    before = {down: Window.partitionBy(*keys).orderBy(F.col(at).desc() if down else F.col(at)).rowsBetween(Window.unboundedPreceding, -1) for down in (True, False)}
    prefix = [(F.sum if k == "count" else FOLDS[k].inside)(F.col(f"{tag}t{i}")).over(before[down]).alias(f"{tag}p{i}") for i, (k, down) in enumerate(zip(kinds, backward, strict=True))]
    totals = totals.select(F.col(at).alias(f"{tag}r"), *(F.col(k).alias(f"{k}r") for k in keys), *prefix)

    parts = (*(f"`{p}`" for p in partition), at)
    inside = cut.withColumns({f"{tag}i{i}": FOLDS[k].inside(F.col(f"{tag}v{i}")).over(window(down, *parts)) for i, (k, down) in enumerate(zip(kinds, backward, strict=True))})
    # a row for each range, and of heavy keys for each range of each
    on = [F.col(at) == F.col(f"{tag}r"), *(F.col(f"`{c}`").eqNullSafe(F.col(f"{k}r")) & F.col(k).eqNullSafe(F.col(f"{k}r")) for c, k in zip(partition, keys, strict=False))]
    if keys:
        on.append(F.col(f"{tag}heavy").isNotNull())
    joined = inside.join(totals if keys else F.broadcast(totals), on, "left")
    made = {o: _none_is_zero(k, FOLDS[k].join(F.col(f"{tag}p{i}"), F.col(f"{tag}i{i}"))) for i, (o, (k, _)) in enumerate(outputs.items())}
    return joined.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *(c.alias(o) for o, c in made.items()))


def _none_is_zero(kind: str, c: Column) -> Column:
    return _zero(c) if kind == "count" else c


def with_index(df: DataFrame, order: str | Sequence[str], name: str = "index", partition: Sequence[str] = (), heavy: Any = COUNTED) -> DataFrame:
    """Adds the 0-based position."""
    return running(df, order, {name: ("count", F.lit(1))}, partition, inclusive=False, heavy=heavy).withColumn(name, F.col(name).cast("bigint"))


def with_neighbours(df: DataFrame, order: str | Sequence[str], before: dict[str, Column], after: dict[str, Column], partition: Sequence[str] = (), heavy: Any = COUNTED) -> DataFrame:
    """Adds for each name in `before` the column's value in the row before, null in the first row, and in `after` in the row after: one exchange for both."""
    outputs = {n: ("last", F.struct(c.alias("v"))) for n, c in {**before, **after}.items()}
    return running(df, order, outputs, partition, inclusive=False, back=frozenset(after), heavy=heavy).withColumns({n: F.col(n)["v"] for n in outputs})


def with_previous(df: DataFrame, order: str | Sequence[str], columns: dict[str, Column], partition: Sequence[str] = (), heavy: Any = COUNTED) -> DataFrame:
    """Adds for each name the column's value in the row before, null in the first row."""
    return with_neighbours(df, order, columns, {}, partition, heavy)


def with_next(df: DataFrame, order: str | Sequence[str], columns: dict[str, Column], partition: Sequence[str] = ()) -> DataFrame:
    """Adds for each name the column's value in the row after, null in the last row."""
    return with_neighbours(df, order, {}, columns, partition)
