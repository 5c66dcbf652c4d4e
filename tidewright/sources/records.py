"""Literal and generated sources."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import islice
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def of(spark: SparkSession, *values: Any, schema: str = "value bigint") -> DataFrame:
    """Literal rows with their position in _seq."""
    return from_iterable(spark, values, schema)


def from_iterable(spark: SparkSession, values: Iterable[Any], schema: str) -> DataFrame:
    """A finite iterable at the driver, with positions in _seq."""
    rows = [(i, *v) if isinstance(v, (tuple, list)) else (i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"_seq bigint, {schema}")


def from_call(spark: SparkSession, f: Callable[[], Any], schema: str) -> DataFrame:
    """One row that a call at the driver produces."""
    return from_iterable(spark, [f()], schema)


def fail(spark: SparkSession, message: str, schema: str) -> DataFrame:
    """A source that fails as soon as it is read."""
    return spark.range(1).where(F.raise_error(F.lit(message)).isNotNull()).select(*(F.lit(None).cast(x.dataType).alias(x.name) for x in empty(spark, schema).schema))


def suspend(make: Callable[[], DataFrame]) -> Callable[[], DataFrame]:
    """Plans are lazy already; a factory gives a fresh one for each run."""
    return make


def number_range(spark: SparkSession, start: float, end: float, step: float = 1) -> DataFrame:
    """start, start + step, ... before end; steps may be fractional or negative: _seq, value."""
    if step == 0:
        raise ValueError("the step is 0")
    n = max(0, -int(-(end - start) // step)) if (end - start) / step > 0 else 0
    value = F.col("id") * F.lit(step) + F.lit(start)
    return spark.range(n).select(F.col("id").alias("_seq"), value.alias("value"))


def unfold(spark: SparkSession, seed: Any, step: Callable[[Any], tuple[Any, Any] | None], schema: str, most: int | None = None) -> DataFrame:
    """step(state) -> (value, next state) or None. Runs on one executor, as each state needs the one before."""

    def rows(_: Iterator) -> Iterator:
        import pandas as pd

        def values() -> Iterator:
            state, n = seed, 0
            while (most is None or n < most) and (out := step(state)) is not None:
                value, state = out
                yield (n, *value) if isinstance(value, tuple) else (n, value)
                n += 1

        made = values()
        while batch := list(islice(made, 4096)):
            yield pd.DataFrame(batch, columns=names)

    names = ["_seq", *empty(spark, schema).columns]
    return spark.range(1, numPartitions=1).mapInPandas(rows, f"_seq bigint, {schema}")


def iterate(spark: SparkSession, seed: Any, f: Callable[[Any], Any], schema: str, most: int) -> DataFrame:
    """seed, f(seed), f(f(seed)), ...: `most` rows."""
    return unfold(spark, seed, lambda s: (s, f(s)), schema, most)


def repeat_value(spark: SparkSession, value: Any, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("_seq"), F.lit(value).alias("value"))


def ticks(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """A streaming source of (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
