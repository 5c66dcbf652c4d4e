"""Terminals as values: what a DataFrame is run for, with their inputs and results mapped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from . import ordered


@dataclass(frozen=True)
class Terminal:
    run: Callable[[DataFrame], Any]

    def contramap(self, f: Callable[[DataFrame], DataFrame]) -> Terminal:
        return Terminal(lambda df: self.run(f(df)))

    def map(self, f: Callable[[Any], Any]) -> Terminal:
        return Terminal(lambda df: f(self.run(df)))

    def flat_map(self, f: Callable[[Any], Terminal]) -> Terminal:
        return Terminal(lambda df: f(self.run(df)).run(df))


def collect_all() -> Terminal:
    return Terminal(lambda df: df.collect())


def collect_n(n: int, order: str) -> Terminal:
    return Terminal(lambda df: ordered.take(df, n, order).collect())


def head(order: str) -> Terminal:
    return Terminal(lambda df: ordered.head(df, order).first())


def last(order: str) -> Terminal:
    return Terminal(lambda df: ordered.last(df, order).first())


def count() -> Terminal:
    return Terminal(lambda df: df.count())


def drain() -> Terminal:
    return Terminal(lambda df: df.write.format("noop").mode("overwrite").save())


def aggregate(*columns: Column) -> Terminal:
    return Terminal(lambda df: df.agg(*columns).first())


def fold(order: str, init: Column, step: Callable[[Column, Column], Column], value: Column) -> Terminal:
    def run(df: DataFrame) -> Any:
        row = ordered.fold(df, order, init, step, value).first()
        return row["result"] if row else None

    return Terminal(run)


def for_each_while(f: Callable[[Row], bool], order: str) -> Terminal:
    """Rows in order, one partition at a time, until f says no; the number of rows seen."""

    def run(df: DataFrame) -> int:
        n = 0
        for row in df.orderBy(order).toLocalIterator():
            n += 1
            if not f(row):
                break
        return n

    return Terminal(run)


def for_each(f: Callable[[Row], Any], order: str) -> Terminal:
    return for_each_while(lambda row: (f(row), True)[1], order)


def counters(df: DataFrame, labels: list[str], value: Column) -> DataFrame:
    return df.groupBy(*labels).agg(F.sum(value).alias("value"))


def gauges(df: DataFrame, labels: list[str], value: str, order: str) -> DataFrame:
    """The latest value of each label set."""
    return df.groupBy(*labels).agg(F.max_by(value, order).alias("value"))


def json_equal(a: Column, b: Column) -> Column:
    return F.to_json(a).eqNullSafe(F.to_json(b))


def shown(a: Column, most: int = 200) -> Column:
    return F.substring(F.to_json(a), 1, most)
