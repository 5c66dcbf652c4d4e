"""Failures as values, and failures of actions."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

T = TypeVar("T")


def either(df: DataFrame, name: str, value: Column, failed: dict[str, Column]) -> DataFrame:
    """Adds struct(ok, value, error): the first of `failed` (message: condition) that holds makes a row a failure."""
    error = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.lit(m)) for m, c in failed.items()))
    return df.withColumn(name, F.struct(error.isNull().alias("ok"), F.when(error.isNull(), value).alias("value"), error.alias("error")))


def rethrow(df: DataFrame, name: str) -> DataFrame:
    """The value in place of the struct; the query fails at a row that isn't ok."""
    e = F.col(name)
    return df.withColumn(name, F.when(e["ok"], e["value"]).otherwise(F.raise_error(e["error"]).cast(df.schema[name].dataType["value"].dataType)))


def map_error(df: DataFrame, name: str, f: Callable[[Column], Column]) -> DataFrame:
    """The struct with f of its error, where it has one."""
    e = F.col(name)
    return df.withColumn(name, e.withField("error", F.when(e["error"].isNotNull(), f(e["error"]))))


def recover(df: DataFrame, name: str, value: Callable[[Column], Column]) -> DataFrame:
    """The value in place of the struct, of a failed row what value(error) gives."""
    e = F.col(name)
    return df.withColumn(name, F.when(e["ok"], e["value"]).otherwise(value(e["error"])))


def failures(df: DataFrame, name: str) -> DataFrame:
    """Failed rows with their error in place of the struct."""
    return df.where(~F.col(name)["ok"]).withColumn(name, F.col(name)["error"])


def or_else_rows(df: DataFrame, name: str, order: str, fallback: DataFrame, failed: str | None = None) -> DataFrame:
    """Rows up to the first that failed, with their values, then all of `fallback` (of these columns), none if no row failed. With
    `failed`, only an error that begins so is answered; another one fails the query. Rows are marked by _src, 0 and 1."""
    first = df.where(~F.col(name)["ok"]).agg(F.min_by(F.struct(F.col(order).alias("at"), F.col(name)["error"].alias("error")), order).alias("_fails"))
    if failed is not None:
        other = ~F.col("_fails.error").startswith(failed)
        first = first.where(F.when(other, F.raise_error(F.col("_fails.error")).isNull()).otherwise(F.lit(True)))
    first = F.broadcast(first)  # one row
    before = df.join(first, F.col("_fails").isNull() | (F.col(order) < F.col("_fails.at"))).select(*(F.col(name)["value"].alias(name) if c == name else F.col(c) for c in df.columns))
    after = fallback.join(first, F.col("_fails").isNotNull()).select(*(F.col(c) for c in df.columns))
    return before.withColumn("_src", F.lit(0)).unionByName(after.withColumn("_src", F.lit(1)))


def condition_of(error: BaseException) -> str:
    """Spark's error class, or the exception's type."""
    return (error.getCondition() or type(error).__name__) if isinstance(error, PySparkException) else type(error).__name__


def catch(action: Callable[[], T], handlers: dict[str, Callable[[BaseException], T]]) -> T:
    """Runs an action; a failure whose condition begins with a handler's name goes to it ("" takes all)."""
    try:
        return action()
    except Exception as error:
        for name, handle in handlers.items():
            if condition_of(error).startswith(name):
                return handle(error)
        raise


def or_else(action: Callable[[], T], fallback: Callable[[], T]) -> T:
    return catch(action, {"": lambda _: fallback()})


def finalised(action: Callable[[], T], release: Callable[[], Any]) -> T:
    try:
        return action()
    finally:
        release()


def bracket(acquire: Callable[[], Any], use: Callable[[Any], T], release: Callable[[Any], Any]) -> T:
    resource = acquire()
    return finalised(lambda: use(resource), lambda: release(resource))


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """df with metrics that its next action fills in, without another pass."""
    seen = Observation(name)
    return df.observe(seen, *(c.alias(n) for n, c in metrics.items())), seen
