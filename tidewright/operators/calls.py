"""Calls of user functions with retries, failures as values, and results in order of completion."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from operator import itemgetter
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from ..functions.schedule import Schedule
from ..session import cut


def attempted(call: Callable[[Any, int], Any], value: Any, schedule: Schedule) -> dict:
    """call(value, attempt from 0), again after each delay of the schedule until it returns or the schedule ends: value, error (name, message), attempts, waited_ms."""
    waited, n = 0.0, 0
    while True:
        try:
            return {"value": call(value, n), "error": None, "attempts": n + 1, "waited_ms": waited}
        except Exception as e:  # noqa: BLE001  whatever the call raises is the row's value
            delay = schedule.step(n, waited)
            n += 1
            if delay is None:
                return {"value": None, "error": {"name": type(e).__name__, "message": str(e)}, "attempts": n, "waited_ms": waited}
            if delay:
                time.sleep(delay / 1000)
            waited += delay


def map_retried(df: DataFrame, call: Callable[[Any, int], Any], column: str, name: str, kind: str, schedule: Schedule | None = None, concurrency: int = 8, ordered: bool = True) -> DataFrame:
    """Adds struct(value, error, attempts, waited_ms) of up to `concurrency` calls at a time in each task; no exception of a call fails the job, nor holds up
    others that wait for their next attempt in a thread of their own. Rows keep their order, or with ordered=False come as their calls are completed within an Arrow batch, which `completed` numbers."""
    from pyspark.sql.pandas.types import to_arrow_type

    if concurrency < 1:
        raise ValueError("a task makes one call at a time or more")
    policy = schedule or Schedule.recurs(0)
    made = _parse_datatype_string(f"struct<value:{kind}, error:struct<name:string,message:string>, attempts:int, waited_ms:double{'' if ordered else ', completed:bigint'}>")
    arrow, at = to_arrow_type(made), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = 0
        with ThreadPoolExecutor(concurrency) as pool:
            for batch in batches:
                # threads take the next value each from one iterator, as a future for each call costs more than a call
                waiting, completed = enumerate(batch.column(at).to_pylist()), []

                def work(waiting: Iterator, completed: list) -> None:
                    for i, v in waiting:
                        completed.append((i, attempted(call, v, policy)))

                for worker in [pool.submit(work, waiting, completed) for _ in range(min(concurrency, len(batch)))]:
                    worker.result()
                if ordered:
                    completed.sort(key=itemgetter(0))
                else:
                    batch = batch.take(pa.array([i for i, _ in completed], pa.int64()))
                results = [r if ordered else r | {"completed": done + n} for n, (_, r) in enumerate(completed)]
                done += len(completed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(results, arrow)], [*batch.schema.names, name])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(name, made)]))


def split_failures(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the value in place of the struct, dead letters: the row as JSON, error, attempts) of map_retried. What the calls gave is written to the
    shared folder first, so that both frames come of one call for each row."""
    df = cut(df, "calls")
    failed = F.col(f"{name}.error").isNotNull()
    row = F.to_json(F.struct(*(f"`{c}`" for c in df.columns if c != name)))
    return df.where(~failed).withColumn(name, F.col(f"{name}.value")), df.where(failed).select(row.alias("value"), F.col(f"{name}.error").alias("error"), F.col(f"{name}.attempts").alias("attempts"))
