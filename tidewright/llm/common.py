"""Helpers that the training-data operators share: shared folders, cut lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import small

#: Most rows that broadcast_if_small sends to every executor.
BROADCAST_ROWS = 20_000

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; in local mode, where that is unset, a temporary one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewright-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    path = f"{shared_dir(spark)}/tidewright-{what}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # the session may be gone by now  # noqa: BLE001, S112
            continue


def cut(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write df to the shared folder and read it back: its lineage ends there, and a lost executor costs nothing."""
    path = new_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewright_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once no later plan reads it."""
    drop_path(df.sparkSession, df._tidewright_path)


def free_dropped(spark: SparkSession) -> None:
    """Collects the driver's garbage: what plans that are over sent to executors, and their shuffle files, stay until then, and a driver with much memory does it seldom."""
    spark.sparkContext._jvm.System.gc()


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint where df is counted to have at most `most` rows, and joins.LOOKUP_BYTES of them; Spark's own choice of join beyond."""
    return F.broadcast(df) if small(df, most) else df


class Recent(dict):
    """What work(key) gave for keys, in two generations: once there are `most`, they become the older ones, which go unless they
    are asked for again before the next time. Workers keep it between tasks."""

    def __init__(self, most: int, work: Callable[[Any], Any]):
        super().__init__()
        self.most, self.work, self.old = most, work, {}
        _memories.append(self)

    def __missing__(self, key: Any) -> Any:
        value = self.old.pop(key, None)
        if value is None:
            value = self.work(key)
        self[key] = value
        return value

    def age(self) -> None:
        """To be called now and then, between texts."""
        if len(self) >= self.most:
            self.old = dict(self)
            super().clear()

    def clear(self) -> None:
        super().clear()
        self.old = {}


_memories: list[Recent] = []


def use(*mine: Recent) -> None:
    """To be called as a task begins: frees what other operators' tasks have left in this worker."""
    left = [m for m in _memories if (m or m.old) and not any(m is x for x in mine)]
    for m in left:
        m.clear()
    if left:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
        if trim:
            trim(0)


#: Bytes of text that are Python objects at a time, and that Arrow batches of texts have.
SLICE_BYTES, BATCH_BYTES = 1 << 20, 2 << 20
_BYTES_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def text_batches(spark: SparkSession) -> None:
    """From now on the session's Arrow batches end at BATCH_BYTES in place of Spark's 64 MB, as a worker holds several; a setting of the user's stays."""
    if spark.conf.get(_BYTES_PER_BATCH) in ("67108864b", "67108864"):
        spark.conf.set(_BYTES_PER_BATCH, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `most` bytes of text each, one row at least."""
    size = np.full(batch.num_rows, 16, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(size), 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, end - at)
        at = end


_SUMS_BLOCK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once, also within lambdas."""
    return F.transform(F.array(value), use)[0]


def running_sums(a: Column) -> Column:
    """Sums of an array up to each element. Appending copies, so it goes in blocks, and their totals likewise."""
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    run = lambda xs: F.aggregate(xs, F.array().cast("array<bigint>"), lambda got, x: F.array_append(got, F.coalesce(last(got), F.lit(0)) + x))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _SUMS_BLOCK).cast("int")), lambda b: run(F.slice(a, b * _SUMS_BLOCK + 1, F.lit(_SUMS_BLOCK))))
    joined = lambda bs: let(run(F.transform(bs, last)), lambda totals: F.flatten(F.transform(bs, lambda b, i: F.transform(b, lambda v: v + F.coalesce(F.get(totals, i - 1), F.lit(0))))))
    return let(blocks, joined)


def packed(columns: dict[str, pa.Array]) -> bytes:
    """Arrays of one length as compressed Arrow."""
    batch, out = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return out.getvalue().to_pybytes()


def unpacked(blob: bytes | pa.Buffer) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def map_rows(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable[..., Iterable[list]]]) -> DataFrame:
    """Slices of the named columns as Python lists, given to the function that start() returns in each task, which returns the output's columns as lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start()
        for batch in (part for whole in batches for part in slices(whole)):
            out = f(*(batch.column(i).to_pylist() for i in range(len(columns))))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    text_batches(df.sparkSession)
    fields = _parse_datatype_string(schema).fields
    names, types = [x.name for x in fields], [to_arrow_type(x.dataType) for x in fields]
    return df.select(*columns).mapInArrow(run, schema)
