"""Sinks of live topologies: a ledger of written batches, idempotent folders, dead letters, keyed and dry sinks."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Write = Callable[[DataFrame, int], None]


class Folder:
    """Small files by name, on any storage that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path
        self._at = lambda *p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((path, *p)))
        self._fs = self._at().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def has(self, *name: str) -> bool:
        return self._fs.exists(self._at(*name))

    def put(self, text: str, *name: str) -> None:
        out = self._fs.create(self._at(*name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def put_new(self, text: str, *name: str) -> bool:
        """Whether the file was not there before."""
        if self.has(*name):
            return False
        try:
            out = self._fs.create(self._at(*name), False)
        except Py4JJavaError:  # another writer was faster
            return False
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def names(self, *folder: str) -> list[str]:
        return [x.getPath().getName() for x in self._fs.listStatus(self._at(*folder))] if self.has(*folder) else []

    def get(self, *name: str) -> str:
        f = self._fs.open(self._at(*name))
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()


class Ledger:
    """Batches that were written, and the plan that a checkpoint belongs to, as small files beside it."""

    def __init__(self, spark: SparkSession, path: str, plan: str):
        self.folder, self.plan = Folder(spark, path), plan

    def claim(self) -> None:
        if not self.folder.has("plan"):
            self.folder.put(self.plan, "plan")
        elif (there := self.folder.get("plan")) != self.plan:
            raise ValueError(f"the checkpoint belongs to another plan: {there}")

    def guarded(self, write: Write) -> Write:
        """write once for each batch, but for a failure between the write and its entry."""

        def f(df: DataFrame, batch: int) -> None:
            if not self.folder.has("batches", str(batch)):
                write(df, batch)
                self.folder.put("", "batches", str(batch))

        return f


def parquet_sink(path: str) -> Write:
    """A folder for each batch, replaced if the batch comes again: idempotent."""

    def f(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return f


def table_sink(path: str, kind: str = "parquet", mode: str = "append", key: str | None = None) -> Write:
    """Appends; with a key, rows of one key go to one file of a batch."""

    def f(df: DataFrame, batch: int) -> None:
        (df.repartition(key) if key else df).write.format(kind).mode(mode).save(path)

    return f


def tee(*writes: Write) -> Write:
    """Several sinks of one batch, which is computed once."""

    def f(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for w in writes:
                w(df, batch)
        finally:
            df.unpersist()

    return f


def to_kafka(df: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows as the Kafka sink takes them: key, JSON value."""
    value = F.to_json(F.struct(*df.columns)).alias("value")
    return df.select(*([key.cast("string").alias("key")] if key is not None else []), value)


def guarded_map(df: DataFrame, columns: dict[str, Column], failed: dict[str, Column]) -> DataFrame:
    """Adds columns, and `_error` struct(name, message): the first of `failed` (message: condition) that holds, else null."""
    error = F.coalesce(*(F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit("TypeError").alias("name"), F.lit(m).alias("message"))) for m, c in failed.items()))
    original = F.to_json(F.struct(*df.columns))
    return df.withColumn("_original", original).withColumns(columns | {"_error": error})


def split_errors(df: DataFrame, topic: str = "_topic", partition: str = "_partition", seq: str = "_seq") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of guarded_map's rows: the original row as JSON, the error, where it came from, when it failed."""
    good = df.where("_error is null").drop("_error", "_original")
    dead = df.where("_error is not null").select(
        F.col("_original").alias("value"), F.col("_error").alias("error"),
        F.struct(F.col(topic).alias("topic"), F.col(partition).alias("partition"), F.col(seq).alias("offset")).alias("source"),
        F.unix_millis(F.current_timestamp()).alias("failed_at"),
    )
    return good, dead


def dead_letter_sink(good: Write, dead: Write) -> Write:
    def f(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            a, b = split_errors(df)
            good(a, batch)
            dead(b, batch)
        finally:
            df.unpersist()

    return f


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()
