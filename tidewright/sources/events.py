"""Sources of topologies: rows with the columns _topic, _partition, _seq (ordinal in the partition), _event_time_us."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.windows import micros

SEQ, PARTITION, TOPIC, TIME = "_seq", "_partition", "_topic", "_event_time_us"


def normalised(df: DataFrame, seq: str, time: Column | None = None, partition: Column | None = None, topic: str = "") -> DataFrame:
    """`time` is a column of epoch microseconds; without one, implicit_time() is used."""
    return df.withColumns({
        SEQ: F.col(seq).cast("bigint"),
        PARTITION: (partition if partition is not None else F.lit(0)).cast("int"),
        TOPIC: F.lit(topic),
        TIME: (time if time is not None else implicit_time(df)).cast("bigint"),
    })


def implicit_time(df: DataFrame) -> Column:
    """The first of ts, timestamp, eventTime that is a number (epoch ms) or a timestamp; else createdAt (ISO text); else now."""
    found = []
    for name, kind in df.dtypes:
        if name in ("ts", "timestamp", "eventTime") and kind.startswith("timestamp"):
            found.append((("ts", "timestamp", "eventTime").index(name), micros(F.col(name))))
        elif name in ("ts", "timestamp", "eventTime") and kind in ("int", "bigint", "float", "double"):
            found.append((("ts", "timestamp", "eventTime").index(name), (F.col(name) * 1000).cast("bigint")))
    columns = [c for _, c in sorted(found, key=lambda x: x[0])]
    if "createdAt" in df.columns:
        columns.append(F.unix_micros(F.try_to_timestamp("createdAt")))
    return F.coalesce(*columns, F.unix_micros(F.current_timestamp()))


def start_at(df: DataFrame, offset: str | int, seq: str = SEQ, time: str = TIME) -> DataFrame:
    """earliest, latest, an ordinal, or "timestamp:<ms>"."""
    if offset == "earliest":
        return df
    if offset == "latest":
        return df.limit(0)
    if isinstance(offset, str) and offset.startswith("timestamp:"):
        return df.where(F.col(time) >= int(offset.partition(":")[2]) * 1000)
    return df.where(F.col(seq) >= int(offset))


def partitions(df: DataFrame, wanted: list[int]) -> DataFrame:
    return df.where(F.col(PARTITION).isin(wanted))


def once(df: DataFrame) -> DataFrame:
    """Drops redelivered records; those without an ordinal are never taken for copies."""
    return df.where(F.col(SEQ).isNotNull()).dropDuplicates([TOPIC, PARTITION, SEQ]).unionByName(df.where(F.col(SEQ).isNull()))


def kafka(spark: SparkSession, servers: str, topic: str, schema: str, streaming: bool = True, starting: str = "latest", **options: str) -> DataFrame:
    """JSON values of a topic with their metadata. Needs Spark's Kafka connector on the class path."""
    reader = (spark.readStream if streaming else spark.read).format("kafka").options(**options).option("kafka.bootstrap.servers", servers)
    how = starting.partition(":")
    reader = reader.option("startingTimestamp", how[2]) if how[0] == "timestamp" else reader.option("startingOffsets", starting)
    return from_kafka(reader.option("subscribe", topic).load(), schema)


def from_kafka(records: DataFrame, schema: str) -> DataFrame:
    value = F.from_json(F.col("value").cast("string"), schema)
    return records.select(value.alias("v"), F.col("topic").alias(TOPIC), F.col("partition").alias(PARTITION), F.col("offset").cast("bigint").alias(SEQ), F.col("key").cast("string").alias("_record_key"), F.unix_micros("timestamp").alias(TIME)).select("v.*", TOPIC, PARTITION, SEQ, "_record_key", TIME)
