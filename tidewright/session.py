"""Session factory with the settings that results depend on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.chunkBase64String.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(app: str = "tidewright", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map=SETTINGS | conf).getOrCreate()


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder's name where the driver and all executors see it: in spark.checkpoint.dir, or in local mode, where that is unset, in a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidewright-")
    return f"{at.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """df written to the shared folder and read back, so that what follows doesn't make it again; as it is if it has types that Parquet lacks. Its columns may have any names."""
    if any(kind in df.schema.simpleString() for kind in ("void", "interval")):
        return df
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    path = shared_folder(df.sparkSession, what)
    plain.write.parquet(path)
    return df.sparkSession.read.schema(plain.schema).parquet(path).toDF(*df.columns)
