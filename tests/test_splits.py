"""Records by ranges and with commits."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewright.sources import splits

TEXTS = ["plain", 'a "quoted" word', "two\nlines", 'ends with "', '"\n"', "", None, ",", "é\r\n𝒳", '""\n""']


@pytest.fixture(scope="module")
def registered(spark):
    splits.register(spark)
    return spark


def rows(n=3000):
    rng = random.Random(4)
    return [(i if i % 7 else None, rng.choice(TEXTS), rng.random()) for i in range(n)]


def plain(df):
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()), key=repr)


def test_csv_round_trip_by_ranges(registered, tmp_path):
    spark, path = registered, str(tmp_path / "csv")
    df = spark.createDataFrame(rows(), "id bigint, text string, x double").repartition(2)
    df.write.format(splits.NAME).option("kind", "csv").option("split", 9000).mode("append").save(path)
    read = spark.read.format(splits.NAME).option("kind", "csv").option("split", 9000).option("names", "id,text,x")
    back = read.schema("id bigint, text string, x double").load(path)
    assert back.rdd.getNumPartitions() > 3 and plain(back) == plain(df)
    assert plain(read.schema("x double, id bigint").load(path)) == plain(df.select("x", "id"))


def test_frames_round_trip_by_ranges(registered, tmp_path):
    spark, path = registered, str(tmp_path / "frames")
    df = spark.createDataFrame([(bytes(random.Random(i).randbytes(i % 400)),) for i in range(9000)], "frame binary").repartition(2)
    df.write.format(splits.NAME).option("split", 50_000).mode("append").save(path)
    back = spark.read.format(splits.NAME).option("split", 50_000).load(path)
    assert back.rdd.getNumPartitions() > 6 and plain(back) == plain(df)


def test_index_of_files_from_elsewhere(registered, tmp_path):
    spark, path = registered, str(tmp_path)
    out = io.StringIO(newline="")
    own = [(i, t or "", x) for i, (_, t, x) in enumerate(rows(2000))]
    csv.writer(out, quoting=csv.QUOTE_NONNUMERIC, lineterminator="\n").writerows(own)
    (tmp_path / "a.csv").write_bytes(out.getvalue().encode())
    index = splits.index_records(spark, path, ["a.csv"], "csv", split=700)
    assert splits.commit_index(path, index, "a") and not splits.commit_index(path, spark.createDataFrame([], index.schema), "a")
    read = spark.read.format(splits.NAME).option("kind", "csv").option("split", 700).schema("id bigint, text string, x double").load(path)
    assert read.rdd.getNumPartitions() > 50 and plain(read) == sorted(own, key=repr)

    frames = tmp_path / "f"
    frames.mkdir()
    bodies = [bytes([i % 256]) * (i % 50) for i in range(1000)]
    (frames / "x.frames").write_bytes(b"".join(len(b).to_bytes(4, "big") + b for b in bodies))
    splits.commit_index(str(frames), splits.index_records(spark, str(frames), ["x.frames"], "frames", split=800), "x")
    back = spark.read.format(splits.NAME).option("split", 800).load(str(frames))
    assert back.rdd.getNumPartitions() > 20 and plain(back) == sorted(((b,) for b in bodies), key=repr)


def test_errors_are_the_sources_own(registered, tmp_path):
    spark, bad = registered, tmp_path / "bad"
    bad.mkdir()
    (bad / "x.frames").write_bytes(b"\0\0\0\2ab\0\0\1\0abc")
    with pytest.raises(Exception, match="RecordError: the frame at byte 6 of x.frames"):
        splits.index_records(spark, str(bad), ["x.frames"], "frames").collect()
    splits.commit(str(bad), "x", [{"name": "x.frames", "size": 13, "rows": None, "starts": []}])
    with pytest.raises(Exception, match="RecordError: the frame at byte 6 of x.frames"):
        spark.read.format(splits.NAME).load(str(bad)).collect()
    (bad / "y.csv").write_bytes(b"1,2\n3\n")
    splits.commit(str(bad / "."), "y", [])
    with pytest.raises(Exception, match="schema"):
        spark.read.format(splits.NAME).option("kind", "csv").load(str(bad)).collect()


def test_commit_and_abort(registered, tmp_path):
    spark, path = registered, str(tmp_path / "c")
    read = lambda: spark.read.format(splits.NAME).option("kind", "csv").schema("id bigint").load(path)
    write = lambda df, **o: df.write.format(splits.NAME).option("kind", "csv").options(**o).mode("append").save(path)
    write(spark.range(10), batch="1")
    broken = spark.range(0, 40, numPartitions=4).select(F.when(F.col("id") < 39, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="no"):
        write(broken, batch="2")
    assert plain(read()) == plain(spark.range(10))
    splits.sweep(path, 0)  # of tasks that were killed
    assert {f for f in os.listdir(path) if f.startswith("part-")} == {e["name"] for c in splits.commits(path).values() for e in c["files"]}
    write(spark.range(100, 103), batch="2")
    write(spark.range(10), batch="1")  # it comes again
    assert plain(read()) == sorted([(i,) for i in [*range(10), 100, 101, 102]], key=repr)
    spark.range(5).write.format(splits.NAME).option("kind", "csv").mode("overwrite").save(path)
    assert plain(read()) == [(i,) for i in range(5)] and splits.sweep(path) == 0 and splits.sweep(path, 0) > 0 and plain(read()) == [(i,) for i in range(5)]


def test_attempts_of_a_task_leave_nothing(tmp_path):
    import pyarrow as pa
    from pyspark.sql.types import LongType, StructField, StructType

    w = splits._Writer(StructType([StructField("id", LongType())]), splits._Options({"path": str(tmp_path), "kind": "csv"}))
    one = pa.RecordBatch.from_pydict({"id": [1, 2]})

    def fails():
        yield one
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        w.write(fails())
    assert os.listdir(tmp_path) == []
    a, b = w.write(iter([one])), w.write(iter([one]))  # a second attempt of the same task
    w.commit([b])
    assert a.entry["name"] != b.entry["name"] and [e["name"] for c in splits.commits(str(tmp_path)).values() for e in c["files"]] == [b.entry["name"]]
    w.abort([a, None])
    assert not (tmp_path / a.entry["name"]).exists()


def test_stream_writes_batches_once(registered, tmp_path):
    spark, src, path = registered, tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "a.json").write_text('{"id": 1}\n{"id": 2}\n')
    run = lambda checkpoint: spark.readStream.schema("id bigint").json(str(src)).writeStream.format(splits.NAME).option("kind", "csv").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start(path).awaitTermination(60)
    run("c1")
    run("c2")  # another run whose first batch has the same number: it is the same batch
    (src / "b.json").write_text('{"id": 3}\n')
    run("c1")
    assert plain(spark.read.format(splits.NAME).option("kind", "csv").schema("id bigint").load(path)) == [(1,), (2,), (3,)]
    assert list(splits.commits(path)) == ["batch-000000000000", "batch-000000000001"]
