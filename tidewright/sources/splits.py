"""A folder of records that is read by byte ranges and written with a commit: length-prefixed frames, and CSV whose fields may hold line breaks.

    register(spark)
    df.write.format("tidewright_records").option("kind", "csv").mode("append").save(path)
    spark.read.format("tidewright_records").option("kind", "csv").option("names", "a,b,c").schema("a bigint, c string").load(path)

Ranges begin and end at records, which no reader can tell from bytes alone (a line break may stand in a field, a length may be any
bytes), so starts of records are known beforehand, one about every `split` bytes: the writer notes them, and `index_records` finds them for files from elsewhere. Frames are walked by their
lengths, a task for each file; CSV is cut anywhere, the quotes of each piece are counted in parallel, and from the number of quotes before a piece
follows whether it begins within a field.

A write is seen once its commit is: tasks write files of their own, send what they wrote to the driver, and one small file that names all of
these is moved into place. A failed task's file is named nowhere, an aborted write removes its files (those of killed tasks stay until `sweep`), and a commit has the name of its batch
(of a stream, or the option `batch`), so that a batch that comes again changes nothing: the mark and the commit are one.

Reading takes the columns of the schema asked for only. A malformed record ends the read with RecordError, which says where.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.csv as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME, COMMITS = "tidewright_records", "_commits"
SPLIT, HEADER = 16 << 20, 4
#: Rows of a piece that is written, or read at a time; a start is noted at a piece at the earliest.
ROWS = 1000
#: Bytes that a walk over frames reads at a time.
_READ = 1 << 20


class RecordError(ValueError):
    pass


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def commits(path: str) -> dict[str, dict]:
    """Commits by name, without replaced ones."""
    files, root = opened(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/{COMMITS}", allow_not_found=True))
    out = {}
    for f in found:
        if f.is_file and f.base_name.endswith(".json") and not f.base_name.startswith("."):
            with files.open_input_stream(f.path) as s:
                out[f.base_name.removesuffix(".json")] = json.loads(s.read())
    gone = {x for c in out.values() for x in c["replaces"]}
    return {k: c for k, c in sorted(out.items()) if k not in gone}


def commit(path: str, name: str, entries: list[dict], replaces: Sequence[str] = ()) -> bool:
    """Whether the commit wasn't there before; if it was, the entries' files go."""
    files, root = opened(path)
    place = f"{root}/{COMMITS}/{name}.json"
    if files.get_file_info(place).type != fs.FileType.NotFound:
        remove(path, entries)
        return False
    files.create_dir(f"{root}/{COMMITS}", recursive=True)
    part = f"{root}/{COMMITS}/.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as s:
        s.write(json.dumps({"files": entries, "replaces": list(replaces)}).encode())
    files.move(part, place)
    return True


def remove(path: str, entries: list[dict]) -> None:
    files, root = opened(path)
    for e in entries:
        if files.get_file_info(f"{root}/{e['name']}").type != fs.FileType.NotFound:
            files.delete_file(f"{root}/{e['name']}")


def sweep(path: str, older_s: float = 86_400) -> int:
    """Deletes files that no commit names (of killed tasks, and of replaced commits) and that are so old that no write can still be at them; how many."""
    files, root = opened(path)
    named, before = {e["name"] for c in commits(path).values() for e in c["files"]}, time.time() - older_s
    gone = [f for f in files.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.startswith("part-") and f.base_name not in named and f.mtime_ns / 1e9 <= before]
    for f in gone:
        files.delete_file(f.path)
    return len(gone)


@dataclass
class Range(InputPartition):
    name: str
    start: int
    end: int


@dataclass
class Wrote(WriterCommitMessage):
    entry: dict | None = None


class _Options:
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("records need a path")
        self.path, self.kind = options["path"], options.get("kind", "frames")
        if self.kind not in ("frames", "csv"):
            raise ValueError(f"records are frames or csv, not {self.kind}")
        self.split, self.header = int(options.get("split", SPLIT)), int(options.get("header", HEADER))
        self.names = [n.strip() for n in options["names"].split(",")] if options.get("names") else None
        self.batch = options.get("batch")


class _Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: _Options):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.o, self.schema = options, to_arrow_schema(schema)
        if options.kind == "frames" and schema.simpleString() != "struct<frame:binary>":
            raise ValueError("frames have the one column frame binary")

    def partitions(self) -> list[Range]:
        out = []
        for c in commits(self.o.path).values():
            for e in c["files"]:
                starts = [0]
                for at in e["starts"]:
                    if at - starts[-1] >= self.o.split:
                        starts.append(at)
                out += [Range(e["name"], a, b) for a, b in zip(starts, [*starts[1:], e["size"]], strict=True) if b > a]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.o.path)
        with files.open_input_file(f"{root}/{part.name}") as f:
            yield from (self._frames if self.o.kind == "frames" else self._csv)(f, part)

    def _frames(self, f: Any, part: Range) -> Iterator[pa.RecordBatch]:
        f.seek(part.start)
        at, held = part.start, []
        while at < part.end:
            size = int.from_bytes(f.read(self.o.header), "big")
            body = f.read(size) if at + self.o.header + size <= part.end else b""
            if len(body) < size:
                raise RecordError(f"the frame at byte {at} of {part.name} has a length of {size}, beyond byte {part.end}")
            held.append(body)
            at += self.o.header + size
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=self.schema)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], schema=self.schema)

    def _csv(self, f: Any, part: Range) -> Iterator[pa.RecordBatch]:
        names = self.o.names or self.schema.names
        f.seek(part.start)
        read = pc.ReadOptions(column_names=names, block_size=max(_READ, part.end - part.start + 1), use_threads=False)
        convert = pc.ConvertOptions(column_types={x.name: x.type for x in self.schema}, include_columns=self.schema.names, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""])
        try:
            table = pc.read_csv(pa.BufferReader(f.read(part.end - part.start)), read, pc.ParseOptions(newlines_in_values=True, ignore_empty_lines=False), convert)
        except pa.ArrowInvalid as e:
            raise RecordError(f"bytes {part.start} to {part.end} of {part.name}: {e}") from e
        yield from table.to_batches(max_chunksize=ROWS)


class _Writing:
    def __init__(self, schema: StructType, options: _Options, overwrite: bool = False):
        self.o, self.overwrite = options, overwrite
        if options.kind == "frames" and schema.simpleString() != "struct<frame:binary>":
            raise ValueError("frames have the one column frame binary")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        files, root = opened(self.o.path)
        files.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.{self.o.kind}"  # of this attempt alone
        entry, last = {"name": name, "size": 0, "rows": 0, "starts": []}, 0
        try:
            with files.open_output_stream(f"{root}/{name}") as s:
                for batch in batches:
                    for i in range(0, batch.num_rows, ROWS):
                        piece = batch.slice(i, ROWS)
                        if entry["size"] - last >= min(self.o.split, _READ):
                            last = entry["size"]
                            entry["starts"].append(last)
                        data = self._bytes(piece)
                        s.write(data)
                        entry["size"] += len(data)
                        entry["rows"] += piece.num_rows
        except BaseException:
            remove(self.o.path, [entry])
            raise
        if not entry["rows"]:
            remove(self.o.path, [entry])
        return Wrote(entry if entry["rows"] else None)

    def _bytes(self, piece: pa.RecordBatch) -> bytes:
        if self.o.kind == "frames":
            bodies = [b or b"" for b in piece.column(0).to_pylist()]
            for b in bodies:
                if len(b) >= 1 << 8 * self.o.header:
                    raise RecordError(f"a frame of {len(b)} bytes is too long for a header of {self.o.header}")
            return b"".join(x for b in bodies for x in (len(b).to_bytes(self.o.header, "big"), b))
        out = pa.BufferOutputStream()
        pc.write_csv(piece, out, pc.WriteOptions(include_header=False))
        return out.getvalue().to_pybytes()

    def done(self, messages: list, name: str) -> None:
        before = list(commits(self.o.path)) if self.overwrite else []
        commit(self.o.path, name, [m.entry for m in messages if m and m.entry], [b for b in before if b != name])

    def undone(self, messages: list) -> None:
        remove(self.o.path, [m.entry for m in messages if m and m.entry])


class _Writer(_Writing, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self.done(messages, f"batch-{self.o.batch}" if self.o.batch else uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self.undone(messages)


class _StreamWriter(_Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.done(messages, f"batch-{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:
        self.undone(messages)


class Records(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        if self.options.get("kind", "frames") == "frames":
            return "frame binary"
        raise ValueError("CSV records are read by a schema: spark.read.schema(...)")

    def reader(self, schema: StructType) -> _Reader:
        return _Reader(schema, _Options(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(schema, _Options(self.options), overwrite)

    def streamWriter(self, schema: StructType, overwrite: bool) -> _StreamWriter:
        return _StreamWriter(schema, _Options(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Records)


# starts of records in files from elsewhere


def _sizes(path: str, names: Sequence[str]) -> list[tuple[str, int]]:
    files, root = opened(path)
    return [(n, files.get_file_info(f"{root}/{n}").size) for n in names]


def _walk(path: str, name: str, split: int, header: int) -> Iterator[int]:
    """Starts of frames, one for each `split` bytes, by headers alone."""
    files, root = opened(path)
    with files.open_input_file(f"{root}/{name}") as f:
        size, at, last = f.size(), 0, 0
        while at < size:
            f.seek(at)
            n = int.from_bytes(f.read(header), "big")
            if at + header + n > size:
                raise RecordError(f"the frame at byte {at} of {name} has a length of {n}, beyond the file's {size} bytes")
            at += header + n
            if at - last >= split and at < size:
                yield at
                last = at


def _piece(path: str, name: str, start: int, end: int) -> bytes:
    files, root = opened(path)
    with files.open_input_file(f"{root}/{name}") as f:
        f.seek(start)
        return f.read(end - start)


def _first_start(piece: bytes, quoted: bool) -> int | None:
    """Where a record begins after the first line break outside quotes; an escaped quote is two of them, which leaves the state as it is."""
    at = 0
    while True:
        stop = piece.find(b'"' if quoted else b"\n", at)
        mark = -1 if quoted else piece.find(b'"', at)
        if not quoted and 0 <= mark and (stop < 0 or mark < stop):
            quoted, at = True, mark + 1
        elif stop < 0:
            return None
        elif quoted:
            quoted, at = False, stop + 1
        else:
            return stop + 1


def index_records(spark: SparkSession, path: str, names: Sequence[str], kind: str, split: int = SPLIT, header: int = HEADER) -> DataFrame:
    """name, size, starts of the named files of a folder; commit_index() then makes them readable."""
    sizes = _sizes(path, names)
    files = spark.createDataFrame(sizes, "name string, size bigint").repartition(max(1, len(sizes)), "name")
    if kind == "frames":

        def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield pa.RecordBatch.from_pylist([{"name": name, "size": size, "starts": list(_walk(path, name, split, header))}], pa.schema([("name", pa.string()), ("size", pa.int64()), ("starts", pa.list_(pa.int64()))]))

        return files.mapInArrow(walked, "name string, size bigint, starts array<bigint>")
    pieces = files.withColumn("start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(split).cast("bigint"))))
    pieces = pieces.repartition("name", "start").withColumn("end", F.least(F.col("start") + split, F.col("size")))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [_piece(path, r["name"], r["start"], r["end"]).count(b'"') for r in b.to_pylist()]
            yield b.append_column("quotes", pa.array(n, pa.int64()))

    from pyspark.sql import Window

    columns = "name string, size bigint, start bigint, end bigint"
    before = Window.partitionBy("name").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each piece of a file
    known = pieces.mapInArrow(counted, f"{columns}, quotes bigint").withColumn("quoted", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [None if r["start"] == 0 else _first_start(_piece(path, r["name"], r["start"], r["end"]), r["quoted"]) for r in b.to_pylist()]
            starts = [None if x is None else r["start"] + x for x, r in zip(at, b.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(starts, pa.int64())], ["name", "size", "at"])

    dealt = known.select("name", "size", "start", "end", "quoted").repartition("name", "start")
    starts = dealt.mapInArrow(found, "name string, size bigint, at bigint").where("at is null or at < size")
    return starts.groupBy("name", "size").agg(F.array_sort(F.collect_set("at")).alias("starts"))


def commit_index(path: str, index: DataFrame, name: str) -> bool:
    """The files of an index, a row each, as one commit of the folder."""
    return commit(path, name, [{"name": r["name"], "size": r["size"], "rows": None, "starts": list(r["starts"])} for r in index.collect()])
