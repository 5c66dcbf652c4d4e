"""Token ids in sorted-string-table shards.

    shard  := block* index bloom footer
    block  := zstd(entry*)                     up to about BLOCK bytes of entries
    entry  := varint shared, varint rest, varint bytes of value, rest of the key, value
    index  := zstd of (varint key bytes, last key, varint offset, varint length, varint documents, varint ids)*
    bloom  := bits over keys; footer has their number and that of the hashes
    footer := FOOTER struct, ends with MAGIC

A key is one byte (0: null, 1: set) and the identifier in 8 bytes, sign bit flipped, big-endian: keys sort as identifiers,
nulls first. A block starts with a whole key; each next one leaves out the bytes it shares with its predecessor. A value
is the ids as little-endian integers of the width in the footer.

Shards hold ranges of identifiers, and of one identifier's rows: the rows are dealt out by range and sorted in each task, which begins another shard once one
has SHARD bytes, so neither a shard nor what its writer holds grows with the data. A name has the number of the attempt, and
MANIFEST.json lists in order the shards of the attempts that Spark took, so a lost or doubled attempt is never read.

Defined results: a null or empty text has the end id only; rows of one identifier are kept side by side, by the hash of their text, in as many shards as they need;
a null identifier sorts first; a very long text is one entry, in a block of its own; an empty table gives a manifest without shards; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import json
import struct
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, text_batches
from .encode import MOST_CHUNKS, library_encoder

BLOCK, SHARD, BITS_PER_KEY, HASHES, MAGIC = 64 << 10, 256 << 20, 10, 7, b"TIDESST1"
#: index offset, index bytes, bloom offset, bloom bytes, bloom hashes, id width, documents, ids, crc32 of index and bloom
FOOTER = struct.Struct("<QQQQIIQQI8s")


def filesystem(uri: str) -> tuple[Any, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + ((doc_id + (1 << 63)) & ((1 << 64) - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key[1:], "big") - (1 << 63) if key[0] else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(h: int, n_bits: int, hashes: int) -> list[int]:
    """Bits for a key of 64-bit hash h."""
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % n_bits for i in range(hashes)]


class ShardWriter:
    """Takes keys in ascending order."""

    def __init__(self, sink: Any, width: int):
        self.sink, self.width, self.at = sink, width, 0
        self.entries, self.size, self.last = [], 0, b""
        self.index: list[bytes] = []
        self.hashes = array("Q")  # of different keys
        self.docs = self.ids = self.block_docs = self.block_ids = 0
        self.pack = zstandard.ZstdCompressor(level=1)

    def _out(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.entries:
            if key < self.last:
                raise ValueError("keys must ascend")
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.entries.append(entry)
        if key != self.last or not self.hashes:
            self.hashes.append(xxhash.xxh3_64_intdigest(key))
        self.size, self.last = self.size + len(entry), key
        self.block_docs, self.block_ids = self.block_docs + 1, self.block_ids + len(value) // self.width
        if self.size >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if not self.entries:
            return
        data = self.pack.compress(b"".join(self.entries))
        self.index.append(_varint(len(self.last)) + self.last + b"".join(map(_varint, (self.at, len(data), self.block_docs, self.block_ids))))
        self._out(data)
        self.docs, self.ids = self.docs + self.block_docs, self.ids + self.block_ids
        self.entries, self.size, self.block_docs, self.block_ids = [], 0, 0, 0

    def close(self) -> None:
        self._flush()
        index_at, index = self.at, self.pack.compress(b"".join(self.index))
        self._out(index)
        n_bits = max(64, len(self.hashes) * BITS_PER_KEY + 7 & ~7)
        bloom, h = np.zeros(n_bits // 8, np.uint8), np.frombuffer(self.hashes, np.uint64)
        low, high = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        for i in range(HASHES):  # the bits of _bits, for all keys at once
            b = (low + np.uint64(i) * high) % np.uint64(n_bits)
            np.bitwise_or.at(bloom, (b >> np.uint64(3)).astype(np.int64), (1 << (b & np.uint64(7)).astype(np.int64)).astype(np.uint8))
        bloom = bloom.tobytes()
        bloom_at = self.at
        self._out(bloom)
        crc = zlib.crc32(bloom, zlib.crc32(index))
        self._out(FOOTER.pack(index_at, len(index), bloom_at, len(bloom), HASHES, self.width, self.docs, self.ids, crc, MAGIC))


class ShardReader:
    """Look-ups by binary search, and reading in order, on a random-access file."""

    def __init__(self, source: Any, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        index_at, index_n, bloom_at, bloom_n, self.hashes, self.width, self.docs, self.ids, crc, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        source.seek(index_at)
        index = source.read(index_n)
        source.seek(bloom_at)
        self.bloom = source.read(bloom_n)
        if zlib.crc32(self.bloom, zlib.crc32(index)) != crc:
            raise ValueError("index or filter is damaged")
        self.unpack = zstandard.ZstdDecompressor()
        raw, at = self.unpack.decompress(index), 0
        self.last_keys: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.last_keys.append(raw[at : at + n])
            at += n
            four = []
            for _ in range(4):
                x, at = _read_varint(raw, at)
                four.append(x)
            self.blocks.append(tuple(four))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, _, _ = self.blocks[i]
        self.source.seek(at)
        raw, at, key = self.unpack.decompress(self.source.read(n)), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            size, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[b >> 3] >> (b & 7) & 1 for b in _bits(xxhash.xxh3_64_intdigest(key), len(self.bloom) * 8, self.hashes))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each row with that identifier."""
        key, out = key_of(doc_id), []
        if self.may_hold(key):
            for i in range(bisect.bisect_left(self.last_keys, key), len(self.blocks)):
                found = [v for k, v in self.block(i) if k == key]
                out += [np.frombuffer(v, f"<u{self.width}").astype("<u4") for v in found]
                if self.last_keys[i] > key:
                    break
        return out


def write_shards(docs: DataFrame, tokenizer: str, out_dir: str, end_id: int = 1, shard: int = SHARD, remember: int = MOST_CHUNKS) -> list[dict]:
    """Encode docs(doc_id, text), append end_id to each, write shards below out_dir; the manifest, one entry a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder = library_encoder(tokenizer, remember)
        width = 2 if encoder.size <= 1 << 16 and end_id < 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()
        fs, root = filesystem(out_dir)
        number, writer, name, first = 0, None, "", b""

        def closed() -> pa.RecordBatch:
            last = writer.last
            writer.close()
            writer.sink.close()
            return pa.RecordBatch.from_pydict({"shard": [name], "first": [first.hex()], "last": [last.hex()], "docs": [writer.docs], "ids": [writer.ids], "bytes": [writer.at]})

        for batch in (part for whole in batches for part in slices(whole)):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, coded in zip(ids, encoder.batch(texts), strict=True):
                if writer is None:
                    name = f"shard-{task.partitionId():06d}-{number:06d}-{task.taskAttemptId()}.sst"
                    writer, first = ShardWriter(fs.open_output_stream(f"{root}/{name}"), width), key_of(doc_id)
                writer.add(key_of(doc_id), np.frombuffer(coded, "<u4").astype(f"<u{width}").tobytes() + end)
                if writer.at + writer.size >= shard:
                    yield closed()
                    number, writer = number + 1, None
        if writer is not None:
            yield closed()

    text_batches(docs.sparkSession)
    fs, root = filesystem(out_dir)
    fs.create_dir(root, recursive=True)
    # rows of one identifier, or of none, may be many, and equal ones too: they are dealt out by the hash of their text, then by where they lie
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    along = ("doc_id", "hash", "place")
    dealt = rows.repartitionByRange(*along).sortWithinPartitions(*along).select("doc_id", "text")
    # one row for each shard, not for each document
    rows = dealt.mapInArrow(run, "shard string, first string, last string, docs bigint, ids bigint, bytes bigint").collect()
    manifest = sorted((r.asDict() for r in rows), key=lambda r: r["shard"])
    start = 0
    for m in manifest:
        m["start"], start = start, start + m["ids"]
    with fs.open_output_stream(f"{root}/MANIFEST.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def open_shard(out_dir: str, name: str) -> ShardReader:
    fs, root = filesystem(out_dir)
    at = f"{root}/{name}"
    return ShardReader(fs.open_input_file(at), fs.get_file_info(at).size)


def look_up(out_dir: str, doc_id: int | None) -> list[np.ndarray]:
    """Ids of a document, by binary search among the shards and in the shard."""
    fs, root = filesystem(out_dir)
    with fs.open_input_stream(f"{root}/MANIFEST.json") as f:
        manifest = json.loads(f.read())
    key, out = key_of(doc_id).hex(), []
    for m in manifest[bisect.bisect_left([m["last"] for m in manifest], key) :]:
        if m["first"] > key:
            break
        out += open_shard(out_dir, m["shard"]).get(doc_id)
    return out


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and ids (little-endian, 32 bits) of every document."""
    fs, root = filesystem(out_dir)
    with fs.open_input_stream(f"{root}/MANIFEST.json") as f:
        manifest = json.loads(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader, rows, size = open_shard(out_dir, name), [], 0
                for key, value in reader.scan():
                    ids = np.frombuffer(value, f"<u{reader.width}").astype("<u4").tobytes()
                    rows.append((id_of(key), start, len(ids) // 4, zlib.crc32(ids), ids))
                    start, size = start + len(ids) // 4, size + len(ids)
                    if size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    shards = spark.createDataFrame([(m["shard"], m["start"]) for m in manifest], "shard string, start bigint")
    return shards.repartition(max(1, len(manifest))).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
