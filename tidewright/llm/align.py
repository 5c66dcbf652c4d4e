"""Alignment of two tokenizers' tokens over whole texts, by segment deduplication.

A is a byte-level BPE file of the tokenizers library, B a sentencepiece BPE model with byte fallback. Both encode a space and the
text. Texts are cut before runs of white space, where neither can merge across: A's splitting pattern has white space at the
beginning of a piece only, and of B's vocabulary no piece has a character other than white space followed by one of CUTS
(white space that some piece does have there, as a carriage return, is no place to cut; see `cutting`). So tokens of a text are those of its segments, one after another.

1. A pass over the texts makes chunks of some CHUNK_BYTES: a dictionary of their distinct segments, and documents as numbers in it.
2. Segments of all chunks meet by one exchange, sorted, so that each distinct one is tokenised and aligned once; links are counted by pair of ids.
3. Alignments, scored by the pairs' counts, go back to their chunks, where documents are composed of them.

Both tokens of a link end at one byte, so that one is a suffix of the other: there are no more pairs of ids than bytes in both
vocabularies (`most_pairs`), whatever the corpus. That bounds what is gathered and broadcast. A segment is in a chunk's
dictionary once, so that no segment has more rows than there are chunks.

Defined results: a null or empty text, or one with U+2581 (which B can't tell from a space), has no tokens: zeros and an empty digest;
a very long text counts whole, and is a chunk of its own; a long text without white space is one segment; texts of white space have tokens as any other; rows are
independent but for the counts, so repeated rows stay and count each; identifiers are carried only, nulls too; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, slices, text_batches, unpacked, use
from .encode import byte_chars

#: Text of a chunk, and rows of segments that a task holds before it sends them.
CHUNK_BYTES, HELD = 8 << 20, 200_000
#: White space, known to both tokenizers, before which a text may be cut.
CUTS = " \n\t"
SPACE = "▁"


class Pair:
    """Both tokenizers, the bytes of their tokens, and where texts may be cut."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Tokenizer

        spec = json.load(open(path_a, encoding="utf-8"))
        split = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or split.get("type") != "ByteLevel" or not split.get("use_regex") or split.get("add_prefix_space"):
            raise ValueError("the first tokenizer has to be byte-level, split by the usual pattern, without a normaliser")
        self.a = Tokenizer.from_file(path_a)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        byte = {c: i for i, c in enumerate(byte_chars())}
        self.bytes_a = {i: bytes(map(byte.__getitem__, t)) for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(open(path_b, "rb").read())
        normal = model.normalizer_spec
        if normal.name != "identity" or normal.precompiled_charsmap or normal.remove_extra_whitespaces or not normal.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("the second tokenizer has to keep texts as they are, with a space before them and byte fallback")
        # segments begin with their own white space
        normal.add_dummy_prefix = False
        self.b = sentencepiece.SentencePieceProcessor()
        self.b.load_from_serialized_proto(model.SerializeToString())
        self.bytes_b, whole = {}, []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                self.bytes_b[i] = bytes([int(piece[3:-1], 16)])
            elif not self.b.is_control(i) and not self.b.is_unknown(i):
                self.bytes_b[i] = piece.replace(SPACE, " ").encode()
                whole.append(piece.replace(SPACE, " "))
        self.cutting = "".join(c for c in CUTS if not any(re.search(rf"\S{c}", piece) for piece in whole))
        self._odd = re.compile(rf"[^\S{self.cutting}]")
        self._plain = re.compile(r"\s*\S+|\s+")
        self._cut = re.compile(rf"(?<=\S)(?=[{self.cutting}])") if self.cutting else None

    def most_pairs(self) -> int:
        return sum(map(len, self.bytes_a.values())) + sum(map(len, self.bytes_b.values()))

    def segments(self, text: str) -> list[str]:
        """Of a space and the text."""
        text = " " + text
        if self._odd.search(text):
            return self._cut.split(text) if self._cut else [text]
        return self._plain.findall(text)

    def align(self, segments: list[str]) -> list[tuple[int, int, str, list[int]]]:
        """Of each segment the numbers of both tokens, the groups as text, and the links as a << 32 | b."""
        out, size_a, size_b = [], self.bytes_a, self.bytes_b
        for s, a, b in zip(segments, (e.ids for e in self.a.encode_batch(segments, add_special_tokens=False)), self.b.encode(segments, num_threads=1), strict=True):
            if len(a) == 1 == len(b):
                out.append((1, 1, f"{a[0]}|{b[0]}", [a[0] << 32 | b[0]]))
                continue
            groups, links = [], []
            i = j = from_i = from_j = end_a = end_b = 0
            while i < len(a):
                end_a += len(size_a[a[i]])
                i += 1
                while end_b < end_a and j < len(b):
                    end_b += len(size_b[b[j]])
                    j += 1
                if end_a == end_b:
                    groups.append(f"{','.join(map(str, a[from_i:i]))}|{','.join(map(str, b[from_j:j]))}")
                    links.append(a[i - 1] << 32 | b[j - 1])
                    from_i, from_j = i, j
            if not end_a == end_b == len(s.encode()) or j < len(b):
                raise ValueError(f"tokens of {s[:80]!r} don't make up its bytes")
            out.append((len(a), len(b), ";".join(groups), links))
        return out


_pairs: dict[tuple[str, str], Pair] = {}


def pair(path_a: str, path_b: str) -> Pair:
    """One for each two files in a worker."""
    if (path_a, path_b) not in _pairs:
        _pairs[path_a, path_b] = Pair(path_a, path_b)
    return _pairs[path_a, path_b]


class _Numbers(dict):
    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_CHUNKS = pa.schema([("chunk", pa.int64()), ("no", pa.int32()), ("segment", pa.string()), ("n", pa.int64()), ("blob", pa.binary())])
_ALIGNED = pa.schema([("pair", pa.int64()), ("n", pa.int64()), ("segments", pa.binary()), ("rows", pa.binary())])


def _chunks(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of chunk, blob with a chunk's documents, and of chunk, no, segment, n with its dictionary and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        use()
        tokenizers, chunk = pair(*paths), TaskContext.get().partitionId() << 32
        numbers, ids, sizes, parts, held = _Numbers(), [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            refs = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
            documents = packed({"doc_id": pa.array(ids, pa.int64()), "size": pa.array(sizes, pa.int64())})
            blob = packed({"at": pa.array([documents], pa.binary()), "refs": pa.array([packed({"ref": pa.array(refs)})], pa.binary())})
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary())], schema=_CHUNKS)
            n, names = np.bincount(refs, minlength=len(numbers)), list(numbers)
            for i in range(0, len(names), 50_000):
                some = names[i : i + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), chunk)), pa.array(np.arange(i, i + len(some), dtype=np.int32)), pa.array(some, pa.string()), pa.array(n[i : i + len(some)].astype(np.int64)), pa.nulls(len(some), pa.binary())],
                    schema=_CHUNKS,
                )

        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                refs = np.fromiter(map(numbers.__getitem__, tokenizers.segments(text)), np.uint32) if text and SPACE not in text else np.zeros(0, np.uint32)
                ids.append(doc_id)
                sizes.append(len(refs))
                parts.append(refs)
                held += len(text or "")
                if held >= CHUNK_BYTES or len(ids) >= HELD:
                    yield from out()
                    chunk += 1
                    numbers, ids, sizes, parts, held = _Numbers(), [], [], [], 0
        if ids:
            yield from out()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "chunk bigint, no int, segment string, n bigint, blob binary")


def _aligned(needs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of pair, n with a task's counts, and of blobs with alignments of segments and the places in chunks that need them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        tokenizers, counts = pair(*paths), {}
        last = None  # the last segment and its alignment: it may go on in the next batch
        for batch in (part for whole in batches for part in slices(whole)):
            segment = batch.column(2)
            if not len(segment):
                continue
            begins = np.concatenate([[True], pc.not_equal(segment[1:], segment[:-1]).to_numpy(zero_copy_only=False)]).astype(bool)
            names = segment.filter(pa.array(begins)).to_pylist()
            goes_on = last is not None and names[0] == last[0]
            found = ([last[1]] if goes_on else []) + tokenizers.align(names[1:] if goes_on else names)
            last = (names[-1], found[-1])
            which = np.cumsum(begins) - 1
            often = np.bincount(which, batch.column(3).to_numpy()).astype(np.int64)  # counts below 2**53
            for (_, _, _, links), n in zip(found, often.tolist(), strict=True):
                for x in links:
                    counts[x] = counts.get(x, 0) + n
            na, nb, groups, links = zip(*found, strict=True)
            segments = packed({"n_a": pa.array(na, pa.int64()), "n_b": pa.array(nb, pa.int64()), "groups": pa.array(groups, pa.large_string()), "links": pa.array(links, pa.large_list(pa.int64()))})
            rows = packed({"chunk": batch.column(0), "no": batch.column(1), "which": pa.array(which)})
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([segments], pa.binary()), pa.array([rows], pa.binary())], schema=_ALIGNED)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64()), pa.nulls(len(counts), pa.binary()), pa.nulls(len(counts), pa.binary())], schema=_ALIGNED)

    return needs.mapInArrow(run, "pair bigint, n bigint, segments binary, rows binary")


def _scored(aligned: DataFrame, scores) -> DataFrame:
    """chunk, blob: alignments that a chunk needs, with sums over their links of the pairs' counts and of the best ones."""
    schema = pa.schema([("chunk", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        pairs, count, best = scores.value
        held, rows = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held).combine_chunks()
            chunk = table["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            edges = np.flatnonzero(np.diff(chunk[order])) + 1
            table = table.drop_columns("chunk")
            for part in np.split(order, edges):
                batch = table.take(pa.array(part)).combine_chunks().to_batches()[0]
                blob = packed(dict(zip(batch.schema.names, batch.columns, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([chunk[part[0]]]), pa.array([blob], pa.binary())], schema=schema)

        for batch in batches:
            for segments, places in zip(batch.column(0), batch.column(1), strict=True):
                s, at = unpacked(segments.as_buffer()), unpacked(places.as_buffer())
                links, ends = s["links"].values.to_numpy(), s["links"].offsets.to_numpy()
                i = np.searchsorted(pairs, links)
                # every segment has a link, as its last tokens end together
                sums = [np.add.reduceat(x[i], ends[:-1]) for x in (best, count)]
                which = pa.array(at["which"])
                full = pa.RecordBatch.from_arrays([s["n_a"], s["n_b"], pa.array(np.diff(ends)), *map(pa.array, sums), s["groups"]], ["n_a", "n_b", "n_groups", "n_best", "count_sum", "groups"]).take(which)
                held.append(pa.RecordBatch.from_arrays([at["chunk"], at["no"], *full.columns], ["chunk", "no", *full.schema.names]))
                rows += len(which)
                if rows >= HELD:
                    yield from out()
                    held, rows = [], 0
        if held:
            yield from out()

    return aligned.select("segments", "rows").mapInArrow(run, "chunk bigint, blob binary")


_SUMS = ("n_a", "n_b", "n_groups", "n_best", "count_sum")
OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string, groups_sha256 string"


def _composed(rows: DataFrame, texts: bool) -> DataFrame:
    """rows(chunk, part, blob), sorted by chunk and part, of which part 0 has the documents."""
    names = [x.split()[0] for x in OUT.split(", ")]
    wanted = names if texts else [n for n in names if n != "groups"]
    schema = ", ".join(x for x in OUT.split(", ") if x.split()[0] in wanted)

    def compose(documents: pa.RecordBatch, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = unpacked(documents["at"][0].as_buffer())
        refs = unpacked(documents["refs"][0].as_buffer())["ref"].to_numpy()
        size, ids = at["size"].to_numpy(), at["doc_id"]
        places = np.concatenate([p["no"].to_numpy() for p in parts]) if parts else np.zeros(0, np.int32)
        sums, groups = np.zeros((len(_SUMS), len(places)), np.int64), np.empty(len(places), object)
        for k, name in enumerate(_SUMS):
            if parts:
                sums[k, places] = np.concatenate([p[name].to_numpy() for p in parts])
        if parts:
            groups[places] = [g for p in parts for g in p["groups"].to_pylist()]
        groups, starts, step = groups.tolist(), np.concatenate([[0], np.cumsum(size)]), 500
        for low in range(0, len(size), step):
            high, digests, told = min(low + step, len(size)), [], []
            totals = np.zeros((high - low, len(_SUMS)), np.int64)
            for k in range(low, high):
                own = refs[starts[k] : starts[k + 1]]
                text = ";".join(map(groups.__getitem__, own.tolist()))
                totals[k - low] = sums[:, own].sum(1)
                digests.append(hashlib.sha256(text.encode()).hexdigest() if len(own) else "")
                if texts:
                    told.append(text)
            by = dict(zip(_SUMS, map(pa.array, np.ascontiguousarray(totals.T)), strict=True))
            by |= {"doc_id": ids[low:high], "n_links": by["n_groups"], "groups_sha256": pa.array(digests, pa.string()), "groups": pa.array(told, pa.string())}
            yield pa.RecordBatch.from_arrays([by[n] for n in wanted], wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        now, documents, parts = None, None, []
        for batch in batches:
            for chunk, part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if chunk != now and documents is not None:
                    yield from compose(documents, parts)
                if chunk != now:
                    now, documents, parts = chunk, None, []
                if part == 0:
                    documents = unpacked(blob.as_buffer())
                else:
                    parts.append(unpacked(blob.as_buffer()))
        if documents is not None:
            yield from compose(documents, parts)

    return rows.mapInArrow(run, schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, texts: bool = True) -> DataFrame:
    """docs(doc_id, text) to doc_id, the numbers of tokens, groups, links and best links, the sum of the links' counts, the groups as
    text (`a1,a2|b1;a3|b2`; left out unless `texts`) and their digest. Runs jobs to build its result."""
    spark, paths = docs.sparkSession, (path_a, path_b)
    text_batches(spark)
    chunks = cut(spark, _chunks(docs, paths), "chunks")
    needs = chunks.where("no is not null").select("chunk", "no", "segment", "n")
    aligned = cut(spark, _aligned(needs.repartition("segment").sortWithinPartitions("segment"), paths), "aligned")
    counts = aligned.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # Pair.most_pairs bounds it
    pairs, count = (np.array([r[k] for r in counts], np.int64) for k in ("pair", "n"))
    order = np.argsort(pairs)
    pairs, count = pairs[order], count[order]
    _, b = np.unique(pairs & 0xFFFFFFFF, return_inverse=True)
    highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
    np.maximum.at(highest, b, count)
    scores = spark.sparkContext.broadcast((pairs, count, (count == highest[b]).astype(np.int64)))
    scored = _scored(aligned.where("pair is null"), scores).select("chunk", F.lit(1).alias("part"), "blob")
    documents = chunks.where("no is null").select("chunk", F.lit(0).alias("part"), "blob")
    return _composed(documents.unionByName(scored).repartition("chunk").sortWithinPartitions("chunk", "part"), texts)

