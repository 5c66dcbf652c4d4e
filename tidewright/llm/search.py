"""Ranked lexical search with block-max pruning.

1. `build_index` cuts each task's documents into blocks (ranges of documents as they lie in the table), of BLOCK_DOCS documents or BLOCK_TERMS terms at most.
   A block has a head, for each of its terms the number of documents, the greatest frequency and the least length of a document that holds it, and a
   body, the forward index: each document's terms with their frequencies.
2. A pass over heads sums the document frequencies of the items' terms.
3. From a head follows a bound of the score of any document in its block. In a pass over heads each task gives its best block for each item; the
   SEEDS best of all are scored, which gives each item a first threshold: the score of the k-th document so far.
4. A last pass takes blocks some at a time, sorts them by bound for each item, and scores the forward index of blocks until the bound drops below the item's threshold, which rises with
   each task's own k best. Bodies of other blocks aren't unpacked. A task gives k rows an item at most, and those are ranked.

Bounds hold whatever the number of documents and their lengths, so the index needs one pass, and can serve any items. The frequency only raises a term's part of a score
and the length only lowers it, also with rounding down, so no document of a block scores above its bound; a block with an equal bound is scored, as ties go by doc_id.

What is sent to all tasks are items, ITEM_BYTES of their text at a time; with more the searching passes run for each such part.

Defined results: a null text, or one without terms, is no document and no item; a very long text is a block of its own; repeated documents rank one after another; of equal scores the least doc_id comes first,
null before all; each row of items has its own ranks, also where item_ids repeat or are null; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, packed, slices, text_batches, unpacked, use
from .words import alnum_words

BLOCK_DOCS, BLOCK_TERMS = 64, 32_768
#: Blocks that are sorted together, and bytes of their bodies.
WINDOW_BLOCKS, WINDOW_BYTES = 256, 16 << 20
SEEDS, ITEM_BYTES = 4, 4 << 20


def _block(number: int, ids: list, words: list[list[bytes]]) -> tuple:
    n = np.array(list(map(len, words)), np.int64)
    terms = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
    size = len(terms.dictionary)
    key, tf = np.unique(np.repeat(np.arange(len(n)), n) * size + terms.indices.to_numpy(), return_counts=True)
    doc, term = key // size, key % size
    most, least = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    np.maximum.at(most, term, tf)
    np.minimum.at(least, term, n[doc])
    head = packed({"term": terms.dictionary, "df": pa.array(np.bincount(term, minlength=size)), "most_tf": pa.array(most), "least_n": pa.array(least)})
    documents = packed({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n)})
    forward = packed({"doc": pa.array(doc.astype(np.uint32)), "term": pa.array(term.astype(np.uint32)), "tf": pa.array(tf.astype(np.uint32))})
    return number, len(ids), int(n.sum()), head, documents, forward


_INDEX = pa.schema([("block", pa.int64()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("head", pa.binary()), ("documents", pa.binary()), ("forward", pa.binary())])


def build_index(docs: DataFrame, block_docs: int = BLOCK_DOCS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """docs(doc_id, text) to a row for each block. To be written before it is searched, as numbers of blocks hold for one reading of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        use()
        number, ids, words, held = TaskContext.get().partitionId() << 32, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(_block(number, ids, words), _INDEX, strict=True)], schema=_INDEX)

        for batch in (part for whole in batches for part in slices(whole)):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not (own := alnum_words(text)):
                    continue
                if ids and (len(ids) >= block_docs or held + len(own) > block_terms):
                    yield out()
                    number, ids, words, held = number + 1, [], [], 0
                ids.append(doc_id)
                words.append(own)
                held += len(own)
        if ids:
            yield out()

    text_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "block bigint, n_docs bigint, n_terms bigint, head binary, documents binary, forward binary")


@dataclass
class Corpus:
    """Numbers of documents and of terms with repeats."""

    docs: int
    terms: int

    def norms(self, n: np.ndarray) -> np.ndarray:
        """The part of a score's denominator that the length n has."""
        if len(n) and 75 * self.docs * int(n.max()) >= 1 << 63:
            return np.array([25 + 75 * x * self.docs // self.terms for x in n.tolist()], np.int64)
        return 25 + 75 * n * self.docs // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.docs + 2) / (2 * df + 1)))


def share(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * norm)


class Items:
    """Items' terms as numbers: `flat` those of all items that have any, each once with `times`, item i from `starts[i]` on."""

    def __init__(self, texts: list[str | None]):
        numbers: dict[bytes, int] = {}
        flat, times, starts, self.rows = [], [], [], []
        for row, text in enumerate(texts):
            own: dict[int, int] = {}
            for w in alnum_words(text):
                t = numbers.setdefault(w, len(numbers))
                own[t] = own.get(t, 0) + 1
            if own:
                self.rows.append(row)
                starts.append(len(flat))
                flat += own
                times += own.values()
        self.terms = pa.array(list(numbers), pa.binary())
        self.flat, self.times, self.starts = np.array(flat, np.int64), np.array(times, np.int64), np.array(starts, np.int64)
        self.weights = self.times

    def __len__(self) -> int:
        return len(self.rows)

    def weigh(self, corpus: Corpus, df: dict[int, int]) -> None:
        w = np.array([corpus.weight(df.get(t, 0)) for t in range(len(self.terms))], np.int64)
        self.weights = self.times * w[self.flat]

    def of(self, item: int) -> slice:
        return slice(self.starts[item], self.starts[item + 1] if item + 1 < len(self) else len(self.flat))

    def numbers(self, head: pa.RecordBatch) -> np.ndarray:
        """The number of each of a block's terms, -1 for those that no item has."""
        return pc.fill_null(pc.index_in(head["term"], value_set=self.terms), -1).to_numpy()

    def bounds(self, head: pa.RecordBatch, corpus: Corpus) -> np.ndarray:
        """Of the scores of a block's documents, for each item."""
        at = self.numbers(head)
        here = at >= 0
        most = np.zeros(len(self.terms), np.int64)
        most[at[here]] = share(head["most_tf"].to_numpy()[here], corpus.norms(head["least_n"].to_numpy()[here]))
        return np.add.reduceat(self.weights * most[self.flat], self.starts)


class Block:
    """A block whose body is unpacked when it is first scored."""

    def __init__(self, items: Items, corpus: Corpus, row: tuple):
        self.items, self.corpus = items, corpus
        self.head, self.documents, self.forward = row
        self.ids = None

    def _unpack(self) -> None:
        documents, forward = unpacked(self.documents), unpacked(self.forward)
        term = self.items.numbers(unpacked(self.head))[forward["term"].to_numpy()]
        here = term >= 0
        self.doc, self.term = forward["doc"].to_numpy()[here].astype(np.int64), term[here]
        tf = forward["tf"].to_numpy()[here].astype(np.int64)
        self.share = share(tf, self.corpus.norms(documents["n"].to_numpy())[self.doc])
        self.ids = documents["doc_id"].to_pylist()
        self.weight = np.zeros(len(self.items.terms), np.int64)

    def scores(self, item: int) -> np.ndarray:
        if self.ids is None:
            self._unpack()
        of = self.items.of(item)
        self.weight[self.items.flat[of]] = self.items.weights[of]
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, self.doc, self.weight[self.term] * self.share)
        self.weight[self.items.flat[of]] = 0
        return out


class Best:
    """The k best documents of each item so far, and the score that another one has to reach."""

    def __init__(self, k: int, least: list[int]):
        self.k, self.least, self.rows = k, least, [[] for _ in least]

    def add(self, item: int, block: Block) -> None:
        scores = block.scores(item)
        found = np.flatnonzero((scores > 0) & (scores >= self.least[item]))
        if len(found):
            new = [(-s, block.ids[d] is not None, block.ids[d] or 0) for d, s in zip(found.tolist(), scores[found].tolist(), strict=True)]
            self.rows[item] = rows = heapq.nsmallest(self.k, self.rows[item] + new)
            if len(rows) == self.k:
                self.least[item] = max(self.least[item], -rows[-1][0])

    def batch(self) -> pa.RecordBatch:
        out = [(item, doc_id if known else None, -s) for item, rows in enumerate(self.rows) for s, known, doc_id in rows]
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["item", "doc_id", "score"])


_FOUND = "item bigint, doc_id bigint, score bigint"


def _frequencies(index: DataFrame, items) -> dict[int, int]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = items.value
        total = np.zeros(len(own.terms), np.int64)
        for batch in batches:
            for blob in batch.column(0):
                head = unpacked(blob.as_buffer())
                at = own.numbers(head)
                here = at >= 0
                total[at[here]] += head["df"].to_numpy()[here]
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["term", "df"])

    counted = index.select("head").mapInArrow(run, "term bigint, df bigint")
    return {r["term"]: r["df"] for r in counted.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # no more than terms of items


def _seeds(index: DataFrame, sent, corpus: Corpus) -> dict[int, list[int]]:
    """Items by the blocks of the greatest bounds: SEEDS of each item at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        bound, at = np.zeros(len(items), np.int64), np.full(len(items), -1)
        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = items.bounds(unpacked(blob.as_buffer()), corpus)
                at[b > bound] = block
                bound = np.maximum(b, bound)
        found = np.flatnonzero(at >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(at[found]), pa.array(bound[found])], ["item", "block", "bound"])

    best = index.select("block", "head").mapInArrow(run, "item bigint, block bigint, bound bigint")
    w = Window.partitionBy("item").orderBy(F.col("bound").desc(), "block")
    out: dict[int, list[int]] = {}
    for r in best.withColumn("r", F.row_number().over(w)).where(F.col("r") <= SEEDS).collect():
        out.setdefault(r["block"], []).append(r["item"])
    return out


def _scored(index: DataFrame, sent, corpus: Corpus, k: int, least: list[int], only: dict[int, list[int]] | None = None) -> DataFrame:
    """Each task's k best documents of each item that reach `least`; `only` names the items for which a block is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        items, best, held, size = sent.value, Best(k, list(least)), [], 0

        def window() -> None:
            if only is not None:
                for number, _, block in held:
                    for item in only[number]:
                        best.add(item, block)
                return
            bounds = np.stack([b for _, b, _ in held])
            order = np.argsort(-bounds, axis=0, kind="stable")
            top = bounds.max(0)
            for item in np.flatnonzero(top >= np.maximum(best.least, 1)).tolist():
                for i in order[:, item].tolist():
                    if bounds[i, item] < max(best.least[item], 1):
                        break
                    best.add(item, held[i][2])

        for batch in batches:
            for number, *blobs in zip(batch.column(0).to_pylist(), *(batch.column(i) for i in range(1, 4)), strict=True):
                row = tuple(b.as_buffer() for b in blobs)
                held.append((number, None if only is not None else items.bounds(unpacked(row[0]), corpus), Block(items, corpus, row)))
                size += sum(b.size for b in row)
                if len(held) >= WINDOW_BLOCKS or size >= WINDOW_BYTES:
                    window()
                    held.clear()
                    size = 0
        if held:
            window()
        yield best.batch()

    return index.select("block", "head", "documents", "forward").mapInArrow(run, _FOUND)


def search_index(index: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """A written index and items(item_id, text) to item_id, rank, doc_id, score: the k best documents of each item with a score above 0. Runs jobs to build its result."""
    spark = index.sparkSession
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint"
    docs, terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    corpus = Corpus(docs, terms)
    rows = items.select("item_id", "text").where(F.length("text") > 0)
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    out = spark.createDataFrame([], schema)
    parts = -(-total // item_bytes)
    if parts > 1:
        # a written table, so that each row falls into one part
        rows = cut(spark, rows.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts))), "items")
    for part in range(parts if docs else 0):
        mine = (rows.where(F.col("part") == part) if parts > 1 else rows).collect()
        out = out.unionByName(_search_part(index, corpus, mine, k, schema))
    return out


def _search_part(index: DataFrame, corpus: Corpus, rows: list, k: int, schema: str) -> DataFrame:
    spark, items = index.sparkSession, Items([r["text"] for r in rows])
    if not len(items):
        return spark.createDataFrame([], schema)
    items.weigh(corpus, _frequencies(index, spark.sparkContext.broadcast(items)))
    sent = spark.sparkContext.broadcast(items)
    only = _seeds(index, sent, corpus)
    blocks = F.broadcast(spark.createDataFrame([(b,) for b in only], "block bigint"))  # SEEDS an item
    least = [0] * len(items)
    first: list[list[int]] = [[] for _ in least]
    for r in _scored(index.join(blocks, "block", "left_semi"), sent, corpus, k, least, only).collect():  # k rows an item and seed
        first[r["item"]].append(r["score"])
    least = [sorted(s)[-k] if len(s) >= k else 0 for s in first]
    found = _scored(index, sent, corpus, k, least)
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    ranked = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    kind = schema.split(", ")[0]
    names = spark.createDataFrame([(item, rows[row]["item_id"]) for item, row in enumerate(items.rows)], f"item bigint, {kind}")
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """search_index over an index of docs(doc_id, text) that is written to the shared folder."""
    return search_index(cut(docs.sparkSession, build_index(docs), "index"), items, k)
