"""Packing documents into training sequences by vector bin packing.

An example demands tokens, one segment, and loss-bearing tokens; a sequence has a limit on each. The open sequence takes,
again and again, the example whose demand has the largest dot product with what is left of the limits, each dimension
divided by its limit and weighted by the mean demand. If no example fits whole, or only one segment is left, an example is
cut so that it fills the sequence. Documents whose rest exceeds a sequence are cut from their start, the longest first: they bear loss
all along, and come to the loss limit unless prompts of others, of which there are most at first, lie beside them.

As instruction data has it, an example begins with a prompt, whose tokens bear no loss: prompt() gives it for a text, by
default its first line, nothing for a text of one line.

Each task packs its own rows, WINDOW of them after one another; nothing is shuffled. What the examples at hand can't fill
waits for the next ones, unless it is the segment or the loss limit that keeps a sequence from being full: then it is closed
at a power of two. So are a task's last ones. Nothing is padded.

Defined results: a null or empty text is its end id; a very long text takes several sequences; rows are packed one by one, so
ties and repeated rows are separate examples and null identifiers stay null; an empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_batches
from .encode import MOST_CHUNKS, library_encoder

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: Examples that a task takes in before it packs.
WINDOW = 512


@dataclass(frozen=True)
class Limits:
    """Of a sequence."""

    tokens: int = 2048
    segments: int = 8
    loss_tokens: int = 1984


def first_line(text: str) -> str:
    return text[: max(0, text.find("\n"))]


class Packer:
    """add() examples, then take sequences: lists of (example, start, length). Example n has loss from position loss_from on."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.capacity = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.at = np.zeros((0, 4), np.int64)  # example, start, length, loss_from
        #: Sequences by what ended them: no token, segment or loss-bearing token was left, or no example was.
        self.ended = dict.fromkeys(("tokens", "segments", "loss_tokens", "examples"), 0)
        #: Sequences that came to each limit, one or several.
        self.reached = dict.fromkeys(("tokens", "segments", "loss_tokens"), 0)

    def _loss(self, at: np.ndarray) -> np.ndarray:
        return np.maximum(0, at[:, 1] + at[:, 2] - np.maximum(at[:, 1], at[:, 3]))

    def _most(self, at: np.ndarray, tokens: int, loss: int) -> np.ndarray:
        """How many of the examples' first tokens fit."""
        return np.minimum(np.minimum(at[:, 2], tokens), np.maximum(0, at[:, 3] - at[:, 1]) + loss)

    def add(self, examples: list[tuple[int, int, int, int]]) -> None:
        if examples:
            self.at = np.concatenate([self.at, np.array(examples, np.int64)])

    def sequences(self, last: bool = False) -> Iterator[list[tuple[int, int, int]]]:
        """Full sequences, and those that a limit keeps from being full; with last, what remains as well."""
        full = self.limits.tokens
        while len(self.at):
            lengths = self.at[:, 2]
            if not last and int(lengths.sum()) < full:
                return
            # with fewer tokens than a sequence, the largest power of two
            target = full if (total := int(lengths.sum())) >= full else 1 << (total.bit_length() - 1)
            pieces = self._fill(target)
            kept = sum(p[2] for p in pieces)
            if kept < target and kept & (kept - 1):  # the loss limit or the segments ran out: back to a power of two
                over, back = kept - (1 << (kept.bit_length() - 1)), []
                while over:
                    example, start, length, loss_from = pieces.pop()
                    cut = min(over, length)
                    back.append((example, start + length - cut, cut, loss_from))
                    over -= cut
                    if cut < length:
                        pieces.append((example, start, length - cut, loss_from))
                self.add(back)
            yield [p[:3] for p in pieces]

    def _fill(self, target: int) -> list[tuple[int, int, int, int]]:
        at, pieces = self.at, []
        alive = np.ones(len(at), bool)
        demand = np.stack([at[:, 2], np.ones(len(at)), self._loss(at)], 1) / self.capacity
        weight = demand.mean(0)
        left = [target, self.limits.segments, self.limits.loss_tokens]
        # the longest first, as what exceeds a sequence bears loss all along and needs the prompts of others beside it
        longest = int(np.argmax(at[:, 2])) if int(at[:, 2].max()) > target else None
        while left[0] and left[1] and left[2] >= 0 and alive.any():
            fits = alive & (at[:, 2] <= left[0]) & (demand[:, 2] * self.capacity[2] <= left[2] + 1e-6)
            if longest is not None:
                i, longest = longest, None
            elif left[1] > 1 and fits.any():
                score = demand @ (weight * np.array(left) / self.capacity)
                i = int(np.argmax(np.where(fits, score, -1.0)))
            else:  # the smallest of which enough tokens fit to fill what is left, or else the one of which most do
                fit = np.where(alive, self._most(at, left[0], left[2]), 0)
                enough = fit >= left[0]
                i = int(np.argmin(np.where(enough, at[:, 2], np.iinfo(np.int64).max)) if enough.any() else np.argmax(fit))
            take = int(self._most(at[i : i + 1], left[0], left[2])[0])
            if not take:
                break
            example, start, length, loss_from = (int(x) for x in at[i])
            pieces.append((example, start, take, loss_from))
            loss = max(0, start + take - max(start, loss_from))
            left = [left[0] - take, left[1] - 1, left[2] - loss]
            if take == length:
                alive[i] = False
            else:
                at[i, 1:3] = start + take, length - take
                demand[i] = np.array([length - take, 1, max(0, start + length - max(start + take, loss_from))]) / self.capacity
        self.at = at[alive]
        for k, rest in zip(self.reached, left, strict=True):
            self.reached[k] += not rest
        self.ended["tokens" if not left[0] else "segments" if not left[1] else "loss_tokens" if len(self.at) else "examples"] += 1
        return pieces


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), prompt: Callable[[str], str] | None = first_line, remember: int = MOST_CHUNKS) -> DataFrame:  # noqa: B008
    """Pieces of docs(doc_id, text) with their sequences; prompt gives the part of a text, from its start up to white space, that bears no loss; a worker remembers `remember` chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, end = library_encoder(tokenizer, remember), np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        packer = Packer(limits)
        held: dict[int, tuple] = {}  # examples that the packer still has
        rows: list[tuple] = []
        n = waiting = 0

        def put(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for example, start, length in pieces:
                doc_id, ids = held[example]
                rows.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, sequence, offset))
                offset += length
            sequence += 1

        def out(last: bool) -> pa.RecordBatch:
            nonlocal held
            for pieces in packer.sequences(last):
                put(pieces)
            alive = set(packer.at[:, 0].tolist())
            held = {k: v for k, v in held.items() if k in alive}
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in (part for whole in batches for part in slices(whole)):
            texts = batch.column(1).to_pylist()
            prompts = encoder.batch([prompt(t or "") for t in texts]) if prompt else [b""] * len(texts)
            examples = []
            for doc_id, ids, first in zip(batch.column(0).to_pylist(), encoder.batch(texts), prompts, strict=True):
                held[n] = (doc_id, ids + end)
                examples.append((n, 0, len(ids) // 4 + 1, len(first) // 4))
                n += 1
            packer.add(examples)
            waiting += len(examples)
            if waiting >= WINDOW:
                yield out(False)
                waiting = 0
        yield out(True)

    text_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
