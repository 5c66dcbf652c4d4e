"""Byte-pair encoding and decoding by forced-boundary splitting.

A merge makes a vocabulary token, so a pair of adjacent symbols that occurs inside no token is never merged across: a cut
between them is certain. Words are cut at all such places; the fragments are encoded independently by merges and
concatenated. Only a word's last fragment carries the end-of-word mark. Words and chunks between white space are remembered up to a bound.

decode() is the library's for a tokenizer without a decoder: token strings joined by spaces.

Defined results: a null or empty text has no ids and decodes to the empty string; a very long text is encoded whole, and is the one
row of its slice; rows are independent, so ties and
repeated rows don't matter; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .common import Recent, map_rows, use
from .encode import MOST_CHUNKS, WORD, byte_chars, plain_chunks


class BoundaryBPE:
    def __init__(self, path: str, most: int = MOST_CHUNKS):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): r for r, m in enumerate(model["merges"])}
        self.inside: set[str] = set()
        for token in self.vocab:
            bare = token.removesuffix(self.end) if self.end else token
            self.inside.update(map(str.__add__, bare, bare[1:]))
        self.tokens: list[str] = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for token, i in [*self.vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        self.bytes_of = [t.encode() for t in self.tokens]
        self.char = {b: c for b, c in enumerate(byte_chars())}
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.chunks, self.words = Recent(most, self._chunk), Recent(most, self.word)

    def cuts(self, symbols: str) -> list[str]:
        """Fragments between the certain cuts."""
        inside, out, a = self.inside, [], 0
        for i in range(1, len(symbols)):
            if symbols[i - 1 : i + 1] not in inside:
                out.append(symbols[a:i])
                a = i
        out.append(symbols[a:])
        return out

    def _fragment(self, symbols: str, last: bool) -> bytes:
        parts, rank = list(symbols), self.rank
        if last:
            parts[-1] += self.end
        none = len(rank)
        ranks = [rank.get(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = rank.get((parts[i], parts[i + 1]), none)
        # as in the library without an unknown token, symbols that the vocabulary lacks go
        return np.array([self.vocab[p] for p in parts if p in self.vocab], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        char = self.char
        *head, tail = self.cuts("".join([char[b] for b in word.encode()]))
        return b"".join([*(self._fragment(f, False) for f in head), self._fragment(tail, True)])

    def _odd(self, chunk: str) -> bytes:
        """Of a part between white space that isn't plain."""
        # special tokens are cut out of the raw text first; then the library normalises and splits, merges are ours
        out, rest = [], chunk
        while rest:
            found = min(((i, -len(s), s) for s in self.special if (i := rest.find(s)) >= 0), default=None)
            piece = rest[: found[0]] if found else rest
            normal = self.library.normalizer.normalize_str(piece)
            # the library's splitter has mapped bytes to characters already
            for symbols, _ in self.library.pre_tokenizer.pre_tokenize_str(normal):
                *head, tail = self.cuts(symbols)
                out += [*(self._fragment(f, False) for f in head), self._fragment(tail, True)]
            if not found:
                break
            out.append(np.array([self.special[found[2]]], "<u4").tobytes())
            rest = rest[found[0] + len(found[2]) :]
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        chunks, get = plain_chunks(text), self.chunks.__getitem__
        odd = chunks and isinstance(chunks[0], tuple)
        out = b"".join([get(c) if known else self._odd(c) for c, known in chunks] if odd else map(get, chunks))
        self.chunks.age()
        self.words.age()
        return out

    def _chunk(self, chunk: str) -> bytes:
        words = WORD.findall(chunk)
        return self.words[chunk] if words == [chunk] else b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """The text in UTF-8."""
        return b" ".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, int], BoundaryBPE] = {}


def codec(path: str, most: int = MOST_CHUNKS) -> BoundaryBPE:
    """One for each file in a worker; to be called as a task begins. `most` bounds what it remembers."""
    if (path, most) not in _codecs:
        _codecs[path, most] = BoundaryBPE(path, most)
    own = _codecs[path, most]
    use(own.chunks, own.words)
    return own


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_tokens, ids (binary), decoded (string)."""

    def start() -> Callable:
        c = codec(path)

        def f(doc_ids: list, texts: list) -> list[list]:
            ids = [c.encode(t) for t in texts]
            return [doc_ids, [len(i) // 4 for i in ids], ids, [c.decode(i).decode() for i in ids]]

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids binary, decoded string", start)


def digest_documents(docs: DataFrame, path: str, remember: int = MOST_CHUNKS) -> DataFrame:
    """As encode_documents, with digests in place of ids and texts."""

    def start() -> Callable:
        c = codec(path, remember)

        def f(doc_ids: list, texts: list) -> list[list]:
            n, coded, decoded = [], [], []
            for t in texts:
                ids = c.encode(t)
                n.append(len(ids) // 4)
                coded.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids)).hexdigest())
            return [doc_ids, n, coded, decoded]

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
