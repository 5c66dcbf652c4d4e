"""Token counts by greedy longest-match word pieces, without building the pieces.

A trie holds the vocabulary, continuation pieces below a node of their own. Each node has a failure link and the number of
pieces that are popped on following it, both computed beforehand, so a word is read once, character by character, in
linear time. Counts of words are remembered up to a bound.

Pieces come from a byte-level vocabulary: a token with the space mark begins a word, any other continues one. A word is
UTF-8 bytes between white space (ASCII), in lower case for A-Z; if greedy matching fails anywhere, the word is one
unknown piece.

Defined results: a null or empty text counts 0; a very long text, or word, is counted whole; rows are independent, so ties and repeated rows don't matter; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import Recent, map_rows, use
from .encode import byte_chars
from .words import lower_space_words

MARK = "Ġ"


def vocabulary(path: str) -> tuple[set[bytes], set[bytes]]:
    """Pieces that begin a word and pieces that continue one, as bytes."""
    byte = {c: b for b, c in enumerate(byte_chars())}
    begin, go_on = set(), set()
    for token in json.load(open(path, encoding="utf-8"))["model"]["vocab"]:
        bare, kind = (token[1:], begin) if token.startswith(MARK) else (token, go_on)
        if bare and all(c in byte for c in bare):
            kind.add(bytes([byte[c] for c in bare]))
    return begin, go_on


class LongestMatch:
    """Children, failure link and popped count by node; node 0 begins words, node 1 continues them."""

    def __init__(self, begin: set[bytes], go_on: set[bytes], most: int = 200_000):
        self.next: list[dict[int, int]] = [{}, {}]
        ends: list[bool] = [False, False]
        for root, pieces in ((0, begin), (1, go_on)):
            for p in sorted(pieces):
                at = root
                for b in p:
                    if b not in self.next[at]:
                        self.next[at][b] = len(self.next)
                        self.next.append({})
                        ends.append(False)
                    at = self.next[at][b]
                ends[at] = True
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        todo = deque((root, b, child) for root in (0, 1) for b, child in self.next[root].items())
        while todo:
            parent, b, at = todo.popleft()
            if ends[at]:
                self.fail[at], self.popped[at] = 1, 1
            else:
                f, n = self.fail[parent], self.popped[parent]
                while f >= 0 and b not in self.next[f]:
                    n += self.popped[f]
                    f = self.fail[f]
                if f >= 0:
                    self.fail[at], self.popped[at] = self.next[f][b], n
            todo.extend((at, c, child) for c, child in self.next[at].items())
        self.known = Recent(most, self.pieces)

    def pieces(self, word: bytes) -> int:
        """Number of greedy longest-match pieces; 1, the unknown piece, if they don't cover the word."""
        at, n, follow, fail, popped = 0, 0, self.next, self.fail, self.popped
        for b in word:
            while b not in follow[at]:
                if fail[at] < 0:
                    return 1
                n += popped[at]
                at = fail[at]
            at = follow[at][b]
        while at > 1:
            if fail[at] < 0:
                return 1
            n += popped[at]
            at = fail[at]
        return n if at == 1 else int(bool(word))

    def count(self, words: list[bytes]) -> int:
        n = sum(map(self.known.__getitem__, words))
        self.known.age()
        return n


_made: dict[str, LongestMatch] = {}


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_words, n_tokens."""

    def start() -> Callable:
        if path not in _made:
            _made[path] = LongestMatch(*vocabulary(path))
        counter = _made[path]
        use(counter.known)

        def f(ids: list, texts: list) -> list[list]:
            split = [lower_space_words(t) for t in texts]
            return [ids, [len(w) for w in split], [counter.count(w) for w in split]]

        return f

    return map_rows(docs, ["doc_id", "text"], "doc_id bigint, n_words bigint, n_tokens bigint", start)
