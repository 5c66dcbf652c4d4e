"""Words of a text as bytes, and hashes of their shingles.

ASCII is handled by byte tables; bytes of 0x80 and above, which only other characters have, always belong to words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: A-Z to a-z; every ASCII character that is no letter or digit to a space.
ALNUM = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))
_MUL = np.uint64(0x9E3779B97F4A7C15)


def alnum_words(text: str | None) -> list[bytes]:
    r"""`[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z in lower case."""
    return (text or "").encode().translate(ALNUM).split()


def space_words(text: str | None) -> list[bytes]:
    r"""`[^\x20\x09-\x0D]+` of the text."""
    return (text or "").encode().split()


def lower_space_words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words by their words' hashes, in order; with fewer words, of the whole sequence as one."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    h = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        h = (h ^ words[i : n - k + 1 + i]) * _MUL
        h ^= h >> np.uint64(29)
    return mixed(h)


# 64-bit word hashes by a polynomial over mixed bytes, modulo 2**64, for all words of many texts at once. Modulo a power of two
# some words collide whatever the base: words of two letters in Thue and Morse's order, from 1,024 bytes on. So only short words are hashed that way.
_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * _MUL)
_LOWER_CODES = _CODES[np.frombuffer(bytes(range(256)).lower(), np.uint8)]
_BASE = 0x9E3779B97F4A7C1B
#: Words of more bytes are hashed by xxh3, one by one; others in blocks of about BLOCK bytes.
_LONG, _BLOCK = 64, 1 << 17
_powers: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse."""
    if not _powers:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(_BLOCK + _LONG + 1, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, nulls empty, and where each begins; the last number is the end."""
    texts = pc.fill_null(texts, "")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    r"""Hashes of the words `[^\x20\x09-\x0D]+` of all texts one after another, with A-Z in lower case if `lower`, and the number of words before each text."""
    data, at = text_bytes(texts)
    begins = ~_SPACE[data]
    ends = np.append(begins, False)  # ends[i]: a word ends before i
    edge = at[(at > 0) & (at < len(data))]
    before = np.concatenate([[False], begins])
    before[edge] = False
    after = ends.copy()
    after[edge] = False
    # a word begins where no word byte of the same text stands before, and ends where none follows
    start = np.flatnonzero(begins & ~before[:-1])
    end = np.flatnonzero(begins & ~after[1:]) + 1
    codes, (up, down) = _LOWER_CODES if lower else _CODES, _tables()
    out, long = np.empty(len(start), np.uint64), end - start > _LONG
    for i in np.flatnonzero(long).tolist():
        word = data[start[i] : end[i]].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(word.lower() if lower else word)
    short = np.flatnonzero(~long)
    s, e, i = start[short], end[short], 0
    while i < len(s):
        stop = int(np.searchsorted(s, s[i] + _BLOCK, side="left"))
        first, last = int(s[i]), int(e[stop - 1])
        sums = np.zeros(last - first + 1, np.uint64)
        np.cumsum(codes[data[first:last]] * up[: last - first], out=sums[1:])
        own = s[i:stop] - first
        out[short[i:stop]] = mixed((sums[e[i:stop] - first] - sums[own]) * down[own])
        i = stop
    return out, np.searchsorted(start, at)


def runs(hashes: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """shingle_hashes of each text's words; `at` as word_hashes gives it."""
    n = len(hashes)
    every = shingle_hashes(hashes, k) if n >= k else hashes[:0]
    return [every[a : b - k + 1] if b - a >= k else shingle_hashes(hashes[a:b], k) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
