"""Encoding whole texts with the tokenizers library, through memories of chunks between white space and of words.

For a tokenizer that drops white space and splits words by its pattern, ids of a text are those of its chunks, one after
another. Chunks of plain texts are split into words here; words not yet seen are encoded by the library, by its model alone, past
the normaliser and splitter whose work is done by then. A chunk with a special token, or a character
outside the plain range, is encoded by the library on its own.

The memories are bounded (common.Recent): where words hardly repeat they cost time, not memory.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

from .common import Recent, use

#: Chunks in each generation of a worker's memory: some 15 MB.
MOST_CHUNKS = 100_000
#: Characters below this are always in normal form C; U+0130 has a lower-case form of two characters.
PLAIN_END = 0x250


def _of(*kinds: str) -> str:
    return "".join(rf"\u{c:04x}" for c in range(PLAIN_END) if unicodedata.category(chr(c))[0] in kinds)


_LETTERS, _NUMBERS = _of("L"), _of("N")
#: The splitting pattern of word_bpe_49k.json, for plain characters (fixed value).
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_NOT_PLAIN = re.compile(r"[^\x00-ɏ]|İ|<\|")
_ODD_ASCII = re.compile("[\x1c-\x1f]|<\\|")
_OWN_SPACE = re.compile("[\x1c-\x1f]")  # white space for str.split, not for the tokenizer
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def chunks_of(text: str | None) -> list[str]:
    text = text or ""
    return [c for c in _SPACE.split(text) if c] if _OWN_SPACE.search(text) else text.split()


def plain(text: str) -> str | None:
    """A text, or a part between white space, in lower case; None if only the library can split it."""
    if text.isascii():
        return None if _ODD_ASCII.search(text) else text.lower()
    if _NOT_PLAIN.search(text) or _OWN_SPACE.search(text):
        return None
    text = text.lower()
    return None if _NOT_PLAIN.search(text) else text


def plain_chunks(text: str | None) -> list[tuple[str, bool]] | list[str]:
    """The chunks between white space: in lower case if all are plain, or else pairs with whether they are."""
    text = text or ""
    if (lower := plain(text)) is not None:
        return lower.split()
    return [(c, False) if (lower := plain(c)) is None else (lower, True) for c in chunks_of(text)]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class LibraryEncoder:
    """batch(texts): their ids, as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str, most: int = MOST_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.model = self.tokenizer.model
        self.byte_level = str.maketrans({chr(b): c for b, c in enumerate(byte_chars())})
        self.chunks, self.words = Recent(most, self._chunk), Recent(most, self._word)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """Of a plain chunk in lower case."""
        words = WORD.findall(chunk)
        return self.words[chunk] if words == [chunk] else b"".join(map(self.words.__getitem__, words))

    def _word(self, word: str) -> bytes:
        """It goes straight to the library's model, in byte-level characters."""
        symbols = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.byte_level)
        return array("I", [t.id for t in self.model.tokenize(symbols)]).tobytes()

    def batch(self, texts: list[str | None]) -> list[bytes]:
        get, out = self.chunks.__getitem__, []
        for text in texts:
            split = plain_chunks(text)
            odd = split and isinstance(split[0], tuple)
            out.append(b"".join([get(c) if known else self.whole(c) for c, known in split] if odd else map(get, split)))
            self.chunks.age()
            self.words.age()
        return out


_encoders: dict[tuple[str, int], LibraryEncoder] = {}


def library_encoder(path: str, most: int = MOST_CHUNKS) -> LibraryEncoder:
    """One for each file in a worker, so that what it has learnt serves later tasks; to be called as a task begins. `most` bounds what it remembers."""
    if (path, most) not in _encoders:
        _encoders[path, most] = LibraryEncoder(path, most)
    own = _encoders[path, most]
    use(own.chunks, own.words)
    return own
