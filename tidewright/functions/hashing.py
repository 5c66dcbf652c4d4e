"""Hashes that must agree across processes: MurmurHash3, consistent-hash rings, canonical JSON digests."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .codecs import FLAGS, Undefined

# Constants of MurmurHash3, and the name of a node's i-th point on a ring.
_SCRAMBLE, _MIX, _FINISH = (0xCC9E2D51, 0x1B873593), 0xE6546B64, ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1))
POINT = "{node}#{i}"


def _rotated(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint32(r)) | (x >> np.uint32(32 - r))


def _scrambled(k: np.ndarray) -> np.ndarray:
    return _rotated(k * np.uint32(_SCRAMBLE[0]), 15) * np.uint32(_SCRAMBLE[1])


def murmur3_all(data: list[bytes], seed: int = 0) -> np.ndarray:
    """MurmurHash3 x86 32-bit, unsigned (public algorithm by A. Appleby), of many byte strings: all strings of one length at a time."""
    out, length = np.empty(len(data), np.uint32), np.fromiter(map(len, data), np.int64, len(data))
    for n in np.unique(length).tolist():
        at = np.flatnonzero(length == n)
        padded = np.frombuffer(b"".join([data[i] + bytes(-n % 4) for i in at]), "<u4").reshape(len(at), -1)
        h = np.full(len(at), seed & 0xFFFFFFFF, np.uint32)
        for block in range(n // 4):
            h = _rotated(h ^ _scrambled(padded[:, block]), 13) * np.uint32(5) + np.uint32(_MIX)
        if n % 4:
            h = h ^ _scrambled(padded[:, -1])
        h = h ^ np.uint32(n)
        for shift, factor in _FINISH:
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        out[at] = h
    return out


def murmur3_32(data: bytes, seed: int = 0) -> int:
    return int(murmur3_all([data], seed)[0])


def _hashed(s: pd.Series, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of texts, and where there are none."""
    none = s.isna().to_numpy()
    return murmur3_all([b"" if gone else x.encode() for x, gone in zip(s, none, strict=True)], seed), none


def hash32(text: Column, seed: int = 0) -> Column:
    @F.pandas_udf("bigint")
    def f(s: pd.Series) -> pd.Series:
        h, none = _hashed(s, seed)
        return pd.Series(pd.array(h.astype(np.int64), "Int64")).mask(none)

    return f(text)


@dataclass(frozen=True)
class HashRing:
    """Consistent hashing: each node has `vnodes` points, a key belongs to the first point at or after its hash, around."""

    nodes: tuple[str, ...]
    vnodes: int = 128

    @classmethod
    def of(cls, nodes: Iterable[str], vnodes: int = 128) -> HashRing:
        return cls(tuple(sorted(set(nodes))), vnodes)

    @cached_property
    def points(self) -> list[tuple[int, str]]:
        names = [(n, POINT.format(node=n, i=i).encode()) for n in self.nodes for i in range(self.vnodes)]
        return sorted(zip(murmur3_all([p for _, p in names]).tolist(), [n for n, _ in names], strict=True))

    def owners(self, key: str, count: int) -> list[str]:
        start = bisect_left(self.points, (murmur3_32(key.encode()),))
        around = self.points[start:] + self.points[:start]
        return list(dict.fromkeys(n for _, n in around))[:count]

    def owner(self, key: str) -> str | None:
        if not self.points:
            return None
        at = bisect_left(self.points, (murmur3_32(key.encode()),))
        return self.points[at % len(self.points)][1]

    def with_node(self, node: str) -> HashRing:
        return HashRing.of([*self.nodes, node], self.vnodes)

    def without_node(self, node: str) -> HashRing:
        return HashRing.of((n for n in self.nodes if n != node), self.vnodes)

    def moved(self, after: HashRing, keys: Iterable[str]) -> list[tuple[str, str | None, str | None]]:
        return [(k, a, b) for k in keys if (a := self.owner(k)) != (b := after.owner(k))]

    def owner_of(self, key: Column) -> Column:
        """The owner of each key of a column; the ring, of a fixed size, goes along with the function."""
        hashes, names = np.array([h for h, _ in self.points], np.uint32), np.array([n for _, n in self.points], object)

        @F.pandas_udf("string")
        def f(s: pd.Series) -> pd.Series:
            if not len(names):
                return pd.Series([None] * len(s), dtype=object)
            h, none = _hashed(s)
            return pd.Series(np.where(none, None, names[np.searchsorted(hashes, h) % len(names)]))

        return f(key)


def _number(x: float) -> str:
    """As JavaScript prints it: the shortest digits that read back as the same double."""
    if x != x:
        return '{"$nan":true}'
    if x in (float("inf"), float("-inf")):
        return '{"$inf":' + ("1" if x > 0 else "-1") + "}"
    if x == 0:
        return '{"$negzero":true}' if str(x).startswith("-") else "0"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    digits, _, exponent = repr(x).partition("e")
    if not exponent:
        return digits
    e = int(exponent)
    if -7 < e < 0:
        sign, digits = ("-", digits[1:]) if digits[0] == "-" else ("", digits)
        return f"{sign}0.{'0' * (-e - 1)}{digits.replace('.', '')}"
    return f"{digits.removesuffix('.0')}e{'+' if e > 0 else '-'}{abs(e)}"


def _units(text: str) -> bytes:
    """Sorts as the text's UTF-16 units do."""
    return text.encode("utf-16-be", "surrogatepass")


def _quoted(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def canonical_json(value: object, above: tuple[int, ...] = ()) -> str:
    """One text for equal values: sorted keys (by UTF-16 units), no spaces, shortest numbers. Kinds that JSON lacks are objects of one
    marked key (fixed values): $date (epoch ms), $map (a dict with keys that aren't strings), $set, $bigint (beyond 2**53), $regexp,
    $error, $undefined, $nan, $inf, $negzero. A value inside itself is an error."""
    if isinstance(value, (dict, list, tuple, set, frozenset)):
        if id(value) in above:
            raise ValueError("a value contains itself")
        above = (*above, id(value))
    inner = lambda v: canonical_json(v, above)
    match value:
        case dict() if all(isinstance(k, str) for k in value):
            return "{" + ",".join(f"{_quoted(k)}:{inner(value[k])}" for k in sorted(value, key=_units)) + "}"
        case dict():
            return '{"$map":[' + ",".join(f"[{k},{v}]" for k, v in sorted(((inner(k), inner(v)) for k, v in value.items()), key=lambda e: _units(e[0]))) + "]}"
        case list() | tuple():
            return "[" + ",".join(map(inner, value)) + "]"
        case set() | frozenset():
            return '{"$set":[' + ",".join(sorted(map(inner, value), key=_units)) + "]}"
        case None | bool():
            return json.dumps(value)
        case str():
            return _quoted(value)
        case int() if abs(value) > 1 << 53:
            return f'{{"$bigint":"{value}"}}'
        case int() | float():
            return _number(value)
        case dt.datetime():
            return f'{{"$date":{round((value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).timestamp() * 1000)}}}'
        case re.Pattern():
            return f'{{"$regexp":{_quoted(value.pattern)},"flags":{_quoted("".join(c for c, f in FLAGS.items() if value.flags & f))}}}'
        case BaseException():
            return f'{{"$error":{{"name":{_quoted(type(value).__name__)},"message":{_quoted(str(value))}}}}}'
        case Undefined():
            return '{"$undefined":true}'
    raise TypeError(f"{type(value).__name__} has no canonical form")


def canonical(json_text: Column) -> Column:
    """Canonical form of JSON texts; null where one doesn't parse."""

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else canonical_json(json.loads(x, parse_int=float))
        except ValueError:
            return None

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(one)

    return f(json_text)


def payload_hash(json_text: Column) -> Column:
    return F.sha2(canonical(json_text), 256)


def payload_hash_of(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()
