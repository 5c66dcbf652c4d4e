"""Lossless JSON, binary frames and base64.

Lossless JSON writes values that JSON lacks as {"__t": tag, "v": value}; an object with a key "__t" of its own is wrapped
as "raw". Python stands in for the value kinds: float, int beyond 2**53 (bigint), datetime (date), set, dict with keys that aren't
strings (map), re.Pattern (regexp), Exception (error), UNDEFINED.
"""

from __future__ import annotations

import base64
import datetime as dt
import json
import re
import struct
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Undefined:
    def __repr__(self) -> str:
        return "UNDEFINED"


UNDEFINED = Undefined()
# The tag, its kinds below, and the flags of patterns.
_TAG, _SAFE = "__t", 1 << 53
FLAGS = {"i": re.I, "m": re.M, "s": re.S}


def _tagged(kind: str, *value: Any) -> dict:
    return {_TAG: kind} | ({"v": value[0]} if value else {})


def _odd_float(x: float) -> str | None:
    return "nan" if x != x else "inf" if x == float("inf") else "-inf" if x == float("-inf") else "-0" if x == 0 and str(x)[0] == "-" else None


def to_plain(x: Any) -> Any:
    """A value that json can write."""
    if isinstance(x, Undefined):
        return _tagged("undefined")
    if isinstance(x, float):
        return _tagged(k) if (k := _odd_float(x)) else x
    if x is None or isinstance(x, (bool, str)):
        return x
    if isinstance(x, int):
        return x if -_SAFE <= x <= _SAFE else _tagged("bigint", str(x))
    if isinstance(x, dt.datetime):
        utc = x.astimezone(dt.timezone.utc)
        return _tagged("date", f"{utc:%Y-%m-%dT%H:%M:%S}.{utc.microsecond // 1000:03d}Z")
    if isinstance(x, (set, frozenset)):
        return _tagged("set", [to_plain(v) for v in x])
    if isinstance(x, re.Pattern):
        return _tagged("regexp", {"source": x.pattern, "flags": "".join(c for c, f in FLAGS.items() if x.flags & f)})
    if isinstance(x, BaseException):
        return _tagged("error", {"name": type(x).__name__, "message": str(x), "stack": None})
    if isinstance(x, (list, tuple)):
        return [to_plain(v) for v in x]
    if isinstance(x, dict):
        if not all(isinstance(k, str) for k in x):
            return _tagged("map", [[to_plain(k), to_plain(v)] for k, v in x.items()])
        inner = {k: to_plain(v) for k, v in x.items()}
        return _tagged("raw", inner) if _TAG in x else inner
    raise TypeError(f"a {type(x).__name__} has no lossless form")


_READ: dict[str, Callable[[Any], Any]] = {
    "undefined": lambda _: UNDEFINED,
    "nan": lambda _: float("nan"),
    "inf": lambda _: float("inf"),
    "-inf": lambda _: float("-inf"),
    "-0": lambda _: -0.0,
    "bigint": int,
    "date": dt.datetime.fromisoformat,
    "url": str,
    "set": lambda v: {from_plain(x) for x in v},
    "map": lambda v: {from_plain(k): from_plain(x) for k, x in v},
    "regexp": lambda v: re.compile(v["source"], sum(FLAGS.get(c, 0) for c in v["flags"])),
    "error": lambda v: Exception(v["message"]),
    "raw": lambda v: {k: from_plain(x) for k, x in v.items()},
}


def from_plain(x: Any) -> Any:
    if isinstance(x, list):
        return [from_plain(v) for v in x]
    if not isinstance(x, dict):
        return x
    read = _READ.get(x[_TAG]) if isinstance(x.get(_TAG), str) else None
    return read(x.get("v")) if read else {k: from_plain(v) for k, v in x.items()}


def dumps(x: Any) -> str:
    return json.dumps(to_plain(x), ensure_ascii=False, separators=(",", ":"), allow_nan=False)


def loads(text: str) -> Any:
    return from_plain(json.loads(text))


def to_base64(data: Column) -> Column:
    """Without line breaks, whatever spark.sql.chunkBase64String.enabled is."""
    return F.regexp_replace(F.base64(data), "[\r\n]", "")


class FrameTooLarge(ValueError):
    pass


def frames(data: bytes, header: int = 4, little: bool = False, most: int = 16 << 20) -> Iterator[bytes]:
    """Length-prefixed frames of a whole byte string; an unfinished last frame is dropped."""
    at, order = 0, "little" if little else "big"
    while at + header <= len(data):
        n = int.from_bytes(data[at : at + header], order)
        if n > most:
            raise FrameTooLarge(f"a frame of {n} bytes; the limit is {most}")
        if at + header + n > len(data):
            return
        yield data[at + header : at + header + n]
        at += header + n


def frame(payload: bytes, header: int = 4, little: bool = False, most: int = 16 << 20) -> bytes:
    if len(payload) > min(most, (1 << 8 * header) - 1):
        raise FrameTooLarge(f"a frame of {len(payload)} bytes")
    return len(payload).to_bytes(header, "little" if little else "big") + payload


def split_frames(df: DataFrame, column: str, header: int = 4, little: bool = False, most: int = 16 << 20) -> DataFrame:
    """Adds frame_no and frame, a row for each frame of the binary column."""

    @F.pandas_udf("array<binary>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda b: None if b is None else list(frames(bytes(b), header, little, most)))

    return df.select("*", F.posexplode(f(F.col(column))).alias("frame_no", "frame"))


def join_frames(frame_column: Column, header: int = 4, little: bool = False) -> Column:
    """Encoded frame of each binary value, in JVM expressions."""
    size = F.lpad(F.hex(F.length(frame_column)), 2 * header, "0")
    if little:
        size = F.concat(*(F.substring(size, 2 * i + 1, 2) for i in reversed(range(header))))
    return F.concat(F.unhex(size), frame_column)


def pack_message(x: Any) -> bytes:
    """MessagePack (public format): nil, booleans, integers, doubles, texts, bytes, arrays, maps."""
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        if -32 <= x < 128:
            return struct.pack("b" if x < 0 else "B", x)
        signs = ((0xD0, "b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q")) if x < 0 else ((0xCC, "B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q"))
        for code, form in signs:
            try:
                return bytes([code]) + struct.pack(form, x)
            except struct.error:
                continue
        raise OverflowError(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)

    def sized(n: int, fix: tuple[int, int] | None, codes: tuple[int | None, int, int]) -> bytes:
        if fix and n <= fix[1]:
            return bytes([fix[0] | n])
        for code, form, most in zip(codes, ("B", ">H", ">I"), (255, 65535, (1 << 32) - 1), strict=True):
            if code is not None and n <= most:
                return bytes([code]) + struct.pack(form, n)
        raise OverflowError(n)

    if isinstance(x, str):
        raw = x.encode()
        return sized(len(raw), (0xA0, 31), (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(x, (bytes, bytearray)):
        return sized(len(x), None, (0xC4, 0xC5, 0xC6)) + bytes(x)
    if isinstance(x, dict):
        return sized(len(x), (0x80, 15), (None, 0xDE, 0xDF)) + b"".join(pack_message(k) + pack_message(v) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        return sized(len(x), (0x90, 15), (None, 0xDC, 0xDD)) + b"".join(map(pack_message, x))
    raise TypeError(type(x).__name__)


def unpack_message(data: bytes) -> Any:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ValueError("the message is cut short")
        at += n
        return data[at - n : at]

    def number(form: str) -> Any:
        return struct.unpack(form, take(struct.calcsize(form)))[0]

    def items(n: int) -> list:
        return [read() for _ in range(n)]

    def table(n: int) -> dict:
        return dict((read(), read()) for _ in range(n))

    forms = {0xCA: ">f", 0xCB: ">d", 0xCC: "B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: "b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    sizes = {0xC4: "B", 0xC5: ">H", 0xC6: ">I", 0xD9: "B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}

    def read() -> Any:
        c = take(1)[0]
        if c < 0x80:
            return c
        if c >= 0xE0:
            return c - 256
        if c < 0x90:
            return table(c & 15)
        if c < 0xA0:
            return items(c & 15)
        if c < 0xC0:
            return take(c & 31).decode()
        if c in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[c]
        if c in forms:
            return number(forms[c])
        if c in sizes:
            n = number(sizes[c])
            return take(n) if c <= 0xC6 else take(n).decode() if c <= 0xDB else items(n) if c <= 0xDD else table(n)
        raise ValueError(f"code {c:#x} is not supported")

    out = read()
    if at != len(data):
        raise ValueError("bytes after the message")
    return out


def packed(json_text: Column) -> Column:
    """MessagePack of lossless JSON texts; null where one doesn't parse."""

    @F.pandas_udf("binary")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _tried(lambda: pack_message(loads(x))), na_action="ignore")

    return f(json_text)


def unpacked(data: Column) -> Column:
    """Lossless JSON texts of MessagePack; null where it is malformed."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _tried(lambda: dumps(unpack_message(bytes(x)))), na_action="ignore")

    return f(data)


def _tried(f: Callable[[], Any]) -> Any:
    try:
        return f()
    except (ValueError, IndexError, TypeError):
        return None


def base64_text(text: str) -> str:
    return base64.b64encode(text.encode()).decode()
