"""Codecs as pairs of column expressions, and codecs made of codecs: tuples, records, arrays. All of it is Catalyst's, at any depth.

    c = array_of(tuple_of(identity(), record_of(text("struct<a:int>"))))
    df.select(c.encode(F.col("x")).alias("raw")).select(attempt(c, F.col("raw")).alias("r")).select("r.value", "r.error")

Nulls stay null and empty arrays and records empty. decode() gives null for what it can't read, wherever that is inside; attempt() says whether there was such a part.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _whole(raw: Column, value: Column) -> Column:
    return raw.isNull() | value.isNotNull()


@dataclass(frozen=True)
class Codec:
    encode: Callable[[Column], Column]
    decode: Callable[[Column], Column]
    #: Whether all of a raw value was read, from it and what decode() gave.
    read: Callable[[Column, Column], Column] = _whole


def identity() -> Codec:
    return Codec(lambda c: c, lambda c: c)


def text(ddl: str) -> Codec:
    """Values of a type as JSON texts; a text that isn't such a value doesn't decode."""
    kept = "_broken"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": kept}
    schema = f"v {ddl}, {kept} string"

    def decode(c: Column) -> Column:
        parsed = F.from_json(F.concat(F.lit('{"v":'), c, F.lit("}")), schema, options)
        return F.when(parsed[kept].isNull(), parsed["v"])

    def encode(c: Column) -> Column:
        json = F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
        return F.when(c.isNotNull(), F.substring(json, F.lit(6), F.length(json) - 6))

    return Codec(encode, decode)


def parsed(parse: Callable[[Column], Column]) -> Codec:
    """Raw values as they are; decode() is the parser's, which gives null for what doesn't fit."""
    return Codec(lambda c: c, parse)


def tuple_of(*parts: Codec) -> Codec:
    names = [f"_{i + 1}" for i in range(len(parts))]
    every = lambda f: lambda c: F.when(c.isNotNull(), F.struct(*(f(p)(c[n]).alias(n) for p, n in zip(parts, names, strict=True))))

    def read(raw: Column, value: Column) -> Column:
        out = _whole(raw, value)
        for p, n in zip(parts, names, strict=True):
            out = out & (raw.isNull() | p.read(raw[n], value[n]))
        return out

    return Codec(every(lambda p: p.encode), every(lambda p: p.decode), read)


def record_of(value: Codec) -> Codec:
    """Maps from text."""

    def read(raw: Column, got: Column) -> Column:
        pairs = F.zip_with(F.map_values(raw), F.map_values(got), value.read)
        return _whole(raw, got) & (raw.isNull() | F.forall(pairs, lambda ok: ok))

    return Codec(lambda c: F.transform_values(c, lambda _, v: value.encode(v)), lambda c: F.transform_values(c, lambda _, v: value.decode(v)), read)


def array_of(item: Codec) -> Codec:
    def read(raw: Column, got: Column) -> Column:
        return _whole(raw, got) & (raw.isNull() | F.forall(F.zip_with(raw, got, item.read), lambda ok: ok))

    return Codec(lambda c: F.transform(c, item.encode), lambda c: F.transform(c, item.decode), read)


def attempt(codec: Codec, raw: Column) -> Column:
    """struct(value, error): the value and no error, or no value and the raw one as JSON."""
    value = codec.decode(raw)
    ok = F.coalesce(codec.read(raw, value), F.lit(False))
    return F.struct(F.when(ok, value).alias("value"), F.when(~ok, F.to_json(F.struct(raw.alias("raw")))).alias("error"))
