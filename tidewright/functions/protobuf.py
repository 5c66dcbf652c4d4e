"""Protocol Buffers wire format (public format) from declared messages, over Arrow columns.

    line = Message(number=Field(1, "int32"), quantity=Field(2, "double"))
    order = Message(key=Field(1, "int64"), lines=Field(2, line, repeated=True))
    df.select(encode(F.struct("key", "lines"), order).alias("bytes")).select(decode("bytes", order).alias("m")).select("m.value.*", "m.error")

Fields have explicit presence: a null isn't written, a default is. Repeated numbers are packed, and read packed or not; an empty list and a null one are the same on the wire and come back empty. Of a
field that comes twice the last one counts, of a nested message both are merged. Fields of other numbers come back as bytes in the column `unknown`, and are written after the known ones where
that column is given, so a message passes through a reader of an older schema whole. Malformed bytes give a null value and an error; null bytes give null and no error.

Columns are encoded field by field, all rows and all elements of nested lists together, and decoded by one field of all messages at a time, in arrays. Messages that
are malformed, or have unknown or packed fields, are decoded one by one.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
_U64 = (1 << 64) - 1
_FIXED = {"double": "<d", "float": "<f", "fixed32": "<I", "fixed64": "<Q", "sfixed32": "<i", "sfixed64": "<q"}
_VARINTS = ("int32", "int64", "uint32", "uint64", "sint32", "sint64", "bool", "enum")
#: Columns that hold each kind; unsigned ones of 64 bits keep their bits in a signed column.
_COLUMNS = {"double": "double", "float": "float", "fixed32": "bigint", "fixed64": "bigint", "sfixed32": "int", "sfixed64": "bigint", "int32": "int", "int64": "bigint", "uint32": "bigint", "uint64": "bigint", "sint32": "int", "sint64": "bigint", "bool": "boolean", "enum": "int", "string": "string", "bytes": "binary"}


@dataclass(frozen=True)
class Field:
    number: int
    kind: str | Message
    repeated: bool = False

    def __post_init__(self) -> None:
        if not (1 <= self.number < 1 << 29 and not 19_000 <= self.number < 20_000):
            raise ValueError(f"{self.number} is no field number")
        if isinstance(self.kind, str) and self.kind not in _COLUMNS:
            raise ValueError(f"no kind {self.kind!r}")

    @property
    def packed(self) -> bool:
        return self.repeated and isinstance(self.kind, str) and self.kind not in ("string", "bytes")

    @property
    def wire(self) -> int:
        """Of one value."""
        if isinstance(self.kind, Message) or self.kind in ("string", "bytes"):
            return 2
        return 0 if self.kind in _VARINTS else 1 if struct.calcsize(_FIXED[self.kind]) == 8 else 5

    def ddl(self) -> str:
        one = self.kind.ddl() if isinstance(self.kind, Message) else _COLUMNS[self.kind]
        return f"array<{one}>" if self.repeated else one


class Message:
    def __init__(self, **fields: Field):
        self.fields = fields
        self.by_number = {f.number: (n, f) for n, f in fields.items()}
        if len(self.by_number) < len(fields) or UNKNOWN in fields:
            raise ValueError(f"field numbers have to differ, and {UNKNOWN!r} is taken")

    def ddl(self) -> str:
        return f"struct<{', '.join(f'`{n}`:{f.ddl()}' for n, f in self.fields.items())}, {UNKNOWN}:binary>"


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _scalar(kind: str) -> Callable[[Any], bytes]:
    if kind in _FIXED:
        form, mask = _FIXED[kind], (1 << 32) - 1 if kind == "fixed32" else _U64
        return (lambda v: struct.pack(form, v & mask)) if kind in ("fixed32", "fixed64") else lambda v: struct.pack(form, v)
    if kind in ("sint32", "sint64"):
        return lambda v: varint((v << 1 ^ v >> 63) & _U64)
    if kind == "string":
        return lambda v: v.encode()
    return bytes if kind == "bytes" else lambda v: varint(int(v) & _U64)


class Malformed(ValueError):
    pass


def _varint_at(data: bytes, at: int, end: int) -> tuple[int, int]:
    n = shift = 0
    while at < end and shift < 70:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n & _U64, at
    raise Malformed(f"no varint ends before byte {at}")


def _number(kind: str, n: int) -> Any:
    if kind == "bool":
        return n != 0
    if kind in ("sint32", "sint64"):
        return n >> 1 ^ -(n & 1)
    if kind in ("int32", "enum"):
        n &= (1 << 32) - 1
        return n - (1 << 32) if n >> 31 else n
    if kind == "uint32":
        return n & (1 << 32) - 1
    return n - (1 << 64) if n >> 63 else n


def _one(field: Field, data: bytes, at: int, end: int, before: Any) -> tuple[Any, int]:
    """A value and where it ends; `before` is what a nested message is merged into."""
    if field.wire == 0:
        n, at = _varint_at(data, at, end)
        return _number(field.kind, n), at
    if field.wire == 2:
        n, at = _varint_at(data, at, end)
        if at + n > end:
            raise Malformed(f"{n} bytes at byte {at} are beyond byte {end}")
        if isinstance(field.kind, Message):
            return _decoded(data, at, at + n, field.kind, before), at + n
        body = data[at : at + n]
        if field.kind == "string":
            try:
                return body.decode(), at + n
            except UnicodeDecodeError as e:
                raise Malformed(f"the text at byte {at} is no UTF-8") from e
        return body, at + n
    form = _FIXED[field.kind]
    size = struct.calcsize(form)
    if at + size > end:
        raise Malformed(f"{size} bytes at byte {at} are beyond byte {end}")
    v = struct.unpack_from(form, data, at)[0]
    return (v - (1 << 64) if field.kind == "fixed64" and v >> 63 else v), at + size


def _skip(data: bytes, at: int, end: int, wire: int) -> int:
    if wire == 0:
        return _varint_at(data, at, end)[1]
    if wire not in (1, 2, 5):
        raise Malformed(f"no wire type {wire} at byte {at}")
    n, at = _varint_at(data, at, end) if wire == 2 else (8 if wire == 1 else 4, at)
    if at + n > end:
        raise Malformed(f"{n} bytes at byte {at} are beyond byte {end}")
    return at + n


def _decoded(data: bytes, at: int, end: int, message: Message, into: dict | None = None) -> dict:
    out = into if into is not None else {n: [] if f.repeated else None for n, f in message.fields.items()} | {UNKNOWN: b""}
    while at < end:
        start = at
        tag, at = _varint_at(data, at, end)
        name, field = message.by_number.get(tag >> 3, (None, None))
        if not tag >> 3:
            raise Malformed(f"field number 0 at byte {start}")
        if field is not None and field.packed and tag & 7 == 2:
            n, at = _varint_at(data, at, end)
            if at + n > end:
                raise Malformed(f"{n} bytes at byte {at} are beyond byte {end}")
            stop = at + n
            while at < stop:
                v, at = _one(field, data, at, stop, None)
                out[name].append(v)
        elif field is not None and tag & 7 == field.wire:
            v, at = _one(field, data, at, end, None if field.repeated else out[name])
            if field.repeated:
                out[name].append(v)
            else:
                out[name] = v
        else:
            at = _skip(data, at, end, tag & 7)
            out[UNKNOWN] += data[start:at]
    return out


def _parsed(data: bytes, message: Message) -> tuple[dict | None, str | None]:
    try:
        return _decoded(data, 0, len(data), message), None
    except Malformed as e:
        return None, str(e)


#: Bytes of values one after another: the size of each, and all together.
Sized = tuple[np.ndarray, np.ndarray]


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of each range, one after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _joined(*parts: Sized) -> Sized:
    """Each value's parts one after another."""
    sizes = np.sum([s for s, _ in parts], axis=0, dtype=np.int64)
    at, out = np.cumsum(sizes) - sizes, np.empty(int(sizes.sum()), np.uint8)
    for size, data in parts:
        out[_ranges(at, size)] = data
        at = at + size
    return sizes, out


def _varints(n: np.ndarray) -> Sized:
    size = np.ones(len(n), np.int64)
    for k in range(1, 10):
        size += n >= np.uint64(1 << 7 * k)
    k = np.arange(10)
    data = (n[:, None] >> (7 * k).astype(np.uint64)).astype(np.uint8) & 127 | np.where(k < size[:, None] - 1, 128, 0).astype(np.uint8)
    return size, data[k < size[:, None]]


def _prefixed(tag: int, bodies: Sized, sized: bool) -> Sized:
    size, prefix = bodies[0], np.frombuffer(varint(tag), np.uint8)
    tags = np.full(len(size), len(prefix), np.int64), np.tile(prefix, len(size))
    return _joined(tags, _varints(size.astype(np.uint64)), bodies) if sized else _joined(tags, bodies)


def _bytes_of(values: pa.Array) -> Sized:
    """Of texts or bytes without nulls."""
    large = pa.concat_arrays([values.cast(pa.large_string() if pa.types.is_string(values.type) else pa.large_binary())])
    at = np.frombuffer(large.buffers()[1], np.int64)[large.offset : large.offset + len(large) + 1]
    return np.diff(at), np.frombuffer(large.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]


def _bodies(values: pa.Array, kind: str | Message) -> Sized:
    """Each value's bytes without tag and length, of values without nulls."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.uint8)
    if isinstance(kind, Message):
        return _messages(values, kind)
    t = values.type
    if kind in ("string", "bytes") and t in (pa.string(), pa.binary(), pa.large_string(), pa.large_binary()):
        return _bytes_of(values)
    if kind in _VARINTS and (pa.types.is_signed_integer(t) or pa.types.is_boolean(t)):
        n = values.cast(pa.int64()).to_numpy(zero_copy_only=False)
        return _varints((n << 1 ^ n >> 63 if kind in ("sint32", "sint64") else n).view(np.uint64))
    if kind in ("double", "float") and pa.types.is_floating(t):
        v = values.to_numpy(zero_copy_only=False).astype(_FIXED[kind])
        return np.full(len(v), v.itemsize, np.int64), v.view(np.uint8)
    # fixed integers, and columns of other types than the kind's own
    each = list(map(_scalar(kind), values.to_pylist()))
    return np.array([len(b) for b in each], np.int64), np.frombuffer(b"".join(each), np.uint8)


def _messages(rows: pa.StructArray, message: Message) -> Sized:
    """Each struct's bytes, of structs without nulls."""
    n, parts = len(rows), []
    have = {rows.type.field(i).name: i for i in range(rows.type.num_fields)}
    for name, column in zip(have, rows.flatten(), strict=True):
        if name == UNKNOWN or name not in message.fields:
            continue
        field = message.fields[name]
        tag, size = field.number << 3 | (2 if field.packed else field.wire), np.zeros(n, np.int64)
        if not field.repeated:
            valid = column.is_valid()
            made = _prefixed(tag, _bodies(column.filter(valid), field.kind), field.wire == 2)
            size[valid.to_numpy(zero_copy_only=False)] = made[0]
        else:
            values = column.flatten()
            if values.null_count:
                raise ValueError(f"the repeated field {name!r} has a null")
            bodies = _bodies(values, field.kind)
            made = bodies if field.packed else _prefixed(tag, bodies, field.wire == 2)
            ends = np.cumsum(pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            size = np.diff(np.append(0, np.cumsum(made[0]))[np.append(0, ends)])
            if field.packed:
                some = size > 0
                made = _prefixed(tag, (size[some], made[1]), True)
                size[some] = made[0]
        parts.append((list(message.fields).index(name), (size, made[1])))
    if UNKNOWN in have:
        more = pa.compute.fill_null(rows.flatten()[have[UNKNOWN]], b"")
        parts.append((len(message.fields), _bytes_of(more)))
    return _joined(*(p for _, p in sorted(parts, key=lambda p: p[0]))) if parts else (np.zeros(n, np.int64), np.zeros(0, np.uint8))


def _array(size: np.ndarray, data: np.ndarray, valid: np.ndarray | None = None) -> pa.Array:
    at = np.append(0, np.cumsum(size)).astype(np.int64)
    large = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
    out = large.cast(pa.binary())
    return out if valid is None else pa.compute.if_else(pa.array(valid), out, pa.scalar(None, pa.binary()))


def encoded(rows: pa.StructArray, message: Message) -> pa.Array:
    """Bytes of structs."""
    valid = rows.is_valid()
    sizes, own = np.zeros(len(rows), np.int64), valid.to_numpy(zero_copy_only=False)
    made = _bodies(rows.filter(valid), message)
    sizes[own] = made[0]
    return _array(sizes, made[1], own)


def _varints_at(data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Varints that begin at each place, where they end, and whether they do."""
    n, at, ok = np.zeros(len(at), np.uint64), at.copy(), np.zeros(len(at), bool)
    left = np.arange(len(at))
    for shift in range(0, 70, 7):
        left = left[at[left] < end[left]]
        b = data[at[left]]
        n[left] |= (b & 127).astype(np.uint64) << np.uint64(shift)
        at[left] += 1
        ok[left[b < 128]] = True
        left = left[b > 127]
    return n, at, ok


def _numbers(kind: str, n: np.ndarray) -> np.ndarray:
    """As _number."""
    if kind == "bool":
        return n != 0
    if kind in ("sint32", "sint64"):
        return (n >> np.uint64(1)).astype(np.int64) ^ -(n & np.uint64(1)).astype(np.int64)
    low = (n & np.uint64((1 << 32) - 1)).astype(np.uint32)
    return low.view(np.int32) if kind in ("int32", "enum") else low.astype(np.int64) if kind == "uint32" else n.view(np.int64)


#: Messages that are left after FEW_AFTER fields, if fewer than FEW, are decoded one by one: they are long.
FEW, FEW_AFTER = 16, 64


def _columns(data: np.ndarray, start: np.ndarray, end: np.ndarray, message: Message, kind: pa.StructType) -> tuple[pa.StructArray, np.ndarray]:
    """Messages between places, and which of them are to be decoded one by one."""
    n, at, odd, steps = len(start), start.copy(), np.zeros(len(start), bool), 0
    found: dict[str, list[tuple]] = {name: [] for name in message.fields}
    live = np.flatnonzero(at < end)
    while len(live):
        steps += 1
        tags, after, ok = _varints_at(data, at[live], end[live])
        odd[live[~ok]] = True
        live, tags, after = live[ok], tags[ok], after[ok]
        if steps > FEW_AFTER and len(live) < FEW:
            odd[live] = True
            break
        for tag in np.unique(tags).tolist():
            here = tags == tag
            rows, place = live[here], after[here]
            name, field = message.by_number.get(tag >> 3, (None, None))
            if field is None or field.packed or tag & 7 != field.wire:
                odd[rows] = True
                continue
            if field.wire in (0, 2):
                value, place, ok = _varints_at(data, place, end[rows])
                size = value
                if field.wire == 2:
                    ok &= value <= (end[rows] - place).astype(np.uint64)
                    size = np.where(ok, value, 0).astype(np.int64)
                    value, place = place, place + size
            else:
                form = np.dtype(_FIXED[field.kind])
                ok = place + form.itemsize <= end[rows]
                value = np.where(ok, place, 0)
                size, place = value, place + form.itemsize
            odd[rows[~ok]] = True
            found[name].append((rows[ok], value[ok], size[ok]))
            at[rows] = place
        live = live[~odd[live]]
        live = live[at[live] < end[live]]

    columns = []
    for (name, field), column in zip(message.fields.items(), list(kind)[:-1], strict=True):
        empty = [np.zeros(0, np.int64)] * 3
        rows, value, size = map(np.concatenate, zip(*found[name], strict=True)) if found[name] else empty
        along = np.argsort(rows, kind="stable")
        one = column.type.value_type if field.repeated else column.type
        if not field.repeated and len(rows):  # the last of each row counts
            last = np.append(rows[along][1:] != rows[along][:-1], True)
            if isinstance(field.kind, Message):
                odd[rows[along][~last]] = True
            along = along[last]
        rows, value, size = rows[along], value[along], size[along]
        if isinstance(field.kind, Message):
            values, bad = _columns(data, value, value + size, field.kind, one)
            odd[rows[bad]] = True
        elif field.wire == 2:
            values = _array(size, data[_ranges(value, size)])
            if field.kind == "string":
                try:
                    values = values.cast(pa.string())
                except pa.ArrowInvalid:
                    good = [_is_text(b) for b in values.to_pylist()]
                    odd[rows[~np.array(good)]] = True
                    values = pa.compute.if_else(pa.array(good), values, b"").cast(pa.string())
        else:
            if field.wire == 0:
                values = _numbers(field.kind, value.astype(np.uint64))
                if field.kind == "sint32":
                    wide = values != values.astype(np.int32)
                    odd[rows[wide]] = True
                    values = np.where(wide, 0, values)
            else:
                form = np.dtype(_FIXED[field.kind])
                values = np.ascontiguousarray(data[value[:, None] + np.arange(form.itemsize)]).view(form).reshape(len(value))
                values = values.view(np.int64) if field.kind == "fixed64" else values
            values = pa.array(values).cast(one)
        if field.repeated:
            ends = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
            columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, type=column.type))
        else:
            place = np.full(n, -1)
            place[rows] = np.arange(len(rows))
            columns.append(values.take(pa.array(place, pa.int64(), mask=place < 0)))
    columns.append(pa.array([b""] * n, pa.binary()))
    return pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind)) if n else pa.array([], kind), odd


def _is_text(data: bytes) -> bool:
    try:
        data.decode()
    except UnicodeDecodeError:
        return False
    return True


def decoded(rows: pa.Array, message: Message, kind: pa.StructType) -> pa.Array:
    """struct(value, error) of bytes."""
    valid = rows.is_valid()
    size, data = _bytes_of(pa.compute.fill_null(rows, b""))
    end = np.cumsum(size)
    fast, odd = _columns(data, end - size, end, message, kind.field(0).type)
    odd &= valid.to_numpy(zero_copy_only=False)
    value, error = fast, pa.nulls(len(rows), pa.string())
    if odd.any():
        each = [_parsed(b, message) for b in rows.filter(pa.array(odd)).to_pylist()]
        place = np.where(odd, len(rows) + np.cumsum(odd) - 1, np.arange(len(rows)))
        value = pa.concat_arrays([fast, pa.array([v for v, _ in each], fast.type)]).take(pa.array(place))
        error = pa.concat_arrays([error, pa.array([e for _, e in each], pa.string())]).take(pa.array(place))
    value = value.take(pa.array(np.arange(len(rows)), pa.int64(), mask=~valid.to_numpy(zero_copy_only=False)))
    return pa.StructArray.from_arrays([value, error], fields=list(kind))


def encode(column: Column | str, message: Message) -> Column:
    """Bytes of a struct with the message's fields (those that it lacks are left out)."""

    @F.arrow_udf("binary")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield encoded(rows, message)

    return f(column)


def decode(column: Column | str, message: Message) -> Column:
    """struct(value, error) of bytes."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"struct<value:{message.ddl()}, error:string>"
    kind = to_arrow_type(_parse_datatype_string(ddl))

    @F.arrow_udf(ddl)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            yield decoded(rows, message, kind)

    return f(column)
