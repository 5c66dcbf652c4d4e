"""Protocol Buffers against the public library, and composed codecs."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.functions import composed
from tidewright.functions import protobuf as pb

LINE = pb.Message(number=pb.Field(1, "sint32"), price=pb.Field(2, "double"), note=pb.Field(16, "string"))
ORDER = pb.Message(
    key=pb.Field(1, "int64"), status=pb.Field(2, "string"), flags=pb.Field(3, "int32", repeated=True), lines=pb.Field(4, LINE, repeated=True), first=pb.Field(5, LINE),
    raw=pb.Field(6, "bytes"), big=pb.Field(7, "uint64"), z=pb.Field(8, "sint64"), ok=pb.Field(9, "bool"), f=pb.Field(10, "float"), x=pb.Field(11, "fixed32"), y=pb.Field(12, "sfixed64"), names=pb.Field(13, "string", repeated=True), d=pb.Field(100, "double", repeated=True),
)


def library():
    """The same messages for the public library."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    file, kinds = descriptor_pb2.FileDescriptorProto(name="t.proto", package="t", syntax="proto3"), descriptor_pb2.FieldDescriptorProto
    for name, message in (("Line", LINE), ("Order", ORDER)):
        m = file.message_type.add(name=name)
        for n, f in message.fields.items():
            nested = isinstance(f.kind, pb.Message)
            field = m.field.add(name=n, number=f.number, type=kinds.TYPE_MESSAGE if nested else getattr(kinds, f"TYPE_{f.kind.upper()}"), label=kinds.LABEL_REPEATED if f.repeated else kinds.LABEL_OPTIONAL)
            if nested:
                field.type_name = ".t.Line"
            elif not f.repeated:
                m.oneof_decl.add(name=f"_{n}")
                field.oneof_index, field.proto3_optional = len(m.oneof_decl) - 1, True
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("t.Order"))


def rows():
    rng = random.Random(9)
    line = lambda: rng.choice([None, (rng.randint(-(2**31), 2**31 - 1), rng.random(), rng.choice([None, "", "é𝒳", "x" * 300]))])
    some = lambda v: v if rng.random() < 0.7 else None
    out = []
    for _ in range(300):
        lines = [x for x in (line() for _ in range(rng.randint(0, 4))) if x]
        out.append((some(rng.choice([0, -1, 2**63 - 1, -(2**63), rng.randint(-999, 999)])), some(rng.choice(["", "open", "\u0000ü"])), [rng.randint(-(2**31), 2**31 - 1) for _ in range(rng.randint(0, 5))], lines, line(), some(bytearray(rng.randbytes(rng.randint(0, 200)))), some(rng.choice([0, -1, 2**62])), some(rng.randint(-(2**63), 2**63 - 1)), some(rng.random() < 0.5), some(0.5), some(rng.choice([0, 2**32 - 1])), some(-5), rng.choice([[], ["", "a"]]), [1.5] * rng.randint(0, 2)))
    return out


SCHEMA = "key bigint, status string, flags array<int>, lines array<struct<number:int,price:double,note:string>>, first struct<number:int,price:double,note:string>, raw binary, big bigint, z bigint, ok boolean, f float, x bigint, y bigint, names array<string>, d array<double>"


def test_protobuf_against_the_library(spark):
    given = rows()
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    coded = df.select("*", pb.encode(F.struct(*df.columns), ORDER).alias("bytes")).cache()
    back = coded.select(*df.columns, "bytes", pb.decode("bytes", ORDER).alias("m"))
    order, plain = library(), lambda v: bytes(v) if isinstance(v, bytearray) else v
    for r in back.collect():
        value = r["m"]["value"]
        assert r["m"]["error"] is None and bytes(value["unknown"]) == b""
        for n in df.columns:
            if n == "lines":
                assert [tuple(x)[:3] for x in value[n]] == [tuple(x) for x in r[n]]
            elif n == "first":
                assert (value[n] and tuple(value[n])[:3]) == (r[n] and tuple(r[n]))
            else:
                assert plain(value[n]) == plain(r[n]), n
        m = order.FromString(bytes(r["bytes"]))
        assert m.SerializeToString(deterministic=True) == bytes(r["bytes"]) and len(m.lines) == len(r["lines"])
        assert list(m.flags) == r["flags"] and m.HasField("key") == (r["key"] is not None) and (r["key"] is None or m.key == r["key"])
        assert r["big"] is None or m.big == r["big"] % 2**64


def test_unknown_fields_pass_through(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    older = pb.Message(status=pb.Field(2, "string"))
    coded = df.select(pb.encode(F.struct(*df.columns), ORDER).alias("a"))
    through = coded.select("a", pb.decode("a", older)["value"].alias("v")).select("a", pb.encode("v", older).alias("b")).select(pb.decode("a", ORDER)["value"].alias("x"), pb.decode("b", ORDER)["value"].alias("y"))
    assert through.where(~F.col("x").eqNullSafe(F.col("y"))).isEmpty()


def test_malformed_protobuf_is_a_value(spark):
    bad = [b"\x08", b"\x12\x05ab", b"\x12\x02\xff\xfe", b"\x00\x01", b"\x0b", b"\x22\x02\x08", b"\x59\x01", bytes([8] + [255] * 11)]
    df = spark.createDataFrame([(bytearray(b),) for b in bad] + [(None,), (bytearray(b""),)], "bytes binary")
    out = df.select(pb.decode("bytes", ORDER).alias("m")).collect()
    assert all(r["m"]["value"] is None and r["m"]["error"] for r in out[: len(bad)])
    assert out[-2]["m"]["value"] is None and out[-2]["m"]["error"] is None and out[-1]["m"]["value"]["key"] is None and out[-1]["m"]["error"] is None
    # the last of a field counts, nested messages are merged, numbers may come unpacked
    twice = bytearray(b"\x08\x01\x08\x02" + b"\x18\x05\x1a\x02\x06\x07" + b"\x2a\x02\x08\x02" + b"\x2a\x04\x82\x01\x01x")
    v = spark.createDataFrame([(twice,)], "b binary").select(pb.decode("b", ORDER)["value"].alias("v")).first()["v"]
    assert (v["key"], v["flags"], v["first"]["number"], v["first"]["note"]) == (2, [5, 6, 7], 1, "x")
    with pytest.raises(ValueError, match="number"):
        pb.Field(19_500, "bool")


def test_composed_codecs(spark):
    codec = composed.array_of(composed.tuple_of(composed.identity(), composed.record_of(composed.text("struct<a:int,b:array<string>>"))))
    given = [([(1, {"x": (1, ["p", None]), "y": None}), (2, {})],), ([],), (None,), ([None, (None, None)],), ([(3, {"z": (None, [])})],)]
    df = spark.createDataFrame(given, "v array<struct<_1:int,_2:map<string,struct<a:int,b:array<string>>>>>")
    coded = df.select("v", codec.encode(F.col("v")).alias("raw"))
    assert dict(coded.dtypes)["raw"] == "array<struct<_1:int,_2:map<string,string>>>"
    out = coded.select("v", composed.attempt(codec, F.col("raw")).alias("r")).collect()
    assert all(r["r"]["value"] == r["v"] and r["r"]["error"] is None for r in out)
    broken = coded.select(F.transform("raw", lambda t: F.struct(t["_1"].alias("_1"), F.transform_values(t["_2"], lambda k, v: F.when(k == "z", F.lit("{oops")).otherwise(v)).alias("_2"))).alias("raw"))
    out = broken.select(composed.attempt(codec, F.col("raw")).alias("r")).collect()
    assert [r["r"]["error"] is not None for r in out] == [False, False, False, False, True] and "oops" in out[4]["r"]["error"] and out[4]["r"]["value"] is None
    digits = composed.parsed(lambda c: c.try_cast("int"))
    got = spark.createDataFrame([("1",), ("x",), (None,)], "s string").select(composed.attempt(digits, F.col("s")).alias("r")).collect()
    assert [(r["r"]["value"], r["r"]["error"]) for r in got] == [(1, None), (None, '{"raw":"x"}'), (None, None)]


def test_columns_decode_as_one_by_one(spark):
    """all messages were decoded in Python, byte by byte; now only those that are malformed, merged or have packed or unknown fields."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    rng, kind = random.Random(3), to_arrow_type(_parse_datatype_string(f"struct<value:{ORDER.ddl()}, error:string>"))
    given = to_arrow_type(_parse_datatype_string(f"struct<{SCHEMA.replace(' ', ':').replace(',:', ',')}>"))
    names = SCHEMA.split(", ")
    structs = pa.array([dict(zip((x.split()[0] for x in names), (bytes(v) if isinstance(v, bytearray) else [dict(zip(("number", "price", "note"), t, strict=True)) for t in v] if n == 3 else dict(zip(("number", "price", "note"), v, strict=True)) if n == 4 and v else v for n, v in enumerate(r)), strict=True)) for r in rows()] + [None], given)
    good = pb.encoded(structs, ORDER)
    assert good.to_pylist()[-1] is None and pb.encoded(structs.slice(5, 20), ORDER).to_pylist() == good.to_pylist()[5:25]
    assert pb.encoded(structs.slice(0, 0), ORDER).to_pylist() == [] and len(pb.decoded(good.slice(0, 0), ORDER, kind)) == 0
    messages = good.to_pylist()
    for m in messages[:300]:
        bad = bytearray(m)
        for _ in range(rng.randint(0, 3)):
            if bad:
                bad[rng.randrange(len(bad))] = rng.randrange(256)
        messages += [bytes(bad), m[: rng.randint(0, len(m))], m + messages[rng.randrange(300)], bytes(bad) + m]
    want, kept = [], []
    for m in messages:
        try:  # numbers beyond their kind's column fail as before
            want += pa.array([dict(zip(("value", "error"), (None, None) if m is None else pb._parsed(m, ORDER), strict=True))], kind).to_pylist()
            kept.append(m)
        except (OverflowError, pa.ArrowInvalid):
            pass
    got = pb.decoded(pa.array(kept, pa.binary()), ORDER, kind).to_pylist()
    assert repr(got) == repr(want) and 200 < sum(w["error"] is not None for w in want) and len(kept) > 1200


def test_plain_messages_are_decoded_in_columns(monkeypatch):
    import pyarrow as pa

    message = pb.Message(number=pb.Field(1, "sint32"), lines=pb.Field(2, LINE, repeated=True), first=pb.Field(3, LINE))
    line = pa.struct([("number", pa.int32()), ("price", pa.float64()), ("note", pa.string()), ("unknown", pa.binary())])
    kind = pa.struct([("value", pa.struct([("number", pa.int32()), ("lines", pa.list_(line)), ("first", line), ("unknown", pa.binary())])), ("error", pa.string())])
    monkeypatch.setattr(pb, "_parsed", None)
    one = {"number": -3, "price": 1.5, "note": "é", "unknown": b""}
    values = [{"number": i - 50, "lines": [one] * (i % 4), "first": one if i % 3 else None, "unknown": b""} for i in range(100)]
    coded = pb.encoded(pa.array(values, kind.field(0).type), message)
    assert pb.decoded(coded, message, kind).to_pylist() == [{"value": v, "error": None} for v in values]
