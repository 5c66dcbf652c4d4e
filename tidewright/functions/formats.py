"""Text formats as columns: lines, CSV, TSV, white-space and fixed-width fields, regular expressions, JSON lines, server-sent
events, XML events. All but XML, CSV and TSV stay in the JVM; those three scan character by character, in Arrow batches.

Payloads are read whole (wholetext, binaryFile), so nothing depends on where a chunk was cut.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lines(text: Column) -> Column:
    """Array of lines: split on newline, one carriage return before it dropped; none after a last newline."""
    cut = F.split(text, "\n", -1)
    whole = F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)
    return F.transform(whole, lambda x: F.regexp_replace(x, "\r$", ""))


def explode_lines(df: DataFrame, column: str) -> DataFrame:
    """Adds line_no and line."""
    return df.select("*", F.posexplode(lines(F.col(column))).alias("line_no", "line"))


def ssv(line: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " ", -1)


def fixed_width(line: Column, columns: dict[str, tuple[int, int]], trim: bool = True) -> Column:
    """Struct of the half-open character ranges."""

    def one(a: int, b: int) -> Column:
        x = F.substring(line, a + 1, b - a)
        return F.regexp_replace(x, r"^\s+|\s+$", "") if trim else x

    return F.struct(*(one(a, b).alias(n) for n, (a, b) in columns.items()))


def regex_groups(line: Column, pattern: str) -> Column:
    """Struct of the named groups; null where the line doesn't match or the pattern has no named group."""
    groups = re.compile(re.sub(r"\(\?<(?=[A-Za-z])", "(?P<", pattern)).groupindex
    if not groups:
        return F.lit(None).cast("struct<>")
    return F.when(line.rlike(pattern), F.struct(*(F.regexp_extract(line, pattern, i).alias(n) for n, i in groups.items())))


def jsonl(line: Column, schema: str) -> Column:
    """Parsed lines; null where one is malformed (filter those for lenient reading)."""
    return F.when(F.try_parse_json(line).isNotNull(), F.from_json(line, schema))


def ndjson(line: Column, schema: str) -> Column:
    """Parsed lines; null for blank ones, an error for malformed ones."""
    return F.when(F.trim(line) != "", F.from_json(line, schema, {"mode": "FAILFAST"}))


def delimited_rows(text: str, separator: str = ",", quote: str = '"', trim: bool = False) -> Iterator[list[str]]:
    """CSV rows: quotes count at a field's start, a doubled one inside is literal; rows end in \\n, \\r\\n or \\r."""
    stop = re.compile(f"{re.escape(separator)}|\r\n|\n|\r")
    at, row, n = 0, [], len(text)
    while at < n or row:
        if at < n and text[at] == quote:
            parts, at = [], at + 1
            while True:
                end = text.find(quote, at)
                if end < 0:
                    parts.append(text[at:])
                    at = n
                    break
                parts.append(text[at:end])
                at = end + 1
                if text[at : at + 1] != quote:
                    break
                parts.append(quote)
                at += 1
            field = "".join(parts)
        else:
            field = ""
        m = stop.search(text, at)
        tail = text[at : m.start() if m else n]
        field += tail
        row.append(field.strip() if trim else field)
        at = m.end() if m else n
        if not m or m[0] != separator:
            yield row
            row = []
        elif at >= n:
            row.append("")
            yield row
            row = []


def csv_records(text: Column, columns: list[str] | None = None, separator: str = ",", quote: str = '"', trim: bool = False) -> Column:
    """Array of map<string,string>: by header line, or by the given names; missing fields are empty, further ones dropped."""

    def one(x: str | None) -> list[dict[str, str]] | None:
        if x is None:
            return None
        rows = delimited_rows(x, separator, quote, trim)
        names = columns or next(rows, [])
        return [dict(zip(names, [*r, *[""] * len(names)])) for r in rows]  # noqa: B905

    @F.pandas_udf("array<map<string,string>>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(one)

    return f(text)


def tsv_fields(line: str, separator: str = "\t", quote: str = '"') -> list[str]:
    """Quotes toggle anywhere; a doubled one inside quotes is literal."""
    out, field, inside, i = [], [], False, 0
    while i < len(line):
        c = line[i]
        if c == quote and inside and line[i + 1 : i + 2] == quote:
            field.append(quote)
            i += 1
        elif c == quote:
            inside = not inside
        elif c == separator and not inside:
            out.append("".join(field))
            field = []
        else:
            field.append(c)
        i += 1
    return [*out, "".join(field)]


def tsv(line: Column) -> Column:
    """Array of fields; lines without quotes are split in the JVM's own way after the scan is skipped."""

    @F.pandas_udf("array<string>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else x.split("\t") if '"' not in x else tsv_fields(x))

    return f(line)


def sse_events(text: Column) -> Column:
    """Array of struct(event, data, id, retry): fields of consecutive lines, an event ends at a blank line or the end."""
    kept = F.filter(lines(F.regexp_replace(text, "\r\n?", "\n")), lambda x: ~x.startswith(":"))
    blocks = F.split(F.array_join(kept, "\n"), "\n\n+", -1)

    def values(block: Column, name: str) -> Column:
        own = F.filter(F.split(block, "\n", -1), lambda x: (x == name) | x.startswith(name + ":"))
        return F.transform(own, lambda x: F.regexp_replace(F.substring(x, len(name) + 2, 1 << 30), "^ ", ""))

    def last(block: Column, name: str) -> Column:
        v = values(block, name)
        return F.when(F.size(v) > 0, F.element_at(v, -1))

    events = F.transform(
        blocks,
        lambda b: F.struct(
            F.coalesce(F.nullif(last(b, "event"), F.lit("")), F.lit("message")).alias("event"),
            F.when(F.size(values(b, "data")) > 0, F.array_join(values(b, "data"), "\n")).alias("data"),
            last(b, "id").alias("id"),
            F.when(last(b, "retry").rlike(r"^\d+$"), last(b, "retry").cast("int")).alias("retry"),
        ),
    )
    return F.filter(events, lambda e: e["data"].isNotNull())


_XML = re.compile(
    r"<!\[CDATA\[(?P<cdata>.*?)\]\]>|<!--.*?-->|<\?.*?\?>|<!(?!\[CDATA\[|--).*?>"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][\w.-]*)(?P<attributes>(?:\s+[\w.-]+\s*=\s*\"[^\">]*\")*)\s*(?P<self>/?)>|(?P<text>[^<]+)|(?P<open><(?:!--|\?|!)?)",
    re.S | re.A,
)
_XML_ATTRIBUTE = re.compile(r'([\w.-]+)\s*=\s*"([^"]*)"', re.A)
XML_EVENT = "struct<type:string,tag:string,attributes:map<string,string>,text:string>"


def xml_events(text: str) -> Iterator[dict]:
    """Open, close, selfClose and text events; declarations, comments and doctypes are skipped, a lone `<` too."""
    for m in _XML.finditer(text):
        if m["open"] and len(m["open"]) > 1:
            return  # unfinished to the end
        if m["tag"]:
            if m["close"]:
                yield {"type": "close", "tag": m["tag"]}
            else:
                yield {"type": "selfClose" if m["self"] else "open", "tag": m["tag"], "attributes": dict(_XML_ATTRIBUTE.findall(m["attributes"])) or None}
        elif (said := (m["cdata"] or m["text"] or "").strip()):
            yield {"type": "text", "text": said}


#: Bytes of text whose events a worker holds at a time.
XML_SLICE = 1 << 18


def _slices(texts: pa.Array, most: int) -> Iterator[pa.Array]:
    """Pieces of about `most` bytes, one text at least."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 16), 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + most, side="right")))
        yield texts.slice(at, end - at)
        at = end


def _xml_arrays(texts: list[str | None], kind: pa.ListType) -> pa.ListArray:
    ends, fields = [0], {"type": [], "tag": [], "attributes": [], "text": []}
    for text in texts:
        for event in xml_events(text) if text is not None else ():
            for name, values in fields.items():
                values.append(event.get(name))
        ends.append(len(fields["type"]))
    struct = kind.value_type
    columns = [pa.array([v and list(v.items()) for v in fields[f.name]] if f.name == "attributes" else fields[f.name], f.type) for f in struct]
    events = pa.StructArray.from_arrays(columns, fields=list(struct))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), events, type=kind, mask=pa.array([t is None for t in texts]))


def xml(text: Column) -> Column:
    """Array of XML_EVENT. A worker holds the events of XML_SLICE bytes of text, or of one text, in columns; Arrow batches are cut to that."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    ddl = f"array<{XML_EVENT}>"
    kind = to_arrow_type(_parse_datatype_string(ddl))

    @F.arrow_udf(ddl)
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for part in _slices(batch, XML_SLICE):
                yield _xml_arrays(part.to_pylist(), kind)
            if not len(batch):
                yield _xml_arrays([], kind)

    return f(text)


def offsets_map(text: Column) -> Column:
    """`0:42,1:17` to map<int,bigint>."""
    pairs = F.str_to_map(text, F.lit(","), F.lit(":"))
    return F.map_from_entries(F.transform(F.map_entries(pairs), lambda e: F.struct(e["key"].cast("int"), e["value"].cast("bigint"))))


def offsets_text(offsets: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(offsets)), lambda e: F.concat_ws(":", e["key"].cast("string"), e["value"].cast("string"))), ",")


def histogram_counts(value: Column, bounds: list[float]) -> list[Column]:
    """Cumulative bucket counts (value <= bound) and the count of all, as aggregates."""
    return [*(F.count_if(value <= b).alias(f"le_{b:g}".replace(".", "_")) for b in bounds), F.count(value).alias("le_inf")]
