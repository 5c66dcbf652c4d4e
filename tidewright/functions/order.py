"""Orders as sort keys: texts by UTF-16 units, reversed, derived and joined orders.

    orders = by(lambda r: r["name"], text()).then(by(lambda r: r["age"], number().reversed()))
    df.orderBy(*orders.columns(F.struct("name", "age")))

Spark sorts texts by code points (as UTF-8 does); by 16-bit units, characters beyond U+FFFF come before those from U+E000 on. Nulls come first, and last in a reversed order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf16(text: Column) -> Column:
    """Bytes that compare as the text's UTF-16 units."""
    return F.encode(text, "UTF-16BE")


@dataclass(frozen=True)
class Order:
    #: Keys, and whether each descends.
    keys: tuple[tuple[Callable[[Column], Column], bool], ...]

    def columns(self, c: Column) -> list[Column]:
        """For orderBy, sortWithinPartitions and windows."""
        return [key(c).desc_nulls_last() if down else key(c).asc_nulls_first() for key, down in self.keys]

    def reversed(self) -> Order:
        return Order(tuple((key, not down) for key, down in self.keys))

    def then(self, other: Order) -> Order:
        """The other one decides between equals."""
        return Order(self.keys + other.keys)

    def compare(self, a: Column, b: Column) -> Column:
        """-1, 0 or 1."""
        out = F.lit(0)
        for key, down in reversed(self.keys):
            x, y = F.struct(key(a).alias("v")), F.struct(key(b).alias("v"))  # structs compare nulls too
            out = F.when(x < y, 1 if down else -1).when(x > y, -1 if down else 1).otherwise(out)
        return out

    def equals(self, a: Column, b: Column) -> Column:
        return self.compare(a, b) == 0


def text() -> Order:
    return Order(((utf16, False),))


def number() -> Order:
    return Order(((lambda c: c, False),))


def by(derive: Callable[[Column], Column], order: Order | None = None) -> Order:
    """The order of what is derived from a value, by default as a number."""
    return Order(tuple((lambda c, key=key: key(derive(c)), down) for key, down in (order or number()).keys))
