"""Spans of time, held as milliseconds. A text is a decimal number and a unit of UNIT_MS, a bare number counts milliseconds; duration_ms()
reads a whole column in the JVM with the same pattern as Duration.of() reads one text."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units.
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
PATTERN = rf"([0-9]+(?:[.][0-9]+)?)[ \t\n\r\f\x0b]*({'|'.join(UNIT_MS)})"
_TEXT = re.compile(PATTERN)


@dataclass(frozen=True, order=True)
class Duration:
    ms: float

    @classmethod
    def of(cls, value: Duration | float | str) -> Duration:
        if isinstance(value, Duration):
            return value
        if not isinstance(value, str):
            return cls(value)
        if not (m := _TEXT.fullmatch(value)):
            raise ValueError(f"not a duration: {value!r}")
        return cls(float(m[1]) * UNIT_MS[m[2]])

    def __add__(self, other: Duration | float | str) -> Duration:
        return Duration(self.ms + Duration.of(other).ms)

    def __sub__(self, other: Duration | float | str) -> Duration:
        return Duration(self.ms - Duration.of(other).ms)

    def __mul__(self, factor: float) -> Duration:
        return Duration(self.ms * factor)

    def to(self, unit: str) -> float:
        return self.ms / UNIT_MS[unit]

    @property
    def micros(self) -> int:
        return round(self.ms * 1000)

    def interval(self) -> Column:
        """As a day-time interval."""
        return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(self.ms / 1000).cast("decimal(18,6)"))

    def __str__(self) -> str:
        unit = next((u for u in ("d", "h", "m", "s") if self.ms >= UNIT_MS[u]), "ms")
        return f"{self.ms / UNIT_MS[unit]:g}{unit}"


def duration_ms(text: Column) -> Column:
    """Milliseconds of a column of duration texts; null where one is malformed."""
    number, unit = (F.regexp_extract(text, rf"\A{PATTERN}\z", i) for i in (1, 2))
    number = number.try_cast("double")
    scale = F.create_map(*(F.lit(x) for pair in UNIT_MS.items() for x in pair))
    return number * F.element_at(scale, F.nullif(unit, F.lit("")))
