"""Delay policies as pure data: step n of a policy gives the delay before the next attempt, or None for no more.

Policies compose, and delays() lists them, so they can drive a supervisor or be laid out as rows.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from .duration import Duration

Step = Callable[[int, float], float | None]  # (attempt from 0, elapsed ms) -> delay ms


@dataclass(frozen=True)
class Schedule:
    step: Step

    @staticmethod
    def recurs(times: int) -> Schedule:
        return Schedule(lambda n, _: 0.0 if n < times else None)

    @staticmethod
    def once() -> Schedule:
        return Schedule.recurs(1)

    @staticmethod
    def spaced(every: str | float) -> Schedule:
        ms = Duration.of(every).ms
        return Schedule(lambda n, _: ms)

    @staticmethod
    def fixed(every: str | float) -> Schedule:
        """Aligned to multiples of the period since the start."""
        ms = Duration.of(every).ms
        return Schedule(lambda n, elapsed: ms - elapsed % ms)

    @staticmethod
    def exponential(base: str | float, factor: float = 2.0) -> Schedule:
        ms = Duration.of(base).ms
        return Schedule(lambda n, _: ms * factor**n)

    @staticmethod
    def linear(base: str | float) -> Schedule:
        ms = Duration.of(base).ms
        return Schedule(lambda n, _: ms * (n + 1))

    @staticmethod
    def fibonacci(base: str | float) -> Schedule:
        ms = Duration.of(base).ms

        def step(n: int, _: float) -> float:
            a, b = 1, 1
            for _i in range(n):
                a, b = b, a + b
            return ms * a

        return Schedule(step)

    @staticmethod
    def cron(expression: str, start_ms: float = 0, zone: str = "UTC") -> Schedule:
        from .cron import Cron

        c = Cron(expression, zone)
        return Schedule(lambda n, elapsed: c.next_ms(start_ms + elapsed) - start_ms - elapsed)

    def _both(self, other: Schedule, join: Callable[[float | None, float | None], float | None]) -> Schedule:
        return Schedule(lambda n, elapsed: join(self.step(n, elapsed), other.step(n, elapsed)))

    def intersect(self, other: Schedule) -> Schedule:
        """Goes on while both do, with the longer delay."""
        return self._both(other, lambda a, b: None if a is None or b is None else max(a, b))

    def union(self, other: Schedule) -> Schedule:
        """Goes on while either does, with the shorter delay."""
        return self._both(other, lambda a, b: b if a is None else a if b is None else min(a, b))

    def map(self, f: Callable[[float], float]) -> Schedule:
        return Schedule(lambda n, elapsed: None if (d := self.step(n, elapsed)) is None else f(d))

    def jittered(self, low: float = 0.8, high: float = 1.2, seed: int | None = None) -> Schedule:
        rng = random.Random(seed)  # noqa: S311
        return self.map(lambda d: d * rng.uniform(low, high))

    def full_jitter(self, seed: int | None = None) -> Schedule:
        return self.jittered(0.0, 1.0, seed)

    def while_output(self, keep: Callable[[float], bool]) -> Schedule:
        return Schedule(lambda n, elapsed: d if (d := self.step(n, elapsed)) is not None and keep(d) else None)

    def while_input(self, keep: Callable[[int], bool]) -> Schedule:
        return Schedule(lambda n, elapsed: self.step(n, elapsed) if keep(n) else None)

    def max_delay(self, most: str | float) -> Schedule:
        ms = Duration.of(most).ms
        return self.map(lambda d: min(d, ms))

    def cumulative_delay(self, most: str | float) -> Schedule:
        """Ends once the elapsed time would pass the bound."""
        ms = Duration.of(most).ms
        return Schedule(lambda n, elapsed: d if (d := self.step(n, elapsed)) is not None and elapsed + d <= ms else None)

    def delays(self, most: int) -> list[float]:
        out, elapsed = [], 0.0
        for n in range(most):
            if (d := self.step(n, elapsed)) is None:
                break
            out.append(d)
            elapsed += d
        return out
