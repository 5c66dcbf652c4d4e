"""Fluent API of topologies. The same topology runs as a replay (batch, deterministic) or live (Structured Streaming).

    (topology(events, seq="event_id", time=micros(F.col("ts")))
        .filter(F.col("event_type") != "error").key_by(F.col("user_id")).tumbling("1h").count().replay())
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.duration import Duration
from ..sources.events import normalised
from . import nodes


def topology(rows: DataFrame, seq: str = "_seq", time: Column | None = None, partition: Column | None = None, name: str = "source") -> Topology:
    """A topology over rows with an ordinal column; for streaming rows, `time` is required."""
    return Topology(nodes.Source(rows=normalised(rows, seq, time, partition, name), name=name, one_partition=partition is None))


@dataclass(frozen=True)
class Topology:
    node: nodes.Node

    def _with(self, node: nodes.Node) -> Any:
        nodes.check_names(node)
        return type(self)(node)

    def map(self, **columns: Column) -> Any:
        return self._with(nodes.Project(self.node, columns))

    def drop(self, *columns: str) -> Any:
        return self._with(nodes.Project(self.node, {}, columns))

    def filter(self, predicate: Column, keep: bool = True) -> Any:
        return self._with(nodes.Filter(self.node, predicate, keep))

    def flat_map(self, values: Column, name: str = "value") -> Any:
        return self._with(nodes.FlatMap(self.node, values, name))

    def map_async(self, call: Callable[[Any], Any], column: str, name: str, type: str, concurrency: int = 8) -> Any:  # noqa: A002
        return self._with(nodes.MapAsync(self.node, call, column, name, type, concurrency))

    def event_time(self, micros: Column) -> Any:
        return self._with(nodes.EventTime(self.node, micros))

    def key_by(self, key: Column) -> Keyed:
        return Keyed(nodes.KeyBy(self.node, key))

    def to(self, write: Callable[[DataFrame, int], None], idempotent: bool = False) -> Built:
        return Built(nodes.Sink(self.node, write, idempotent))

    def build(self) -> Built:
        return Built(nodes.Sink(self.node))

    def replay(self, **options: Any) -> DataFrame:
        from .replay import lower

        return lower(self.node, **options)


@dataclass(frozen=True)
class Keyed(Topology):
    def shuffle(self, partitions: int | None = None) -> Keyed:
        return self._with(nodes.Shuffle(self.node, partitions))

    def dedupe(self, key: Column, most: int | None = None, name: str | None = None, within: str | float | None = None) -> Keyed:
        """With `within` a key is forgotten so long after its last row that passed, and the next one passes again. `most` bounds the remembered keys
        of a replay. A live query with neither remembers all keys."""
        return self._with(nodes.Dedupe(self.node, key, most, name, None if within is None else Duration.of(within).micros))

    def process(self, init: Callable[[], Any], step: Callable[[Any, dict], tuple[Any, dict | None]], schema: str, name: str | None = None, ttl: str | float | None = None) -> Keyed:
        """A live query forgets the state of a key for which no row has come in `ttl`; a replay forgets none."""
        return self._with(nodes.Process(self.node, init, step, schema, name, None if ttl is None else Duration.of(ttl).micros))

    def join(self, other: Keyed, within: str | float, bound: str = "strict", name: str | None = None) -> Keyed:
        return self._with(nodes.IntervalJoin(self.node, other.node, Duration.of(within).micros, bound, name))

    def tumbling(self, size: str | float, lateness: str | float = 0, name: str | None = None) -> WindowedTopology:
        return WindowedTopology(nodes.Windowed(self.node, "tumbling", Duration.of(size).micros, 0, Duration.of(lateness).micros, name))

    def sliding(self, size: str | float, slide: str | float, lateness: str | float = 0, name: str | None = None) -> WindowedTopology:
        return WindowedTopology(nodes.Windowed(self.node, "sliding", Duration.of(size).micros, Duration.of(slide).micros, Duration.of(lateness).micros, name))

    def session(self, gap: str | float, lateness: str | float = 0, name: str | None = None) -> WindowedTopology:
        return WindowedTopology(nodes.Windowed(self.node, "session", Duration.of(gap).micros, 0, Duration.of(lateness).micros, name))


@dataclass(frozen=True)
class WindowedTopology:
    node: nodes.Windowed

    def aggregate(self, *columns: Column) -> Topology:
        nodes.check_names(self.node)
        return Topology(nodes.Aggregate(self.node, columns))

    def fold(self, init: Callable[[], Any], add: Callable[[Any, dict], Any], emit: Callable[[dict, Any], dict], schema: str, merge: Callable[[Any, Any], Any] | None = None) -> Topology:
        """A user's aggregate: add(state, row) in arrival order from init(), then emit(keys and bounds, state) to a row of `schema`. Sessions
        that a row bridges become one by `merge`; without it they stay apart. Live, states have to be values that JSON or codecs.dumps holds."""
        nodes.check_names(self.node)
        return Topology(nodes.Fold(self.node, init, add, emit, merge, schema))

    def count(self) -> Topology:
        return self.aggregate(F.count(F.lit(1)).alias("count"))

    def sum(self, value: Column, nulls: str = "skip") -> Topology:
        """nulls="nan" makes a sum with a null NaN."""
        total = F.sum(value.cast("double"))
        return self.aggregate((F.when(F.count_if(value.isNull()) > 0, float("nan")).otherwise(total) if nulls == "nan" else total).alias("sum"))


@dataclass(frozen=True)
class Built:
    node: nodes.Sink

    def stages(self) -> list[list[str]]:
        return nodes.stages(self.node)

    def lint(self) -> list[str]:
        return nodes.lint(self.node)

    def replay(self, **options: Any) -> DataFrame:
        from .replay import lower

        out = lower(self.node.parent, **options)
        if self.node.write:
            self.node.write(out, 0)
        return out

    def run(self, checkpoint: str, **options: Any) -> Any:
        from ..streaming.live import start

        return start(self.node, checkpoint, **options)
