"""A topology as a Structured Streaming query.

Spark's watermark is global and moves between micro-batches, so a late row is dropped one batch later than in a replay; for input
in order, or lateness that covers the disorder, both give the same windows. Users' aggregates (`fold`) carry the record's own watermark along, so they
agree on any disorder (see stateful). Windows still open when a query ends stay in the checkpoint: the next run goes on with them. A replay emits them all.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import ordered
from ..plans import nodes
from ..plans.replay import KEY
from ..sources.events import SEQ, TIME
from . import stateful
from .sinks import Ledger
from .stateful import STAMP as _STAMP


def lower(node: nodes.Node) -> DataFrame:
    if isinstance(node, nodes.Fold):
        w = node.parent
        return stateful.fold_windows(lower(w.parent), KEY, w.shape, w.size_us, w.slide_us, w.lateness_us, node.init, node.add, node.emit, node.schema, node.merge)
    df = lower(node.parent) if node.parent else None
    match node:
        case nodes.Source():
            return node.rows
        case nodes.Project():
            return df.withColumns(node.columns).drop(*node.drop)
        case nodes.Filter():
            return ordered.keep(df, node.predicate) if node.keep else ordered.drop_where(df, node.predicate)
        case nodes.FlatMap():
            return ordered.flat_map(df, node.values, node.name, "_flat")
        case nodes.MapAsync():
            return ordered.map_async(df, node.call, node.column, node.name, node.type, node.concurrency)
        case nodes.EventTime():
            return df.withColumn(TIME, node.micros.cast("bigint"))
        case nodes.KeyBy():
            return df.withColumn(KEY, node.key.cast("string"))
        case nodes.Shuffle():
            return df.repartition(node.partitions, KEY) if node.partitions else df.repartition(KEY)
        case nodes.Dedupe():
            return _dedupe(df.withColumn("_dedupe", node.key), node).drop("_dedupe")
        case nodes.Process():
            return stateful.process(df, KEY, node.init, node.step, node.schema, node.ttl_us)
        case nodes.Windowed():
            return df.withColumn(_STAMP, F.timestamp_micros(TIME)).withWatermark(_STAMP, f"{node.lateness_us} microseconds")
        case nodes.Aggregate():
            return _windows(df, node)
        case nodes.IntervalJoin():
            return _join(df, lower(node.other), node)
        case nodes.Sink():
            return df
    raise TypeError(node.kind)


def _dedupe(df: DataFrame, node: nodes.Dedupe) -> DataFrame:
    if node.within_us is not None:
        return stateful.dedupe_within(df, "_dedupe", node.within_us)
    if node.most is not None:
        raise ValueError("keys are bounded by number in a replay only; give a live query `within`")
    return df.dropDuplicates(["_dedupe"])


def _windows(df: DataFrame, node: nodes.Aggregate) -> DataFrame:
    w: nodes.Windowed = node.parent
    if w.shape == "session":
        at = F.session_window(_STAMP, f"{w.size_us} microseconds")
        out = df.groupBy(KEY, at).agg(*node.columns)
        start, end = F.unix_micros(F.col("session_window.start")), F.unix_micros(F.col("session_window.end")) - w.size_us
        return out.withColumns({"window_start_us": start, "window_end_us": end}).drop("session_window")
    if w.shape == "sliding" and w.slide_us > w.size_us:
        # windows as long as the slide, of which the gaps are cut off first
        at = F.window(_STAMP, f"{w.slide_us} microseconds")
        out = df.where(F.pmod(F.col(TIME), F.lit(w.slide_us)) < w.size_us).groupBy(KEY, at).agg(*node.columns)
        start = F.unix_micros(F.col("window.start"))
        return out.withColumns({"window_start_us": start, "window_end_us": start + w.size_us}).drop("window").where("window_start_us >= 0")
    slide = w.slide_us if w.shape == "sliding" else w.size_us
    at = F.window(_STAMP, f"{w.size_us} microseconds", f"{slide} microseconds")
    out = df.groupBy(KEY, at).agg(*node.columns)
    out = out.withColumns({"window_start_us": F.unix_micros(F.col("window.start")), "window_end_us": F.unix_micros(F.col("window.end"))}).drop("window")
    return out.where("window_start_us >= 0") if w.shape == "sliding" else out


def _join(left: DataFrame, right: DataFrame, node: nodes.IntervalJoin) -> DataFrame:
    late = f"{node.window_us} microseconds"
    a = left.select(F.col(KEY).alias("_ka"), F.timestamp_micros(TIME).alias("_ta"), F.struct(*left.columns).alias("left")).withWatermark("_ta", late)
    b = right.select(F.col(KEY).alias("_kb"), F.timestamp_micros(TIME).alias("_tb"), F.struct(*right.columns).alias("right")).withWatermark("_tb", late)
    span = F.expr(f"INTERVAL {node.window_us} MICROSECONDS")
    near = (F.col("_tb") >= F.col("_ta") - span) & (F.col("_tb") <= F.col("_ta") + span)
    if node.bound == "strict":
        near = near & (F.abs(F.unix_micros("_ta") - F.unix_micros("_tb")) < node.window_us)
    return a.join(b, (F.col("_ka") == F.col("_kb")) & near).select("left", "right", F.col("_ka").alias(KEY))


#: What Spark calls the operators that hold each kind of state.
_STATES = {"dedupe_size": ("dedupe",), "active_windows": ("stateStoreSave", "sessionWindow"), "join_buffer_size": ("symmetricHashJoin",)}


_OWN = "transformWithState"


def own_states(node: nodes.Node) -> list[str]:
    """What the operators of stateful.py hold, from the sink on, as Spark reports them: all have one name there."""
    kinds = {nodes.Fold: ["active_windows", "clocks"], nodes.Process: ["process_states"]}
    return [k for n in reversed(list(node.walk())) for k in (["dedupe_size"] if isinstance(n, nodes.Dedupe) and n.within_us is not None else kinds.get(type(n), []))]


class Handle:
    """A running topology."""

    def __init__(self, query: StreamingQuery, states: list[str] | None = None):
        self.query, self.states = query, states or []

    @property
    def is_running(self) -> bool:
        return self.query.isActive

    def await_exit(self, seconds: float | None = None) -> bool | None:
        return self.query.awaitTermination(seconds) if seconds is not None else self.query.awaitTermination()

    def drain(self) -> Handle:
        self.query.processAllAvailable()
        return self

    def stop(self) -> None:
        self.query.stop()

    def metrics(self) -> dict[str, float]:
        """Totals of the progress reports that the query still holds."""
        reports = [json.loads(p.json) if hasattr(p, "json") else p for p in self.query.recentProgress]
        states = [s for p in reports[-1:] for s in p.get("stateOperators", [])]
        own = dict.fromkeys(("process_states", *self.states), 0)
        for name, s in zip(self.states, (s for s in states if _OWN in s.get("operatorName", "")), strict=False):
            own[name] += s.get("numRowsTotal", 0)
        known = {n: sum(s.get("numRowsTotal", 0) for s in states if any(k in s.get("operatorName", "") for k in kinds)) for n, kinds in _STATES.items()}
        return {
            "items_processed": sum(p.get("numInputRows", 0) for p in reports),
            "items_per_second": reports[-1].get("processedRowsPerSecond", 0.0) if reports else 0.0,
            "state_rows": sum(s.get("numRowsTotal", 0) for s in states),
            **{n: known.get(n, 0) + own.get(n, 0) for n in {**known, **own}},
            "late_records": sum(s.get("numRowsDroppedByWatermark", 0) for p in reports for s in p.get("stateOperators", [])),
        }


def start(sink: nodes.Sink, checkpoint: str, delivery: str = "at-least-once", trigger: dict | None = None, name: str | None = None) -> Handle:
    """delivery: at-least-once, or exactly-once, which needs a sink that is idempotent or keeps to the ledger of batches."""
    if sink.write is None:
        raise ValueError("a live topology needs a sink")
    nodes.check_names(sink)
    df = lower(sink)
    spark = df.sparkSession
    ledger = Ledger(spark, checkpoint, nodes.fingerprint(sink))
    ledger.claim()
    if delivery == "exactly-once" and not sink.idempotent:
        raise ValueError("exactly-once needs a sink that takes a repeated batch as the same one")
    write: Callable[[DataFrame, int], None] = sink.write if sink.idempotent else ledger.guarded(sink.write)
    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query").outputMode("append")
    if name:
        writer = writer.queryName(name)
    return Handle(writer.trigger(**(trigger or {"availableNow": True})).start(), own_states(sink))
