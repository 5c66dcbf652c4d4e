"""A topology as DataFrames over recorded rows: deterministic, with watermarks exactly as record-at-a-time processing has them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import joins, ordered, state, windows
from ..sources.events import PARTITION, SEQ, TIME
from . import nodes

KEY = "_key"


def lower(node: nodes.Node, scope: str = "key", reference: bool = False, rekey: bool = False) -> DataFrame:
    """scope: "key", or "partition_key" for state per source partition and key. reference: also emit again what late rows of
    overlapping windows would. rekey: key expressions are taken on the mapped row."""
    return _Replay(scope, reference, rekey).run(node)


def _with_seq(seqs: list, row: dict) -> list:
    seqs.append(row[SEQ])  # in place: a session's list isn't copied for each row
    return seqs


def _joined(a: list, b: list) -> list:
    a.extend(b)
    return a


class _Replay:
    def __init__(self, scope: str, reference: bool, rekey: bool):
        if scope not in ("key", "partition_key"):
            raise ValueError(scope)
        self.scope, self.reference, self.rekey = scope, reference, rekey
        self.key: Column | None = None

    def keys(self) -> list[str]:
        return [KEY] if self.scope == "key" else [PARTITION, KEY]

    def run(self, node: nodes.Node) -> DataFrame:
        df = self.run(node.parent) if node.parent else None
        return getattr(self, f"_{node.kind}")(node, df)

    def _keyed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(KEY, self.key.cast("string")) if self.rekey and self.key is not None else df

    def _source(self, node: nodes.Source, _: None) -> DataFrame:
        return node.rows

    def _project(self, node: nodes.Project, df: DataFrame) -> DataFrame:
        return df.withColumns(node.columns).drop(*node.drop)

    def _filter(self, node: nodes.Filter, df: DataFrame) -> DataFrame:
        return ordered.keep(df, node.predicate) if node.keep else ordered.drop_where(df, node.predicate)

    def _flatmap(self, node: nodes.FlatMap, df: DataFrame) -> DataFrame:
        return ordered.flat_map(df, node.values, node.name, "_flat")

    def _mapasync(self, node: nodes.MapAsync, df: DataFrame) -> DataFrame:
        return ordered.map_async(df, node.call, node.column, node.name, node.type, node.concurrency)

    def _eventtime(self, node: nodes.EventTime, df: DataFrame) -> DataFrame:
        return df.withColumn(TIME, node.micros.cast("bigint"))

    def _keyby(self, node: nodes.KeyBy, df: DataFrame) -> DataFrame:
        self.key = node.key
        return df.withColumn(KEY, node.key.cast("string"))

    def _shuffle(self, node: nodes.Shuffle, df: DataFrame) -> DataFrame:
        return df.repartition(node.partitions, KEY) if node.partitions else df.repartition(KEY)

    def _dedupe(self, node: nodes.Dedupe, df: DataFrame) -> DataFrame:
        keyed = df.withColumn("_dedupe", node.key)
        if node.most is not None:
            return state.dedupe_capped(keyed, "_dedupe", SEQ, PARTITION, node.most).drop("_dedupe")
        keys = ["_dedupe"] if self.scope == "key" else [PARTITION, "_dedupe"]
        if node.within_us is not None:
            return state.dedupe_within(keyed, keys, SEQ, TIME, node.within_us).drop("_dedupe")
        return ordered.dedupe_first(keyed, keys, SEQ).drop("_dedupe")

    def _process(self, node: nodes.Process, df: DataFrame) -> DataFrame:
        return state.process(self._keyed(df), self.keys(), SEQ, node.init, node.step, node.schema)

    def _intervaljoin(self, node: nodes.IntervalJoin, df: DataFrame) -> DataFrame:
        left, right = self._keyed(df), self.run(node.other)
        if self.scope == "partition_key":
            left, right = (x.withColumn(KEY, F.concat_ws("\x00", PARTITION, KEY)) for x in (left, right))
        pairs = joins.interval_join(left, right, KEY, TIME, node.window_us, node.bound)
        return pairs.select("left", "right", F.col("left")[KEY].alias(KEY), F.col("left")[PARTITION].alias(PARTITION), F.greatest(F.col("left")[TIME], F.col("right")[TIME]).alias(TIME), F.greatest(F.col("left")[SEQ], F.col("right")[SEQ]).alias(SEQ))

    def _windowed(self, node: nodes.Windowed, df: DataFrame) -> DataFrame:
        several = PARTITION in df.columns and not all(x.one_partition for x in node.walk() if isinstance(x, nodes.Source))
        marked = windows.with_watermark(self._keyed(df), TIME, SEQ, node.lateness_us, [PARTITION] if several else [])
        if node.shape == "session":
            return marked
        if node.shape == "tumbling":
            return windows.open_windows(windows.assign_tumbling(marked, TIME, node.size_us))
        return windows.open_windows(windows.assign_sliding(marked, TIME, node.size_us, node.slide_us), self.reference, SEQ)

    def _fold(self, node: nodes.Fold, df: DataFrame) -> DataFrame:
        w, kinds = node.parent, dict(df.dtypes)
        schema = ", ".join([*(f"{k} {kinds[k]}" for k in self.keys()), f"{windows.START} bigint", f"{windows.END} bigint", node.schema])
        if w.shape == "session":
            return windows.fold_sessions(df, self.keys(), TIME, SEQ, w.size_us, node.init, node.add, node.emit, schema, node.merge)
        extra = [windows.STALE] if windows.STALE in df.columns else []
        keys = [*self.keys(), windows.START, windows.END]
        more = f", {windows.STALE} bigint" if extra else ""
        return state.aggregate_windows(df, [*keys, *extra], SEQ, node.init, node.add, node.emit, schema + more).drop(*extra)

    def _aggregate(self, node: nodes.Aggregate, df: DataFrame) -> DataFrame:
        w = node.parent
        if w.shape == "session":
            if windows.needs_scan(df, TIME, w.size_us):  # out of order: which sessions were open decides, record by record
                return self._scanned(node, df)
            return windows.sessions(df, self.keys(), TIME, w.size_us, node.columns)
        extra = [windows.STALE] if windows.STALE in df.columns else []
        return df.groupBy(*self.keys(), windows.START, windows.END, *extra).agg(*node.columns).drop(windows.STALE)

    def _scanned(self, node: nodes.Aggregate, df: DataFrame) -> DataFrame:
        """The scan gives each session's ordinals; its rows meet them again for the declared columns."""
        kinds = dict(df.dtypes)
        schema = ", ".join([*(f"{k} {kinds[k]}" for k in self.keys()), f"{windows.START} bigint", f"{windows.END} bigint", "_members array<bigint>"])
        key = df.select(*dict.fromkeys([*self.keys(), TIME, SEQ, windows.WM]))
        found = windows.fold_sessions(key, self.keys(), TIME, SEQ, node.parent.size_us, list, _with_seq, lambda _, s: {"_members": s}, schema, _joined)
        members = found.select(windows.START, windows.END, *(F.col(k).alias(f"_m{k}") for k in self.keys()), F.explode("_members").alias("_member"))
        same = [F.col(k).eqNullSafe(F.col(f"_m{k}")) for k in self.keys()] + [F.col(SEQ) == F.col("_member")]
        return df.join(members, same).groupBy(*self.keys(), windows.START, windows.END).agg(*node.columns)
