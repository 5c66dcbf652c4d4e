"""Registered queries: each applies the library's operators to whole tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import codecs, composed, formats, hashing, order, protobuf
from .functions.cron import cron_next
from .functions.duration import duration_ms
from .functions.schedule import Schedule
from .operators import calls, errors, joins, ordered, state, terminals, timing, windows
from .operators.spread import running
from .plans.builder import topology
from .session import shared_folder
from .sources import events as ev
from .sources import queues, records, splits
from .streaming.sinks import drain, guarded_map, split_errors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
HOUR, MINUTE = 3_600_000_000, 60_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t in microseconds."""
    return read(spark, sf_dir, "events").withColumn("t", windows.micros(F.col("ts")))


def shifted() -> Column:
    """A time that is out of order by up to six hours."""
    return windows.micros(F.col("ts")) - (F.col("event_id") % 7) * HOUR


_OUT = ("_key", "window_start_us", "window_end_us")
_T = "(select *, epoch_us(ts) as t from events)"
_T2 = f"(select *, epoch_us(ts) - (event_id % 7) * {HOUR} as t2 from events)"


def _windowed(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select(F.col("_key").cast("bigint").alias("user_id"), "window_start_us", "window_end_us", *more)


# Event-time windows


@query(f"""select user_id, t // {HOUR} * {HOUR} as window_start_us, t // {HOUR} * {HOUR} + {HOUR} as window_end_us, count(*) as "count"
    from {_T} where event_type <> 'error' group by all""")
def tumbling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).filter(F.col("event_type") != "error")
    return _windowed(rows.key_by(F.col("user_id")).shuffle().tumbling("1h").count().replay(), "count")


@query(f"""select user_id, t // {HOUR} * {HOUR} as window_start_us, t // {HOUR} * {HOUR} + {HOUR} as window_end_us, round(sum(value), 6) as "sum"
    from {_T} group by all""")
def tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    return _windowed(rows.tumbling("1h").sum(F.col("value")).replay(), "sum").withColumn("sum", F.round("sum", 6))


@query(f"""select event_type, t // {HOUR * 24} * {HOUR * 24} as window_start_us, round(avg(value), 6) as mean, min(value) as low, max(value) as high
    from {_T} group by all""")
def tumbling_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("event_type"))
    out = rows.tumbling("1d").aggregate(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high")).replay()
    return out.select(F.col("_key").alias("event_type"), "window_start_us", "mean", "low", "high")


_LATE = f"""with a as (select *, max(t2) over (order by event_id rows between unbounded preceding and 1 preceding) - {2 * HOUR} as wm from {_T2})"""


@query(f"""{_LATE} select user_id, t2 // {HOUR} * {HOUR} as window_start_us, t2 // {HOUR} * {HOUR} + {HOUR} as window_end_us, count(*) as "count"
    from a where wm is null or t2 // {HOUR} * {HOUR} + {HOUR} > wm group by all""")
def tumbling_late_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", shifted()).key_by(F.col("user_id"))
    return _windowed(rows.tumbling("1h", lateness="2h").count().replay(), "count")


@query(f"{_LATE} select count(*) as late from a where wm is not null and t2 // {HOUR} * {HOUR} + {HOUR} <= wm")
def late_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("t2", shifted())
    marked = windows.assign_tumbling(windows.with_watermark(df, "t2", "event_id", 2 * HOUR), "t2", HOUR)
    return windows.late_rows(marked, "event_id").agg(F.count(F.lit(1)).alias("late"))


def _sliding_sql(size: int, slide: int) -> str:
    return f"""select user_id, s as window_start_us, s + {size} as window_end_us, count(*) as "count"
        from (select user_id, t, unnest(generate_series(t // {slide} * {slide} - {size // slide * slide}::bigint, t // {slide} * {slide}, {slide}::bigint)) as s from {_T})
        where s <= t and t < s + {size} and s >= 0 group by all"""


@query(_sliding_sql(HOUR, HOUR // 2))
def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    return _windowed(rows.sliding("1h", "30m").count().replay(), "count")


@query(_sliding_sql(HOUR, 90 * MINUTE))
def sliding_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    return _windowed(rows.sliding("1h", "90m").count().replay(), "count")


_SESSIONS = f"""with f as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) <= {2 * HOUR} then 0 else 1 end as first from {_T}),
    s as (select *, sum(first) over (partition by user_id order by t, event_id) as n from f)"""


@query(f"""{_SESSIONS} select user_id, min(t) as window_start_us, max(t) as window_end_us, count(*) as "count" from s group by user_id, n""")
def session_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    return _windowed(rows.session("2h").count().replay(), "count")


@query(f"""{_SESSIONS} select user_id, min(t) as window_start_us, string_agg(event_type, '>' order by event_id) as pages from s group by user_id, n""")
def session_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    visited = F.array_join(F.array_sort(F.collect_list(F.struct("event_id", "event_type")))["event_type"], ">")
    out = rows.session("2h").aggregate(visited.alias("pages")).replay()
    return out.select(F.col("_key").cast("bigint").alias("user_id"), "window_start_us", "pages")


# Joins and combinations


@query(f"""select a.event_id as left_id, b.event_id as right_id from {_T} a join {_T} b
    on a.user_id = b.user_id and abs(a.t - b.t) < {HOUR} where a.event_type = 'view' and b.event_type = 'click'""")
def interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts")))
    views, clicks = (base.filter(F.col("event_type") == k).key_by(F.col("user_id")).shuffle() for k in ("view", "click"))
    out = views.join(clicks, "1h").replay()
    return out.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(f"""select a.event_id as left_id, b.event_id as right_id from {_T} a join {_T} b
    on a.user_id = b.user_id and abs(a.t - b.t) <= {HOUR} where a.event_type = 'view' and b.event_type = 'purchase'""")
def interval_join_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir)
    out = joins.interval_join(df.where("event_type = 'view'"), df.where("event_type = 'purchase'"), "user_id", "t", HOUR, "inclusive")
    return out.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(f"""with e as (select event_id, user_id, event_type, epoch_us(ts) - (event_id % 7) * {HOUR} as t from events)
    select a.event_id as left_id, b.event_id as right_id from e a join e b on a.user_id = b.user_id and abs(a.t - b.t) <= {2 * HOUR}
    where a.event_type = 'view' and b.event_type = 'click' and not exists (select 1 from e m where m.user_id = a.user_id and m.event_type in ('view', 'click')
      and m.event_id > least(a.event_id, b.event_id) and m.event_id <= greatest(a.event_id, b.event_id)
      and m.t - {2 * HOUR} >= case when a.event_id < b.event_id then a.t else b.t end)""")
def interval_join_evicting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buffers that forget, on rows out of order: fewer pairs than the interval join has."""
    df = read(spark, sf_dir, "events").withColumn("t", shifted())
    out = joins.interval_join_evicting(df.where("event_type = 'view'"), df.where("event_type = 'click'"), "user_id", "t", "event_id", 2 * HOUR)
    return out.select(F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query("""select event_id, (select max(b.event_id) from events b where b.user_id = a.user_id and b.event_type = 'view' and b.event_id <= a.event_id) as latest
    from events a where event_type = 'click'
    and exists (select 1 from events b where b.user_id = a.user_id and b.event_type = 'view' and b.event_id <= a.event_id)""")
def asof_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    out = joins.with_latest(df.where("event_type = 'click'"), df.where("event_type = 'view'"), "event_id", ["user_id"])
    return out.select(F.col("main.event_id").alias("event_id"), F.col("side.event_id").alias("latest"))


@query("""with u as (select event_id, case when event_type = 'click' then event_id end as l, case when event_type = 'view' then event_id end as r
      from events where event_type in ('click', 'view')),
    w as (select event_id, max(l) over (order by event_id) as left_id, max(r) over (order by event_id) as right_id from u)
    select * from w where left_id is not null and right_id is not null""")
def combine_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    out = joins.combine_latest(df.where("event_type = 'click'"), df.where("event_type = 'view'"), "event_id")
    return out.select("event_id", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


_NUMBERED = """a as (select event_id, row_number() over (order by event_id) - 1 as i from events where event_type = 'click'),
    b as (select event_id, row_number() over (order by event_id) - 1 as i from events where event_type = 'view')"""


@query(f'with {_NUMBERED} select a.i as "index", a.event_id as left_id, b.event_id as right_id from a join b using (i)')
def zip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    out = ordered.zip_rows(df.where("event_type = 'click'"), df.where("event_type = 'view'"), "event_id", "event_id")
    return out.select("index", F.col("left.event_id").alias("left_id"), F.col("right.event_id").alias("right_id"))


@query(f"""with {_NUMBERED}, p as (select a.i, a.event_id as l, b.event_id as r from a join b using (i))
    select 2 * i as position, l as event_id from p union all select 2 * i + 1, r from p""")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return ordered.interleave(df.where("event_type = 'click'"), df.where("event_type = 'view'"), "event_id", "event_id", "event_id")


@query("select event_id, user_id, c_name, c_mktsegment from events left join customer on user_id = c_custkey")
def lookup_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return joins.lookup(read(spark, sf_dir, "events").select("event_id", "user_id"), customers, "user_id", "c_custkey").drop("c_custkey")


@query("select o_orderkey, o_custkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def not_yet_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.already_processed(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query("select n_name, r_name from nation cross join region")
def cross_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.cross(read(spark, sf_dir, "nation").select("n_name"), read(spark, sf_dir, "region").select("r_name"))


# Dedupe and keyed state


@query("select event_id, user_id, event_type from events qualify row_number() over (partition by event_type, user_id order by event_id) = 1")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.dedupe_first(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["event_type", "user_id"], "event_id")


@query("select event_id, user_id from events qualify row_number() over (partition by user_id order by event_id) = 1")
def topology_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("event_type"))
    return rows.dedupe(F.col("user_id")).replay().select("event_id", "user_id")


@query("""with recursive e as (select event_id, event_type, user_id % 16 as p, row_number() over (partition by user_id % 16 order by event_id) as n from events),
    r as (select p, n, event_id, event_type, [event_type] as seen, true as fresh from e where n = 1
      union all select e.p, e.n, e.event_id, e.event_type, case when list_contains(r.seen, e.event_type) then r.seen else list_append(r.seen, e.event_type)[-2:] end,
        not list_contains(r.seen, e.event_type) from r join e on e.p = r.p and e.n = r.n + 1)
    select event_id, event_type from r where fresh""")
def dedupe_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen source partitions that remember two of five types each."""
    df = read(spark, sf_dir, "events").select("event_id", "event_type", (F.col("user_id") % 16).alias("_partition"))
    return state.dedupe_capped(df, "event_type", "event_id", "_partition", 2).drop("_partition")


@query("select distinct user_id, event_type from events")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("user_id", "event_type").distinct()


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events")
def process_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.counter(read(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id")


@query("select user_id, event_id, row_number() over (partition by user_id order by event_id) as n from events")
def process_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counter as a user's state machine."""
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    step = lambda s, r: (s + 1, {"user_id": r["user_id"], "event_id": r["event_id"], "n": s + 1})
    return rows.process(lambda: 0, step, "user_id bigint, event_id bigint, n bigint").replay()


@query("""with recursive r as (select user_id, event_id, value, row_number() over (partition by user_id order by event_id) as n from events),
    e(user_id, event_id, n, ema) as (select user_id, event_id, n, value from r where n = 1
      union all select r.user_id, r.event_id, r.n, 0.7::double * e.ema + 0.3::double * r.value from e join r on r.user_id = e.user_id and r.n = e.n + 1)
    select user_id, event_id, round(ema, 6) as ema from e""")
def ema_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    def step(s: float | None, r: dict) -> tuple[float, dict]:
        s = r["value"] if s is None else 0.7 * s + 0.3 * r["value"]
        return s, {"user_id": r["user_id"], "event_id": r["event_id"], "ema": s}

    out = state.process(read(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", lambda: None, step, "user_id bigint, event_id bigint, ema double")
    return out.withColumn("ema", F.round("ema", 6))


@query("""with s as (select event_id, user_id, event_type, row_number() over (partition by user_id order by event_id) as n from events)
    select event_id, event_type, n, row_number() over (partition by event_type order by event_id) as m from s""")
def two_stage_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted by user, keyed again by type, counted again."""
    once = state.counter(read(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], "event_id")
    return state.counter(once, ["event_type"], "event_id", "m").select("event_id", "event_type", "n", "m")


@query("select user_id, round(sum(value), 6) as total, count(*) as n from events group by user_id")
def monoid_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("select user_id, string_agg(event_type, ',' order by event_id) as said from events group by user_id")
def ordered_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit(","), x))
    return ordered.fold(read(spark, sf_dir, "events"), "event_id", F.lit(""), step, F.col("event_type"), ["user_id"]).withColumnRenamed("result", "said")


_BOUNDS = [0.5, 5.0, 25.0, 100.0]


@query("select event_type, " + ", ".join(f"""count(*) filter (value <= {b}) as "le_{f'{b:g}'.replace('.', '_')}\"""" for b in _BOUNDS) + ", count(value) as le_inf from events group by event_type")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*formats.histogram_counts(F.col("value"), _BOUNDS))


# Ordered streams


@query("select event_id, event_type from events qualify event_type is distinct from lag(event_type) over (order by event_id) or row_number() over (order by event_id) = 1")
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.changes(read(spark, sf_dir, "events").select("event_id", "event_type"), "event_id", "event_type")


@query("select event_id, row_number() over (order by event_id) - 1 as \"index\" from events")
def zip_with_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.zip_with_index(read(spark, sf_dir, "events").select("event_id"), "event_id")


@query("select event_id, lag(event_type) over (order by event_id) as previous, lead(event_type) over (order by event_id) as next from events")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "event_type")
    return ordered.zip_with_neighbours(df, "event_id", "event_type").drop("event_type")


@query("""select row_number() over (order by event_id) - 1 as position, sum(user_id) over (order by event_id)::bigint as state from events
    union all select -1, 0""")
def running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.scan(read(spark, sf_dir, "events"), "event_id", "sum", F.col("user_id"), 0)


@query("select event_id, max(value) over (order by event_id) as best from events")
def map_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.map_accumulate(read(spark, sf_dir, "events").select("event_id", "value"), "event_id", "max", F.col("value"), name="best").drop("value")


@query("""with n as (select event_id, (row_number() over (order by event_id) - 1) // 100 as batch from events)
    select batch, string_agg(event_id::varchar, ',' order by event_id) as items from n group by batch""")
def grouped_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.grouped(read(spark, sf_dir, "events"), 100, "event_id", "event_id")
    return out.select("batch", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("""with n as (select event_id, row_number() over (order by event_id) - 1 as i from events),
    w as (select i, list(event_id) over (order by i rows between current row and 4 following) as l from n)
    select i as first, array_to_string(l, ',') as items from w where i % 3 = 0 and len(l) = 5""")
def count_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordered.count_sliding(read(spark, sf_dir, "events"), 5, "event_id", "event_id", 3)
    return out.select("first", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query("select event_id, user_id from events order by event_id limit 250")
def take(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit is what this operator is."""
    return ordered.take(read(spark, sf_dir, "events").select("event_id", "user_id"), 250, "event_id")


@query("select event_id, user_id from events order by event_id offset 250")
def drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.drop(read(spark, sf_dir, "events").select("event_id", "user_id"), 250, "event_id")


_FIRST = "coalesce((select min(event_id) from events where value >= 90), 9223372036854775807)"


@query(f"select event_id, value from events where event_id < {_FIRST}")
def take_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.take_while(read(spark, sf_dir, "events").select("event_id", "value"), F.col("value") < 90, "event_id")


@query(f"select event_id, value from events where event_id >= {_FIRST}")
def drop_while(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.drop_while(read(spark, sf_dir, "events").select("event_id", "value"), F.col("value") < 90, "event_id")


@query("select event_id from events where ts < coalesce((select min(ts) from events where value >= 90), timestamp '9999-01-01')")
def take_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    return ordered.take_until(df, "ts", df.where("value >= 90").select(F.col("ts").alias("at")), "at").select("event_id")


@query(f"select event_id from {_T} where t < (select min(t) from {_T}) + {24 * HOUR}")
def interrupt_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.interrupt_after(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", 24 * HOUR / 1000).select("event_id")


@query("""(select 'head' as which, event_id from events order by event_id limit 1) union all
    (select 'last', event_id from events order by event_id desc limit 1) union all
    (select 'first click', min(event_id) from events where event_type = 'click')""")
def head_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "event_type")
    parts = {"head": ordered.head(df, "event_id"), "last": ordered.last(df, "event_id"), "first click": ordered.collect_first(df, F.col("event_type") == "click", "event_id")}
    return ordered.merge_all(*(x.select(F.lit(n).alias("which"), "event_id") for n, x in parts.items()))


@query("select bool_or(value > 50) as some, bool_and(value >= 0) as every, count(*) as n from events")
def some_every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(F.bool_or(F.col("value") > 50).alias("some"), F.bool_and(F.col("value") >= 0).alias("every"), F.count(F.lit(1)).alias("n"))


# Projections, flattening, sets


@query("select event_id, value * 2 as doubled from events where event_type = 'purchase' and value is not null")
def filter_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ordered.keep(read(spark, sf_dir, "events"), F.col("event_type") == "purchase")
    return ordered.filter_map(df, "doubled", F.col("value") * 2).select("event_id", "doubled")


@query("select c_custkey from customer where not coalesce(c_acctbal > 0, false)")
def filter_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.drop_where(read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), F.col("c_acctbal") > 0).select("c_custkey")


@query("""select doc_id, word, count(*) as n from (select doc_id, unnest(string_split(text, ' ')) as word from documents) group by all""")
def flatmap_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.value_counts(read(spark, sf_dir, "documents"), ["doc_id"], F.split("text", " ", -1), "word")


@query("""select 0 as _src, n_nationkey as id, n_name as name from nation union all select 1, r_regionkey, r_name from region""")
def concat_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    b = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return ordered.concat(a, b, "id")


@query("select s_suppkey as id from supplier union all select c_custkey from customer union all select p_partkey from part")
def merge_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.merge_all(*(read(spark, sf_dir, t).select(F.col(c).alias("id")) for t, c in (("supplier", "s_suppkey"), ("customer", "c_custkey"), ("part", "p_partkey"))))


@query("select n_name, _run from nation, unnest(range(3)) as r(_run)")
def repeat_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered.repeat_n(read(spark, sf_dir, "nation").select("n_name"), 3).withColumn("_run", F.col("_run").cast("bigint"))


@query("""select 'view' as branch, event_id from events where event_type = 'view' union all select 'high', event_id from events where value > 50""")
def broadcast_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    view = lambda x: x.where("event_type = 'view'").select(F.lit("view").alias("branch"), "event_id")
    high = lambda x: x.where("value > 50").select(F.lit("high").alias("branch"), "event_id")
    return ordered.broadcast_through(df, view, high)


@query("""with o as (select event_id, user_id, epoch_us(ts) as t, lead(epoch_us(ts)) over (order by event_id) as nxt from events where event_type = 'click'),
    i as (select event_id, k, t + k * 600000000 as inner_t, nxt from o, unnest(range(6)) as u(k))
    select event_id, inner_t from i where nxt is null or inner_t < nxt""")
def switch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    outer = timed(spark, sf_dir).where("event_type = 'click'").select("event_id", "t")
    inner = outer.select("event_id", "t", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    inner = inner.select("event_id", (F.col("t") + F.col("k").cast("bigint") * 10 * MINUTE).alias("inner_t"))
    return ordered.switch_map(outer, inner, "event_id", "t", "inner_t", "event_id").select("event_id", "inner_t")


@query("(select c_nationkey as k from customer) intersect (select s_nationkey from supplier)")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("(select c_custkey as k from customer) except (select o_custkey from orders)")
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")).subtract(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("select user_id, event_id, value, rank() over (partition by user_id order by value desc, event_id) as r from events qualify r <= 3")
def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return read(spark, sf_dir, "events").select("user_id", "event_id", "value").withColumn("r", F.rank().over(w).cast("bigint")).where("r <= 3")


@query("select range as _seq, range * 0.25 + 1 as value from range((select count(*) from customer))")
def number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many steps as there are customers."""
    return records.number_range(spark, 1, 1 + 0.25 * read(spark, sf_dir, "customer").count(), 0.25)


@query("""with recursive f as (select 0 as n, 0::bigint as a, 1::bigint as b union all select n + 1, b, (a + b) % 1000000007 from f where n + 1 < (select count(*) from customer))
    select n::bigint as _seq, a as value from f""")
def unfold_fibonacci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fibonacci numbers modulo a prime, as many as there are customers."""
    step = lambda s: (s[0], (s[1], (s[0] + s[1]) % 1_000_000_007))
    return records.unfold(spark, (0, 1), step, "value bigint", read(spark, sf_dir, "customer").count())


@query(f"select event_id from {_T} qualify lead(t) over (partition by user_id order by event_id) is null or lead(t) over (partition by user_id order by event_id) - t >= {HOUR}")
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.debounce(timed(spark, sf_dir), "event_id", "t", HOUR, ["user_id"]).select("event_id")


@query(f"select event_id from {_T} qualify lead(t) over (order by event_id) is null or lead(t) over (order by event_id) - t >= {5 * MINUTE}")
def debounce_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.debounce(timed(spark, sf_dir), "event_id", "t", 5 * MINUTE).select("event_id")


@query(f"select max(event_id) as event_id from {_T} where t // {HOUR} < (select max(t // {HOUR}) from {_T}) group by t // {HOUR}")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.sample(timed(spark, sf_dir), "event_id", "t", HOUR).select("event_id")


def _chain(first: str, step: str) -> str:
    """Each user's events one after another: r starts with `first`, goes on with `step` of r and the next row e."""
    return f"""with recursive e as (select event_id, user_id, epoch_us(ts) as t, row_number() over (partition by user_id order by ts, event_id) as n from events),
        r as (select event_id, user_id, t, n, {first} from e where n = 1
          union all select e.event_id, e.user_id, e.t, e.n, {step} from r join e on e.user_id = r.user_id and e.n = r.n + 1)"""


@query(f"""{_chain(f"t + {HOUR} as until, true as opens", f"case when e.t >= r.until then e.t + {HOUR} else r.until end, e.t >= r.until")}
    select event_id, user_id, t from r qualify coalesce(lead(opens) over (partition by user_id order by n), true)""")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.audit(timed(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", HOUR)


@query(f"""{_chain(f"t + {HOUR} as until, true as idle", f"case when e.t >= r.until then e.t + {HOUR} else r.until end, e.t >= r.until")}
    select event_id, user_id, t from r where idle""")
def exhaust_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir).select("event_id", "user_id", "t").withColumn("busy", F.lit(HOUR))
    return state.exhaust_map(df, ["user_id"], "t", "busy").drop("busy")


_CLOSED = f"(r.size = 5 or e.t >= r.first + {HOUR})"


@query(f"""{_chain("0::bigint as batch, 1 as size, t as first", f"case when {_CLOSED} then r.batch + 1 else r.batch end, case when {_CLOSED} then 1 else r.size + 1 end, case when {_CLOSED} then e.t else r.first end")}
    select event_id, user_id, t, batch from r""")
def group_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.group_within(timed(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", 5, HOUR)


_RECENT = f"list_filter(r.times, lambda x: x > e.t - {6 * HOUR})"


@query(f"""{_chain("[t] as times, true as ok", f"case when len({_RECENT}) < 3 then list_append({_RECENT}, e.t) else {_RECENT} end, len({_RECENT}) < 3")}
    select event_id, user_id, t from r where ok""")
def rate_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.rate_limit(timed(spark, sf_dir).select("event_id", "user_id", "t"), ["user_id"], "t", "sliding", 3, 6 * HOUR)


# Formats, codecs, hashes


@query("""with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as line_no, len(string_split(text, chr(10))) as n from documents)
    select doc_id, line_no, regexp_replace(line, chr(13) || '$', '') as line from l where not (line = '' and line_no = n - 1)""")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formats.explode_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return out.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@query(r"select doc_id, len(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) as fields, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1] as first from documents")
def ssv_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(formats.ssv(F.col("text"))).cast("bigint").alias("fields"), F.element_at(formats.ssv(F.col("text")), 1).alias("first"))


@query("select c_custkey, trim(substring(c_name, 1, 8)) as kind, trim(substring(c_name, 10, 9)) as number from customer")
def fixed_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formats.fixed_width(F.col("c_name"), {"kind": (0, 8), "number": (9, 18)})
    return read(spark, sf_dir, "customer").select("c_custkey", out.alias("f")).select("c_custkey", "f.*")


@query(r"select page_id, regexp_extract(url, '^(https?)://([^/]+)', 1) as scheme, regexp_extract(url, '^(https?)://([^/]+)', 2) as host from pages where regexp_matches(url, '^(https?)://([^/]+)')")
def regex_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = formats.regex_groups(F.col("url"), r"^(?<scheme>https?)://(?<host>[^/]+)")
    return read(spark, sf_dir, "pages").select("page_id", out.alias("g")).where("g is not null").select("page_id", "g.*")


@query("select event_id, (props::json->>'$.k')::bigint as k from events where json_valid(props)")
def jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", formats.jsonl(F.col("props"), "k bigint").alias("v")).where("v is not null").select("event_id", "v.k")


@query("select n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row written as quoted CSV and parsed again."""
    df = read(spark, sf_dir, "nation")
    quoted = F.concat(F.lit("name,region\n\""), F.replace("n_name", F.lit('"'), F.lit('""')), F.lit('",'), F.col("n_regionkey").cast("string"), F.lit("\n"))
    row = F.element_at(formats.csv_records(quoted), 1)
    return df.select("n_nationkey", F.element_at(row, "name").alias("n_name"), F.element_at(row, "region").alias("n_regionkey"))


@query("select s_suppkey, s_name as name, s_nationkey::varchar as nation from supplier")
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = formats.tsv(F.concat(F.lit('"'), "s_name", F.lit('"\t'), F.col("s_nationkey").cast("string")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", fields.alias("f")).select("s_suppkey", F.get("f", F.lit(0)).alias("name"), F.get("f", F.lit(1)).alias("nation"))


@query("select event_id, event_type as event, props as data from events where event_type <> ''")
def sse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(": note\nevent: "), "event_type", F.lit("\ndata: "), "props", F.lit("\n\n"))
    return read(spark, sf_dir, "events").select("event_id", F.inline(formats.sse_events(text))).select("event_id", "event", "data")


@query()
def xml_page_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.posexplode(formats.xml(F.col("html"))).alias("n", "e")).select("page_id", "n", "e.type", "e.tag", F.to_json("e.attributes").alias("attributes"), "e.text")


@query("select doc_id, octet_length(encode(text)) as bytes, base64(encode(text)) as coded, text as decoded from documents")
def base64_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    df = df.withColumn("coded", codecs.to_base64(F.col("raw")))
    return df.select("doc_id", F.length("raw").cast("bigint").alias("bytes"), "coded", F.unbase64("coded").cast("string").alias("decoded"))


#: An event as nested JSON, with its keys out of order, and in canonical order.
_NESTED = """'{"z":[' || event_id || ',null,{"b":"' || event_type || '","a":true}],"k":' || (props::json->>'$.k') || ',"":[],"e":{}}'"""
_CANONICAL = """'{"":[],"e":{},"k":' || (props::json->>'$.k') || ',"z":[' || event_id || ',null,{"a":true,"b":"' || event_type || '"}]}'"""


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('{"z":['), F.col("event_id").cast("string"), F.lit(',null,{"b":"'), "event_type", F.lit('","a":true}],"k":'), F.get_json_object("props", "$.k"), F.lit(',"":[],"e":{}}'))
    return read(spark, sf_dir, "events").select("event_id", text.alias("text"))


@query(f"select event_id, sha256({_CANONICAL}) as hash from events")
def payload_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).select("event_id", hashing.payload_hash(F.col("text")).alias("hash"))


@query("select doc_id, text as back from documents")
def frame_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "documents").select("doc_id", codecs.join_frames(F.encode("text", "UTF-8")).alias("raw"))
    return codecs.split_frames(df, "raw").select("doc_id", F.col("frame").cast("string").alias("back"))


def _murmur(text: str) -> str:
    """DuckDB SQL for the 32-bit MurmurHash3 of an ASCII text of up to seven characters."""
    mask = "4294967295"
    rotated = lambda x, r: f"((({x}) << {r}) & {mask} | (({x}) >> {32 - r}))"
    scrambled = lambda k: f"({rotated(f'(({k}) * 3432918353::hugeint) & {mask}', 15)} * 461845907::hugeint & {mask})"
    byte = lambda i: f"(case when length({text}) >= {i} then ascii(substr({text}, {i}, 1)) else 0 end)::hugeint"
    four = " + ".join(f"{byte(i + 1)} * {256**i}" for i in range(4))
    tail = " + ".join(f"case when length({text}) >= 4 then {byte(i + 5)} else {byte(i + 1)} end * {256**i}" for i in range(3))
    h = f"case when length({text}) >= 4 then ({rotated(f'({scrambled(four)})', 13)} * 5 + 3864292196::hugeint) & {mask} else 0::hugeint end"
    h = f"xor(xor({h}, {scrambled(tail)}), length({text})::hugeint)"
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        h = f"((xor(({h}), ({h}) >> {shift})) * {factor}::hugeint & {mask})"
    return f"(xor(({h}), ({h}) >> 16))::bigint"


_RING = hashing.HashRing.of(["a", "b", "c"])


@query(f"""with k as (select distinct user_id, {_murmur("user_id::varchar")} as hash from events),
    points(h, owner) as (values {", ".join(f"({h}, '{n}')" for h, n in _RING.points)})
    select user_id, hash, coalesce((select arg_min(owner, h) from points where h >= hash), (select arg_min(owner, h) from points)) as owner from k""")
def ring_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("user_id").cast("string")
    return read(spark, sf_dir, "events").select("user_id").distinct().select("user_id", hashing.hash32(key).alias("hash"), _RING.owner_of(key).alias("owner"))


@query("select event_id, (event_id % 90 + 1) * 60000.0::double as ms from events")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", duration_ms(F.concat((F.col("event_id") % 90 + 1).cast("string"), F.lit("m"))).alias("ms"))


@query("""select event_id, map_keys(m)[1] as partition, map_values(m)[1] as "offset" from (select event_id, map([(user_id % 4)::int], [event_id]) as m from events)""")
def offset_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = formats.offsets_text(F.create_map((F.col("user_id") % 4).cast("int"), F.col("event_id")))
    back = formats.offsets_map(text)
    return read(spark, sf_dir, "events").select("event_id", F.element_at(F.map_keys(back), 1).alias("partition"), F.element_at(F.map_values(back), 1).alias("offset"))


# Connectors as data


@query("""with r as (select l_orderkey, l_linenumber, l_linenumber - row_number() over (partition by l_orderkey order by l_linenumber) as run
      from (select distinct l_orderkey, l_linenumber from lineitem where l_returnflag <> 'R')),
    f as (select l_orderkey, min(run) as run from r group by l_orderkey)
    select l_orderkey, max(l_linenumber) + 1 as committable from r join f using (l_orderkey, run) group by l_orderkey""")
def offset_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.offset_islands(read(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'"), "l_orderkey", "l_linenumber")


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a queue."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "dead").otherwise("pending")
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("payload"), status.alias("status"), F.col("o_orderdate").cast("timestamp").alias("visible_at"), (F.col("o_orderkey") % 4).cast("int").alias("attempt_count"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").cast("timestamp").alias("created_at"))


@query("""select count(*) filter (o_orderstatus not in ('F', 'P')) as pending, count(*) filter (false) as processing, count(*) filter (o_orderstatus = 'F') as completed,
    count(*) filter (o_orderstatus = 'P') as dead, count(*) as total from orders""")
def queue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queues.metrics(_queue(spark, sf_dir))


@query("""select o_orderkey as id from orders where o_orderstatus not in ('F', 'P') and o_orderdate <= timestamp '1997-01-01' and o_orderkey % 4 < 3
    order by o_orderdate, o_orderkey limit 10""")
def queue_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A claim is a batch of ten."""
    return queues.claim(_queue(spark, sf_dir), F.lit("1997-01-01").cast("timestamp")).select("id")


@query("select min(o_orderkey) as id, o_custkey from orders group by o_custkey")
def fifo_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return queues.fifo(rows, "head", "o_custkey", "id", 1 << 30)


@query("""with r as (select o_orderkey as id, o_custkey, row_number() over (partition by o_custkey order by o_orderkey) as n from orders)
    select id, o_custkey from r order by n, id limit 50""")
def fifo_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read takes a batch of fifty."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return queues.fifo(rows, "round-robin", "o_custkey", "id", 50)


@query("""select event_id, ts from events where (ts, event_id) > (timestamp '2024-01-10', 0) order by ts, event_id limit 100""")
def cdc_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has a hundred changes."""
    from datetime import datetime

    return queues.change_page(read(spark, sf_dir, "events"), "ts", "event_id", (datetime(2024, 1, 10), 0), 100).select("event_id", "ts")


@query("""select event_id, round(value * 100)::bigint as cents, cast(null as varchar) as message from events where value >= 1 and event_type <> 'error'
    union all select event_id, null, 'not an amount' from events where not (value >= 1 and event_type <> 'error')""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ev.normalised(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts")), topic="events")
    bad = (F.col("value") < 1) | (F.col("event_type") == "error")
    good, dead = split_errors(guarded_map(df, {"cents": F.round(F.col("value") * 100).cast("bigint")}, {"not an amount": bad}))
    return good.select("event_id", "cents", F.lit(None).cast("string").alias("message")).unionByName(dead.select(F.col("source.offset").alias("event_id"), F.lit(None).cast("bigint").alias("cents"), F.col("error.message").alias("message")))


@query(f"select event_id, max(epoch_us(ts)) over (order by event_id rows between unbounded preceding and 1 preceding) - {HOUR} as watermark from events")
def watermarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = running(timed(spark, sf_dir), "event_id", {"watermark": ("max", F.col("t"))}, inclusive=False)
    return out.select("event_id", (F.col("watermark") - HOUR).alias("watermark"))


# More of topologies: users' aggregates, partitions, repeated emission, positions to start at


@query(f"""{_SESSIONS} select user_id, min(t) as window_start_us, max(t) as window_end_us, round(sum(value), 6) as total, arg_max(event_type, event_id) as last from s group by user_id, n""")
def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's aggregate of sessions, with a merge."""
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    add = lambda s, r: (s[0] + (r["value"] or 0.0), r["event_type"])
    out = rows.session("2h").fold(lambda: (0.0, None), add, lambda _, s: {"total": round(s[0], 6), "last": s[1]}, "total double, last string", lambda a, b: (a[0] + b[0], b[1]))
    return _windowed(out.replay(), F.round("total", 6).alias("total"), "last")


@query(f"""select user_id, t // {HOUR * 24} * {HOUR * 24} as window_start_us, t // {HOUR * 24} * {HOUR * 24} + {HOUR * 24} as window_end_us,
    string_agg(event_type, '>' order by event_id) as path from {_T} group by all""")
def tumbling_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topology(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id"))
    out = rows.tumbling("1d").fold(list, lambda s, r: [*s, r["event_type"]], lambda _, s: {"path": ">".join(s)}, "path string")
    return _windowed(out.replay(), "path")


@query(f"""with a as (select *, user_id % 4 as p, max(t2) over (partition by user_id % 4 order by event_id rows between unbounded preceding and 1 preceding) as wm from {_T2})
    select user_id, t2 // {HOUR} * {HOUR} as window_start_us, t2 // {HOUR} * {HOUR} + {HOUR} as window_end_us, count(*) as "count"
    from a where wm is null or t2 // {HOUR} * {HOUR} + {HOUR} > wm group by all""")
def tumbling_by_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of four source partitions has a watermark of its own."""
    rows = topology(read(spark, sf_dir, "events"), "event_id", shifted(), partition=F.col("user_id") % 4).key_by(F.col("user_id"))
    return _windowed(rows.tumbling("1h").count().replay(), "count")


@query(f"""{_LATE}, w as (select *, unnest([t2 // {HOUR} * {HOUR} - {HOUR}, t2 // {HOUR} * {HOUR}]) as s from a),
    x as (select *, wm is not null and s + {2 * HOUR} <= wm as ended from w where s >= 0),
    y as (select *, bool_or(not ended) over (partition by event_id) as any_open from x)
    select user_id, s as window_start_us, s + {2 * HOUR} as window_end_us, count(*) as "count" from y where any_open group by user_id, s, case when ended then event_id end""")
def sliding_emitted_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late rows of overlapping windows emit the closed one a second time."""
    rows = topology(read(spark, sf_dir, "events"), "event_id", shifted()).key_by(F.col("user_id"))
    return _windowed(rows.sliding("2h", "1h", lateness="2h").count().replay(reference=True), "count")


@query("""select event_id, 'time' as kind from events where ts >= timestamp '2024-01-10' union all select event_id, 'ordinal' from events where event_id >= 500
    union all select event_id, 'earliest' from events""")
def start_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ev.normalised(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts")))
    at = {"time": "timestamp:1704844800000", "ordinal": 500, "earliest": "earliest", "latest": "latest"}
    return ordered.merge_all(*(ev.start_at(df, v).select("event_id", F.lit(k).alias("kind")) for k, v in at.items()))


@query("select event_id, (user_id % 4)::int as p from events where user_id % 4 in (1, 3)")
def chosen_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ev.normalised(read(spark, sf_dir, "events"), "event_id", windows.micros(F.col("ts")), F.col("user_id") % 4)
    return ev.partitions(df, [1, 3]).select("event_id", F.col("_partition").alias("p"))


# Failures, calls, metrics


@query("""select event_id, value >= 1 and event_type <> 'error' as ok, case when value >= 1 and event_type <> 'error' then value end as value,
    case when value < 1 then 'too small' when event_type = 'error' then 'an error' end as error from events""")
def either(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    out = errors.either(df, "e", F.col("value"), {"too small": F.col("value") < 1, "an error": F.col("event_type") == "error"})
    return out.select("event_id", "e.ok", "e.value", "e.error")


@query("""select event_id, value as checked, (select case when count(*) > 0 then 'too small' end from events where value < 1) as thrown from events where value >= 1""")
def rethrown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows thrown again: the first failure ends the job, and its message is caught; then those that are right."""
    checked = errors.either(read(spark, sf_dir, "events").select("event_id", "value"), "checked", F.col("value"), {"too small": F.col("value") < 1})
    thrown = None
    try:
        drain(errors.rethrow(checked, "checked"))
    except Exception as e:
        if "too small" not in str(e):
            raise
        thrown = "too small"
    return errors.rethrow(checked.where("checked.ok"), "checked").select("event_id", "checked", F.lit(thrown).cast("string").alias("thrown"))


@query("select user_id, user_id * user_id + 1 as answer from (select distinct user_id from events)")
def async_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return ordered.map_async(users, lambda x: x * x + 1, "user_id", "answer", "bigint")


@query("select event_id, upper(event_type) as kind from events")
def chunked_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c in chunks:
            yield pd.DataFrame({"event_id": c["event_id"], "kind": c["event_type"].str.upper()})

    return ordered.map_chunks(read(spark, sf_dir, "events").select("event_id", "event_type"), f, "event_id bigint, kind string")


@query("select user_id, case when user_id % 3 = 0 then null else 'u' || user_id end as name from (select distinct user_id from events)")
def remote_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select("user_id").distinct()
    return joins.lookup_remote(users, "user_id", lambda keys: {k: f"u{int(k)}" for k in keys if k % 3}, "name", "string")


@query("""select 'counter' as kind, event_type, round(sum(value), 6) as value from events group by event_type
    union all select 'gauge', event_type, arg_max(value, event_id) from events group by event_type""")
def counters_and_gauges(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events")
    total = terminals.counters(df, ["event_type"], F.col("value")).select(F.lit("counter").alias("kind"), "event_type", F.round("value", 6).alias("value"))
    return total.unionByName(terminals.gauges(df, ["event_type"], "value", "event_id").select(F.lit("gauge").alias("kind"), "event_type", "value"))


@query("select event_id, (props::json->>'$.k')::bigint as k from events")
def ndjson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", formats.ndjson(F.col("props"), "k bigint").alias("v")).select("event_id", "v.k")


@query("""select event_id, date_trunc('hour', ts) + interval 1 hour as hourly, date_trunc('day', ts) + interval 1 day as daily,
    case when ts < date_trunc('day', ts) + interval 390 minute then date_trunc('day', ts) + interval 390 minute else date_trunc('day', ts) + interval 1830 minute end as morning from events""")
def cron_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {"hourly": "@hourly", "daily": "0 0 * * *", "morning": "30 6 * * *"}
    df = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return df.select("event_id", *(cron_next(F.col("ts"), e).cast("timestamp_ntz").alias(n) for n, e in at.items()))


@query("""with l as (select event_id, ts, (ts::timestamp at time zone 'UTC') at time zone 'America/New_York' as local from events),
    c as (select *, date_trunc('day', local) + interval 12 hour + case when local < date_trunc('day', local) + interval 12 hour then interval 0 day else interval 1 day end as noon from l)
    select event_id, ((noon at time zone 'America/New_York') at time zone 'UTC')::timestamp as noon from c""")
def cron_in_a_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next noon in New York, whose clocks change twice a year."""
    df = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return df.select("event_id", cron_next(F.col("ts"), "0 12 * * *", "America/New_York").cast("timestamp_ntz").alias("noon"))


@query("""with c as (select c_custkey, (c_custkey % 100 + 1)::double as base, c_custkey % 6 as kind from customer), n as (select c.*, range::bigint as n from c, range(8))
    select c_custkey, n, case kind when 0 then base * 2 ** n when 1 then base * (n + 1) when 2 then base when 3 then least(500.0::double, base * 2 ** n)
      when 4 then ([1, 1, 2, 3, 5, 8, 13, 21])[n + 1] * base else 0.0::double end as ms from n where kind < 5 or n < 3""")
def schedule_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's policy, by its key, laid out as rows."""
    policies = [Schedule.exponential, Schedule.linear, Schedule.spaced, lambda ms: Schedule.exponential(ms).max_delay("500ms"), Schedule.fibonacci, lambda _: Schedule.recurs(3)]

    def laid_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([(k, n, float(d)) for k in b["c_custkey"] for n, d in enumerate(policies[k % 6](float(k % 100 + 1)).delays(8))], columns=["c_custkey", "n", "ms"])

    return read(spark, sf_dir, "customer").select("c_custkey").mapInPandas(laid_out, "c_custkey bigint, n bigint, ms double")


@query("select event_id, ([1, 1000, 60000, 3600000, 86400000, 604800000])[event_id % 6 + 1] * (event_id % 50 + 0.5)::double as ms from events where event_id % 7 <> 0 union all select event_id, null from events where event_id % 7 = 0")
def duration_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("ms", "s", "m", "h", "d", "w"))), (F.col("event_id") % 6 + 1).cast("int"))
    text = F.when(F.col("event_id") % 7 == 0, "7 years").otherwise(F.concat((F.col("event_id") % 50).cast("string"), F.lit(".5 "), unit))
    return read(spark, sf_dir, "events").select("event_id", duration_ms(text).alias("ms"))


@query("""with recursive f as (select 0 as n, (select sum(n_nationkey) from nation)::bigint as x union all select n + 1, (x * 48271) % 2147483647 from f where n + 1 < (select count(*) from customer))
    select n::bigint as _seq, x as value from f""")
def iterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A congruential sequence from the nations' sum, as long as there are customers."""
    seed = read(spark, sf_dir, "nation").agg(F.sum("n_nationkey")).first()[0]
    return records.iterate(spark, seed, lambda x: x * 48_271 % 2_147_483_647, "value bigint", read(spark, sf_dir, "customer").count())


@query("select n_nationkey, n_regionkey = n_nationkey % 5 as same, substr('{\"k\":' || n_nationkey || ',\"r\":' || n_regionkey || '}', 1, 8) as shown from nation")
def json_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.struct(F.col("n_regionkey").alias("v")), F.struct((F.col("n_nationkey") % 5).cast("bigint").alias("v"))
    row = F.struct(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    return read(spark, sf_dir, "nation").select("n_nationkey", terminals.json_equal(F.struct(a["v"].cast("bigint").alias("v")), b).alias("same"), terminals.shown(row, 8).alias("shown"))


# More of queues


@query("""with q as (select o_orderkey as id, o_custkey, min(o_orderkey) over (partition by o_custkey) as first from orders)
    select id, o_custkey from q order by first, id limit 60""")
def fifo_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A read takes a batch of sixty, group by group."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey")
    return queues.fifo(rows, "grouped", "o_custkey", "id", 60)


_QUEUE = """q as (select o_orderkey as id, case o_orderstatus when 'F' then 'completed' when 'P' then 'dead' else 'pending' end as status, (o_orderkey % 4)::int as attempts from orders)"""


@query(f"""with {_QUEUE}, o as (select id, id % 2 = 0 as ok from q where status = 'pending' and id % 3 <> 0)
    select q.id, case when ok then 'completed' when not ok and attempts + 1 >= 3 then 'dead' when not ok then 'pending' else status end as status,
    attempts + case when ok is null then 0 else 1 end as attempt_count from q left join o using (id)""")
def queue_settle(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    outcomes = queue.where("status = 'pending' and id % 3 <> 0").select("id", (F.col("id") % 2 == 0).alias("ok"))
    return queues.settle(queue, outcomes, F.lit("1999-01-01").cast("timestamp")).select("id", "status", "attempt_count")


@query(f"""with {_QUEUE} select id, case when status = 'dead' then 'pending' else status end as status, case when status = 'dead' then 0 else attempts end as attempt_count, status = 'completed' as archived from q
    union all select -n_nationkey - 1, 'pending', 0, false from nation""")
def queue_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages appended, dead ones sent back, completed ones moved to the archive."""
    now = F.lit("1999-01-01").cast("timestamp")
    new = read(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).alias("id"), F.col("n_name").alias("payload"))
    stays, goes = queues.archive(queues.requeue_dead(queues.publish(_queue(spark, sf_dir), new, now), now))
    part = lambda df, archived: df.select("id", "status", "attempt_count", F.lit(archived).alias("archived"))
    return part(stays, False).unionByName(part(goes, True))


@query("""with n as (select o_orderkey as id, o_custkey % 5 as feed, row_number() over (partition by o_custkey % 5 order by o_orderkey) - 1 as n from orders)
    select id, feed from n union all select id, feed from n where n % 3 = 0""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each change comes twice: two thirds of them ten changes later, which is known, others a hundred later, by when sixty others have made it forgotten."""
    once = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 5).alias("feed"))
    n = ordered.with_index(once, "id", "n", ["feed"])
    twice = n.withColumn("at", F.explode(F.array(F.col("n") * 4, F.when(F.col("n") % 3 == 0, F.col("n") * 4 + 401).otherwise(F.col("n") * 4 + 42))))
    # changes of nothing at the end, so that the last ones are forgotten as well
    more = n.groupBy("feed").agg(F.max("n").alias("last")).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(110))))
    more = more.select((-F.col("feed") * 1000 - F.col("k")).alias("id"), "feed", (F.col("last") + F.col("k")).alias("n"), ((F.col("last") + F.col("k")) * 4).alias("at"))
    return queues.drop_repeated(twice.unionByName(more), "id", "at", "feed", 60).where("id >= 0").select("id", "feed")


@query("select count(*) filter (o_orderstatus in ('F', 'P')) as left_over, count(*) filter (o_orderstatus not in ('F', 'P')) as purged from orders")
def queue_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = _queue(spark, sf_dir)
    both = queues.purge(queue).select(F.lit(1).alias("a")).unionByName(queue.where("status = 'pending'").select(F.lit(0).alias("a")))
    return both.agg(F.sum("a").cast("bigint").alias("left_over"), F.count_if(F.col("a") == 0).alias("purged"))


@query(f"select event_id, {_NESTED} as back from events")
def message_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nested(spark, sf_dir).select("event_id", codecs.unpacked(codecs.packed(F.col("text"))).alias("back"))


@query(f"""select event_id, value, 0 as _src from events where event_id < {_FIRST} union all select -n_nationkey, n_nationkey::double, 1 from nation where {_FIRST} < 9223372036854775807""")
def or_else(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows up to the first of 90 or more, then another source."""
    rows = errors.either(read(spark, sf_dir, "events").select("event_id", "value"), "v", F.col("value"), {"too large": F.col("value") >= 90}).select("event_id", F.col("v").alias("value"))
    other = read(spark, sf_dir, "nation").select((-F.col("n_nationkey")).alias("event_id"), F.col("n_nationkey").cast("double").alias("value"))
    return errors.or_else_rows(rows, "value", "event_id", other, "too")


@query("""select event_id, case when value < 1 then -1.0::double when event_type = 'error' then -2.0::double else value end as value,
    case when value < 1 then 'E: small' when event_type = 'error' then 'E: kind' end as error from events""")
def recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = errors.either(read(spark, sf_dir, "events"), "e", F.col("value"), {"small": F.col("value") < 1, "kind": F.col("event_type") == "error"})
    rows = errors.map_error(rows, "e", lambda x: F.concat(F.lit("E: "), x)).withColumn("error", F.col("e.error"))
    return errors.recover(rows, "e", lambda x: F.when(x == "E: small", -1.0).otherwise(-2.0)).select("event_id", F.col("e").alias("value"), "error")


_GAP = 20 * MINUTE


@query(f"""with g as (select event_id, t - lag(t) over (order by event_id) as gap from {_T})
    select event_id from events where event_id < coalesce((select min(event_id) from g where gap > {_GAP}), 9223372036854775807)""")
def timed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timing.timeout(timed(spark, sf_dir), "event_id", "t", _GAP).select("event_id")


@query(f"""with s as (select t, (event_id // 50) % 2 = 1 as paused from {_T} where event_id % 50 = 7),
    e as (select event_id, t from {_T} where event_id % 50 <> 7)
    select event_id, case when coalesce((select arg_max(paused, t) from s where s.t <= e.t), false) then (select min(t) from s where s.t > e.t and not paused) else t end as delivered_at from e""")
def paused(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = timed(spark, sf_dir).select("event_id", "t")
    signals = df.where("event_id % 50 = 7").select(F.col("t").alias("at"), (F.floor(F.col("event_id") / 50) % 2 == 1).alias("stop"))
    return timing.pause_when(df.where("event_id % 50 <> 7"), "t", signals, "at", "stop").select("event_id", "delivered_at")


# Commits, closing windows, recovery, retention


def _deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each supplier as offsets of a partition, of which those returned never complete; others complete by their day of shipping, ties by ordinal."""
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate", "l_returnflag")
    offsets = ordered.with_index(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "offset", ["l_suppkey"])
    done = F.unix_seconds(F.col("l_shipdate").cast("timestamp")) * 100_000 + F.col("offset")
    return offsets.select("l_suppkey", "offset", F.when(F.col("l_returnflag") != "R", done).when(F.col("offset") % 5 > 0, done + 10**12).alias("done"))


_DELIVERIES = """select l_suppkey, o as "offset", case when l_returnflag <> 'R' then d when o % 5 > 0 then d + 1000000000000 end as done
    from (select *, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as o, epoch(l_shipdate::timestamp)::bigint * 100000 + o as d from lineitem)"""
_FRONTIER = f"""with d as ({_DELIVERIES}),
    r as (select *, max(coalesce(done, 9e18::bigint)) over (partition by l_suppkey order by "offset") as ready from d)
    select l_suppkey, "offset", done, (select max("offset") + 1 from r b where b.l_suppkey = a.l_suppkey and b.ready <= a.done) as committable from d a where done is not null"""


@query(_FRONTIER)
def commit_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset that is committable after each completion."""
    return timing.commit_frontier(_deliveries(spark, sf_dir), "l_suppkey", "offset", "done")


_SPAN = 20 * 86_400 * 100_000


@query(f"""with recursive f as ({_FRONTIER}), n as (select *, row_number() over (partition by l_suppkey order by done) as n from f),
    b as (select l_suppkey, n, done, committable, done as first, 1 as size, 0 as batch from n where n = 1
      union all select n.l_suppkey, n.n, n.done, n.committable, case when b.size = 8 or n.done >= b.first + {_SPAN} then n.done else b.first end,
        case when b.size = 8 or n.done >= b.first + {_SPAN} then 1 else b.size + 1 end, case when b.size = 8 or n.done >= b.first + {_SPAN} then b.batch + 1 else b.batch end
      from b join n on n.l_suppkey = b.l_suppkey and n.n = b.n + 1),
    e as (select l_suppkey as partition, batch, max(done) as committed_at, max(committable) as committed from b group by all),
    p as (select *, lag(committed) over (partition by partition order by batch) as before from e)
    select partition, batch::bigint as batch, committed_at, committed from p where committed is not null and (before is null or committed > before)""")
def batched_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledgements in batches of eight, or of twenty days."""
    return timing.commits(_deliveries(spark, sf_dir), "l_suppkey", "offset", "done", 8, _SPAN)


def _closing_sql(found: str, bound: str) -> str:
    return f"""with e as (select event_id, user_id, epoch_us(ts) - (event_id % 7) * {HOUR} as t from events),
        m as (select *, max(t) over (order by event_id rows between unbounded preceding and 1 preceding) - {2 * HOUR} as wm from e),
        moves as (select t - {2 * HOUR} as x, event_id from m where wm is null or t - {2 * HOUR} > wm),
        f as ({found}),
        c as (select f.*, (select min(event_id) from moves where x >= {bound}) as closed_seq from f),
        u as (select *, max(coalesce(closed_seq, 9e18::bigint)) over (partition by user_id order by opened, window_start_us rows between unbounded preceding and 1 preceding) as before from c),
        s as (select *, max(case when before is null or opened > before then opened end) over (partition by user_id order by opened, window_start_us) as stint from u)
        select user_id, window_start_us, window_end_us, opened, closed_seq, row_number() over (partition by closed_seq order by stint, window_start_us) - 1 as emitted from s"""


@query(_closing_sql(f"select user_id, t - t % {HOUR} as window_start_us, t - t % {HOUR} + {HOUR} as window_end_us, min(event_id) as opened from m where wm is null or t - t % {HOUR} + {HOUR} > wm group by all", "window_end_us"))
def tumbling_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which record each window is emitted, and in which place there."""
    df = read(spark, sf_dir, "events").withColumn("t", shifted())
    found = topology(df, "event_id", F.col("t")).key_by(F.col("user_id")).tumbling("1h", lateness="2h").aggregate(F.min("event_id").alias("opened")).replay()
    found = found.select(F.col("_key").cast("bigint").alias("user_id"), "window_start_us", "window_end_us", "opened")
    return windows.with_closing(found, df, ["user_id"], "t", "event_id", "opened", 2 * HOUR)


@query(_closing_sql(f"""select user_id, min(t) as window_start_us, max(t) as window_end_us, min(event_id) as opened from (
      select *, sum(starts) over (partition by user_id order by t, event_id) as n from (
        select *, case when t - lag(t) over (partition by user_id order by t, event_id) <= {6 * HOUR} then 0 else 1 end as starts from m where wm is null or wm - t <= {6 * HOUR})) group by user_id, n""", f"window_end_us + {6 * HOUR} + 1"))
def session_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "events").withColumn("t", shifted())
    marked = windows.with_watermark(df, "t", "event_id", 2 * HOUR)
    found = windows.sessions(marked, ["user_id"], "t", 6 * HOUR, [F.min("event_id").alias("opened")])
    return windows.with_closing(found, df, ["user_id"], "t", "event_id", "opened", 2 * HOUR, 6 * HOUR)


_KIND = "case event_type when 'purchase' then 'ack' when 'click' then 'claim' else 'deliver' end"
_PENDING = f"""with l as (select event_id, user_id, epoch_us(ts) as t, {_KIND} as kind from events),
    a as (select *, coalesce(max(case when kind = 'ack' then event_id end) over w, -1) as acked, coalesce(max(case when kind = 'deliver' then event_id end) over w, -1) as opened,
      coalesce(max(case when kind = 'ack' then event_id end) over (partition by user_id), -1) as last_ack from l window w as (partition by user_id order by event_id)),
    p as (select user_id as entry, count(*) as deliveries, max(t) as delivered_at, min(event_id) as first_seq from a where kind <> 'ack' and opened > acked and acked = last_ack group by user_id)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark, sf_dir).select("event_id", "user_id", "t", F.expr(_KIND).alias("kind"))


@query(f"{_PENDING} select * from p")
def pending_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as entries of a log: purchases acknowledge, clicks claim, all else delivers."""
    return queues.pending(_log(spark, sf_dir), "user_id", "event_id", "t", "kind")


_NOW = "(select max(epoch_us(ts)) from events)"


@query(f"""{_PENDING} select entry, deliveries + 1 as deliveries, {_NOW} - delivered_at as idle_us, first_seq, deliveries + 1 >= 5 as dead from p where {_NOW} - delivered_at >= {24 * HOUR}""")
def pending_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries idle for a day are claimed anew; with the fifth delivery they are dead letters."""
    log = _log(spark, sf_dir)
    waiting = queues.pending(log, "user_id", "event_id", "t", "kind").crossJoin(F.broadcast(log.agg(F.max("t").alias("now"))))  # one row
    claimed, dead = queues.recover(waiting, F.col("now"), 24 * HOUR, 5)
    return claimed.withColumn("dead", F.lit(False)).unionByName(dead.withColumn("dead", F.lit(True)))


@query(f"""{_chain("t as last, true as pass", f"case when e.t > r.last + {3 * HOUR} then e.t else r.last end, e.t > r.last + {3 * HOUR}")} select event_id, user_id from r where pass""")
def dedupe_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user passes again three hours after the last event that passed."""
    df = read(spark, sf_dir, "events")
    out = topology(df, "event_id", windows.micros(F.col("ts"))).key_by(F.col("user_id")).dedupe(F.col("user_id"), within="3h").replay()
    return out.select("event_id", "user_id")


# Records by ranges


def _registered(spark: SparkSession, what: str) -> str:
    """A new folder for records."""
    splits.register(spark)
    return shared_folder(spark, what)


@query("select doc_id, text, lang, source, n_chars from documents")
def split_csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSV with line breaks in fields, read by ranges."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), _registered(spark, "csv")
    docs.write.format(splits.NAME).option("kind", "csv").mode("append").save(path)
    return spark.read.format(splits.NAME).option("kind", "csv").option("split", 1 << 20).schema(docs.schema).load(path)


@query("select doc_id, length(text)::bigint as n, sha256(text) as digest from documents")
def split_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as frames of JSON, read by ranges."""
    docs, path = read(spark, sf_dir, "documents").select("doc_id", "text"), _registered(spark, "frames")
    docs.select(F.encode(F.to_json(F.struct("doc_id", "text")), "UTF-8").alias("frame")).write.format(splits.NAME).mode("append").save(path)
    back = spark.read.format(splits.NAME).option("split", 1 << 20).load(path).select(F.from_json(F.decode("frame", "UTF-8"), "doc_id bigint, text string").alias("r"))
    return back.select("r.doc_id", F.length("r.text").cast("bigint").alias("n"), F.sha2("r.text", 256).alias("digest"))


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def committed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in two batches, of which one comes twice and one fails and comes again."""
    orders, path = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), _registered(spark, "orders")
    odd = F.col("o_orderkey") % 2 == 1
    write = lambda df, batch: df.write.format(splits.NAME).option("kind", "csv").option("batch", batch).mode("append").save(path)
    write(orders.where(odd), "odd")
    write(orders.where(odd), "odd")
    failing = F.when(F.col("o_orderpriority").isNotNull(), F.raise_error(F.lit("the sink's failure"))).otherwise(F.col("o_orderpriority"))
    try:
        write(orders.where(~odd).withColumn("o_orderpriority", failing.cast("string")), "even")
    except Exception as e:  # the failure that is asked for, and no other
        if "the sink's failure" not in str(e):
            raise
    write(orders.where(~odd), "even")
    return spark.read.format(splits.NAME).option("kind", "csv").schema(orders.schema).load(path)


# Codecs, orders, retried calls

_LINE = protobuf.Message(number=protobuf.Field(1, "int32"), quantity=protobuf.Field(2, "double"), flag=protobuf.Field(3, "string"))
_ORDER = protobuf.Message(key=protobuf.Field(1, "int64"), priority=protobuf.Field(2, "string"), lines=protobuf.Field(3, _LINE, repeated=True))


@query("""select o_orderkey as key, o_orderpriority as priority, l_linenumber as number, l_quantity::double as quantity, l_returnflag as flag, null::varchar as error
    from orders left join lineitem on l_orderkey = o_orderkey""")
def protobuf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as messages, and back."""
    line = F.struct(F.col("l_linenumber").cast("int").alias("number"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_returnflag").alias("flag"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.collect_list(line).alias("lines"))
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority")).join(lines, "key", "left")
    coded = orders.select(protobuf.encode(F.struct("key", "priority", "lines"), _ORDER).alias("bytes"))
    back = coded.select(protobuf.decode("bytes", _ORDER).alias("m")).select("m.value.key", "m.value.priority", F.explode_outer("m.value.lines").alias("l"), "m.error")
    return back.select("key", "priority", "l.number", "l.quantity", "l.flag", "error")


@query("""select c_custkey, c_custkey % 7 <> 3 as fits, case when c_custkey % 7 <> 3 then c_name end as name, case when c_custkey % 7 <> 3 then c_acctbal::varchar end as balance from customer""")
def composed_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An array of tuples with a record of JSON texts, of which some are broken on the way."""
    codec = composed.array_of(composed.tuple_of(composed.identity(), composed.record_of(composed.text("struct<n:string,b:array<string>>"))))
    inner = F.struct(F.col("c_name").alias("n"), F.array(F.col("c_acctbal").cast("string"), F.lit(None).cast("string")).alias("b"))
    value = F.array(F.struct(F.col("c_custkey").alias("_1"), F.create_map(F.lit("c"), inner, F.lit("none"), F.lit(None).cast("struct<n:string,b:array<string>>")).alias("_2")))
    raw = read(spark, sf_dir, "customer").select("c_custkey", codec.encode(value).alias("raw"))
    broken = F.transform("raw", lambda t: F.struct(t["_1"].alias("_1"), F.transform_values(t["_2"], lambda _, v: F.when(F.col("c_custkey") % 7 == 3, F.substring(v, 1, 9)).otherwise(v)).alias("_2")))
    out = raw.select("c_custkey", broken.alias("raw")).select("c_custkey", composed.attempt(codec, F.col("raw")).alias("r"))
    found = F.element_at(F.col("r.value")[0]["_2"], "c")
    return out.select("c_custkey", F.col("r.error").isNull().alias("fits"), found["n"].alias("name"), F.get(found["b"], F.lit(0)).alias("balance"))


@query("""with t as (select doc_id, substr(coalesce(text, ''), 1, 2) || ([chr(65374), chr(128512), 'z', chr(57344), ''])[doc_id % 5 + 1] as t, n_chars from documents),
    u as (select *, flatten(list_transform(list_filter(string_split(t, ''), lambda c: c <> ''), lambda c: case when unicode(c) >= 65536 then [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] else [unicode(c)] end)) as units from t)
    select doc_id, t, row_number() over (order by units, n_chars desc, doc_id) as place from u""")
def utf16_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beginnings of texts in the order of their UTF-16 units, longer texts first, then by identifier."""
    ends = F.array(*map(F.lit, ("\uff5e", "\U0001f600", "z", "\ue000", "")))
    df = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.substring(F.coalesce("text", F.lit("")), 1, 2), F.get(ends, (F.col("doc_id") % 5).cast("int"))).alias("t"), "n_chars")
    along = order.by(lambda r: r["t"], order.text()).then(order.by(lambda r: r["n_chars"]).reversed()).then(order.by(lambda r: r["doc_id"]))
    keys = [f"k{i}" for i in range(3)]
    keyed = df.withColumns(dict(zip(keys, (F.encode("t", "UTF-16BE"), -F.col("n_chars"), F.col("doc_id")), strict=True)))
    ranked = ordered.with_index(keyed.select(*keys), keys, "place")
    check = Window.partitionBy(F.substring("t", 1, 1)).orderBy(*along.columns(F.struct("t", "n_chars", "doc_id")))
    # the sort columns of the order agree with the keys that the whole table is ranked by
    same = keyed.withColumn("own", F.row_number().over(check)).withColumn("by_keys", F.row_number().over(Window.partitionBy(F.substring("t", 1, 1)).orderBy(*keys))).where("own = by_keys")
    return same.join(ranked.select(F.col("k2").alias("id"), "place"), F.col("doc_id") == F.col("id")).select("doc_id", "t", (F.col("place") + 1).alias("place"))


@query("""select c_custkey, case when c_custkey % 5 <= 3 then c_custkey * 2 end as answer, least(c_custkey % 5, 3)::int + 1 as attempts,
    case when c_custkey % 5 > 3 then 'LookupError: attempt 3 of ' || c_custkey end as dead from customer""")
def retried_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A loader that fails by key and attempt, three times retried; what fails then is a dead letter."""

    def load(key: int, attempt: int) -> int:
        if attempt < key % 5:
            raise LookupError(f"attempt {attempt} of {key}")
        return key * 2

    out = calls.map_retried(read(spark, sf_dir, "customer").select("c_custkey"), load, "c_custkey", "r", "bigint", Schedule.recurs(3), ordered=False)
    good, dead = calls.split_failures(out.select("c_custkey", "r").withColumn("n", F.col("r.attempts")), "r")
    good = good.select("c_custkey", F.col("r").alias("answer"), F.col("n").alias("attempts"), F.lit(None).cast("string").alias("dead"))
    letters = dead.select(F.get_json_object("value", "$.c_custkey").cast("bigint").alias("c_custkey"), F.lit(None).cast("bigint").alias("answer"), "attempts", F.concat("error.name", F.lit(": "), "error.message").alias("dead"))
    return good.unionByName(letters)
