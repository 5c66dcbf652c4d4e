"""Windows, watermarks, joins and state on small fixtures and against record-at-a-time models."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import state, windows
from tidewright.plans.builder import topology
from tidewright.sources import events as ev

SECOND = 1_000_000


def rows(spark, data, schema="user string, ts bigint"):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"seq bigint, {schema}")


def start(spark, data, key="user", **more):
    return topology(rows(spark, data, **more), "seq").key_by(F.col(key))


def got(df, *columns):
    return sorted(tuple(r[c] // 1000 if c.startswith("window") else r[c] for c in columns) for r in df.collect())


W = ("_key", "window_start_us", "window_end_us", "count")


def test_tumbling(spark):
    out = start(spark, [("ann", 100), ("bob", 1200), ("bob", 1300)]).tumbling(1000).count().replay()
    assert got(out, *W) == [("ann", 0, 1000, 1), ("bob", 1000, 2000, 2)]


def test_late_rows_are_dropped_unless_allowed(spark):
    data = [("ann", 100), ("ann", 1500), ("ann", 200)]
    assert got(start(spark, data).tumbling(1000).count().replay(), *W) == [("ann", 0, 1000, 1), ("ann", 1000, 2000, 1)]
    out = start(spark, [*data, ("ann", 2100)]).tumbling("1s", lateness="1s").count().replay()
    assert got(out, *W) == [("ann", 0, 1000, 2), ("ann", 1000, 2000, 1), ("ann", 2000, 3000, 1)]


def test_sessions_include_a_gap_of_exactly_the_length(spark):
    out = start(spark, [("ann", 0), ("ann", 2000), ("ann", 1000)]).session(1000, lateness=5000).count().replay()
    assert got(out, *W) == [("ann", 0, 2000, 3)]
    pages = [("u1", "home", 100), ("u1", "products", 200), ("u1", "cart", 400), ("u1", "checkout", 1200)]
    visited = F.array_join(F.array_sort(F.collect_list(F.struct("seq", "page")))["page"], ",").alias("pages")
    out = start(spark, pages, schema="user string, page string, ts bigint").session(500).aggregate(visited).replay()
    assert got(out, "window_start_us", "window_end_us", "pages") == [(100, 400, "home,products,cart"), (1200, 1200, "checkout")]


def test_sliding(spark):
    out = start(spark, [("k1", 750)]).sliding(1000, 500).count().replay()
    assert got(out, *W) == [("k1", 0, 1000, 1), ("k1", 500, 1500, 1)]
    out = start(spark, [("k", 100), ("k", 1600), ("k", 2999)]).sliding(1000, 1500).count().replay()
    assert got(out, *W) == [("k", 0, 1000, 1), ("k", 1500, 2500, 1)]


def test_negative_times_align_to_the_epoch(spark):
    assert got(start(spark, [("a", -1), ("a", 0)]).tumbling(1000).count().replay(), *W) == [("a", -1000, 0, 1), ("a", 0, 1000, 1)]


def test_sum_of_null(spark):
    t = start(spark, [("a", 1.0, 0), ("a", None, 1)], schema="user string, v double, ts bigint").tumbling(1000)
    assert t.sum(F.col("v")).replay().first()["sum"] == 1.0
    import math

    assert math.isnan(t.sum(F.col("v"), nulls="nan").replay().first()["sum"])


def model_windows(data, size, slide, lateness, reference=False):
    """One record at a time: {(key, start): counts as emitted}."""
    out, newest = {}, None
    for i, (k, t) in enumerate(data):
        mark = None if newest is None else newest - lateness
        starts = [s for s in range((t // slide) * slide - (size // slide + 1) * slide, t + 1, slide) if s <= t < s + size and s >= 0]
        live = [s for s in starts if mark is None or s + size > mark]
        for s in live:
            out[k, s, None] = out.get((k, s, None), 0) + 1
        if reference and live:
            for s in set(starts) - set(live):
                out[k, s, i] = 1
        newest = t if newest is None else max(newest, t)
    return sorted((k, s, n) for (k, s, _), n in out.items())


@pytest.mark.parametrize("shape", [(1000, 1000), (1000, 400), (600, 900)])
def test_windows_match_the_model_on_disordered_input(spark, shape):
    (size, slide), rng = shape, random.Random(sum(shape))
    data = [(rng.choice("ab"), max(0, i * 150 + rng.randrange(-2500, 2500))) for i in range(120)]
    for lateness in (0, 700, 5000):
        for reference in (False, True):
            t = start(spark, data).sliding(size, slide, lateness=lateness)
            out = t.count().replay(reference=reference)
            assert got(out, "_key", "window_start_us", "count") == model_windows(data, size, slide, lateness, reference)


def model_sessions(data, gap, lateness):
    open_, out, newest = [], [], None
    for k, t in data:
        mark = None if newest is None else newest - lateness
        if mark is None or mark - t <= gap:
            hit = [s for s in open_ if s[0] == k and s[1] - gap <= t <= s[2] + gap]
            open_ = [s for s in open_ if s not in hit] + [(k, min([t, *(s[1] for s in hit)]), max([t, *(s[2] for s in hit)]), 1 + sum(s[3] for s in hit))]
            newest = t if newest is None else max(newest, t)
            out += [s for s in open_ if newest - lateness - s[2] > gap]
            open_ = [s for s in open_ if newest - lateness - s[2] <= gap]
    return sorted(out + open_)


def test_sessions_match_the_model(spark):
    rng = random.Random(4)
    data = [(rng.choice("ab"), 5000 + i * 100 + rng.randrange(-800, 800)) for i in range(150)]
    assert got(start(spark, data).session(120, lateness=2000).count().replay(), *W) == model_sessions(data, 120, 2000)
    # beyond the lateness, sessions close before rows that would have bridged them
    t = start(spark, data).session(120, lateness=200)
    assert windows.needs_scan(windows.with_watermark(ev.normalised(rows(spark, data), "seq"), "_event_time_us", "_seq", 200_000), "_event_time_us", 120_000)
    want = model_sessions(data, 120, 200)
    assert got(t.count().replay(), *W) == want != model_sessions(data, 120, 2000)
    add, emit = (lambda n, r: n + 1), (lambda at, n: {"count": n})
    assert got(t.fold(lambda: 0, add, emit, "count bigint", lambda a, b: a + b).replay(), *W) == want
    assert got(t.count().replay(scope="partition_key"), *W) == want


def test_sessions_without_a_merge_stay_apart(spark):
    t = start(spark, [("ann", 0), ("ann", 2000), ("ann", 1000)]).session(1000, lateness=5000)
    add, emit = (lambda s, r: [*s, r["ts"]]), (lambda at, s: {"seen": s, "width": at["window_end_us"] - at["window_start_us"]})
    out = t.fold(list, add, emit, "seen array<bigint>, width bigint").replay()
    assert sorted((r["seen"], r["width"]) for r in out.collect()) == [([0, 1000], 1_000_000), ([2000], 0)]
    out = t.fold(list, add, emit, "seen array<bigint>, width bigint", lambda a, b: a + b).replay()
    assert [(r["seen"], r["width"]) for r in out.collect()] == [([0, 2000, 1000], 2_000_000)]


def test_user_aggregates_of_windows(spark):
    data = [("a", 100), ("b", 150), ("a", 900), ("a", 1200), (None, 1300)]
    t = start(spark, data)
    args = (list, lambda s, r: [*s, r["ts"]], lambda at, s: {"first": s[0], "n": len(s)}, "first bigint, n bigint")
    assert got(t.tumbling(1000).fold(*args).replay(), "window_start_us", "first", "n") == [(0, 100, 2), (0, 150, 1), (1000, 1200, 1), (1000, 1300, 1)]
    assert got(t.sliding(1000, 500).fold(*args).replay(), "window_start_us", "first", "n") == [(0, 100, 2), (0, 150, 1), (500, 900, 2), (500, 1300, 1), (1000, 1200, 1), (1000, 1300, 1)]


def test_scans_hold_a_key_over_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(200).select((F.col("id") % 3 == 0).alias("k"), F.when(F.col("id") % 5 == 0, float("nan")).otherwise(1.0).alias("f"), "id").repartition(4)
        out = state.process(df, ["k", "f"], "id", lambda: 0, lambda n, r: (n + 1, {"id": r["id"], "n": n + 1}), "id bigint, n int").collect()
        seen = {}
        for r in sorted(out):
            key = (r["id"] % 3 == 0, r["id"] % 5 == 0)
            seen[key] = seen.get(key, 0) + 1
            assert r["n"] == seen[key]
        assert len(out) == 200 and state.audit(df.limit(0), ["k"], "id", 5).count() == 0
        assert state.dedupe_capped(df.withColumn("p", F.lit(0)).withColumn("m", F.col("id") % 20), "m", "id", "p", 5).count() == 200
        assert state.dedupe_capped(df.withColumn("p", F.lit(0)).withColumn("m", F.col("id") % 4), "m", "id", "p", 5).count() == 4
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_join(spark):
    one = "key string, v string, t bigint"

    def pairs(left, right, within, bound="strict"):
        a, b = (topology(rows(spark, x, schema=one), "seq", F.col("t") * 1000).key_by(F.col("key")) for x in (left, right))
        return sorted((r["left"]["v"], r["right"]["v"]) for r in a.join(b, within, bound).replay().collect())

    assert pairs([("c1", "l", 1000)], [("c1", "r", 3000)], 5000) == [("l", "r")]
    assert pairs([("k1", "l", 1000)], [("k1", "r", 5000)], 1000) == []
    assert pairs([("k1", "1", 1000), ("k1", "2", 2000)], [("k1", "A", 3000)], 5000) == [("1", "A"), ("2", "A")]
    assert pairs([("k", "l", 1000)], [("k", "r", 2000)], 1000) == []
    assert pairs([("k", "l", 1000)], [("k", "r", 2000)], 1000, "inclusive") == [("l", "r")]
    assert pairs([("k", "l", 1000)], [("j", "r", 1000)], 1000) == []
    rng = random.Random(1)
    left, right = ([(rng.choice("ab"), f"{s}{i}", rng.randrange(-3000, 9000)) for i in range(60)] for s in "lr")
    for bound in ("strict", "inclusive"):
        want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and (abs(x[2] - y[2]) < 700 or bound == "inclusive" and abs(x[2] - y[2]) == 700))
        assert pairs(left, right, 700, bound) == want


def count_step(s, r):
    return s + 1, {"user": r["user"], "seq": r["seq"], "n": s + 1}


def test_process_counts_by_key_and_partition(spark):
    t = start(spark, [("ann", 1), ("bob", 2), ("ann", 3), ("ann", 4)]).process(lambda: 0, count_step, "user string, seq bigint, n bigint")
    assert sorted(tuple(r) for r in t.replay().collect()) == [("ann", 0, 1), ("ann", 2, 2), ("ann", 3, 3), ("bob", 1, 1)]
    df = rows(spark, [("same", 0, 1), ("same", 1, 2)], "user string, p int, ts bigint")
    t = topology(df, "seq", partition=F.col("p")).key_by(F.col("user")).process(lambda: 0, count_step, "user string, seq bigint, n bigint")
    assert sorted(r["n"] for r in t.replay(scope="partition_key").collect()) == [1, 1]
    assert sorted(r["n"] for r in t.replay().collect()) == [1, 2]


def test_process_may_emit_nothing(spark):
    t = start(spark, [("a", 1)]).process(lambda: 0, lambda s, r: (s, None), "n bigint")
    assert t.replay().count() == 0


def test_dedupe(spark):
    t = start(spark, [("a", 1), ("b", 2), ("a", 3), ("c", 4), ("b", 5)]).dedupe(F.col("user"))
    assert sorted(r["ts"] for r in t.replay().collect()) == [1, 2, 4]
    items = [(f"item-{i}", i) for i in range(20)] + [("item-0", 20), ("item-1", 21)]
    assert start(spark, items).dedupe(F.col("user"), most=5).replay().count() == 22
    assert start(spark, items).dedupe(F.col("user"), most=50).replay().count() == 20


def test_stateless_steps(spark):
    t = topology(rows(spark, [("a", 1), ("b", None), ("c", 3)]), "seq", F.lit(0))
    assert sorted(r["x"] for r in t.filter(F.col("ts") > 1).map(x=F.col("ts") * 10).replay().collect()) == [30]
    assert sorted(r["user"] for r in t.filter(F.col("ts") > 1, keep=False).replay().collect()) == ["a", "b"]
    assert t.flat_map(F.array(F.lit(1), F.lit(2)), "v").replay().count() == 6
    out = t.map_async(lambda u: u.upper(), "user", "big", "string", concurrency=2).replay()
    assert sorted(r["big"] for r in out.collect()) == ["A", "B", "C"]


def test_event_time_survives_a_map_that_drops_its_field(spark):
    df = rows(spark, [("ann", "2024-01-01T00:00:00.100Z"), ("ann", "2024-01-01T00:00:00.900Z"), ("ann", "2024-01-01T00:00:01.500Z")], "user string, at string")
    t = topology(df, "seq").event_time(F.unix_micros(F.to_timestamp("at"))).drop("at").key_by(F.col("user")).tumbling("1s").count()
    assert sorted(r["count"] for r in t.replay().collect()) == [1, 2]


def test_plans(spark):
    t = start(spark, [("a", 1)])
    built = t.shuffle().dedupe(F.col("user"), name="x").shuffle().tumbling(5).count().build()
    assert len(built.stages()) == 3 and built.lint() == []
    assert t.dedupe(F.col("user")).build().lint() == ["dedupe has no shuffle before it"]
    with pytest.raises(ValueError, match="named 'x'"):
        t.dedupe(F.col("user"), name="x").dedupe(F.col("ts"), name="x")


def test_sources(spark):
    df = spark.createDataFrame([(0, None, "2024-01-01T00:00:00Z"), (1, 5.0, "bad"), (2, None, "bad")], "seq bigint, ts double, createdAt string")
    n = ev.normalised(df, "seq").orderBy("seq").collect()
    assert n[0]["_event_time_us"] == 1704067200 * SECOND and n[1]["_event_time_us"] == 5000 and n[2]["_event_time_us"] > 1704067200 * SECOND
    copies = spark.createDataFrame([("t", 0, 1, 1), ("t", 0, 1, 1), ("t", 1, 1, 1), ("t", 0, None, 1), ("t", 0, None, 1)], "_topic string, _partition int, _seq bigint, v int")
    assert ev.once(copies).count() == 4
    base = ev.normalised(rows(spark, [("a", 1), ("b", 2), ("c", 3)]), "seq")
    assert [ev.start_at(base, x).count() for x in ("earliest", "latest", 1, "timestamp:3")] == [3, 0, 2, 1]
    assert ev.partitions(base, [0]).count() == 3 and ev.partitions(base, [1]).count() == 0


def test_sequential_operators_match_models(spark):
    rng = random.Random(7)
    data = [(rng.choice("ab"), t) for t in sorted(rng.sample(range(5000), 120))]
    df = rows(spark, data)

    def by_key(f):
        return sorted(t for k in "ab" for t in f([t for key, t in data if key == k]))

    def audit(ts):
        out, end, last = [], None, None
        for t in ts:
            if end is None or t >= end:
                out += [last] if last is not None else []
                end = t + 200
            last = t
        return out + [last]

    def exhaust(ts):
        out, until = [], -1
        for t in ts:
            if t >= until:
                out.append(t)
                until = t + 300
        return out

    assert sorted(r["ts"] for r in state.audit(df, ["user"], "ts", 200).collect()) == by_key(audit)
    assert sorted(r["ts"] for r in state.exhaust_map(df.withColumn("busy", F.lit(300)), ["user"], "ts", "busy").collect()) == by_key(exhaust)
    batches = state.group_within(df, ["user"], "ts", 4, 250).collect()
    for k in "ab":
        groups = {}
        for r in sorted(batches, key=lambda r: r["ts"]):
            if r["user"] == k:
                groups.setdefault(r["batch"], []).append(r["ts"])
        assert all(len(g) <= 4 and g[-1] < g[0] + 250 for g in groups.values())
        assert sorted(groups) == list(range(len(groups)))


def test_rate_limiters():
    assert state.admitted([0, 1, 2, 10, 11], "sliding", 2, 10) == [True, True, False, True, True]
    assert state.admitted([5, 6, 7, 14, 15], "fixed", 2, 10) == [True, True, False, False, True]
    assert state.admitted([0, 0, 0, 5, 10], "bucket", 2, 10) == [True, True, False, True, True]
