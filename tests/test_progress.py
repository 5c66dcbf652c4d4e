"""Commit frontiers, evicting joins, closing windows, recovery and retention against plain simulations; null orders and clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins, ordered, state, timing, windows
from tidewright.sources import queues


def test_commit_frontier_matches_a_tracker(spark):
    rng = random.Random(5)
    rows = []
    for p in (0, 1, None):
        offsets = [o for o in range(50, 110) if not (p == 1 and o == 80)]  # partition 1 has a gap
        done = rng.sample(range(1000), len(offsets))
        rows += [(p, o, None if o == 100 else d) for o, d in zip(offsets, done, strict=True)]
        rows += [(p, 55, 2000)]  # delivered and completed again
    want = []
    for p in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == p]
        front, finished = min(o for _, o, _ in own), set()
        least = front
        for _, o, d in sorted((r for r in own if r[2] is not None), key=lambda r: r[2]):
            finished.add(o)
            while front in finished:
                front += 1
            want.append((p, o, d, front if front > least else None))
    df = spark.createDataFrame(rows, "p int, o bigint, d bigint").repartition(3)
    out = timing.commit_frontier(df, "p", "o", "d")
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert timing.commit_frontier(df.limit(0), "p", "o", "d").collect() == []
    # batches of seven: each commits where the frontier has come to by its last completion
    batches = timing.commits(df.where("p = 0"), "p", "o", "d", 7, 10**9).collect()
    own = sorted((w for w in want if w[0] == 0), key=lambda w: w[2])
    expected, before = [], None
    for i in range(0, len(own), 7):
        last = own[min(i + 6, len(own) - 1)]
        if last[3] is not None and last[3] != before:
            expected.append((0, i // 7, last[2], last[3]))
            before = last[3]
    assert sorted(tuple(r) for r in batches) == expected


def test_evicting_join_matches_buffers(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("ab"), max(0, i * 10 + rng.choice([0, 0, -30, -120, 90, 200])), rng.choice("LR")) for i in range(400)]
    held, want = [], []
    for i, k, t, side in rows:
        held = [h for h in held if h[1] != k or h[2] > t - 60]
        want += [(i, h[0]) if side == "L" else (h[0], i) for h in held if h[1] == k and h[3] != side and abs(h[2] - t) <= 60]
        held.append((i, k, t, side))
    df = spark.createDataFrame(rows, "seq bigint, k string, t bigint, side string").withColumn("_forgotten", F.lit("mine"))
    out = joins.interval_join_evicting(df.where("side = 'L'"), df.where("side = 'R'"), "k", "t", "seq", 60)
    assert sorted((r["left"]["seq"], r["right"]["seq"]) for r in out.collect()) == sorted(want)
    assert out.first()["left"].asDict().keys() == set(df.columns)
    assert len(want) < joins.interval_join(df.where("side = 'L'"), df.where("side = 'R'"), "k", "t", 60, "inclusive").count()


def closings(rows, size, lateness):
    """(key, start, place of emission) by a runner that adds a record, moves its clock and closes windows, key by key."""
    open_, newest, out = {}, None, []
    for seq, k, t in rows:
        start = t - t % size
        if newest is None or start + size > newest - lateness:
            open_.setdefault(k, {}).setdefault(start, seq)
        newest = t if newest is None else max(newest, t)
        n = 0
        for key in list(open_):
            for s in sorted(open_[key]):
                if s + size <= newest - lateness:
                    out.append((key, s, open_[key].pop(s), seq, n))
                    n += 1
            if not open_[key]:
                del open_[key]
    n = 0
    for key, own in open_.items():
        for s in sorted(own):
            out.append((key, s, own[s], None, n))
            n += 1
    return sorted(out, key=repr)


@pytest.mark.parametrize("lateness", [0, 50])
def test_closing_matches_a_runner(spark, lateness):
    rng = random.Random(8)
    rows = [(i, rng.choice("abcd"), max(0, i * 9 + rng.choice([0, 0, -40, -200, 120]))) for i in range(300)]
    df = spark.createDataFrame(rows, "seq bigint, k string, t bigint").repartition(3)
    marked = windows.with_watermark(df, "t", "seq", lateness)
    found = windows.open_windows(windows.assign_tumbling(marked, "t", 100)).groupBy("k", windows.START, windows.END).agg(F.min("seq").alias("first"))
    out = windows.with_closing(found, df, ["k"], "t", "seq", "first", lateness)
    assert sorted(((r["k"], r[windows.START], r["first"], r[windows.CLOSED], r[windows.RANK]) for r in out.collect()), key=repr) == closings(rows, 100, lateness)


def test_pending_and_recovery(spark):
    log = [(0, "a", 0, "deliver"), (1, "b", 5, "claim"), (2, "b", 10, "deliver"), (3, "a", 20, "claim"), (4, "c", 30, "deliver"), (5, "c", 40, "ack"), (6, "c", 41, "claim"), (7, "d", 50, "deliver"), (8, "d", 60, "ack"), (9, "d", 70, "deliver"), (10, None, 80, "deliver")]
    df = spark.createDataFrame(log, "seq bigint, id string, at bigint, kind string")
    waiting = queues.pending(df, "id", "seq", "at", "kind")
    assert sorted(tuple(r) for r in waiting.collect()) == [("a", 2, 20, 0), ("b", 1, 10, 2), ("d", 1, 70, 9)]
    claimed, dead = queues.recover(waiting, F.lit(100), 60, max_deliveries=3)
    assert [tuple(r) for r in claimed.collect()] == [("b", 2, 90, 2)] and [tuple(r) for r in dead.collect()] == [("a", 3, 80, 0)]
    claimed, dead = queues.recover(waiting, F.lit(100), 0, count=1)
    assert [r["entry"] for r in claimed.collect()] == ["a"] and dead.collect() == []


def test_retention_chains(spark):
    rows = [(0, "a", 0), (1, "a", 10), (2, "a", 11), (3, "a", 5), (4, "a", 22), (5, "b", None), (6, "b", None), (7, "b", 3), (8, "b", 20), (9, "a", 32), (10, "a", 33)]
    df = spark.createDataFrame(rows, "seq bigint, k string, t bigint")
    assert sorted(r["seq"] for r in state.dedupe_within(df, ["k"], "seq", "t", 10).collect()) == [0, 2, 4, 5, 7, 8, 10]


def test_null_orders_come_first(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", 2, 2), ("b", 1, 3), ("c", 5, 4), ("c", None, 5)], "k string, o bigint, v bigint")
    ids = lambda x: sorted(r["v"] for r in x.collect())
    assert ids(ordered.dedupe_first(df, ["k"], "o")) == [1, 3, 5] and ids(ordered.last(df, "o")) == [4] and ids(ordered.head(df.where("k = 'a'"), "o")) == [1]
    assert ids(ordered.last(df.where("k = 'a'"), "o")) == [1] and ids(ordered.drop_while(df, F.col("o").isNull(), "o")) == [2, 3, 4]
    assert ids(ordered.drop_while(df, F.col("o").isNotNull(), "o")) == [1, 2, 3, 4, 5] and ids(ordered.take_while(df, F.col("o").isNull(), "o")) == [1, 5]
    assert ids(timing.sample(spark.createDataFrame([(None, 0, 1), (3, 100, 2)], "o bigint, t bigint, v bigint"), "o", "t", 50)) == [1]
    with_ties = ordered.drop(df, 1, "o").collect()
    assert len(with_ties) == 4


def test_no_name_clashes(spark):
    names = ["_n", "_bound", "_fails", "_before", "_next", "_i", "_first", "_on", "_until", "_signal", "_count", "_o", "_tie", "_go"]
    df = spark.createDataFrame([(i, i * 10, *[f"{n}{i}" for n in names]) for i in range(6)], f"o bigint, t bigint, {', '.join(f'{n} string' for n in names)}")
    whole = sorted(map(tuple, df.collect()))
    same = lambda out, keep: sorted(map(tuple, out.select(*df.columns).collect())) == [w for w in whole if keep(w[0])]
    assert same(ordered.drop(df, 2, "o"), lambda o: o >= 2) and same(ordered.take_while(df, F.col("o") < 3, "o"), lambda o: o < 3) and same(ordered.drop_while(df, F.col("o") < 3, "o"), lambda o: o >= 3)
    assert same(ordered.changes(df, "o", "_before"), lambda o: True) and same(timing.debounce(df, "o", "t", 10), lambda o: True) and same(timing.timeout(df, "o", "t", 50), lambda o: True)
    stamped = df.withColumn("t", F.timestamp_millis("t"))
    assert same(ordered.interrupt_after(stamped, "t", 25).withColumn("t", F.unix_millis("t")), lambda o: o < 3) and same(ordered.take_until(df, "t", df.where("o = 4"), "t"), lambda o: o < 4)
    pairs = ordered.zip_rows(df, df, "o", "o").collect()
    assert len(pairs) == 6 and all(r["left"] == r["right"] for r in pairs)
    assert [r["items"] for r in ordered.grouped(df, 4, "o", "_i").orderBy("batch").collect()] == [[f"_i{i}" for i in range(4)], ["_i4", "_i5"]]
    assert [r["items"] for r in ordered.count_sliding(df, 3, "o", "_i", 3).orderBy("first").collect()] == [["_i0", "_i1", "_i2"], ["_i3", "_i4", "_i5"]]
    assert same(ordered.switch_map(df, df, "o", "t", "t", "o"), lambda o: True)


def _counting(monkeypatch):
    """Frames of which heavy keys are counted, by the nodes of their plans."""
    from pyspark.sql import DataFrame

    from tidewright.operators import spread

    plans, real = [], spread.heavy_keys

    def counted(df: DataFrame, *args):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return real(df, *args)

    for module in (spread, timing, windows):
        monkeypatch.setattr(module, "heavy_keys", counted, raising=False)
    return plans


def test_batched_commits_make_their_rows_once(spark, monkeypatch):
    """each running value counted its keys on all that was before it, Python's batches too."""
    plans = _counting(monkeypatch)
    df = spark.range(400).select((F.col("id") % 3).alias("p"), F.floor(F.col("id") / 3).alias("o"), F.col("id").alias("d"))
    assert timing.commits(df, "p", "o", "d", 7, 10**9).count() == 20 + 19 + 19
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_commit_frontier_counts_keys_in_its_source(spark, monkeypatch):
    """F5, as F1."""
    plans = _counting(monkeypatch)
    df = spark.range(400).select((F.col("id") % 3).alias("p"), F.floor(F.col("id") / 3).alias("o"), F.col("id").alias("d"))
    assert timing.commit_frontier(df, "p", "o", "d").where("committable = o + 1").count() == 400
    assert len(plans) == 1 and "Window" not in plans[0]


def test_commit_frontier_deals_its_rows_out_once(spark):
    """they are sorted where they are, not hashed, made twice and dealt out again."""
    df = spark.range(400).select((F.col("id") % 3).alias("p"), F.floor(F.col("id") / 3).alias("o"), F.col("id").alias("d"))
    plan = timing.commit_frontier(df, "p", "o", "d", heavy=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Union" not in plan and "Aggregate" not in plan


def test_batches_of_odd_keys_and_times(spark):
    nan = float("nan")
    rows = [(k, None if i < 2 else nan if i > 20 else float(i * i % 50 + 10 * i), str(i)) for k in (1.0, nan, None) for i in range(24)]
    out = state.group_within(spark.createDataFrame(rows, "k double, t double, x string").repartition(3), ["k"], "t", 4, 25).collect()
    for k in (1.0, nan, None):
        own = sorted((t for j, t, _ in rows if repr(j) == repr(k)), key=lambda t: (t is not None, t != t, t))
        number, n, first, want = -1, 0, None, []
        for t in own:
            if first is None or n == 4 or t >= first + 25:
                number, n, first = number + 1, 0, t
            n += 1
            want.append((repr(t), number))
        assert sorted((repr(r["t"]), r["batch"]) for r in out if repr(r["k"]) == repr(k)) == sorted(want)
    assert sorted((repr(r["k"]), r["x"]) for r in out) == sorted((repr(k), x) for k, _, x in rows)
    assert [r["batch"] for r in state.group_within(spark.range(5).coalesce(1), [], "id", 2, 100).orderBy("id").collect()] == [0, 0, 1, 1, 2]
    # heavy keys that were counted elsewhere, or not at all, change no value
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id")
    from tidewright.operators import spread

    for heavy in (None, spark.createDataFrame([(0,)], "k bigint"), spark.createDataFrame([(0,), (1,), (9,)], "k bigint")):
        got = spread.running(df, "id", {"n": ("sum", F.col("id"))}, ["k"], ranges=16, heavy=heavy)
        assert got.where("n <> (id - k) / 2 * ((id - k) / 2 + 1) + k * ((id - k) / 2 + 1)").count() == 0 and got.count() == 500


@pytest.mark.parametrize("gap", [None, 50])
def test_closing_windows_are_made_once(spark, monkeypatch, gap):
    """windows were made anew to cut their times, and to count their keys and the ordinals that close them."""
    from tidewright.operators import spread

    plans, cut_by, real = _counting(monkeypatch), [], spread._cuts
    monkeypatch.setattr(spread, "_cuts", lambda df, *a: cut_by.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df, *a))
    rows = spark.range(600).select("id", (F.col("id") % 4).alias("k"), (F.col("id") * 10 - (F.col("id") % 7) * 20).alias("t"))
    found = rows.groupBy("k", (F.floor(F.col("t") / 100) * 100).cast("bigint").alias(windows.START)).agg((F.max(F.floor(F.col("t") / 100)) * 100 + 100).cast("bigint").alias(windows.END), F.min("id").alias("o w"))
    out = windows.with_closing(found, rows, ["k"], "t", "id", "o w", 100, gap)
    assert out.count() == found.count() and out.columns == [*found.columns, windows.CLOSED, windows.RANK]
    assert out.groupBy(windows.CLOSED).agg(F.max(windows.RANK).alias("m"), F.count("*").alias("n")).where("m + 1 <> n").count() == 0
    assert len(plans) == 2 and not any("Window" in p or "Aggregate" in p for p in plans)
    assert not any("Union" in p or "Aggregate" in p for p in cut_by)
