"""Ordered operators, joins, timing, queues."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import joins, ordered, spread, timing
from tidewright.sources import queues, records


def numbers(spark, values):
    return spark.createDataFrame([(i * 3, v) for i, v in enumerate(values)], "o bigint, v bigint").repartition(3)


def column(df, name="v", order="o"):
    return [r[name] for r in sorted(df.collect(), key=lambda r: r[order])]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(1)
    return [rng.choice([1, 1, 2, 3, None]) for _ in range(200)]


def test_running_folds_match_a_loop(spark, values):
    df = numbers(spark, values)
    for inclusive in (True, False):
        out = spread.running(df, "o", {"s": ("sum", F.col("v")), "c": ("count", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "f": ("first", F.col("v")), "l": ("last", F.col("v"))}, inclusive=inclusive, ranges=7)
        for i, r in enumerate(sorted(out.collect(), key=lambda r: r["o"])):
            seen = [v for v in values[: i + inclusive] if v is not None]
            assert (r["s"], r["c"], r["lo"], r["hi"], r["f"], r["l"]) == (sum(seen) if seen else None, len(seen), min(seen, default=None), max(seen, default=None), seen[0] if seen else None, seen[-1] if seen else None)


def test_no_single_partition_window(spark, values):
    plan = ordered.zip_with_index(numbers(spark, values), "o")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" in plan or "BroadcastHashJoin" in plan


def test_positions_and_neighbours(spark, values):
    df = numbers(spark, values)
    assert column(ordered.zip_with_index(df, "o"), "index") == list(range(200))
    assert column(ordered.zip_with_previous(df, "o", "v"), "previous") == [None, *values[:-1]]
    assert column(ordered.zip_with_next(df, "o", "v"), "next") == [*values[1:], None]
    assert column(ordered.changes(df, "o", "v")) == [v for i, v in enumerate(values) if i == 0 or v != values[i - 1]]
    assert column(ordered.changes(numbers(spark, [1, 1, 2, 1]), "o", "v")) == [1, 2, 1]


def test_prefixes(spark):
    df = numbers(spark, [1, 2, 5, 1, 9])
    p = F.col("v") < 5
    assert column(ordered.take(df, 2, "o")) == [1, 2] and column(ordered.take(df, -1, "o")) == []
    assert column(ordered.drop(df, 2, "o")) == [5, 1, 9] and column(ordered.drop(df, 9, "o")) == [] and column(ordered.drop(df, 0, "o")) == [1, 2, 5, 1, 9]
    assert column(ordered.take_while(df, p, "o")) == [1, 2] and column(ordered.drop_while(df, p, "o")) == [5, 1, 9]
    assert column(ordered.take_while(df, F.lit(True), "o")) == [1, 2, 5, 1, 9] and column(ordered.drop_while(df, F.lit(True), "o")) == []
    assert ordered.head(df, "o").first()["v"] == 1 and ordered.last(df, "o").first()["v"] == 9
    assert ordered.collect_first(df, F.col("v") > 4, "o").first()["v"] == 5 and ordered.head(df.limit(0), "o").count() == 0
    assert column(ordered.take_until(df, "o", df.where("v = 5"), "o")) == [1, 2] and column(ordered.take_until(df, "o", df.limit(0), "o")) == [1, 2, 5, 1, 9]


def test_scans_and_batches(spark):
    df = numbers(spark, [1, 2, 3])
    assert column(ordered.scan(df, "o", "sum", F.col("v"), 0), "state", "position") == [0, 1, 3, 6]
    assert column(ordered.map_accumulate(df, "o", "sum", F.col("v"), 10), "state") == [11, 13, 16]
    five = numbers(spark, [1, 2, 3, 4, 5])
    assert column(ordered.grouped(five, 2, "o", "v"), "items", "batch") == [[1, 2], [3, 4], [5]]
    assert column(ordered.count_sliding(five, 3, "o", "v"), "items", "first") == [[1, 2, 3], [2, 3, 4], [3, 4, 5]]
    assert column(ordered.count_sliding(numbers(spark, [1, 2, 3, 4, 5, 6]), 2, "o", "v", 2), "items", "first") == [[1, 2], [3, 4], [5, 6]]
    assert column(ordered.count_sliding(numbers(spark, range(7)), 2, "o", "v", 3), "items", "first") == [[0, 1], [3, 4]]
    assert ordered.fold(df, "o", F.lit(0).cast("bigint"), lambda a, x: a * 10 + x, F.col("v")).first()["result"] == 123
    with pytest.raises(ValueError):
        ordered.grouped(df, 0, "o", "v")


def test_dedupe_and_repeats(spark):
    assert column(ordered.dedupe_first(numbers(spark, [1, 2, 1, 3, 2, 1]), ["v"], "o")) == [1, 2, 3]
    assert ordered.repeat_n(numbers(spark, [1, 2]), 3).count() == 6 and ordered.repeat_n(numbers(spark, [1, 2]), 0).count() == 0
    assert ordered.filter_map(numbers(spark, [1, None]), "w", F.col("v") + 1).count() == 1


def test_zip_and_interleave(spark):
    a, b = numbers(spark, [1, 2, 3]), numbers(spark, [10, 20])
    assert [(r["left"]["v"], r["right"]["v"]) for r in sorted(ordered.zip_rows(a, b, "o", "o").collect(), key=lambda r: r["index"])] == [(1, 10), (2, 20)]
    assert column(ordered.interleave(a, b, "o", "o", "v"), "v", "position") == [1, 10, 2, 20]
    assert [r["v"] for r in ordered.concat(a, b, "o").orderBy("_src", "o").collect()] == [1, 2, 3, 10, 20]


def test_latest_values(spark):
    main = spark.createDataFrame([(1, "a", "k"), (5, "b", "k"), (6, "c", "j")], "o bigint, m string, key string")
    side = spark.createDataFrame([(2, "x", "k"), (5, "y", "k"), (9, "z", "k")], "o bigint, s string, key string")
    assert sorted((r["main"]["m"], r["side"]["s"]) for r in joins.with_latest(main, side, "o").collect()) == [("b", "y"), ("c", "y")]
    assert sorted((r["main"]["m"], r["side"]["s"]) for r in joins.with_latest(main, side, "o", ["key"]).collect()) == [("b", "y")]
    both = joins.combine_latest(main, side, "o").orderBy("o").collect()
    assert [(r["left"]["m"], r["right"]["s"]) for r in both] == [("a", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("c", "z")]


def test_lookups(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k bigint")
    table = spark.createDataFrame([(2, "two")], "id bigint, name string")
    assert sorted((r["k"] or 0, r["name"] or "") for r in joins.lookup(df, table, "k", "id").collect()) == [(0, ""), (1, ""), (2, "two"), (2, "two")]
    assert joins.lookup(df, table, "k", "id", most=0).count() == 4
    out = joins.lookup_remote(df, "k", lambda keys: {k: f"n{int(k)}" for k in keys if k == 2}, "name", "string")
    assert sorted((r["k"] or 0, r["name"] or "") for r in out.collect()) == [(0, ""), (1, ""), (2, "n2"), (2, "n2")]


def test_timing(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 10, 20, 200, 210, 900])], "o bigint, t bigint")
    assert column(timing.debounce(df, "o", "t", 50), "t") == [20, 210, 900]
    assert column(timing.sample(df, "o", "t", 100), "t") == [20, 210]
    assert sorted(r["t"] for r in timing.sample(df.withColumn("k", F.col("o") % 2), "o", "t", 100, ["k"]).collect()) == [10, 20, 200]
    offsets = spark.createDataFrame([(0, 5), (0, 6), (0, 6), (0, 8), (1, 0)], "p int, off bigint")
    assert sorted(tuple(r) for r in timing.offset_islands(offsets, "p", "off").collect()) == [(0, 7), (1, 1)]


def test_switch_map(spark):
    outer = spark.createDataFrame([(0, 0), (1, 100)], "o bigint, t bigint")
    inner = outer.select("o", F.explode(F.array(F.lit(0), F.lit(60), F.lit(120))).alias("d"), "t").select("o", (F.col("t") + F.col("d")).alias("at"))
    assert sorted(r["at"] for r in ordered.switch_map(outer, inner, "o", "t", "at", "o").collect()) == [0, 60, 100, 160, 220]


@pytest.fixture
def queue(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, "pending", 0), (2, "processing", 2), (3, "pending", 3), (4, "completed", 1), (5, "dead", 3), (6, "pending", 0)]
    return spark.createDataFrame([(i, f"p{i}", s, t if i != 6 else t + dt.timedelta(days=9), n, 3, t) for i, s, n in rows], "id bigint, payload string, status string, visible_at timestamp, attempt_count int, max_attempts int, created_at timestamp")


def test_queue(spark, queue):
    now = F.lit(dt.datetime(2024, 1, 2))
    assert [r["id"] for r in queues.claim(queue, now).collect()] == [1, 2]
    outcomes = spark.createDataFrame([(1, True), (2, False)], "id bigint, ok boolean")
    after = {r["id"]: (r["status"], r["attempt_count"]) for r in queues.settle(queue, outcomes, now).collect()}
    assert after[1] == ("completed", 1) and after[2] == ("dead", 3) and after[6] == ("pending", 0)
    assert queues.metrics(queue).first().asDict() == {"pending": 3, "processing": 1, "completed": 1, "dead": 1, "total": 6}
    assert {r["id"]: r["status"] for r in queues.requeue_dead(queue, now).collect()}[5] == "pending"
    assert [x.count() for x in queues.archive(queue)] == [5, 1]
    new = queues.publish(queue, spark.createDataFrame([(9, "p9")], "id bigint, payload string"), now, delay_s=60)
    assert new.count() == 7 and new.where("id = 9").first()["status"] == "pending"


def test_fifo_modes(spark):
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a"), (5, "c")], "id bigint, g string")
    read = lambda mode, n: [r["id"] for r in queues.fifo(m, mode, "g", "id", n).collect()]
    assert read("standard", 3) == [1, 2, 3] and read("grouped", 4) == [1, 2, 4, 3]
    assert read("round-robin", 4) == [1, 3, 5, 2] and read("head", 9) == [1, 3, 5]


def test_change_page(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (3, 1)], "ts bigint, seq bigint")
    assert [tuple(r) for r in queues.change_page(df, "ts", "seq", (1, 1), 2).collect()] == [(1, 2), (2, 1)]
    assert queues.change_page(df, "ts", "seq", None, 9).count() == 4


def test_generated_sources(spark):
    assert records.empty(spark, "a int").count() == 0
    assert column(records.number_range(spark, 0, 1, 0.25), "value", "_seq") == [0, 0.25, 0.5, 0.75]
    assert column(records.number_range(spark, 3, 0, -1), "value", "_seq") == [3, 2, 1] and records.number_range(spark, 3, 0).count() == 0
    assert column(records.iterate(spark, 1, lambda x: x * 2, "value bigint", 5), "value", "_seq") == [1, 2, 4, 8, 16]
    assert records.unfold(spark, 0, lambda s: (s, s + 1) if s < 10_000 else None, "value bigint").count() == 10_000
    assert column(records.of(spark, 7, 8), "value", "_seq") == [7, 8] and records.repeat_value(spark, "x", 4).count() == 4
    assert records.from_call(spark, lambda: 5, "value bigint").first()["value"] == 5
    with pytest.raises(Exception, match="broken"):
        records.fail(spark, "broken", "a int").collect()


ODD = {
    "empty": ([], "bigint"), "one": ([5], "bigint"), "nulls": ([None] * 4, "bigint"), "tied": ([2, 2, 2, 2, 1, 3], "bigint"),
    "date": ([dt.date(2024, 1, d) for d in range(1, 9)], "date"), "time": ([dt.datetime(2024, 1, 1, h) for h in range(9)], "timestamp"),
    "no zone": ([dt.datetime(2024, 1, 1, h) for h in range(9)], "timestamp_ntz"), "text": (["", "a", "ab", "b", "commonprefix1", "commonprefix2", "ü"], "string"),
    "decimal": ([dt.timedelta(days=d).days * 3 for d in range(9)], "int"), "nan": ([1.0, float("nan"), float("inf"), -1.0, None], "double"),
}


@pytest.mark.parametrize("case", ODD)
@pytest.mark.parametrize("ranges", [1, 4])
def test_running_serves_any_order(spark, case, ranges):
    values, kind = ODD[case]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"o {kind}, v int").repartition(3)
    out = spread.running(df, "o", {"n": ("count", F.lit(1)), "s": ("sum", F.col("v"))}, ranges=ranges).collect()
    assert sorted(r["n"] for r in out) == list(range(1, len(values) + 1))
    by = [r["o"] for r in sorted(out, key=lambda r: r["n"])]
    assert [repr(x) for x in by] == [repr(r["o"]) for r in df.orderBy("o").collect()]
    back = spread.running(df, "o", {"n": ("count", F.lit(1))}, ranges=ranges, back=True).collect()
    assert [repr(r["o"]) for r in sorted(back, key=lambda r: -r["n"])] == [repr(x) for x in by]


def test_running_cuts_heavy_keys(spark):
    rng = random.Random(3)
    rows = [(i, None if rng.random() < 0.6 else rng.choice("abc"), rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "o int, k string, v int").repartition(4)
    assert spread.heavy_keys(df, ["k"], 32).collect() != [] and spread.heavy_keys(df, ["k"], 8) is None
    for back in (False, True):
        out = spread.running(df, "o", {"s": ("sum", F.col("v")), "l": ("last", F.col("v"))}, ["k"], inclusive=False, ranges=32, back=back)
        for r in out.collect():
            seen = [v for o, k, v in sorted(rows, reverse=back) if k == r["k"] and (o > r["o"] if back else o < r["o"])]
            assert (r["s"], r["l"]) == (sum(seen) if seen else None, seen[-1] if seen else None)
    assert "_run_" in out._jdf.queryExecution().optimizedPlan().toString()


def test_running_names_clash_with_no_column(spark):
    df = spark.createDataFrame([(1, 2, 3, 4), (2, 3, 4, 5)], "o int, _range int, _run_range int, _run_v0 int")
    out = spread.running(df, "o", {"_range": ("sum", F.col("_run_v0"))}, ranges=3)
    assert [tuple(r) for r in out.select("o", "_range", "_run_range", "_run_v0").orderBy("o").collect()] == [(1, 4, 3, 4), (2, 9, 4, 5)]


def test_latest_values_by_time(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    for kind, of in (("timestamp", day), ("date", lambda d: day(d).date()), ("string", str)):
        main = spark.createDataFrame([(of(2), "a"), (of(5), "b"), (of(1), "c")], f"t {kind}, m string")
        side = spark.createDataFrame([(of(2), "x"), (of(4), "y")], f"t {kind}, s string")
        assert sorted((r["main"]["m"], r["side"]["s"]) for r in joins.with_latest(main, side, "t").collect()) == [("a", "x"), ("b", "y")]
        assert [(r["left"]["m"], r["right"]["s"]) for r in sorted(joins.combine_latest(main, side, "t").collect(), key=lambda r: r["t"])] == [("c", "x"), ("a", "x"), ("a", "y"), ("b", "y")]


def test_drop_counts_rows_that_tie(spark):
    for values, n, left in (([1, 2, 2, 2], 2, 2), ([7] * 5, 3, 2), ([None, None, 1], 1, 2), ([1], 1, 0), ([], 2, 0), ([1, 2], 5, 0)):
        assert ordered.drop(spark.createDataFrame([(v,) for v in values], "o int"), n, "o").count() == left


def test_lookup_and_cross_beyond_a_broadcast(spark):
    df, table = spark.createDataFrame([(1, "a"), (None, "b")], "k int, name string"), spark.createDataFrame([(1, "one", 9), (2, "two", 8)], "k int, name string, extra int")
    for most in (5, 0):
        out = joins.lookup(df, table, "k", "k", most)
        assert out.columns == ["k", "name", "extra"] and sorted(out.collect(), key=repr) == [(1, "a", 9), (None, "b", None)]
        assert joins.cross(df, table.toDF("x", "y", "z"), most).count() == 4


def test_windows_of_an_empty_table(spark):
    from tidewright.plans.builder import topology

    empty = spark.createDataFrame([], "id bigint, t bigint, k string")
    t = topology(empty, seq="id", time=F.col("t")).key_by(F.col("k"))
    for w in (t.tumbling("1s"), t.sliding("2s", "1s"), t.session("1s")):
        assert w.count().replay().collect() == []


def test_ranges_of_texts_and_nested_orders(spark):
    rng = random.Random(3)
    urls = [f"https://example.com/articles/{rng.randrange(10**6):06d}/é{i % 3}" for i in range(5000)] + ["http://other.org/x"] * 1500 + [None, ""]
    df = spark.createDataFrame([(u, (u, i), [i % 7, i], bytearray((u or "").encode()), {"a": i}) for i, u in enumerate(urls)], "u string, s struct<u:string,i:int>, a array<int>, b binary, m map<string,int>").repartition(4)
    for order in ("u", "s", "b", "a"):
        out = spread.ranged(df, order, "r", 16).select(order, "r").collect()
        key = {"u": lambda r: (r["u"] is not None, (r["u"] or "").encode()), "s": lambda r: (r["s"]["u"] is not None, (r["s"]["u"] or "").encode()), "b": lambda r: bytes(r["b"]), "a": lambda r: r["a"][0]}[order]
        rows = sorted((key(r), r["r"]) for r in out)
        assert all(x[1] <= y[1] and (x[0] != y[0] or x[1] == y[1]) for x, y in zip(rows, rows[1:], strict=False))
        sizes = [sum(r == k for _, r in rows) for k in {r for _, r in rows}]
        assert len(sizes) >= (6 if order == "a" else 9) and max(sizes) <= 2400
    ranked = ordered.zip_with_index(df.select("u", "s"), "s").select("u", "index").collect()
    assert [r["u"] for r in sorted(ranked, key=lambda r: r["index"])] == sorted(urls, key=lambda u: (u is not None, (u or "").encode()))


def test_neighbours_by_one_exchange(spark, values):
    df = numbers(spark, values)
    out = ordered.zip_with_neighbours(df, "o", "v")
    assert column(out, "previous") == [None, *values[:-1]] and column(out, "next") == [*values[1:], None]
    plan = ordered.zip_with_neighbours(df, "o", "v")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2  # the rows, and a row for each range
    keyed = ordered.zip_with_neighbours(df.withColumn("k", F.col("o") % 2), "o", "v", partition=["k"])
    for k in (0, 1):
        own = [v for i, v in enumerate(values) if i * 3 % 2 == k]
        assert column(keyed.where(F.col("k") == k), "next") == [*own[1:], None] and column(keyed.where(F.col("k") == k), "previous") == [None, *own[:-1]]


def test_values_are_counted_in_place(spark):
    """F8: each row's values were told apart and then exchanged, some ten times the texts."""
    from collections import Counter

    from pyspark.sql import functions as F

    from tidewright import queries
    from tidewright.operators import ordered

    rows = [(1, 1.0, "b a b  a b"), (2, None, ""), (3, float("nan"), None), (4, None, "a"), (5, 2.0, "z z")]
    df = spark.createDataFrame(rows, "n bigint, k double, t string").repartition(3)
    more = [(6, 1.0, "a c"), (7, None, "a b"), (8, float("nan"), "x"), (9, 7.0, None)]
    both = df.unionByName(spark.createDataFrame(more, df.schema))
    for frame, given, key in ((df, rows, 0), (both, rows + more, 1), (df.limit(0), [], 0)):
        want = Counter((repr(r[key]), w) for r in given if r[2] is not None for w in r[2].split(" "))
        out = ordered.value_counts(frame, [frame.columns[key]], F.split("t", " ", -1), "word", "count")
        assert sorted((repr(r[0]), r["word"], r["count"]) for r in out.collect()) == sorted((k, w, n) for (k, w), n in want.items())
    odd = spark.createDataFrame([(0, [None, 2, None, 1]), (1, [None]), (2, [])], "n int, _sorted array<int>")
    got = ordered.value_counts(odd, ["n"], F.col("_sorted"), "v", "c").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(0, None, 2), (0, 1, 1), (0, 2, 1), (1, None, 1)], key=repr)
    plan = queries.flatmap_explode(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
