"""Failures, terminals, supervision."""

import pytest
from pyspark.sql import functions as F

from tidewright.functions.schedule import Schedule
from tidewright.operators import errors, terminals
from tidewright.streaming.supervise import supervise


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, i * 10) for i in range(6)], "o bigint, v bigint").repartition(3)


def test_either_and_rethrow(df):
    out = errors.either(df, "r", F.lit(100) / F.nullif("v", F.lit(0)), {"zero": F.col("v") == 0})
    rows = {r["o"]: r["r"] for r in out.collect()}
    assert tuple(rows[0]) == (False, None, "zero") and rows[1]["value"] == 10
    assert errors.rethrow(out.where("o > 0"), "r").agg(F.max("r")).first()[0] == 10
    with pytest.raises(Exception, match="zero"):
        errors.rethrow(out, "r").collect()


def test_catch(df):
    bad = lambda: df.select(F.raise_error(F.lit("no"))).collect()
    assert errors.catch(bad, {"USER_RAISED": lambda e: "user", "": lambda e: "other"}) == "user"
    assert errors.or_else(bad, lambda: 5) == 5 and errors.or_else(df.count, lambda: 5) == 6
    with pytest.raises(ZeroDivisionError):
        errors.catch(lambda: 1 / 0, {"USER": lambda e: 1})
    seen = []
    assert errors.bracket(lambda: 3, lambda x: x + 1, seen.append) == 4 and seen == [3]
    with pytest.raises(ZeroDivisionError):
        errors.finalised(lambda: 1 / 0, lambda: seen.append(9))
    assert seen == [3, 9]


def test_observed(df):
    out, seen = errors.observed(df, "m", n=F.count(F.lit(1)), total=F.sum("v"))
    out.collect()
    assert seen.get == {"n": 6, "total": 150}


def test_terminals(df):
    t = terminals
    assert t.count().contramap(lambda x: x.where("v > 20")).map(lambda n: n * 2).run(df) == 6
    assert t.head("o").run(df)["v"] == 0 and t.last("o").run(df)["v"] == 50 and [r["o"] for r in t.collect_n(2, "o").run(df)] == [0, 1]
    assert t.fold("o", F.lit(0).cast("bigint"), lambda a, x: a + x, F.col("v")).run(df) == 150 and t.aggregate(F.sum("v").alias("s")).run(df)["s"] == 150
    assert t.count().flat_map(lambda n: t.collect_n(n - 4, "o")).run(df)[-1]["o"] == 1
    seen = []
    assert t.for_each_while(lambda r: seen.append(r["o"]) or r["o"] < 3, "o").run(df) == 4 and seen == [0, 1, 2, 3]
    assert t.for_each(lambda r: None, "o").run(df) == 6 and len(t.collect_all().run(df)) == 6 and t.drain().run(df) is None
    labelled = df.withColumn("k", F.col("o") % 2)
    assert sorted(tuple(r) for r in t.counters(labelled, ["k"], F.col("v")).collect()) == [(0, 60), (1, 90)]
    assert sorted(tuple(r) for r in t.gauges(labelled, ["k"], "v", "o").collect()) == [(0, 40), (1, 50)]
    assert df.where(t.json_equal(F.struct("o"), F.struct(F.lit(1).cast("bigint").alias("o")))).count() == 1


class Fake:
    def __init__(self, fails, items):
        self.fails, self.items = fails, items

    def await_exit(self):
        if self.fails:
            raise RuntimeError("lost")

    def metrics(self):
        return {"items_processed": self.items}


def test_supervise():
    runs, slept = [Fake(True, 0), Fake(True, 0), Fake(False, 3)], []
    last = runs[-1]
    assert supervise(lambda: runs.pop(0), Schedule.exponential(100), sleep=slept.append) is last and slept == [0.1, 0.2]
    with pytest.raises(RuntimeError):
        supervise(lambda: Fake(True, 0), Schedule.recurs(2), sleep=slept.append)
    with pytest.raises(RuntimeError):
        supervise(lambda: Fake(True, 0), Schedule.recurs(2), retryable=lambda e: False, sleep=slept.append)


def test_rows_before_a_failure_are_kept(spark):
    from tidewright.operators import errors

    df = spark.createDataFrame([(1, 5), (2, 6), (3, 99), (4, 7)], "o int, v int")
    bad = {"too large": F.col("v") > 50}
    rows = errors.either(df, "v2", F.col("v"), bad).select("o", F.col("v2").alias("v"))
    other = spark.createDataFrame([(0, -1)], "o int, v int")
    got = lambda out: sorted(tuple(r) for r in out.collect())
    assert got(errors.or_else_rows(rows, "v", "o", other)) == [(0, -1, 1), (1, 5, 0), (2, 6, 0)]
    assert got(errors.or_else_rows(rows, "v", "o", other, "too")) == [(0, -1, 1), (1, 5, 0), (2, 6, 0)]
    assert got(errors.or_else_rows(rows.where("o <> 3"), "v", "o", other)) == [(1, 5, 0), (2, 6, 0), (4, 7, 0)]
    assert got(errors.or_else_rows(rows.limit(0), "v", "o", other)) == []
    with pytest.raises(Exception, match="too large"):
        errors.or_else_rows(rows, "v", "o", other, "something else").collect()
    assert got(errors.failures(rows, "v")) == [(3, "too large")]


def test_timeouts_and_pauses(spark):
    from tidewright.operators import timing

    df = spark.createDataFrame([(i, t) for i, t in enumerate([0, 10, 20, 90, 95])], "o int, t int")
    assert [r["o"] for r in timing.timeout(df, "o", "t", 50).orderBy("o").collect()] == [0, 1, 2]
    assert timing.timeout(df, "o", "t", 500).count() == 5 and timing.timeout(df.limit(0), "o", "t", 5).count() == 0
    signals = spark.createDataFrame([(5, True), (15, False), (80, True)], "at int, stop boolean")
    out = timing.pause_when(df, "t", signals, "at", "stop").orderBy("o").collect()
    assert [r["delivered_at"] for r in out] == [0, 15, 20, None, None]
    assert [r["delivered_at"] for r in timing.pause_when(df, "t", signals.limit(0), "at", "stop").orderBy("o").collect()] == [0, 10, 20, 90, 95]


def test_remote_lookups_forget(spark):
    from tidewright.operators import joins

    df = spark.range(40).repartition(1)
    for more in ({}, {"most": 3}, {"ttl_s": 0.0}):
        assert joins.lookup_remote(df, "id", lambda keys: {k: k * 2 for k in keys}, "x", "bigint", batch=7, **more).where("x <> id * 2 or x is null").count() == 0


def test_retried_calls(spark):
    from pyspark.sql import functions as F

    from tidewright.functions.schedule import Schedule
    from tidewright.operators import calls

    def flaky(v, attempt):
        if v is None or attempt < v:
            raise ValueError(f"{v} at {attempt}")
        return v * 10

    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate([0, 1, 2, 3, None, 9])], "id bigint, v bigint, r_ string").coalesce(1)
    out = calls.map_retried(df, flaky, "v", "r", "bigint", Schedule.exponential(1).intersect(Schedule.recurs(2)))
    rows = out.collect()
    assert [r["id"] for r in rows] == list(range(6)) and [r["r"]["value"] for r in rows] == [0, 10, 20, None, None, None]
    assert [r["r"]["attempts"] for r in rows] == [1, 2, 3, 3, 3, 3] and rows[2]["r"]["waited_ms"] == 3 and rows[3]["r"]["error"]["message"] == "3 at 2"
    good, dead = calls.split_failures(out, "r")
    assert sorted((r["id"], r["r"]) for r in good.collect()) == [(0, 0), (1, 10), (2, 20)]
    assert [(r["error"]["name"], r["attempts"]) for r in dead.collect()] == [("ValueError", 3)] * 3 and '"id":3' in dead.collect()[0]["value"]

    def slow(v, attempt):
        import time

        time.sleep(0.3 if v == 0 else 0)
        return v

    swift = calls.map_retried(df.where("v is not null").select("v"), slow, "v", "r", "bigint", concurrency=3, ordered=False).collect()
    assert swift[-1]["v"] == 0 and sorted(r["r"]["completed"] for r in swift) == [0, 1, 2, 3, 4] and all(r["r"]["value"] == r["v"] for r in swift)
    with pytest.raises(ValueError, match="at a time"):
        calls.map_retried(df, slow, "v", "r", "bigint", concurrency=0)
    assert out.where(F.col("id") > 9).collect() == []


def test_orders(spark):
    from pyspark.sql import functions as F

    from tidewright.functions import order

    texts = ["z", "～", "\U0001f600", "", "", "zz", None]
    df = spark.createDataFrame([(t, i) for i, t in enumerate(texts)], "t string, n int")
    ranked = [r["t"] for r in df.orderBy(*order.text().columns(F.col("t"))).collect()]
    assert ranked == [None, *sorted((t for t in texts if t is not None), key=lambda t: t.encode("utf-16-be"))] and ranked != [None, *sorted(t for t in texts if t is not None)]
    assert [r["t"] for r in df.orderBy(*order.text().reversed().columns(F.col("t"))).collect()] == ranked[::-1]
    both = order.by(lambda r: F.length(r["t"])).reversed().then(order.by(lambda r: r["n"]))
    assert [r["n"] for r in df.where("t is not null").orderBy(*both.columns(F.struct("t", "n"))).collect()] == [5, 0, 1, 2, 3, 4]
    a, b = df.select(F.col("t").alias("a"), F.lit("z").alias("z")), order.text()
    got = {r["a"]: r["c"] for r in a.select("a", b.compare(F.col("a"), F.col("z")).alias("c")).collect()}
    assert got == {"z": 0, "～": 1, "\U0001f600": 1, "": 1, "": -1, "zz": 1, None: -1}
    assert a.select(b.reversed().compare(F.col("a"), F.col("z")).alias("c")).where("c = 1").count() == 2


def test_calls_are_made_once_for_good_and_dead(spark, tmp_path):
    """the good rows and the dead letters each made all calls."""
    from tidewright.functions.schedule import Schedule
    from tidewright.operators import calls

    log = str(tmp_path / "calls")

    def noted(v, attempt):
        with open(log, "a") as f:
            f.write(f"{v}\n")
        if v % 3 == 0:
            raise ValueError("third")
        return v

    out = calls.map_retried(spark.range(60).repartition(2), noted, "id", "r", "bigint", Schedule.recurs(1), ordered=False)
    good, dead = calls.split_failures(out, "r")
    assert good.where("r = id").count() == 40 and dead.where("attempts = 2").count() == 20
    with open(log) as f:
        assert sorted(map(int, f)) == sorted(v for v in range(60) for _ in range(2 if v % 3 == 0 else 1))
