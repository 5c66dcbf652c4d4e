"""Live topologies, sinks, restarts, sources."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidewright.plans import nodes
from tidewright.plans.builder import topology
from tidewright.sources import files, http
from tidewright.sources.polling import PushBuffer, poll_source
from tidewright.streaming import sinks
from tidewright.streaming.live import Handle

SCHEMA = "seq bigint, user string, ts bigint"


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "user", "ts"), r, strict=True))) for r in rows))


def live(spark, folder):
    df = files.watch(spark, str(folder), SCHEMA, files_per_batch=1)
    return topology(df, "seq", F.col("ts") * 1000)


def test_windows_restart_and_late_rows(spark, tmp_path):
    src, out, ckpt = tmp_path / "in", tmp_path / "out", str(tmp_path / "ckpt")
    put(src, "a", [(0, "ann", 100), (1, "bob", 1200), (2, "bob", 1300)])
    build = lambda: live(spark, src).key_by(F.col("user")).tumbling("1s").count().to(sinks.parquet_sink(str(out)), idempotent=True)
    handle = build().run(ckpt, delivery="exactly-once")
    handle.await_exit(60)
    assert not handle.is_running and handle.metrics()["items_processed"] == 3
    put(src, "b", [(3, "ann", 5000)])
    build().run(ckpt, delivery="exactly-once").await_exit(60)
    put(src, "c", [(4, "ann", 150), (5, "ann", 9000)])
    last = build().run(ckpt, delivery="exactly-once")
    last.await_exit(60)
    rows = sorted((r["_key"], r["window_start_us"] // 1000, r["count"]) for r in spark.read.parquet(str(out)).collect())
    assert rows == [("ann", 0, 1), ("ann", 5000, 1), ("bob", 1000, 2)]
    assert last.metrics()["late_records"] == 1


def test_a_checkpoint_keeps_to_its_plan(spark, tmp_path):
    src, ckpt = tmp_path / "in", str(tmp_path / "ckpt")
    put(src, "a", [(0, "ann", 100)])
    write = sinks.parquet_sink(str(tmp_path / "out"))
    live(spark, src).to(write).run(ckpt).await_exit(60)
    with pytest.raises(ValueError, match="another plan"):
        live(spark, src).filter(F.lit(True)).to(write).run(ckpt)
    with pytest.raises(ValueError, match="exactly-once"):
        live(spark, src).to(write).run(str(tmp_path / "c2"), delivery="exactly-once")


def test_process_keeps_state_over_batches(spark, tmp_path):
    src, got = tmp_path / "in", []
    put(src, "a", [(0, "ann", 1), (1, "bob", 2)])
    put(src, "b", [(2, "ann", 3)])

    def step(s, r):
        return s + 1, {"user": r["user"], "n": s + 1}

    t = live(spark, src).key_by(F.col("user")).process(lambda: 0, step, "user string, n bigint")
    t.to(lambda df, _: got.extend(tuple(r) for r in df.collect())).run(str(tmp_path / "ckpt")).await_exit(60)
    assert sorted(got) == [("ann", 1), ("ann", 2), ("bob", 1)]


def test_process_keeps_sets_and_dates(spark, tmp_path):
    import datetime as dt

    src, got = tmp_path / "in", []
    put(src, "a", [(0, "ann", 1), (1, "ann", 2)])
    put(src, "b", [(2, "ann", 2), (3, "ann", 4)])
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)

    def step(s, r):
        seen, at = s
        return [seen | {r["ts"]}, at], {"user": r["user"], "n": len(seen), "year": at.year}

    t = live(spark, src).key_by(F.col("user")).process(lambda: [set(), day], step, "user string, n bigint, year bigint")
    t.to(lambda df, _: got.extend(tuple(r) for r in df.collect())).run(str(tmp_path / "ckpt")).await_exit(60)
    assert got == [("ann", 0, 2024), ("ann", 1, 2024), ("ann", 2, 2024), ("ann", 2, 2024)]


def test_live_join_and_dedupe(spark, tmp_path):
    a, b, got, firsts = tmp_path / "a", tmp_path / "b", [], []
    put(a, "1", [(0, "ann", 1000), (1, "bob", 1000)])
    put(b, "1", [(5, "ann", 1500), (6, "bob", 9000), (7, "ann", 2000)])
    left, right = (live(spark, x).key_by(F.col("user")) for x in (a, b))
    left.join(right, "1s").to(lambda df, _: got.extend((r["left"]["seq"], r["right"]["seq"]) for r in df.collect())).run(str(tmp_path / "c1")).await_exit(60)
    assert got == [(0, 5)]
    right.dedupe(F.col("user")).to(lambda df, _: firsts.extend(r["user"] for r in df.collect())).run(str(tmp_path / "c2")).await_exit(60)
    assert sorted(firsts) == ["ann", "bob"]


def test_ledger_skips_written_batches(spark, tmp_path):
    seen, ledger = [], sinks.Ledger(spark, str(tmp_path / "l"), "p")
    ledger.claim()
    write = ledger.guarded(lambda df, n: seen.append(n))
    for n in (0, 0, 1):
        write(spark.range(1), n)
    assert seen == [0, 1]


def test_dead_letters(spark):
    df = spark.createDataFrame([(0, "o1", "10"), (1, "o2", "ten"), (2, "o3", "30")], "_seq bigint, id string, amount string").withColumns({"_topic": F.lit("orders"), "_partition": F.lit(0)})
    cents = F.col("amount").try_cast("double") * 100
    marked = sinks.guarded_map(df, {"cents": cents}, {"not a number": F.col("amount").isNotNull() & cents.isNull()})
    good, dead, both = [], [], sinks.dead_letter_sink(lambda d, _: good.extend(d.collect()), lambda d, _: dead.extend(d.collect()))
    both(marked, 0)
    assert sorted(r["cents"] for r in good) == [1000, 3000]
    assert [(json.loads(r["value"])["id"], r["error"]["message"], r["source"]["offset"]) for r in dead] == [("o2", "not a number", 1)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, v string")
    sinks.tee(sinks.parquet_sink(str(tmp_path / "p")), sinks.table_sink(str(tmp_path / "t"), "json", key="k"))(df, 0)
    sinks.parquet_sink(str(tmp_path / "p"))(df, 0)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.json(str(tmp_path / "t")).count() == 2
    assert json.loads(sinks.to_kafka(df, F.col("k")).where("key = '1'").first()["value"]) == {"k": 1, "v": "a"}
    sinks.drain(df)


def test_polled_source(spark, tmp_path):
    data = [(i, f"v{i}") for i in range(10)]

    def poll(cursor, limit):
        return data[cursor : cursor + 4], min(len(data), cursor + 4)

    spark.dataSource.register(poll_source("tidewright_numbers", "id int, v string", poll))
    got = []
    q = spark.readStream.format("tidewright_numbers").load().writeStream.foreachBatch(lambda df, _: got.extend(r["id"] for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).start()
    h = Handle(q)
    import time

    for _ in range(100):
        if len(got) >= 10:
            break
        time.sleep(0.2)
    h.stop()
    assert got == list(range(10)) and not h.is_running


def test_push_buffer():
    for overflow, left in (("dropNewest", [1, 2]), ("dropOldest", [2, 3])):
        b = PushBuffer(2, overflow)
        for i in (1, 2, 3):
            b.push((i,))
        assert [r[0] for r in b.poll(0, 9)[0]] == left and b.dropped == 1
    b = PushBuffer(1)
    assert b.push((1,)) and not b.push((2,), timeout=0.01)
    rows, cursor = b.poll(0, 5)
    assert rows == [(1,)] and b.poll(cursor, 5) == ([], 1) and b.push((2,))
    assert b.poll(cursor, 5) == ([(2,)], 2)


def test_files(spark, tmp_path):
    (tmp_path / "x.txt").write_text("a\r\nb\n")
    (tmp_path / "n.json").write_text('{"a":1}\n\n{"a":2}\n')
    (tmp_path / "s.txt").write_text("data: one\n\ndata: two\n\n")
    assert files.read_text(spark, str(tmp_path / "x.txt")).first()["text"] == "a\r\nb\n"
    assert [r["line"] for r in http.body_lines(spark, str(tmp_path / "x.txt")).orderBy("line_no").collect()] == ["a", "b"]
    assert sorted(r["a"] for r in http.body_ndjson(spark, str(tmp_path / "n.json"), "a int").collect()) == [1, 2]
    assert [r["data"] for r in http.body_sse(spark, str(tmp_path / "s.txt")).orderBy("event_no").collect()] == ["one", "two"]
    assert files.read_dir(spark, str(tmp_path)).count() == 3 and files.exists(spark, str(tmp_path)) and not files.exists(spark, str(tmp_path / "no"))
    assert bytes(files.read_bytes(spark, str(tmp_path / "x.txt")).first()["content"]) == b"a\r\nb\n"


def test_live_dedupe_within_a_span(spark, tmp_path):
    src, got = tmp_path / "in", []
    put(src, "a", [(0, "ann", 1000), (1, "ann", 1500), (2, "bob", 2000)])
    put(src, "b", [(3, "ann", 2500)])
    keyed = live(spark, src).key_by(F.col("user"))
    handle = keyed.dedupe(F.col("user"), within="1h").to(lambda df, _: got.extend(r["user"] for r in df.collect())).run(str(tmp_path / "c"))
    handle.await_exit(60)
    assert sorted(got) == ["ann", "bob"] and handle.metrics()["dedupe_size"] == 2 and handle.metrics()["join_buffer_size"] == 0
    with pytest.raises(ValueError, match="within"):
        keyed.dedupe(F.col("user"), most=5).to(lambda df, _: None).run(str(tmp_path / "c2"))


WINDOWS = {
    "tumbling": lambda k: k.tumbling("1s", lateness="300ms"),
    "sliding": lambda k: k.sliding("1s", "400ms", lateness="300ms"),
    "sliding with gaps": lambda k: k.sliding("400ms", "1s", lateness="300ms"),
    "session": lambda k: k.session("250ms", lateness="100ms"),
}
FOLD = (lambda: [0, [], set()], lambda s, r: [s[0] + 1, [*s[1], r["seq"]], s[2] | {r["ts"] % 7}], lambda at, s: {"n": s[0], "seqs": s[1], "kinds": sorted(s[2]), "length": at["window_end_us"] - at["window_start_us"]}, "n bigint, seqs array<bigint>, kinds array<bigint>, length bigint")


@pytest.mark.parametrize("merge", [None, lambda a, b: [a[0] + b[0], a[1] + b[1], a[2] | b[2]]], ids=["apart", "merge"])
@pytest.mark.parametrize("shape", WINDOWS)
def test_live_folds_equal_the_replay(spark, tmp_path, shape, merge):
    """Rows far out of order, beyond the lateness too, over three micro-batches and a restart."""
    if merge and shape != "session":
        pytest.skip("only sessions merge")
    rng = random.Random(len(shape))
    rows = [(i, rng.choice(["ann", "bob", "cy"]), max(0, int(i * 40 + rng.choice([0, 0, 0, -200, -600, 150, 900, -1500])))) for i in range(90)]
    rows += [(90, "zed", 10**7), (91, "zed", 10**7 + 1), (92, "zed", 2 * 10**7)]  # time goes on, so that all other windows end
    shuffled = rows[:30] + rows[30:60] + rows[60:]
    build = lambda df: WINDOWS[shape](topology(df, "seq", F.col("ts") * 1000).key_by(F.col("user"))).fold(*FOLD, merge=merge)
    batch = build(spark.createDataFrame(shuffled, SCHEMA)).replay()
    plain = lambda df: sorted((r["_key"], r["window_start_us"], r["window_end_us"], r["n"], tuple(r["seqs"]), tuple(r["kinds"]), r["length"]) for r in df.collect() if r["_key"] != "zed")
    src, out, ckpt = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ckpt")
    run = lambda: build(files.watch(spark, str(src), SCHEMA, files_per_batch=1)).to(sinks.parquet_sink(out), idempotent=True).run(ckpt, delivery="exactly-once").await_exit(120)
    one = shuffled[:30]
    rng.shuffle(one)  # within a micro-batch the ordinal tells
    put(src, "a", one)
    put(src, "b", shuffled[30:60])
    run()
    put(src, "c", shuffled[60:])
    run()
    assert plain(spark.read.parquet(out)) == plain(batch) and plain(batch)


def test_processes_forget_by_ttl(spark, tmp_path):
    import time

    src, got = tmp_path / "in", []
    put(src, "a", [(0, "ann", 1), (1, "bob", 2)])
    t = live(spark, src).key_by(F.col("user")).process(lambda: 0, lambda s, r: (s + 1, {"user": r["user"], "n": s + 1}), "user string, n bigint", ttl="5s")
    handle = t.to(lambda df, _: got.extend(tuple(r) for r in df.collect())).run(str(tmp_path / "ckpt"), trigger={"processingTime": "200 milliseconds"})

    def wait(n):
        for _ in range(300):
            if len(got) >= n:
                return
            time.sleep(0.2)

    wait(2)
    time.sleep(8)
    put(src, "b", [(2, "ann", 3)])
    wait(3)
    handle.stop()
    assert sorted(got) == [("ann", 1), ("ann", 1), ("bob", 1)]


def test_fingerprints_tell_plans_apart(spark):
    keyed = topology(spark.createDataFrame([], SCHEMA), "seq", F.col("ts")).key_by(F.col("user"))
    plans = [keyed.tumbling("1h").count(), keyed.tumbling("2h").count(), keyed.sliding("1d", "1h").count(), keyed.tumbling("1h", lateness="1m").count(), keyed.join(keyed, "1s"), keyed.join(keyed, "1s", bound="inclusive"), keyed.dedupe(F.col("user"), within="1h"), keyed.dedupe(F.col("user"), within="2h")]
    plans += [keyed.process(dict, lambda s, r: (s, None), x) for x in ("a int", "a string")] + [keyed.map(a=F.lit(1)), keyed.map(b=F.lit(1))]
    assert len({nodes.fingerprint(p.node) for p in plans}) == len(plans)
    assert nodes.fingerprint(keyed.tumbling("1h").count().node) == nodes.fingerprint(keyed.tumbling("60m").count().node)


def test_live_sliding_windows_with_gaps(spark, tmp_path):
    src, got = tmp_path / "in", []
    put(src, "a", [(0, "ann", 100), (1, "ann", 700), (2, "ann", 1200), (3, "ann", 1399)])
    put(src, "b", [(4, "ann", 9000)])
    t = live(spark, src).key_by(F.col("user")).sliding("400ms", "1s").count()
    t.to(lambda df, _: got.extend((r["window_start_us"], r["window_end_us"], r["count"]) for r in df.collect())).run(str(tmp_path / "c")).await_exit(60)
    assert sorted(got) == [(0, 400_000, 1), (1_000_000, 1_400_000, 2)]


def test_live_retention_equals_the_replay(spark, tmp_path):
    src, got, ckpt = tmp_path / "in", [], str(tmp_path / "c")
    rng = random.Random(12)
    rows = [(i, rng.choice(["ann", "bob", "cy"]), max(0, i * 100 + rng.choice([0, 0, -300, 200]))) for i in range(120)]
    build = lambda df: topology(df, "seq", F.col("ts") * 1000).key_by(F.col("user")).dedupe(F.col("user"), within="700ms")
    want = sorted(r["seq"] for r in build(spark.createDataFrame(rows, SCHEMA)).replay().collect())
    run = lambda: build(files.watch(spark, str(src), SCHEMA, files_per_batch=1)).to(lambda df, _: got.extend(r["seq"] for r in df.collect())).run(ckpt).await_exit(120)
    put(src, "a", rows[:40])
    put(src, "b", rows[40:80])
    run()
    put(src, "c", rows[80:])
    run()
    assert sorted(got) == want and len(want) > 20
