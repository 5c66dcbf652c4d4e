"""Similarity join of documents on the Jaccard coefficient of their word n-grams.

1. A pass over the texts gives each document's class (documents of equal sets are one class) and counts n-grams of all
   documents in a table of a fixed size.
2. A second pass orders each set rare-first by that table (ties by hash) and emits the prefix in which any partner of
   sufficient similarity must share an n-gram. Postings travel packed; an n-gram that one class alone has is dropped, and so is
   a posting that no other of its n-gram can pair with by the length and the positional filter, if those are all together.
3. A third pass gives the sets of classes that are left.
4. Candidates are pairs that share a prefix n-gram and pass the length filter, the positional filter (n-grams left after
   the shared one) and the suffix filter: sets are halved again and again at the same places of the hash order, and the
   differences of the parts' sizes, three halvings deep, bound the symmetric difference. Each pair is verified once on its
   sets, of which only the later one travels with the pair.

Candidates come in rounds, so that a group of near copies doesn't emit all its pairs: the classes of an n-gram's list in
order of their hash lead it, about LEADERS * MORE**r of them in round r, and are paired with all later ones that are not yet in
their component. Lists in one component are done; lists whose classes all have led are exhausted, that is, every pair was
either compared or known to be connected. So components are exact, and no link between different texts is lost. A list
of more than LONG classes is dealt to a part for each LONG of them, and its leaders go to each part.

Sets are of 64-bit hashes of n-grams. A class is a 64-bit hash of a set; where a second hash tells that two sets share one,
that one takes the place of the first, so classes have 128 bits. Nothing of the size of the data is broadcast: the
counting table and the filter of classes have fixed sizes (2**SKETCH_BITS and 2**FILTER_BITS bytes), which
bear on speed alone.

Defined results: a null text or one without words has an empty set and links with nothing; equal texts link, whatever
their identifiers; a very long text counts whole; repeated rows stay; a null doc_id keeps its row, names no component and has
the component_id of its group (null if it is alone); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spread import unused
from .common import broadcast_if_small, cut, free_dropped, release, slices, text_batches, use
from .components import components
from .tables import gather, pieces
from .words import mixed, runs, word_hashes

SIZE, PERCENT, LEADERS = 5, 80, 2
#: Each round takes some dozens of jobs, whose plans and broadcasts executors hold for a while, so the number of leaders grows fast.
MORE = 16
SKETCH_BITS, FILTER_BITS, BUCKETS_PER_TASK = 23, 23, 8
#: Postings that a task holds before it sends them, and pairs that are sent to all tasks at most (16 bytes each).
HELD, PAIRS = 500_000, 300_000
#: Postings of a list that are compared with each other before they are written.
NEAR = 16
#: Classes of a list that one task meets, and parts that the lists beyond are first dealt to.
LONG, SALTS = 500, 64
#: Classes with this share of all documents are joined back by broadcast: there can't be more of them than its inverse.
HEAVY = 0.002
_MULTI, NO_ID = 1 << 31, -(1 << 63)


def sets_of(texts: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's n-grams."""
    return list(map(np.unique, runs(*word_hashes(texts, lower=True), size)))


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def class_of(s: np.ndarray, shared: frozenset = frozenset(), bits: int = 64) -> int:
    """`shared` has the first hashes, of `bits` bits, of more sets than one."""
    h = _signed(xxhash.xxh3_64_intdigest(s.tobytes()) >> (64 - bits))
    return check_of(s) if h in shared else h


def check_of(s: np.ndarray) -> int:
    return _signed(xxhash.xxh3_64_intdigest(s.tobytes(), 1))


#: Parts that three halvings of the hash order make.
PARTS = 8


def parts_of(s: np.ndarray) -> tuple[int, int]:
    """Numbers of elements in the parts, 16 bits each and at most 65,535 (the bound only weakens beyond), in two integers."""
    n = np.minimum(np.bincount((s >> np.uint64(61)).astype(np.int64), minlength=PARTS), 65535)
    return tuple(n.astype("<u2").view("<i8").tolist())


def _batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, schema, strict=True)], [n for n, _ in schema])


def _survey(docs: DataFrame, size: int, bits: int, class_bits: int) -> DataFrame:
    schema = [("doc_id", pa.int64()), ("class", pa.int64()), ("check", pa.int64()), ("n", pa.int32()), ("piece", pa.int32()), ("blob", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        counts, shift = np.zeros(1 << bits, np.uint32), np.uint64(64 - bits)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, s in zip(batch.column(0).to_pylist(), sets_of(batch.column(1), size), strict=True):
                np.add.at(counts, s >> shift, np.uint32(1))
                rows.append((doc_id, *((class_of(s, bits=class_bits), check_of(s)) if len(s) else (None, None)), len(s), None, None))
            yield _batch(schema, rows)
        for number, blob in pieces(counts):
            yield _batch(schema, [(None, None, None, None, number, blob)])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, class bigint, check bigint, n int, piece int, blob binary")


_POSTING = np.dtype([("gram", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4")])
_ROW = [("bucket", pa.int32()), ("blob", pa.binary()), ("gram", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]


def _packed(rows: np.ndarray) -> bytes:
    """Postings in ascending order of n-grams: differences of these, and the bytes of equal weight side by side, which compress well."""
    columns = [np.diff(rows["gram"], prepend=np.uint64(0)), rows["class"], rows["n"], rows["pos"]]
    planes = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in columns)
    return zstandard.compress(planes, 1)


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8)
    out, at = np.empty(len(planes) // _POSTING.itemsize, _POSTING), 0
    for name, kind in (("gram", "<u8"), ("class", "<i8"), ("n", "<u4"), ("pos", "<u4")):
        size = len(out) * np.dtype(kind).itemsize
        out[name] = np.ascontiguousarray(planes[at : at + size].reshape(-1, len(out)).T).view(kind).ravel()
        at += size
    out["gram"] = np.cumsum(out["gram"])
    return out


def _postings(docs: DataFrame, size: int, percent: int, table, buckets: int, class_: Callable[[np.ndarray], int]) -> DataFrame:
    """Prefix postings. The first NEAR classes of an n-gram in a task travel in a blob of its bucket, the last marked if the task has more; those go as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        seen, made, held = set(), [], 0
        level = table.value
        shift = np.uint64(64 - (len(level).bit_length() - 1))

        def out() -> Iterator[pa.RecordBatch]:
            if not made:
                return
            all_ = np.concatenate(made)
            made.clear()
            all_ = all_[np.lexsort((all_["class"], all_["gram"]))]
            start = np.concatenate([[True], all_["gram"][1:] != all_["gram"][:-1]])
            number = np.arange(len(all_)) - np.maximum.accumulate(np.where(start, np.arange(len(all_)), 0))
            again = number >= NEAR
            # the last that travels in a blob is followed by more
            all_["pos"][np.append(again[1:], False) & (number == NEAR - 1)] |= _MULTI
            first = all_[~again]
            bucket = (first["gram"] >> np.uint64(32)).astype(np.int64) * buckets >> 32
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = [*edges[1:].tolist(), len(first)]
            blobs = [(int(bucket[a]), _packed(first[a:b]), None, None, None, None) for a, b in zip(edges.tolist(), ends, strict=True)]
            for at in range(0, len(blobs), 200):
                yield _batch(_ROW, blobs[at : at + 200])
            more = all_[again]
            for at in range(0, len(more), 50_000):
                m = more[at : at + 50_000]
                spread = (m["class"] % buckets).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spread), pa.nulls(len(m), pa.binary()), pa.array(m["gram"].view(np.int64)), pa.array(np.ascontiguousarray(m["class"])), pa.array(m["n"].astype(np.int32)), pa.array(m["pos"].astype(np.int32))],
                    [n for n, _ in _ROW],
                )

        for batch in (part for whole in batches for part in slices(whole)):
            for s in sets_of(batch.column(0), size):
                n = len(s)
                if not n or (c := class_(s)) in seen:
                    continue
                seen.add(c)
                p = n - (percent * n + 99) // 100 + 1
                key = (level[(s >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                rows = np.empty(p, _POSTING)
                rows["gram"], rows["class"], rows["n"], rows["pos"] = s[np.argsort(key, kind="stable")[:p]], c, n, np.arange(p)
                made.append(rows)
                held += p
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    return docs.select("text").mapInArrow(run, "bucket int, blob binary, gram bigint, class bigint, n int, pos int")


def _partnered(rows: np.ndarray, percent: int) -> np.ndarray:
    """Which postings, in order of n-grams, have another of their n-gram that passes the length and the positional filter; all in lists of more than NEAR."""
    gram, n, left = rows["gram"], rows["n"].astype(np.int64), rows["n"].astype(np.int64) - rows["pos"]
    out = np.zeros(len(rows), bool)
    for d in range(1, min(NEAR, len(rows))):
        same = np.flatnonzero(gram[d:] == gram[:-d])
        if not len(same):
            break
        x, y = same, same + d
        alike = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
        alike &= np.minimum(left[x], left[y]) * (100 + percent) >= percent * (n[x] + n[y])
        out[x[alike]] = out[y[alike]] = True
    if len(rows) > NEAR:
        # the first and the last of NEAR + 1 in a row
        far = np.flatnonzero(gram[NEAR:] == gram[:-NEAR])
        edges = np.zeros(len(rows) + 1, np.int64)
        np.add.at(edges, far, 1)
        np.add.at(edges, far + NEAR + 1, -1)
        out |= np.cumsum(edges)[:-1] > 0
    return out


def _shared(postings: DataFrame, percent: int) -> DataFrame:
    """Postings of n-grams that two classes or more have, without those that no other of their list can pair with: gram, class, n, pos."""
    schema = [("gram", pa.int64()), ("class", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())]

    def emit(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate(list(map(_unpacked, blobs)))
        rows = rows[np.lexsort((rows["class"], rows["gram"]))]
        multi = (rows["pos"] & _MULTI) > 0
        start = np.concatenate([[True], rows["gram"][1:] != rows["gram"][:-1]])
        group = np.cumsum(start) - 1
        new = start | np.concatenate([[True], rows["class"][1:] != rows["class"][:-1]])
        live = (np.bincount(group, new) >= 2) | (np.bincount(group, multi) > 0)
        # of an n-gram that a task has more of, some postings are elsewhere
        kept = live[group] & new
        keep, whole = rows[kept], np.bincount(group, multi)[group[kept]] == 0
        keep = keep[~whole | _partnered(keep, percent)]
        if len(keep):
            arrays = [keep["gram"].view(np.int64), np.ascontiguousarray(keep["class"]), keep["n"].astype(np.int32), (keep["pos"] & (_MULTI - 1)).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a)) for a in arrays], [n for n, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            import pyarrow.compute as pc

            loose = batch.filter(pc.is_null(batch.column(1)))
            if loose.num_rows:
                yield pa.RecordBatch.from_arrays([loose.column(i) for i in range(2, 6)], [n for n, _ in schema])
            tight = batch.filter(pc.is_valid(batch.column(1)))
            for bucket, blob in zip(tight.column(0).to_pylist(), tight.column(1).to_pylist(), strict=True):
                if bucket != now and blobs:
                    yield from emit(blobs)
                    blobs = []
                now = bucket
                blobs.append(blob)
        if blobs:
            yield from emit(blobs)

    # buckets are equal ranges of a hash, and a task sends an n-gram NEAR times at most each time: neither is hot
    dealt = postings.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "gram bigint, class bigint, n int, pos int")


def _filter_indices(keys: np.ndarray, size: int) -> np.ndarray:
    return np.concatenate([keys % np.uint64(size), (keys >> np.uint64(32)) % np.uint64(size)]).astype(np.int64)


def _class_filter(firsts: DataFrame, bits: int) -> np.ndarray:
    """Marks of firsts(class, first): the document of each wanted class whose set is to be given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            counts[_filter_indices(mixed(batch.column(1).to_numpy().view(np.uint64)), 1 << bits)] = 1
        for number, blob in pieces(counts):
            yield _batch([("piece", pa.int32()), ("blob", pa.binary())], [(number, blob)])

    return gather(firsts.mapInArrow(run, "piece int, blob binary"), 1 << bits)


def _sets(docs: DataFrame, size: int, filter_, class_: Callable[[np.ndarray], int]) -> DataFrame:
    """row (a number), class, sizes of its parts and set of the documents that the filter lets pass: all wanted ones, and a few others."""
    schema = [("row", pa.int64()), ("class", pa.int64()), ("p0", pa.int64()), ("p1", pa.int64()), ("grams", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        use()
        live, row, had = filter_.value, TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            wanted = live[_filter_indices(mixed(ids.view(np.uint64)), len(live))].reshape(2, -1).all(0)
            for part in slices(batch.filter(pa.array(wanted))):
                rows = []
                for s in sets_of(part.column(1), size):
                    if len(s) and (c := class_(s)) not in had:
                        had.add(c)
                        rows.append((row, c, *parts_of(s), s.tobytes()))
                        row += 1
                yield _batch(schema, rows)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "row bigint, class bigint, p0 bigint, p1 bigint, grams binary")


def _marks(sets: DataFrame) -> DataFrame:
    """class, row, p0, p1: one row of each class, as several tasks may have given its set. The sets themselves stay where they are."""
    return sets.groupBy("class").agg(F.min("row").alias("row"), F.min("p0").alias("p0"), F.min("p1").alias("p1"))


def _difference(a: list[Column], b: list[Column]) -> Column:
    """A lower bound of the symmetric difference from the sizes of the parts."""
    size = lambda c, i: F.shiftrightunsigned(c, 16 * i).bitwiseAND(F.lit(65535))
    parts = [F.abs(size(x, i) - size(y, i)) for x, y in zip(a, b, strict=True) for i in range(PARTS // 2)]
    return sum(parts[1:], parts[0])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs(x, y, rx, ry), rx and ry the rows of sets, whose sets are similar enough, as a, b."""
    # few pairs go to the sets, so that the sets of all others stay where they are; many are joined by exchange
    grams = sets.select("row", "grams")
    xs = broadcast_if_small(pairs, 2 * PAIRS).join(grams, F.col("rx") == F.col("row")).select("x", "y", "ry", F.col("grams").alias("gx"))
    ys = broadcast_if_small(pairs.select("ry").distinct(), 2 * PAIRS).join(grams, F.col("ry") == F.col("row")).select("row", F.col("grams").alias("gy"))
    met = xs.join(ys, F.col("ry") == F.col("row")).select("x", "y", "gx", "gy")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for gx, gy in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(gx.as_buffer(), "<u8"), np.frombuffer(gy.as_buffer(), "<u8")
                both = np.sort(np.concatenate([a, b]), kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                keep.append(100 * same >= percent * (len(a) + len(b) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_())), batch.column(1).filter(pa.array(keep, pa.bool_()))], ["a", "b"])

    return met.mapInArrow(run, "a bigint, b bigint")


def _opened(lists: DataFrame, marks: DataFrame) -> DataFrame:
    """lists(gram, class, n, pos) with m and lead, the length of the list and its first class, and row and the parts' sizes of marks(class, row, p0, p1)."""
    lengths = cut(lists.sparkSession, lists.groupBy("gram").agg(F.count(F.lit(1)).alias("m"), F.min("class").alias("lead")), "lengths")
    # a long list is dealt out here too
    salted = lists.withColumn("salt", F.pmod("class", F.lit(SALTS)))
    long = broadcast_if_small(lengths.where(F.col("m") > LONG).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))), SALTS * 1000)
    far = salted.join(long, ["gram", "salt"])
    near = salted.join(long.select("gram", "salt"), ["gram", "salt"], "left_anti").join(lengths.where(F.col("m") <= LONG), "gram")
    both = near.unionByName(far).drop("salt")
    return both.join(marks, "class").withColumn("parts", F.ceil(F.col("m") / LONG).cast("bigint"))


def join(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, sketch_bits: int = SKETCH_BITS, filter_bits: int = FILTER_BITS, class_bits: int = 64) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id; runs jobs to build its result."""
    spark = docs.sparkSession
    text_batches(spark)
    survey = cut(spark, _survey(docs, size, sketch_bits, class_bits), "survey")
    seen = survey.where("piece is null").select("doc_id", "class", "check", "n")
    doubled = seen.where("class is not null").groupBy("class").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi")
    # of 10**10 different sets some three pairs share a hash of 64 bits
    shared = frozenset(r["class"] for r in doubled.select("class").collect())
    class_ = lambda s: class_of(s, shared, class_bits)
    own = F.when(F.col("class").isin(*shared), F.col("check")).otherwise(F.col("class")) if shared else F.col("class")
    members = cut(spark, seen.select("doc_id", own.alias("class"), "n"), "members")
    table = spark.sparkContext.broadcast(gather(survey.where("piece is not null"), 1 << sketch_bits))
    release(survey)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = cut(spark, _shared(_postings(docs, size, percent, table, BUCKETS_PER_TASK * tasks, class_), percent), "lists")
    table.destroy()
    free_dropped(spark)
    # a class of many copies is combined before the shuffle
    firsts = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("first"), F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("any"), F.count(F.lit(1)).alias("copies"))
    firsts = cut(spark, firsts, "firsts")
    wanted = firsts.join(lists.select("class").distinct(), "class", "left_semi").select("class", F.col("any").alias("first"))
    live = spark.sparkContext.broadcast(_class_filter(wanted, filter_bits))
    sets = cut(spark, _sets(docs, size, live, class_), "sets")
    live.destroy()

    open_ = cut(spark, _opened(lists, _marks(sets)), "open")
    release(lists)
    free_dropped(spark)
    at = (F.col("class").cast("double") + 2.0**63) / 2.0**64 * F.col("m")  # expected rank in the list
    reach, led, leaders = None, None, float(LEADERS)
    while not open_.isEmpty():
        rows = open_.withColumn("comp", F.col("class")) if reach is None else open_.join(reach, open_["class"] == reach.node, "left").select(*open_.columns, F.coalesce("component", "class").alias("comp"))
        now = at <= leaders
        if led is None:
            now = now | (F.col("class") == F.col("lead"))
        else:
            now = now & (at > led) & (F.col("class") != F.col("lead"))
        named = lambda side: {"class": side, "n": f"n{side}", "pos": f"p{side}", "comp": f"c{side}", "row": f"r{side}", "p0": f"a{side}", "p1": f"b{side}"}
        y = rows.where(now).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        x = rows.withColumn("part", F.pmod(F.xxhash64("class"), "parts"))
        y, x = (df.select("gram", "part", *(F.col(c).alias(n) for c, n in named(side).items())) for df, side in ((y, "y"), (x, "x")))
        total = F.col("nx") + F.col("ny")
        similar_length = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
        enough_left = F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) * (100 + percent) >= percent * total
        allowed = total - 2 * F.ceil(percent * total / (100 + percent))
        near = _difference([F.col("ax"), F.col("bx")], [F.col("ay"), F.col("by")]) <= allowed
        met = (x.gram == y.gram) & (x.part == y.part) & (F.col("x") > F.col("y")) & (F.col("cx") != F.col("cy")) & similar_length & enough_left & near
        pairs = cut(spark, x.join(y, met).select("x", "y", "rx", "ry").distinct(), "pairs")
        links = _verified(pairs, sets, percent)
        before = reach
        if before is not None:
            links = links.unionByName(before.select(F.col("node").alias("a"), F.col("component").alias("b")))
        reach = components(spark, links)
        release(pairs)
        if before is not None:
            release(before)
        # lists are done if they are in one component, or all of their classes have led
        rows = open_.where(F.col("m") > leaders).join(reach, open_["class"] == reach.node, "left").select("gram", F.coalesce("component", "class").alias("comp"))
        going = cut(spark, rows.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("gram"), "going")
        still = cut(spark, open_.join(broadcast_if_small(going), "gram", "left_semi"), "open")
        release(open_)
        release(going)
        free_dropped(spark)
        open_, led, leaders = still, leaders, leaders * MORE

    release(sets)
    if reach is not None:
        firsts = firsts.join(reach, firsts["class"] == reach.node, "left").select("class", "first", "copies", F.coalesce("component", "class").alias("comp"))
        least = firsts.groupBy("comp").agg(F.min("first").alias("component_id"))
        firsts = firsts.join(least, "comp").select(F.col("class").alias("c"), "copies", "component_id")
    else:
        firsts = firsts.select(F.col("class").alias("c"), "copies", F.col("first").alias("component_id"))
    firsts = cut(spark, firsts, "classes")
    some = members.where("class is not null")
    heavy = F.broadcast(firsts.where(F.col("copies") >= HEAVY * (firsts.agg(F.sum("copies")).first()[0] or 0)))
    one = F.col("class") == F.col("c")
    linked = some.join(heavy, one).unionByName(some.join(heavy, one, "left_anti").join(firsts, one))
    named = lambda df, component: df.select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col(component).alias("component_id"))
    return named(linked, "component_id").unionByName(named(members.where("class is null"), "doc_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Whole rows of docs: of each group the row with the least doc_id, any of equal ones, and one of those with a null doc_id."""
    # numbers of rows hold only in a written table
    number = unused(docs, "_row_number")
    numbered = cut(docs.sparkSession, docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    groups = join(numbered.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), F.col("component_id").alias("lead"))
    many = groups.where("row <> lead")
    # the lead is of its group, so groups of one row need no choice
    members = many.unionByName(many.select(F.col("lead").alias("row"), "lead").distinct())
    rows = numbered.select(F.col(number).alias("own"), F.col("doc_id").cast("bigint").alias("id"))
    ranked = members.join(rows, F.col("row") == F.col("own")).select("row", "lead", F.struct(F.col("id").isNull().alias("no_id"), "id", "row").alias("rank"))
    stays = ranked.groupBy("lead", "rank.no_id").agg(F.min("rank").getField("row").alias("stays")).select("stays")
    gone = members.select("row").join(stays, F.col("row") == F.col("stays"), "left_anti").select(F.col("row").alias(number))
    return numbered.join(gone, number, "left_anti").drop(number)


__all__ = ["check_of", "class_of", "join", "keep_one", "parts_of"]
