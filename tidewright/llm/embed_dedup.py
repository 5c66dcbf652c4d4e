"""Near-duplicate vectors by int8 tile products with error bounds.

A unit vector v is held as s*q + e: int8 q, scale s = max|v| / 127, and the measured norm of the error e. For two of them
    |u.v - su*sv*(qu.qv)| <= |eu| * (1 + |ev|) + |ev|
so only pairs whose approximate cosine plus this bound reaches the threshold are worked out in double precision. The
int8 products are exact: they are taken as float32 matrix products over at most 1024 components at a time, whose sums stay
below 2**24.

Equal vectors of a label are first collapsed to one class with a count, pre-aggregated, so a hot vector costs one row.
The classes of a label are dealt to tiles of about TILE vectors, each quantised once. Pairs of tiles meet as numbers where all tiles
together are small, which is checked, and by exchange of the int8 tiles beyond that. Of each pair, the vectors that have a
possible partner then meet in full precision; that gives for each class the number of vectors linked to it, and a spanning
forest of the links in place of the links.

Defined results: a vector links with nothing if it or its label is null, it is empty or zero, or holds null or non-finite components;
vectors of unequal length never link; rows are vectors, so repeated rows link with each other; a null vec_id counts as
a vector but names no component, has component_id of the others it reaches (null if none) and is not kept; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, release, use
from .components import components

TILE, THRESHOLD, STRIP, EXACT = 2048, 0.93, 512, 1024
#: For rounding in double precision of the bound and the products.
SLACK = 1e-9


class Tile:
    """Quantised vectors."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, error: np.ndarray):
        self.q, self.scale, self.error = q, scale, error

    @staticmethod
    def of(unit: np.ndarray) -> Tile:
        scale = np.abs(unit).max(1) / 127
        q = np.rint(unit / scale[:, None]).astype(np.int8)
        rest = unit - scale[:, None] * q
        return Tile(q, scale, np.sqrt((rest * rest).sum(1)) + 1e-12)


def units(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one; scaled first, so that squares neither overflow nor vanish."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def possible(a: Tile, b: Tile, rows: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs of a[rows] and b that may reach the threshold."""
    dot = np.zeros((len(a.q[rows]), len(b.q)))
    for at in range(0, a.q.shape[1], EXACT):
        dot += a.q[rows, at : at + EXACT].astype(np.float32) @ b.q[:, at : at + EXACT].astype(np.float32).T
    dot *= a.scale[rows, None] * b.scale
    dot += a.error[rows, None] * (1 + b.error) + b.error
    i, j = np.nonzero(dot >= threshold - SLACK)
    return i + rows.start, j


def forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node it reaches) of the edges a-b."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(nodes[i]), int(nodes[r])) for i, r in enumerate(root) if i != r]


def pairs_of(a: Tile, b: Tile, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """possible(), a strip of the first tile at a time; within one tile, each pair once."""
    for at in range(0, len(a.q), STRIP):
        i, j = possible(a, b, slice(at, min(at + STRIP, len(a.q))), threshold)
        yield (i[i < j], j[i < j]) if same else (i, j)


def compare(a: tuple, b: tuple, same: bool, threshold: float) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Of two sides (classes, counts, units): numbers of linked vectors by class, and a spanning forest of the links."""
    linked, xs, ys = {}, [], []
    (ca, ka, ua), (cb, kb, ub) = a, b
    na, nb = np.zeros(len(ca), np.int64), np.zeros(len(cb), np.int64)
    for i, j in pairs_of(Tile.of(ua), Tile.of(ub), same, threshold):
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            hit = np.einsum("ij,ij->i", ua[p], ub[q]) >= threshold
            p, q = p[hit], q[hit]
            np.add.at(na, p, kb[q])
            np.add.at(nb, q, ka[p])
            # a strip's links as a forest: no more edges than classes
            for x, y in forest(ca[p], cb[q]):
                xs.append(x)
                ys.append(y)
    for classes, n in ((ca, na), (cb, nb)):
        for c, k in zip(classes[n > 0].tolist(), n[n > 0].tolist(), strict=True):
            linked[c] = linked.get(c, 0) + k
    return linked, forest(np.array(xs, np.int64), np.array(ys, np.int64))


#: Most bytes of int8 tiles that go to every executor.
TILE_BYTES = 32 << 20
#: Classes with this share of all vectors, of which there can't be more than its inverse, are joined back by broadcast.
HEAVY = 0.002


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """rows(vec_id, embedding, label) to vec_id, n_links, component_id, kept; runs jobs to build its result."""
    spark = rows.sparkSession
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False))
    # equal text of a vector: a key that exchanges can hash and sort cheaply
    good = rows.where(usable).withColumn("h", F.xxhash64("label", "v"))
    classes = good.groupBy("h", "label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first"))
    classes = cut(spark, classes.withColumns({"class": F.monotonically_increasing_id(), "dim": F.size("v")}), "classes")

    sizes = classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    dealt = classes.join(broadcast_if_small(sizes), ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))

    def blob(group: pa.Table) -> pa.Table:
        # a vector's lists are of one length, and a batch of the group has few of them
        t = Tile.of(units(np.array(group["v"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1)))
        return pa.table({
            "label": group["label"][:1], "dim": group["dim"][:1], "tile": group["tile"][:1], "tiles": group["tiles"][:1],
            "classes": pa.array([group["class"].to_numpy().tobytes()]), "q": pa.array([t.q.tobytes()]), "bounds": pa.array([np.stack([t.scale, t.error]).tobytes()]),
        })

    # a group is a tile: about `tile` vectors, however large its label is
    tiles = dealt.select("label", "dim", "tile", "tiles", "class", "v").groupBy("label", "dim", "tile").applyInArrow(
        blob, "label string, dim int, tile int, tiles int, classes binary, q binary, bounds binary"
    )
    tiles = cut(spark, tiles, "tiles")
    size = tiles.agg(F.sum(F.length("q") + F.length("classes") + F.length("bounds"))).first()[0] or 0
    side = F.broadcast if size <= TILE_BYTES else (lambda df: df)
    lone = tiles.select("label", "dim", "tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    pairs = lone.where("tile <= other").select("label", "dim", F.col("tile").alias("i"), F.col("other").alias("j"))
    # a number of tasks by the number of pairs: their bytes say nothing of the work
    n = tiles.agg(F.sum(F.col("tiles") + 1) / 2).first()[0] or 0
    pairs = pairs.repartition(int(min(max(spark.sparkContext.defaultParallelism * 4, n // 32), 100_000)), "label", "dim", "i", "j")
    left = tiles.select("label", "dim", F.col("tile").alias("i"), "classes", "q", "bounds")
    right = tiles.select("label", "dim", F.col("tile").alias("j"), F.col("classes").alias("classes2"), F.col("q").alias("q2"), F.col("bounds").alias("bounds2"))
    met = pairs.join(side(left), ["label", "dim", "i"]).join(side(right), ["label", "dim", "j"])
    columns = ["label", "dim", "i", "j", "classes", "q", "bounds", "classes2", "q2", "bounds2"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use()
        for batch in batches:
            for label, dim, i, j, c, q, e, c2, q2, e2 in zip(*(batch.column(k) for k in range(len(columns))), strict=True):
                sides = [(np.frombuffer(x.as_buffer(), np.int64), Tile(np.frombuffer(y.as_buffer(), np.int8).reshape(-1, dim.as_py()), *np.frombuffer(z.as_buffer(), np.float64).reshape(2, -1))) for x, y, z in ((c, q, e), (c2, q2, e2))]
                found = [np.zeros(len(x), bool) for x, _ in sides]
                same = i.as_py() == j.as_py()
                for p, r in pairs_of(sides[0][1], sides[1][1], same, threshold):
                    found[0][p] = True
                    found[0 if same else 1][r] = True
                for number, (x, has) in enumerate(zip((x for x, _ in sides), found, strict=True)):
                    n = int(has.sum())
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([label.as_py()] * n), *(pa.array([v.as_py()] * n, pa.int32()) for v in (dim, i, j)), pa.array([number] * n, pa.int32()), pa.array(x[has])], ["label", "dim", "i", "j", "side", "class"])

    some = cut(spark, met.select(*columns).mapInArrow(search, "label string, dim int, i int, j int, side int, class bigint"), "possible")
    release(tiles)

    def verify(group: pa.Table) -> pa.Table:
        same = group["i"][0].as_py() == group["j"][0].as_py()
        v = units(np.array(group["v"].combine_chunks().flatten(), np.float64).reshape(group.num_rows, -1))
        number, classes, counts = (group[x].to_numpy() for x in ("side", "class", "n"))
        a, b = ((classes[number == k], counts[number == k], v[number == k]) for k in (0, 0 if same else 1))
        linked, links = compare(a, b, same, threshold)
        rows = [(k, None, m) for k, m in linked.items()] + [(x, y, None) for x, y in links]
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else [[]] * 3)], ["class", "other", "linked"])

    exact = some.join(classes.select("class", "n", "v"), "class").groupBy("label", "dim", "i", "j")
    found = cut(spark, exact.applyInArrow(verify, "class bigint, other bigint, linked bigint"), "links")
    release(some)
    linked = found.where("other is null").groupBy("class").agg(F.sum("linked").alias("linked"))
    reach = components(spark, found.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))

    own = classes.select("h", "label", "v", "class", "n", "first").join(linked, "class", "left").join(reach, F.col("class") == F.col("node"), "left")
    own = own.select("h", "label", "v", "n", "first", F.coalesce("component", "class").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    least = own.groupBy("component").agg(F.min("first").alias("component_id"))
    own = cut(spark, own.join(least, "component").select("h", "label", "v", "n", "n_links", "component_id"), "own")
    release(classes)
    release(found)
    key, total = ["h", "label", "v"], own.agg(F.sum("n")).first()[0] or 0
    heavy = F.broadcast(own.where(F.col("n") >= HEAVY * total))
    back = good.join(heavy, key).unionByName(good.join(heavy.select(*key), key, "left_anti").join(own, key), allowMissingColumns=True)
    out = back.select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~usable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
