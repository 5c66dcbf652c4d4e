"""Connected components of a distributed edge list by contraction: hook each root to its smallest neighbour, shorten the
chains, rename the edges, until no edge joins two roots. Roots at least halve each time. Nothing is gathered by a hub:
minima are pre-aggregated and the joins can split a hot node."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, release


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """edges(a, b) to (node, component): the smallest node that each node of an edge reaches. The result is a written table."""
    both = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = cut(spark, both, "edges")
    # every node's root so far
    roots = None
    while not live.isEmpty():
        up = live.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("parent"))
        parents = cut(spark, up, "parents")
        while True:
            p, q = parents.alias("p"), parents.alias("q")
            jumped = p.join(q, F.col("p.parent") == F.col("q.root"), "left").select(
                "p.root", F.coalesce("q.parent", "p.parent").alias("parent"), F.col("q.parent").isNotNull().alias("moved")
            )
            shorter = cut(spark, jumped, "parents")
            release(parents)
            parents = shorter
            if parents.where("moved").isEmpty():
                break
        p = parents.select("root", "parent")
        if roots is None:
            new_roots = p.select(F.col("root").alias("node"), F.col("parent").alias("component"))
        else:
            r = roots.join(p, roots.component == p.root, "left").select("node", F.coalesce("parent", "component").alias("component"))
            new_roots = r.unionByName(p.join(roots, p.root == roots.node, "left_anti").select(F.col("root").alias("node"), F.col("parent").alias("component")))
        new_roots = cut(spark, new_roots, "roots")
        pa, pb = p.toDF("ra", "pa"), p.toDF("rb", "pb")
        renamed = (
            live.join(pa, live.a == pa.ra, "left").join(pb, live.b == pb.rb, "left")
            .select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
            .where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        new_live = cut(spark, renamed, "edges")
        for old in [live, parents, *([roots] if roots is not None else [])]:
            release(old)
        live, roots = new_live, new_roots
    release(live)
    if roots is None:
        return cut(spark, spark.createDataFrame([], "node bigint, component bigint"), "components")
    # a component's own root hooks to nothing
    own = roots.select(F.col("component").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = cut(spark, roots.unionByName(own), "components")
    release(roots)
    return out
