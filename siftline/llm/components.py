"""Connected components of an edge table, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import saved

_MAX_ROUNDS = 60


def _sum(df: DataFrame) -> tuple[int, int]:
    """Rows and an order-free digest, to see whether a round changed anything."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("n"), F.coalesce(digest, F.lit(0)).alias("s")).first()
    return row.n, int(row.s)


def components(edges: DataFrame) -> DataFrame:
    """Smallest node of each node's component: ``(a, b)`` edges to ``(node, root)``.

    Distributed union-find by alternating large-star and small-star steps: every
    node links its larger neighbours, then its smaller ones, to the smallest
    node it knows, until the edges are stars. Rounds grow with the logarithm of
    a path's length. Minima combine on the map side, so a node with very many
    neighbours costs no task more than its share; its join is one that AQE
    splits. Each round is written to the shared folder. Loops, repeated edges
    and edges with a null end change nothing; isolated nodes are not listed.
    """
    now = saved(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = _sum(now)
    for _ in range(_MAX_ROUNDS):
        if not before[0]:
            break
        around = now.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(
            now.select(F.col("v").alias("x"), F.col("u").alias("y"))
        )
        least = around.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = (
            around.filter("y > x").join(least, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        )
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(floor, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u <> v")
            .distinct()
        )
        now = saved(small, "edges")
        after = _sum(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {_MAX_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
