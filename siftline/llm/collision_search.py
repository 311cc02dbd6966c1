"""Nearest neighbours by collision counting over single projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROJECTIONS = 96
BLOCK = 16384
QUERIES = 4096


class CollisionIndex:
    """Sorted projections of one block of vectors, searched by growing windows.

    Vectors are lengthened by one component so that all have the norm of the
    longest; the largest inner product with a query is then the least Euclidean
    distance. Each projection is one sorted array. A search opens a window around
    the query's own projection in every array and counts for each vector the
    windows that hold it; vectors found in at least ``threshold`` of them are
    candidates. While there are not ``enough`` (10 k and a share of the block), the
    windows widen by ``ratio`` (virtual rehashing: no second table is built).
    What lies outside the windows is counted, as that is the smaller part.
    """

    def __init__(self, vectors: np.ndarray, projections: int = PROJECTIONS, width: float = 1.5, threshold: float = 0.76, ratio: float = 1.15, seed: int = 23) -> None:
        self.vectors = vectors.astype(np.float64)
        squares = (self.vectors**2).sum(axis=1)
        self.norm = np.sqrt(squares.max(initial=0.0))
        extra = np.sqrt(np.maximum(squares.max(initial=0.0) - squares, 0.0))
        axes = np.random.default_rng(seed).standard_normal((vectors.shape[1] + 1, projections))
        self.axes = axes / np.sqrt((axes**2).sum(axis=0))
        shadows = (np.column_stack([self.vectors, extra]) @ self.axes).T
        self.order = np.argsort(shadows, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(shadows, self.order, axis=1)
        self.most_missed = projections - max(1, int(np.ceil(threshold * projections)))
        self.ratio, self.start = ratio, width * float(shadows.std(axis=1).mean()) or 1.0

    def search(self, query: np.ndarray, enough: int) -> np.ndarray:
        """Positions of the candidates of one query."""
        n, width = len(self.vectors), self.start
        # a query's length does not change the order of inner products
        at = np.append(query * (self.norm / np.sqrt((query**2).sum())), 0.0) @ self.axes
        while True:
            low = [v.searchsorted(x - width, "left") for v, x in zip(self.values, at)]
            high = [v.searchsorted(x + width, "right") for v, x in zip(self.values, at)]
            outside = [o[:a] for o, a in zip(self.order, low)] + [o[b:] for o, b in zip(self.order, high)]
            found = np.nonzero(np.bincount(np.concatenate(outside), minlength=n) <= self.most_missed)[0]
            if len(found) >= min(enough, n):
                return found
            width *= self.ratio

    def nearest(self, query: np.ndarray, ids: np.ndarray, own: int, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and inner products of the best ``k`` verified candidates, without the query's own row."""
        found = self.search(query, 10 * k + int(share * len(ids)))
        scores = (self.vectors[found] * query).sum(axis=1)
        found, scores = found[ids[found] != own], scores[ids[found] != own]
        best = np.lexsort((ids[found], -scores))[:k]
        return ids[found[best]], scores[best]


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """``(vec_id, v)``: rows with an id and a vector that is finite, not zero and without nulls."""
    v = F.col("v")
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & sound & F.exists(v, lambda x: x != 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = 0.1, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """The ``k`` vectors of largest inner product found for each query row.

    ``is_query`` says which ``vec_id`` are queries; every other row is a
    candidate. Vectors are dealt by a hash of their ids to blocks of about
    ``block``, queries to blocks of about ``queries``; each pair of blocks is one
    task's group, so its size is bounded at any number of vectors, and equal
    vectors spread. A block gives each query its ``k`` best, and those are merged.

    Gives ``query_id, rank, vec_id, score``: score is the inner product in double
    precision; ties go to the smaller id; fewer rows if there are fewer
    candidates. Null, zero and non-finite vectors take no part, nor do null ids
    or vectors of another length than the most common one (ties: the longest). A
    repeated id counts once, with its least vector.
    """
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size, total = (sizes[0]["size"], sizes[0]["n"]) if sizes else (0, 0)
    sound = rows.filter(F.size("v") == size).withColumn("q", F.coalesce(is_query, F.lit(False)))
    n_blocks = max(1, -(-total // block))
    n_queries = max(1, -(-sound.filter("q").count() // queries))
    place = lambda salt, n: F.pmod(F.xxhash64(F.lit(salt), F.col("vec_id")), F.lit(n)).cast("int")
    left = sound.select("vec_id", "v", place("v", n_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), F.lit(False).alias("asks"))
    right = sound.filter("q").select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), place("q", n_queries).alias("qb"), F.lit(True).alias("asks"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(v=[np.asarray(x, np.float64) for x in frame["v"]])
        frame = frame.sort_values("vec_id", kind="stable")
        if frame.duplicated(["vec_id", "asks"]).any():
            frame = frame.assign(_t=[tuple(x) for x in frame["v"]]).sort_values(["vec_id", "_t"])
            frame = frame.drop_duplicates(["vec_id", "asks"])
        asks = frame["asks"].to_numpy()
        held, asked = frame[~asks], frame[asks]
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(held) or not len(asked):
            return empty
        index, ids = CollisionIndex(np.stack(held["v"].to_list())), held["vec_id"].to_numpy()
        out = []
        for own, query in zip(asked["vec_id"], asked["v"]):
            best, scores = index.nearest(query, ids, own, k, share)
            out.append(pd.DataFrame({"query_id": np.full(len(best), own), "vec_id": best, "score": scores}))
        return pd.concat(out) if out else empty

    found = left.unionByName(right).groupBy("b", "qb").applyInPandas(run, "query_id bigint, vec_id bigint, score double")
    # k rows of each block and query are merged in an ordered array of bounded groups
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id")))), 1, k)
    merged = found.withColumn("_g", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, int(n_blocks**0.5)))))
    for by in (["query_id", "_g"], ["query_id"]):
        lists = merged.groupBy(*by).agg(best.alias("best"))
        merged = lists.select("query_id", F.posexplode("best").alias("p", "x")).select("query_id", "p", (-F.col("x.s")).alias("score"), F.col("x.vec_id").alias("vec_id"))
        merged = merged.withColumn("_g", F.lit(0)) if by != ["query_id"] else merged
    return merged.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "vec_id", "score")
