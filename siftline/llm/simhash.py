"""SimHash near-duplicates: exact Hamming pairs by vantage-point trees; near copies by exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import as_bytes, bottom_sample, join_small, popcount, saved, whole, words
from siftline.llm.components import components
from siftline.llm.line_dedup import classes

SEED = 42
BANDS, ROWS = 16, 4
_HALVES = (0xFFFFFFFF00000000, 0x00000000FFFFFFFF)


def shingles(text: bytes, shingle: int = 4) -> np.ndarray:
    """XXH64 values of all word shingles, in order; none without words."""
    tokens = words(text)
    if not tokens:
        return np.empty(0, "<u8")
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    n = max(len(tokens) - shingle + 1, 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), "<u8", n)


def _majority(hashes: np.ndarray) -> int:
    n, ones = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit majority of the XXH64 values of all word shingles; 0 without words."""
    return _majority(shingles(text, shingle))


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = 4) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long, one row per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, fp bigint")


class VantageTree:
    """Shallow tree that deals fingerprints to shards so that close pairs share one.

    A node holds a vantage point and a radius. Distances count the differing
    bits under ``mask``. Points up to the radius go left, the others right, and
    those within ``reach`` inside the boundary go right as well: by the triangle
    inequality, two points at most ``reach`` apart then meet in one leaf.
    """

    def __init__(self, sample: np.ndarray, mask: int, reach: int, leaf: float, seed: int = 7) -> None:
        self.mask, self.reach = np.uint64(mask), reach
        self.nodes: list[tuple[int, int, int, int]] = []  # vantage, radius, left, right; radius -1: leaf
        self._grow(sample, leaf, np.random.default_rng(seed))

    def _grow(self, points: np.ndarray, leaf: float, rng: np.random.Generator) -> int:
        at = len(self.nodes)
        self.nodes.append((0, -1, -1, -1))
        if len(points) <= leaf:
            return at
        best = None
        for vantage in points[rng.integers(0, len(points), 4)]:
            far = popcount((points ^ vantage) & self.mask).astype(np.int64)
            radius = int(np.median(far))
            for cut in (radius, radius - 1):
                left, right = int((far <= cut).sum()), int((far > cut - self.reach).sum())
                if best is None or max(left, right) < best[0]:
                    best = (max(left, right), int(vantage), cut, far)
        if best is None or best[0] >= 0.95 * len(points):
            return at  # too dense to divide further by this metric
        _, vantage, cut, far = best
        left = self._grow(points[far <= cut], leaf, rng)
        right = self._grow(points[far > cut - self.reach], leaf, rng)
        self.nodes[at] = (vantage, cut, left, right)
        return at

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of all leaves that each point belongs to."""
        rows, leaves, todo = [], [], [(0, np.arange(len(points)))]
        while todo:
            node, at = todo.pop()
            vantage, cut, left, right = self.nodes[node]
            if not len(at):
                continue
            if left < 0:
                rows.append(at)
                leaves.append(np.full(len(at), node))
                continue
            far = popcount((points[at] ^ np.uint64(vantage)) & self.mask).astype(np.int64)
            todo.append((left, at[far <= cut]))
            todo.append((right, at[far > cut - self.reach]))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(rows), np.concatenate(leaves)


def link_shard(points: np.ndarray, mask: int, reach: int, bits: int, leaf: int = 512) -> np.ndarray:
    """Root position of each point of a shard, linking all pairs at most ``bits`` apart.

    A vantage tree on the shard; leaves, and groups too dense to divide, are
    compared in blocks of rows, so memory stays within a block.
    """
    mask_, rng = np.uint64(mask), np.random.default_rng(7)
    label = np.arange(len(points))
    todo = [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) > leaf:
            best = None
            for vantage in points[at[rng.integers(0, len(at), 4)]]:
                far = popcount((points[at] ^ vantage) & mask_).astype(np.int64)
                for cut in (int(np.median(far)), int(np.median(far)) - 1):
                    most = max(int((far <= cut).sum()), int((far > cut - reach).sum()))
                    if best is None or most < best[0]:
                        best = (most, cut, far)
            if best[0] < 0.9 * len(at):
                _, cut, far = best
                todo += [at[far <= cut], at[far > cut - reach]]
                continue
        own = points[at]
        step = max(1, (1 << 20) // max(len(at), 1))
        for i in range(0, len(at), step):
            near = popcount(own[i : i + step, None] ^ own[None, i:]) <= bits
            for row in np.nonzero(near.sum(axis=1) > 1)[0]:
                met = np.unique(label[at[i + np.nonzero(near[row])[0]]])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
    return label


def hamming_links(fps: DataFrame, bits: int = 4, shard: int = 16384, sample: int = 32768) -> DataFrame:
    """Edges ``(a, b)`` between distinct fingerprints that connect all pairs at most ``bits`` apart.

    ``fps`` has distinct ``fp``. Of ``bits`` differing bits, at most half lie in
    one 32-bit half, so each half gets a vantage tree with that smaller reach.
    The trees are grown from at most ``sample`` fingerprints (the smallest hashes)
    on the driver, deep enough that a leaf holds about ``shard`` of all; every
    fingerprint is routed. A shard yields a spanning forest, not its pairs.
    """
    total = fps.count()
    reach = bits // 2
    if bits % 2:
        raise ValueError("bits must be even: the halves share them")
    taken = np.array([r.fp for r in bottom_sample(fps, "fp", sample).collect()], np.int64).view(np.uint64)
    leaf = shard * len(taken) / max(total, 1)
    trees = [VantageTree(taken, mask, reach, leaf) for mask in _HALVES] if total > shard else [VantageTree(taken, (1 << 64) - 1, bits, leaf + 1)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for number, tree in enumerate(trees):
                rows, leaves = tree.route(points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), number, np.int32)), pa.array(leaves.astype(np.int32)), pa.array(points[rows].view(np.int64))],
                    ["tree", "leaf", "fp"],
                )

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        points = np.sort(frame["fp"].to_numpy()).view(np.uint64)
        tree = trees[int(key[0])]
        roots = link_shard(points, int(tree.mask), tree.reach, bits)
        own = np.arange(len(points)) != roots
        return pd.DataFrame({"a": points[own].view(np.int64), "b": points[roots[own]].view(np.int64)})

    return (
        fps.select("fp")
        .mapInArrow(route, "tree int, leaf int, fp bigint")
        .groupBy("tree", "leaf")
        .applyInPandas(link, "a bigint, b bigint")
    )


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = 4, bits: int = 4) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs``.

    Texts are grouped by fingerprint first, so copies never meet as pairs.
    Documents without a word (null, empty, white space) have fingerprint zero
    and link like any other. ``component_id`` is the smallest ``doc_id`` that is
    reached; rows with a null id take part and get it too, or null if no row of
    their component has an id. Repeated rows stay. An empty table gives none.
    """
    own = saved(fingerprints(docs, text, shingle), "fingerprints")
    fps = saved(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    root = components(hamming_links(fps, bits)).select(F.col("node").alias("fp"), "root")
    rooted = fps.join(root, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = saved(rooted.join(lows, "root").select("fp", "component_id"), "names")
    return own.join(names, "fp").select("doc_id", "fp", "component_id")


def hex16(fp: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def profiled(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``(doc_id, h, fp, keys)`` of each row: its words' hash, fingerprint, and hashes of groups of shingle minima."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, prints, keys = [], [], []
            for t in as_bytes(batch.column(1)):
                hashes = shingles(t, shingle)
                least = np.full(len(odd), np.iinfo(np.uint64).max)
                for at in range(0, len(hashes), 4096):
                    least = np.minimum(least, (hashes[at : at + 4096, None] * odd).min(axis=0))
                names.append(xxhash.xxh64_intdigest(b" ".join(words(t))))
                prints.append(_majority(hashes))
                keys.append([xxhash.xxh64_intdigest(m.tobytes(), b) for b, m in enumerate(least.reshape(BANDS, ROWS))])
            flat = pa.array(np.array(keys, np.uint64).ravel().view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS, pa.int32()), flat)
            longs = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (names, prints))
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, lists], ["doc_id", "h", "fp", "keys"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col(text).cast("string")).mapInArrow(run, "doc_id bigint, h bigint, fp bigint, keys array<bigint>")


def copies(docs: DataFrame, text: str = "text", shingle: int = 5, similarity: float = 0.8, bits: int = 4) -> DataFrame:
    """``(doc_id, component_id)`` of every row; texts of one component are linked by near copies.

    Near copies have sets of ``shingle``-word shingles with a Jaccard similarity of
    ``similarity`` or more, which is counted exactly for each link. Candidates
    share a band of shingle minima, or are joined by ``hamming_links`` between
    their fingerprints. Bands find a pair at 0.8 with a probability of 0.9998,
    more similar ones with more. Texts with the same words are one; a shorter
    text is one shingle. ``component_id`` is as in ``near_duplicates``.
    """
    own = saved(profiled(docs, text, shingle), "profiles")
    coded = saved(own.groupBy("h").agg(F.min("fp").alias("fp"), F.first("keys").alias("keys")), "bands")
    fps = saved(coded.groupBy("fp").agg(F.min("h").alias("h"), F.count("*").alias("n")), "fps")
    linked = hamming_links(fps, bits).join(fps.select(F.col("fp").alias("a"), F.col("h").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("h").alias("y")), "b")
    same = coded.select("h", "fp").join(fps.filter("n > 1").select("fp", F.col("h").alias("x")), "fp").filter("h <> x")
    links = saved(linked.select(F.col("x").alias("a"), F.col("y").alias("b")).unionByName(same.select(F.col("x").alias("a"), F.col("h").alias("b"))), "links")
    members = coded.select("h", F.explode("keys").alias("band"))
    shared = members.join(saved(members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"), "shared"), "band").select("h").distinct()
    shared = saved(shared, "sharing")
    ids = saved(shared.unionByName(links.select(F.col("a").alias("h"))).unionByName(links.select(F.col("b").alias("h"))).distinct(), "candidates")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = [b" ".join(words(t)) for t in as_bytes(batch.column(0))]
            names = np.array([xxhash.xxh64_intdigest(t) for t in joined], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(joined, pa.binary())], ["h", "line"])

    texts = join_small(docs.select(F.col(text).cast("string")).mapInArrow(named, "h bigint, line binary"), ids, "h")
    texts = saved(texts.groupBy("h").agg(F.first("line").alias("line")), "texts")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, far = [], []
            for x, y in zip(as_bytes(batch.column("left")), as_bytes(batch.column("right"))):
                one, two = (np.unique(shingles(t, shingle)) for t in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                either = max(len(one) + len(two) - both, 1)
                near.append(both * 1000 >= round(similarity * 1000) * either)
                far.append(1000.0 - 1000.0 * both / either)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_()), pa.array(far, pa.float64())], ["a", "b", "near", "far"])

    def compare(pairs: DataFrame) -> DataFrame:
        left = saved(pairs, "pairs").join(texts.select(F.col("h").alias("a"), F.col("line").alias("left")), "a")
        return left.join(texts.select(F.col("h").alias("b"), F.col("line").alias("right")), "b").mapInArrow(judge, "a bigint, b bigint, near boolean, far double")

    def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(t, shingle)) for t in as_bytes(batch.column("line"))]
            marked = np.zeros((len(sets), 1024), bool)
            for row, own_set in zip(marked, sets):
                row[:] = np.bincount((own_set & np.uint64(1023)).astype(np.int64), minlength=1024) & 1
            found = np.packbits(marked, axis=1, bitorder="little").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column("h"), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(found[:, k].copy()) for k in range(16))], ["h", "size", *(f"w{k}" for k in range(16))])

    def profile(hs: DataFrame) -> DataFrame:
        picked = texts.join(hs.distinct(), "h", "left_semi")
        return picked.mapInArrow(bitmaps, "h bigint, size bigint, " + ", ".join(f"w{k} bigint" for k in range(16)))

    banded = classes(coded.join(shared, "h", "left_semi").select("h", "keys"), compare, profile, similarity)
    edges = banded.select(F.col("h").alias("a"), F.col("root").alias("b")).unionByName(compare(links).filter("near").select("a", "b"))
    roots = components(edges).select(F.col("node").alias("h"), "root")
    rooted = own.select("doc_id", "h").join(roots, "h", "left").select("doc_id", "h", F.coalesce("root", "h").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rooted.join(lows, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame, text: str = "text", shingle: int = 5, bits: int = 4, similarity: float = 0.8) -> DataFrame:
    """The document of the smallest id of each component of near copies; see ``copies``.

    Of rows that share the kept id, the first by their other columns stays, or, where
    these are maps and have no order, the first by the row as text. Rows with a null
    id cannot be named as kept or gone, so all of them stay.
    """
    marked = copies(docs, text, shingle, similarity, bits)
    lone = marked.filter("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(lone, "doc_id", "left_semi")
    ordered = not any("map<" in kind for _, kind in docs.dtypes)
    first = F.min(whole(docs)) if ordered else F.min_by(whole(docs), whole(docs).cast("string"))
    kept = kept.groupBy("doc_id").agg(first.alias("d")).select("d.*")
    return kept.unionByName(docs.filter("doc_id is null"))
