"""Order-dependent building blocks that never put one key into one task.

Spark rows have no order, so every function takes an explicit one. A window
partitioned by the key alone would sort a hot key in a single task; here
first/last are aggregates, global positions come from a range-partitioned sort,
and neighbour look-ups run per block of positions with a small carry table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.session import materialise

BLOCK = 1 << 16
_SALTS = 1024
_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id: partition << 33 | row


def _columns(names: Sequence[Column | str]) -> list[Column]:
    return [F.col(n) if isinstance(n, str) else n for n in names]


def _edge(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], last: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    named = {c: f"o{i}" for i, c in enumerate(order) if isinstance(c, str) and c in rest}
    place = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(_columns(order))])
    # a column of the order is not carried twice
    other = [c for c in rest if c not in named]
    row = F.struct(*other) if other else F.lit(None)
    if any("map<" in kind or "variant" in kind for _, kind in df.dtypes):
        # such columns cannot be compared, so rows cannot break ties of the order
        best = (F.max_by if last else F.min_by)(F.struct(place.alias("p"), row.alias("r")), place)
    else:
        best = (F.max if last else F.min)(F.struct(place.alias("p"), row.alias("r")))
    found = df.groupBy(*keys).agg(best.alias("_best"))
    shown = {c: F.col(f"_best.p.{named[c]}") if c in named else F.col(f"_best.r.`{c}`") for c in rest}
    return found.select(*[shown[c].alias(c) if c in shown else F.col(c) for c in df.columns])


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """First row of each key in ``order``; combines on the map side.

    Rows that tie in ``order`` are taken by their other columns.
    """
    return _edge(df, keys, order, last=False)


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Last row of each key in ``order``; otherwise like ``first_per_key``."""
    return _edge(df, keys, order, last=True)


def _null_safe_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join on ``on`` in which null matches null; keeps one copy of ``on``."""
    renamed = right.select(
        *[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns]
    )
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def add_index(
    df: DataFrame,
    order: Sequence[Column | str],
    start: int = 1,
    name: str = "index",
    total: str | None = None,
) -> DataFrame:
    """Position of every row in a total order, without a single-task window.

    The sorted rows are written once with their partition and row number, so
    the per-partition counts and the rows always agree. ``order`` must end in a
    unique column for the result to be reproducible. ``total`` names a column
    for the number of rows.
    """
    placed = materialise(
        df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "index"
    ).withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per written partition: bounded by the number of tasks
    whole = before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = placed.groupBy("_part").agg(F.count("*").alias("_n")).select(
        "_part",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("_total"),
    )
    within = F.col("_at").bitwiseAND(F.lit(_LOW_BITS))
    return placed.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_before") + within + F.lit(start)).cast("bigint").alias(name),
        *([F.col("_total").alias(total)] if total else []),
    )


def index_by_hash(
    df: DataFrame,
    hashed: Column,
    ties: Sequence[Column | str],
    bits: int,
    buckets: int = 1 << 12,
    start: int = 0,
    name: str = "index",
) -> DataFrame:
    """Position of every row in the order of a uniform ``bits``-bit hash.

    Even buckets of the hash range replace the sampling of ``add_index``: the
    counts per bucket give the offsets and each bucket is numbered on its own.
    """
    shift = max(bits - (buckets.bit_length() - 1), 0)
    keyed = df.withColumn("_hash", hashed).withColumn("_bucket", F.shiftright("_hash", shift))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # at most `buckets` rows
    offsets = keyed.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *_columns(ties)))
    return (
        keyed.withColumn("_row", inside)
        .join(F.broadcast(offsets), "_bucket")
        .select(
            *df.columns,
            (F.col("_before") + F.col("_row") + F.lit(start - 1)).cast("bigint").alias(name),
        )
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    position: str,
    value: Column | str,
    name: str = "previous",
    block: int = BLOCK,
) -> DataFrame:
    """``lag(value)`` per key over an integer ``position`` that is unique per key.

    Rows are grouped by (key, block of positions), at most ``block`` rows each.
    The last value of each block enters the key's next block as an extra first
    row, so the rows are shuffled once and a hot key is spread over its blocks.
    Positions should be dense, like row numbers or event ids: the ends of one
    key's blocks are ordered together, one row per block.
    """
    value = F.col(value) if isinstance(value, str) else value
    blocked = df.withColumn("_value", value).withColumn(
        "_block", F.floor(F.col(position) / F.lit(block)).cast("bigint")
    )
    ends = blocked.groupBy(*keys, "_block").agg(
        F.max_by(F.struct("_value"), F.col(position)).alias("_last")
    )
    chain = Window.partitionBy(*keys).orderBy("_block")
    carried = (
        ends.withColumn("_carried", F.lag("_last").over(chain))
        .filter("_carried is not null")
        .select(*keys, "_block", F.col("_carried._value").alias("_value"), F.lit(True).alias("_extra"))
    )
    here = Window.partitionBy(*keys, "_block").orderBy(F.col("_extra").desc_nulls_last(), position)
    return (
        blocked.unionByName(carried, allowMissingColumns=True)
        .withColumn(name, F.lag("_value").over(here))
        .filter("_extra is null")
        .select(*df.columns, name)
    )


def ordered_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    item: Column,
    wanted: Column | None = None,
    block: int = 4096,
) -> DataFrame:
    """Items of each key as ordered arrays: (keys, segment, items).

    Segments of ``block`` items count from 0 in the key's order, at any number of
    items, so that no array grows with the data and no item is lost. Rows that
    are not ``wanted`` add no item, but a key with only such rows still gets its
    segment 0, with an empty array.
    """
    wanted = F.lit(True) if wanted is None else F.coalesce(wanted, F.lit(False))
    at = [f"_p{i}" for i in range(len(order))]
    placed = df.select(
        *keys,
        *[F.col(c).alias(p) for c, p in zip(order, at)],
        item.alias("_item"),
        wanted.alias("_wanted"),
    )
    # wanted rows come first in their key, so that their places are dense
    last = F.when(F.col("_wanted"), 0).otherwise(1)
    indexed = add_index(placed.withColumn("_last", last), [*keys, "_last", *at, "_item"], 0, "_i")
    starts = indexed.groupBy(*keys).agg(F.min("_i").alias("_start"))
    segment = F.when(F.col("_wanted"), F.floor((F.col("_i") - F.col("_start")) / F.lit(block))).otherwise(0)
    listed = F.array_sort(F.collect_list(F.when(F.col("_wanted"), F.struct("_i", "_item"))))
    return (
        _null_safe_join(indexed, starts, keys)
        .groupBy(*keys, segment.cast("bigint").alias("segment"))
        .agg(F.transform(listed, lambda x: x["_item"]).alias("items"))
    )


def top_k_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str = "rank", salts: int = _SALTS
) -> DataFrame:
    """Best ``k`` rows of each key, cut in two steps.

    A key's rows are first cut to ``k`` for each group of input partitions (at
    most ``salts`` groups), so that the task that ranks a hot key gets no more
    than ``k`` rows of each group, and none sorts the whole key.
    """
    salted = Window.partitionBy(*keys, "_salt").orderBy(*order)
    part = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    cut = part.withColumn("_cut", F.row_number().over(salted)).filter(F.col("_cut") <= k).drop("_salt", "_cut")
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = cut.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
    return kept.withColumn(name, F.col(name).cast("bigint"))


def top_k(df: DataFrame, order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Best ``k`` rows overall, numbered from 1; only ``k`` rows are numbered."""
    best = df.orderBy(*order).limit(k)
    return best.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
