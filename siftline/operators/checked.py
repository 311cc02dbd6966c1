"""Joins that check their keys in the plan itself, and a permutation computed row by row."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _fails(message: Column) -> Column:
    """Raises when it is computed. Not a constant, so that no rule of the optimiser does that."""
    return F.raise_error(F.when(F.rand(0) >= 0, message)).cast("boolean")


def checked_join(
    required: DataFrame, available: DataFrame, on: str = "candidate_id", allow_missing: bool = False, seen: Observation | None = None
) -> DataFrame:
    """Join whose action fails on a repeated id of ``available`` or, unless allowed, on a missing one.

    Each side is scanned once, by the action that uses the result: the ids are
    counted in the aggregation that the join's own shuffle serves, and rows pass a
    filter that raises. ``seen`` gets what passed: ``rows``, and ``missing`` of them.
    Rows with a null id are missing. Every row is checked, also where columns are
    not used, but an action that stops early checks only what it has looked at.
    """
    rest = [c for c in available.columns if c != on]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(True)
    # any_value keeps a whole row: where there are several, the filter fails anyway
    once = available.filter(F.col(on).isNotNull()).groupBy(on).agg(F.any_value(row).alias("_row"), F.count("*").alias("_n"))
    joined = required.join(once, on, "inner" if allow_missing else "left")
    label = F.coalesce(F.col(on).cast("string"), F.lit("null"))
    passes = F.when(F.col("_n") > 1, _fails(F.concat(F.lit("repeated id: "), label)))
    if not allow_missing:
        passes = passes.when(F.col("_n").isNull(), _fails(F.concat(F.lit("missing id: "), label)))
    done = joined.filter(passes.otherwise(F.rand(0) >= 0))
    if seen is not None:
        done = done.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("_n").isNull()).alias("missing"))
    left = [F.col(f"`{c}`") for c in required.columns]
    return done.select(*left, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


#: A prime below 2^31, and the odd multipliers of the rounds' functions.
_PRIME = 2_147_483_647
_ROUNDS = ((1_103_515_245, 12_345), (69_069, 362_437), (1_664_525, 1_013_904), (22_695_477, 7_919), (134_775_813, 104_729), (214_013, 2_531_011))


def _constants(seed: int) -> list[tuple[int, int]]:
    return [(times, (plus + seed * (2 * k + 1)) % _PRIME) for k, (times, plus) in enumerate(_ROUNDS)]


def _beyond(n: int, a: int, b: int, seed: int) -> int:
    """Most passes that a place needs: one, and one for each place from n on that it may meet in a row.

    Fewer than the root of n places lie beyond n, so all of them are followed here.
    """
    place = np.arange(n, a * b, dtype=np.int64)
    # those that others beyond n lead to are met later, or lie on rings that no place enters
    place = np.setdiff1d(place, _once(place, a, b, seed))
    passes = 1
    while len(place):
        passes += 1
        place = _once(place, a, b, seed)
        place = place[place >= n]
    return passes


def _once(place: np.ndarray, a: int, b: int, seed: int) -> np.ndarray:
    low, high = place % a, place // a
    for k, (times, plus) in enumerate(_constants(seed)):
        start = ((low if k % 2 else high) + plus) % _PRIME
        move = (start * start % _PRIME * times + start) % _PRIME
        if k % 2:
            high = (high + move) % b
        else:
            low = (low + move) % a
    return high * a + low


def permuted(df: DataFrame, ordinal: str, n: int, seed: int = 23, name: str = "position") -> DataFrame:
    """Place of each ordinal 0 to n - 1 in a permutation of them, as a column; nothing is shuffled.

    A keyed Feistel network is a permutation of the numbers below ``a * b``, the
    least near-square that holds n; places from n on go through it again until
    they fall below n, which takes a known number of passes. No row needs
    another. Numbers outside 0 to n - 1 and nulls have no place. n may be up to
    10^15.
    """
    if n < 1:
        return df.withColumn(name, F.lit(None).cast("bigint"))
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)
    names = [f"_{part}_{name}" for part in ("low", "high", "start")]
    low, high, start = (F.col(x) for x in names)
    x = F.when((F.col(ordinal) >= 0) & (F.col(ordinal) < n), F.col(ordinal).cast("bigint"))
    out = df.withColumn(name, x)
    place = F.col(name)
    for done in range(_beyond(n, a, b, seed)):
        # steps of their own, so that no expression is written out twice
        out = out.withColumns({names[0]: place % a, names[1]: F.call_function("div", place, F.lit(a).cast("bigint"))})
        for k, (times, plus) in enumerate(_constants(seed)):
            # each half moves by a function of the other, which can be undone
            out = out.withColumn(names[2], ((low if k % 2 else high) + plus) % _PRIME)
            move = (start * start % _PRIME * times + start) % _PRIME
            out = out.withColumn(names[1], (high + move) % b) if k % 2 else out.withColumn(names[0], (low + move) % a)
        again = high * a + low
        out = out.withColumn(name, F.when(place < n, place).otherwise(again) if done else again)
    return out.drop(*names)


def permuted_sql(ordinal: str, n: int | str, seed: int = 23, depth: int = 4) -> str:
    """``permuted`` in DuckDB's SQL for a column and a table ``sizes(n, a, b)``, with up to ``depth`` passes."""
    def once(x: str) -> str:
        state = f"{{'l': {x} % a, 'r': {x} // a}}"
        for k, (times, plus) in enumerate(_constants(seed)):
            moved, by, size = ("r", "l", "b") if k % 2 else ("l", "r", "a")
            start = f"((s.{by} + {plus}) % {_PRIME})"
            value = f"((s.{moved} + ({start} * {start} % {_PRIME} * {times} + {start}) % {_PRIME}) % {size})"
            parts = {"l": "s.l", "r": "s.r", moved: value}
            state = f"list_transform([{state}], lambda s: {{'l': {parts['l']}, 'r': {parts['r']}}})[1]"
        return f"list_transform([{state}], lambda s: s.r * a + s.l)[1]"

    out = once(f"{ordinal}::BIGINT")
    for _ in range(depth - 1):
        out = f"list_transform([{out}], lambda v: CASE WHEN v < {n} THEN v ELSE {once('v')} END)[1]"
    return out


def permute_to_shards(df: DataFrame, ordinal: str, shards: int, n: int, seed: int = 23) -> DataFrame:
    """Rows with ``position``, ``shard`` and ``place`` in the shard, for ordinals 0 to n - 1; nothing is shuffled."""
    placed = permuted(df, ordinal, n, seed)
    return placed.withColumn("shard", F.pmod("position", F.lit(shards)).cast("int")).withColumn("place", F.call_function("div", F.col("position"), F.lit(shards)))
