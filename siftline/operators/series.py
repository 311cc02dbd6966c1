"""Checks of time and residue series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.ordering import with_previous


def falling_steps(df: DataFrame, keys: Sequence[str], position: str, axis: str) -> DataFrame:
    """Rows whose axis value does not exceed the one before it."""
    seen = with_previous(df, keys, position, axis, "previous_axis")
    return seen.filter(F.col(axis) <= F.col("previous_axis"))


def is_increasing(df: DataFrame, keys: Sequence[str], position: str, axis: str) -> DataFrame:
    """Per key: number of steps that do not rise, and whether there are none."""
    seen = with_previous(df, keys, position, axis, "_before")
    falls = F.count_if(F.col(axis) <= F.col("_before"))
    return seen.groupBy(*keys).agg(falls.alias("falls"), (falls == 0).alias("increasing"))


def check_series(
    df: DataFrame,
    axis: str,
    value: str,
    position: str,
    keys: Sequence[str] = (),
    integral: bool | None = None,
) -> DataFrame:
    """Findings per series: (keys, problem).

    Problems: empty, null, not_finite, axis_start, not_increasing, not_integral,
    negative. A residue axis starts at 1 and is integral, a time axis at 0.
    """
    residue = axis == "residue_index" if integral is None else integral
    seen = with_previous(df.select(*keys, position, axis, value), keys, position, axis, "_before")
    a, v = F.col(axis).cast("double"), F.col(value).cast("double")

    def infinite(c):
        return F.isnan(c) | (F.abs(c) == float("inf"))

    tests = {
        "null": a.isNull() | v.isNull(),
        "not_finite": infinite(a) | infinite(v),
        "axis_start": a < (1 if residue else 0),
        "not_increasing": a <= F.col("_before"),
        "not_integral": (a != F.floor(a)) if residue else F.lit(False),
        "negative": v < 0,
    }
    counted = seen.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[F.count_if(t).alias(name) for name, t in tests.items()]
    )
    found = [F.when(F.col("_n") == 0, "empty")] + [
        F.when(F.col(name) > 0, name) for name in tests
    ]
    return counted.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("problem"))
