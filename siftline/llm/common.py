"""Small helpers that several operators of this package share."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.session import materialise


def fold(doc_id: Column | str) -> Column:
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(5))


def fold_of(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def as_bytes(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as bytes."""
    return text.lower().split()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often ``body`` names it.

    Spark puts a column's expression wherever the column is used, also into
    filters that it moves down; a function's argument is bound instead.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def whole(df: DataFrame) -> Column:
    """A row of ``df`` as one struct, so that its columns meet no others' names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def within(df: DataFrame, rows: int) -> bool:
    """Has ``df`` at most ``rows`` rows? Counts no further than that."""
    return df.limit(rows + 1).count() <= rows


def join_small(big: DataFrame, small: DataFrame, on: str | list[str], how: str = "inner", rows: int = 1_000_000) -> DataFrame:
    """Join with a broadcast if ``small`` was counted to have at most ``rows`` rows.

    Otherwise Spark shuffles both sides, and AQE splits partitions of hot keys.
    ``small`` should be narrow and already written, as it is counted first.
    """
    return big.join(F.broadcast(small) if within(small, rows) else small, on, how)


def bottom_sample(df: DataFrame, key: str, rows: int, seed: int = 11) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same ones on each run."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(rows)


def one_text(df: DataFrame) -> DataFrame:
    """One row for each ``doc_id``: the text with the smallest hash."""
    least = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    return df.groupBy("doc_id", *[c for c in df.columns if c not in ("doc_id", "text")]).agg(least).select("*", "least.text").drop("least")


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back; see ``siftline.session.materialise``."""
    return materialise(df, label)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
