"""Writers. Spark's committer publishes a directory only when all of it is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet table."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_series(df: DataFrame, path: str, order: Sequence[Column | str] = ()) -> None:
    """CSV with five decimals in every floating-point column."""
    if order:
        df = df.orderBy(*order)
    real = (T.DoubleType, T.FloatType)
    shown = [
        F.format_string("%.5f", F.col(f.name).cast("double")).alias(f.name)
        if isinstance(f.dataType, real)
        else F.col(f.name)
        for f in df.schema.fields
    ]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def write_screen(df: DataFrame, path: str, stem: str, order: Sequence[Column | str] = ("pos",)) -> None:
    """Three tab-separated tables: original order, ranked, ranked and filtered."""
    def save(table: DataFrame, name: str) -> None:
        table.write.mode("overwrite").option("header", True).option("sep", "\t").csv(f"{path}/{name}")

    ranking = [F.desc("efficacy"), *order]
    save(df.orderBy(*order), stem)
    save(df.orderBy(*ranking), f"{stem}_ranked")
    save(df.filter("filter = 0").orderBy(*ranking), f"{stem}_ranked_filtered")


def write_jsonl(df: DataFrame, path: str, order: DataFrame, on: str = "candidate_id", position: str = "position") -> None:
    """JSON Lines in the order given by (``on``, ``position``)."""
    ordered = df.join(order.select(on, F.col(position).alias("_position")), on)
    ordered.orderBy("_position").drop("_position").write.mode("overwrite").json(path)


def write_shards(df: DataFrame, path: str, stem: str, count: int, place: str = "place") -> None:
    """FASTA text in one folder ``shard_name=<stem>-%05d-of-%05d`` per shard.

    Rows are range-partitioned by (shard, place): a large shard becomes several
    files whose names sort in record order.
    """
    name = F.format_string(f"{stem}-%05d-of-{count:05d}", F.col("shard").cast("int"))
    record = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence"))
    (
        df.repartitionByRange("shard", place)
        .sortWithinPartitions("shard", place)
        .select(record.alias("value"), name.alias("shard_name"))
        .write.mode("overwrite")
        .partitionBy("shard_name")
        .text(path)
    )


def write_fasta(df: DataFrame, path: str) -> None:
    """FASTA text of (header, sequence)."""
    record = F.concat(F.lit(">"), F.col("header"), F.lit("\n"), F.col("sequence"))
    df.select(record.alias("value")).write.mode("overwrite").text(path)
