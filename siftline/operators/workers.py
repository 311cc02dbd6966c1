"""Python workers over rows and over bounded chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.ordering import add_index
from siftline.schemas import OUTCOME


def run_rows(
    df: DataFrame, fn: Callable[[dict], dict], key: str = "candidate_id", outputs: T.StructType | None = None
) -> DataFrame:
    """Run ``fn`` on every row; an exception becomes a failed outcome row.

    ``fn`` returns the values of ``outputs``. The result has candidate_id,
    status, error and those values; parallelism is the number of partitions.
    """
    schema = T.StructType([*OUTCOME.fields, *(outputs.fields if outputs else [])])
    names = schema.names

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                out = dict.fromkeys(names)
                out["candidate_id"] = str(row[key])
                try:
                    out.update(fn(row) or {})
                    out["status"] = out["status"] or "succeeded"
                except Exception as exc:  # noqa: BLE001 - reported in the row
                    out.update(status="failed", error=str(exc))
                rows.append(out)
            yield pd.DataFrame(rows, columns=names)

    return df.mapInPandas(work, schema)


def run_chunks(
    df: DataFrame,
    order: Sequence[Column | str],
    size: int,
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``fn`` on consecutive chunks of at most ``size`` rows in ``order``."""
    indexed = add_index(df, order, 0, "_i").withColumn("_chunk", F.floor(F.col("_i") / size))

    def work(chunk: pd.DataFrame) -> pd.DataFrame:
        return fn(chunk.sort_values("_i").drop(columns=["_i", "_chunk"]).reset_index(drop=True))

    return indexed.groupBy("_chunk").applyInPandas(work, schema)
