"""Exact histogram of encoded lengths, and what it says about every context limit."""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.llm.common import saved

#: Fixed value: the pattern that splits text before the merges of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_STEP = 512
_LONG = 256  # blanks in a row from which a run is cut out
#: Fixed value: the characters of the tokeniser's ``\\s``, fewer than Python's.
_SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_BLANKS = re.compile(rf"{_SPACE}{{{_LONG},}}")


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Rank file (base64 token and rank per line) as a table for the tasks.

    The file is read by the driver or, if it is not a local one, by Spark; a
    vocabulary is a bounded file of about a megabyte.
    """
    try:
        with open(path, "rb") as f:
            lines = f.read().split(b"\n")
    except FileNotFoundError:
        lines = [r.value.encode() for r in spark.read.text(path).collect()]
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def encoded_length(encoding: tiktoken.Encoding, text: str) -> int:
    """Tokens of a text; long runs of blanks are taken out before the pattern sees them.

    The pattern's look-ahead would walk such a run recursively. It makes one piece
    of all blanks but the last if a word follows, and of all of them at the end;
    the last blank goes with the word or stands alone. Nothing joins across the
    run's beginning, so the parts' tokens add up exactly.
    """
    total, start = 0, 0
    for run in _BLANKS.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += _short_length(encoding, text[start : run.start()]) + len(encoding._encode_single_piece(text[run.start() : end]))
        start = end
    return total + _short_length(encoding, text[start:])


def _short_length(encoding: tiktoken.Encoding, text: str) -> int:
    return len(encoding.encode_ordinary(text)) if text else 0


def length_counts(docs: DataFrame, ranks: dict[bytes, int], text: str = "text", pattern: str = PATTERN) -> DataFrame:
    """``(length, docs)``: number of texts of each encoded length.

    Every whole text is encoded; a null text has length 0. Each task adds up its
    own histogram, so a row per length and task is shuffled.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=sent.value, special_tokens={})
        found: Counter = Counter()
        for batch in batches:
            found.update(encoded_length(encoding, t) if t else 0 for t in batch.column(0).to_pylist())
        keys = np.fromiter(found, np.int64, len(found))
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(found.values(), np.int64, len(found)))], ["length", "docs"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(run, "length bigint, docs bigint")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def limits(histogram: DataFrame) -> DataFrame:
    """For each length that occurs, taken as a context limit, exact totals.

    ``docs`` has that length. ``docs_over`` and ``tokens_over`` are the suffix
    sums: the longer documents and their tokens. ``docs_within`` and
    ``tokens_within`` are the rest. ``tokens_kept`` is what is left if longer
    documents are cut at the limit, ``tokens_cut`` what is lost then.
    ``quantile`` is the share of documents within the limit, so the p-quantile of
    the lengths is the first row with a quantile of p or more. Between two rows
    tokens_kept grows by docs_over for each token of the limit.

    Sums run within blocks of lengths; the blocks' totals (one row for each 512
    lengths) are summed first. An empty histogram gives no row.
    """
    blocks = histogram.withColumn("_block", F.floor(F.col("length") / _STEP)).withColumn("_tokens", F.col("length") * F.col("docs"))
    after = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = blocks.groupBy("_block").agg(F.sum("docs").alias("_d"), F.sum("_tokens").alias("_t"))
    later = sums.select(
        "_block",
        F.coalesce(F.sum("_d").over(after), F.lit(0)).alias("_docs_after"),
        F.coalesce(F.sum("_t").over(after), F.lit(0)).alias("_tokens_after"),
        F.sum("_d").over(whole).alias("_docs_all"),
        F.sum("_t").over(whole).alias("_tokens_all"),
    )
    inside = Window.partitionBy("_block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    out = (
        blocks.join(later, "_block")
        .withColumn("docs_over", F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("_docs_after"))
        .withColumn("tokens_over", F.coalesce(F.sum("_tokens").over(inside), F.lit(0)) + F.col("_tokens_after"))
    )
    kept = F.col("_tokens_all") - F.col("tokens_over") + F.col("length") * F.col("docs_over")
    return out.select(
        "length",
        "docs",
        "docs_over",
        "tokens_over",
        (F.col("_docs_all") - F.col("docs_over")).alias("docs_within"),
        (F.col("_tokens_all") - F.col("tokens_over")).alias("tokens_within"),
        kept.alias("tokens_kept"),
        (F.col("_tokens_all") - kept).alias("tokens_cut"),
        ((F.col("_docs_all") - F.col("docs_over")) / F.col("_docs_all")).alias("quantile"),
    )


def length_table(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``limits`` of the documents' lengths under the vocabulary in ``path``."""
    return limits(saved(length_counts(docs, read_ranks(docs.sparkSession, path), text), "lengths"))
