"""Checks that return their findings as rows, and one helper that raises."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.functions.keys import safe_name

# Identifier format and alphabets.
SAFE_ID = r"\A[A-Za-z0-9][A-Za-z0-9._-]{0,239}\z"
ALPHABETS = {
    "protein": "[A-Z]+",
    "rna": "[ACGU]+",
    "iupac": "[ACGTURYSWKMBDHVN]+",
    "nucleotide": "[ACGUTN]+",
}
MAX_QUERY_RESIDUES = 5120


def assert_empty(findings: DataFrame, message: str, shown: int = 20) -> None:
    """Raise if a check found anything; names at most ``shown`` findings."""
    rows = findings.limit(shown).collect()
    if rows:
        raise ValueError(f"{message}: {[tuple(r) if len(r) > 1 else r[0] for r in rows]}")


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df`` itself; raises if a column is missing."""
    absent = sorted(set(columns) - set(df.columns))
    if absent:
        raise ValueError(f"table is missing columns: {absent}")
    return df


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; empty if the column does not exist."""
    if column not in df.columns:
        return df.sparkSession.createDataFrame([], f"{column} string, n bigint")
    return df.groupBy(column).agg(F.count("*").alias("n"))


def unique_safe_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids that are repeated or not safe as file names: (id, problem, n)."""
    counts = df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n"))
    problems = F.array_compact(
        F.array(
            F.when(F.col("n") > 1, "duplicate"),
            F.when(~F.coalesce(F.col("id").rlike(SAFE_ID), F.lit(False)), "unsafe"),
        )
    )
    return counts.select("id", F.explode(problems).alias("problem"), "n")


def alphabet_problem(sequence: Column, alphabet: str, longest: int | None = None) -> Column:
    """Why a sequence is refused: ``empty``, ``too_long``, ``alphabet``; null if it is fine."""
    bad = ~sequence.rlike(rf"\A{ALPHABETS[alphabet]}\z")
    problem = F.when(sequence.isNull() | (F.length(sequence) == 0), "empty")
    if longest is not None:
        problem = problem.when(F.length(sequence) > longest, "too_long")
    return problem.when(bad, "alphabet")


def check_alphabet(
    df: DataFrame, key: str, sequence: str, alphabet: str = "protein", longest: int = MAX_QUERY_RESIDUES
) -> DataFrame:
    """Records whose sequence is refused: (key, problem)."""
    return df.select(
        key, alphabet_problem(F.col(sequence), alphabet, longest).alias("problem")
    ).filter(F.col("problem").isNotNull())


def check_names(df: DataFrame, name: str) -> DataFrame:
    """Record names that are unusable or collide after cleaning: (safe_name, problem, n)."""
    counts = df.groupBy(safe_name(F.col(name)).alias("safe_name")).agg(F.count("*").alias("n"))
    problem = F.when(F.col("safe_name").isNull(), "no_safe_characters").when(
        F.col("n") > 1, "collision"
    )
    return counts.select("safe_name", problem.alias("problem"), "n").filter("problem is not null")


def require_field(df: DataFrame, condition: Column, column: str, shown: Sequence[str]) -> DataFrame:
    """Rows for which ``column`` is required by ``condition`` but empty."""
    empty = F.col(column).isNull() | (F.trim(F.col(column).cast("string")) == "")
    return df.filter(condition & empty).select(*shown)
