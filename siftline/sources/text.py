"""Line- and record-oriented text: FASTA, atom records, hit lines, logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.keys import candidate_key

# Metrics of a short docking log, and the format of their numbers.
LOG_METRICS = ("dockq", "irmsd", "lrmsd", "fnat", "fnonnat", "f1", "clashes")
_LOG_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def read_fasta(spark: SparkSession, path: str | list[str], preamble: bool = True, glob: str | None = None) -> DataFrame:
    """(header, sequence, source_file) records of FASTA files.

    Files are split between tasks at record starts. Wrapped lines are joined,
    blanks trimmed. Text before the first header is no record; looking for it
    costs one more scan, so pass ``preamble=False`` for files known to start
    with a header.
    """
    reader = spark.read.option("lineSep", "\n>")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    starts = F.ltrim(F.col("value")).startswith(">")
    if preamble:
        # the first chunk of a file keeps its ">"; without one it is a preamble
        first = (
            raw.filter(F.col("_start") == 0)
            .groupBy("source_file")
            .agg(F.min("_id").alias("_id"), F.min_by(starts, F.col("_id")).alias("_ok"))
            .filter(~F.col("_ok"))
            .select("source_file", "_id")
        )
        raw = raw.join(first, ["source_file", "_id"], "left_anti")
    body = F.regexp_replace(F.replace(F.col("value"), F.lit("\r"), F.lit("")), r"\A\s*>", "")
    lines = F.split(body, "\n")
    return raw.filter(F.trim(body) != "").select(
        F.trim(lines[0]).alias("header"),
        F.array_join(F.transform(F.slice(lines, F.lit(2), F.size(lines)), lambda x: F.trim(x)), "").alias("sequence"),
        "source_file",
    )


def fasta_sequence_rows(
    spark: SparkSession, path: str | list[str], stage: str, parent: str | None = None
) -> DataFrame:
    """Sequence rows of .fa, .faa and .fasta files with candidate key and source."""
    records = read_fasta(spark, path, glob="*.{fa,faa,fasta,FA,FAA,FASTA}")
    name = F.coalesce(F.nullif(F.col("header"), F.lit("")), F.col("source_file"))
    return records.select(
        candidate_key(name).alias("candidate_id"),
        F.lit(parent).cast("string").alias("parent_candidate_id"),
        F.lit(stage).alias("stage_name"),
        "source_file",
        F.col("header").alias("sequence_id"),
        "sequence",
    )


def parse_atoms(lines: DataFrame, line: str = "value", keep: Sequence[str] = ("file",)) -> DataFrame:
    """Fixed-width fields of every line; non-atom lines have is_atom false."""
    text = F.regexp_replace(F.col(line), r"\r\z", "")

    def cut(start: int, end: int) -> Column:
        return F.trim(F.substring(text, start + 1, end - start))

    def real(start: int) -> Column:
        return cut(start, start + 8).try_cast("double")

    return lines.select(
        *keep,
        (text.startswith("ATOM  ") | text.startswith("HETATM")).alias("is_atom"),
        F.length(text).alias("length"),
        cut(6, 11).try_cast("int").alias("serial"),
        cut(12, 16).alias("atom_name"),
        cut(17, 20).alias("residue"),
        cut(21, 22).alias("chain"),
        cut(22, 26).try_cast("int").alias("residue_index"),
        cut(26, 27).alias("insertion_code"),
        real(30).alias("x"),
        real(38).alias("y"),
        real(46).alias("z"),
        cut(60, 66).try_cast("double").alias("b_factor"),
    )


def read_atoms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of structure files with their atom fields."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    return parse_atoms(lines)


def log_metric(text: Column, key: str) -> Column:
    """Last well-formed value after the token ``key`` or ``key:``, in any case."""
    found = F.regexp_extract_all(
        text, F.lit(rf"(?i)(?<!\S){key}:*\s+({_LOG_NUMBER})(?!\S)"), F.lit(1)
    )
    return F.try_element_at(found, F.lit(-1))


def extract_log_metrics(
    df: DataFrame, text: str, keys: Sequence[str] | Mapping[str, str] = LOG_METRICS, keep: Sequence[str] = ()
) -> DataFrame:
    """Metric columns of a log text, null where absent, and the ``mapping`` word."""
    named = keys if isinstance(keys, Mapping) else {k: k for k in keys}
    mapping = F.nullif(F.regexp_extract(F.col(text), r"\bmapping\s+(\S+)", 1), F.lit(""))
    return df.select(
        *keep,
        *[log_metric(F.col(text), k).alias(name) for k, name in named.items()],
        mapping.alias("mapping"),
    )
