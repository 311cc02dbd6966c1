"""Delimited, JSON and Parquet tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.keys import candidate_key
from siftline.functions.numbers import to_double
from siftline.operators.manifests import validate_manifest
from siftline.operators.quality import assert_empty, duplicate_keys
from siftline.schemas import MANIFEST


def read_scores(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """CSV with a header, every column as text; empty cells are null."""
    return spark.read.option("header", True).csv(path)


def read_typed_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str) -> DataFrame:
    """CSV with declared types; a header or cell that does not fit fails the query."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("mode", "FAILFAST")
        .option("enforceSchema", False)
        .csv(path)
    )


def read_evidence_tsv(
    spark: SparkSession, paths: str | list[str], columns: Sequence[str], numeric: Sequence[str] = ()
) -> DataFrame:
    """Tab-separated files with or without a header row, or empty, as one table.

    ``numeric`` columns become doubles, null where the text is not a number.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).option("sep", "\t").option("header", False).csv(paths)
    header = F.lit(True)
    for c in columns:
        header = header & F.col(c).eqNullSafe(F.lit(c))
    rows = rows.filter(~header)
    return rows.withColumns({c: to_double(F.col(c)) for c in numeric}) if numeric else rows


def read_positional(
    spark: SparkSession, paths: str | list[str], positions: Mapping[int, str], min_columns: int = 28
) -> DataFrame:
    """Chosen columns of a wide tab-separated table, by position, as text."""
    wide = spark.read.option("sep", "\t").option("header", True).csv(paths)
    if len(wide.columns) < min_columns:
        raise ValueError(f"expected at least {min_columns} columns, found {len(wide.columns)}")
    named = wide.toDF(*[f"c{i}" for i in range(len(wide.columns))])
    return named.select(*[F.col(f"c{i}").alias(name) for i, name in positions.items()])


def read_reference_table(
    spark: SparkSession, path: str | list[str], species: str, transcript: int, species_at: int, sequence: int
) -> DataFrame:
    """RNA records of one species from a tab-separated dump with a header row.

    Columns are given by position; a row too short for them is skipped.
    """
    from siftline.operators.sequences import convert_reference_table

    rows = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    named = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    return convert_reference_table(named, species, f"c{transcript}", f"c{species_at}", f"c{sequence}")


def read_manifest(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """Candidate manifest with its columns and ids checked; extra columns stay."""
    df = spark.read.parquet(path)
    return validate_manifest(df) if check else df


def empty_manifest(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MANIFEST)


_SCALARS = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.BooleanType)


def read_metric_json(
    spark: SparkSession, path: str | list[str], stage: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One JSON object per file: its top-level scalars with candidate id and file name.

    Without a ``schema`` Spark reads the files once more to find the fields.
    """
    reader = spark.read.option("multiLine", True).option("pathGlobFilter", "*.json")
    docs = (reader.schema(schema) if schema else reader).json(path)
    scalars = [
        f.name
        for f in docs.schema.fields
        if isinstance(f.dataType, _SCALARS) and f.name != "_corrupt_record"
    ]
    kept = F.coalesce(*[F.col(f"`{c}`").cast("string") for c in scalars]) if scalars else F.lit(None)
    file = F.col("_metadata.file_name")
    own = {"candidate_id", "stage_name", "source_file"}
    return docs.filter(kept.isNotNull()).select(
        candidate_key(file).alias("candidate_id"),
        F.lit(stage).alias("stage_name"),
        F.col("_metadata.file_path").alias("source_file"),
        *[F.col(f"`{c}`") for c in scalars if c not in own],
    )


def json_scalars(df: DataFrame, column: str, schema: str, keep: Sequence[str]) -> DataFrame:
    """Named scalars of a JSON text column."""
    return df.select(*keep, F.from_json(column, schema).alias("_j")).select(*keep, "_j.*")


def read_jsonl(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, key: str, check: bool = True
) -> DataFrame:
    """JSON Lines with a required unique text key; a bad line fails the query."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if check:
        assert_empty(rows.filter(F.col(key).isNull()).select(key), f"records without {key}")
        assert_empty(duplicate_keys(rows, key), f"repeated {key}")
    return rows


def read_listing(
    spark: SparkSession, root: str, globs: Sequence[str] = (), suffixes: Sequence[str] = (".pdb", ".cif")
) -> DataFrame:
    """(path, file_name, size_bytes) of the files below a root, contents unread.

    A file is kept if its name ends in a suffix and, where ``globs`` are given,
    its path below the root or its name matches one of them.
    """
    from siftline.operators.runs import glob_pattern

    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", F.col("length").alias("size_bytes"))
    )
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    name = F.substring_index("path", "/", -1)
    below = F.regexp_replace(F.col("path"), rf"\A(?:[a-z0-9]+:)?/*\Q{base}\E/", "")
    keep = F.lit(not suffixes)
    for s in suffixes:
        keep = keep | F.lower(name).endswith(s)
    if globs:
        match = F.lit(False)
        for g in globs:
            match = match | below.rlike(glob_pattern(g)) | name.rlike(glob_pattern(g))
        keep = keep & match
    return files.filter(keep).select(
        F.col("path"), below.alias("relative_path"), name.alias("file_name"), "size_bytes"
    )
