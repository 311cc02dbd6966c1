"""JSON judged file by file: a bad file loses its own rows, with a reason, and no others."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.keys import candidate_key
from siftline.session import materialise

REASONS = ("unparsable", "not an object", "no key", "repeated key", "empty")


@dataclass
class Judged:
    """Rows of the good files, and a row for each file: ``(source_file, records, reason)``; reason is null for good ones."""

    rows: DataFrame
    files: DataFrame


def _name(path: F.Column) -> F.Column:
    """Path without scheme and leading slashes, so that listings and scans agree."""
    return F.concat(F.lit("/"), F.regexp_replace(path, r"\A(?:[a-z0-9]+:)?/+", ""))


def _verdict(reasons: list[F.Column]) -> F.Column:
    """The first of the named reasons whose condition holds."""
    verdict = F.lit(None).cast("string")
    for reason, holds in reversed(list(zip(REASONS, reasons))):
        verdict = F.when(holds, reason).otherwise(verdict)
    return verdict


def judge_jsonl(spark: SparkSession, path: str, key: str) -> Judged:
    """JSON Lines whose records are objects with a text ``key``, unique in their file.

    ``rows`` has ``(source_file, key, record)``, the record as a variant. Blank
    lines are skipped. One line that is no JSON, no object, has no text key, or
    repeats a key of its file drops all rows of that file and of no other; a file
    without any record is ``empty``. Files are read once; Spark gives no task files
    without bytes, so names come from the list that the driver has made of them.
    """
    scan = spark.read.text(path)
    lines = scan.select(_name(F.col("_metadata.file_path")).alias("source_file"), "value").filter(F.trim("value") != "")
    parsed = lines.withColumn("record", F.try_parse_json("value"))
    kind = F.schema_of_variant("record")
    found = F.try_variant_get("record", f"$.{key}", "string")
    text = F.schema_of_variant(F.try_variant_get("record", f"$.{key}", "variant")) == "STRING"
    flagged = materialise(
        parsed.select(
            "source_file",
            F.when(text, found).alias(key),
            F.col("record").isNull().alias("_broken"),
            (~kind.startswith("OBJECT")).alias("_other"),
            "value",
        ),
        "json-lines",
    )
    # first by file and key, so that a large file is no single group
    keys = flagged.groupBy("source_file", key).agg(
        F.count("*").alias("n"), F.max("_broken").alias("broken"), F.max(F.coalesce("_other", F.lit(False))).alias("other")
    )
    files = keys.groupBy("source_file").agg(
        F.sum("n").alias("records"),
        F.max("broken").alias("broken"),
        F.max("other").alias("other"),
        F.max(F.col(key).isNull()).alias("lost"),
        F.max(F.col(key).isNotNull() & (F.col("n") > 1)).alias("again"),
    )
    listed = spark.createDataFrame([(name,) for name in scan.inputFiles()], "path string").select(_name(F.col("path")).alias("source_file"))
    judged = listed.join(files, "source_file", "left").select(
        "source_file",
        F.coalesce("records", F.lit(0)).alias("records"),
        _verdict([F.col("broken"), F.col("other"), F.col("lost"), F.col("again"), F.col("records").isNull()]).alias("reason"),
    )
    judged = materialise(judged, "json-files")
    good = judged.filter("reason is null").select("source_file")
    rows = flagged.join(good, "source_file", "left_semi").select("source_file", key, F.parse_json("value").alias("record"))
    return Judged(rows, judged)


def judge_metrics(spark: SparkSession, path: str, stage: str, pattern: str = "*.json", folder: str | None = None) -> Judged:
    """One JSON object per file, as a row for each scalar at its top: ``candidate_id, stage_name, source_file, name, value, kind``.

    Each file is judged by its own types: a name may be a number in one and an
    object in another, where it is left out. Nulls are scalars of kind ``VOID`` and
    are kept. Files that are no JSON or no object are named with their reason;
    objects without any scalar are ``empty``. ``folder`` is for files that Spark
    wrote: the part of the path behind it, up to a slash, stands for the name.
    """
    whole = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).text(path)
    file = F.col("_metadata.file_path")
    name = F.substring_index(file, "/", -1) if folder is None else F.substring_index(F.substring_index(file, folder, -1), "/", 1)
    parsed = materialise(
        whole.select(_name(file).alias("source_file"), candidate_key(name).alias("candidate_id"), F.try_parse_json("value").alias("record")),
        "json-metrics",
    )
    entries = parsed.filter(F.schema_of_variant("record").startswith("OBJECT")).lateralJoin(spark.tvf.variant_explode(F.col("record").outer()))
    kind = F.schema_of_variant("value")
    scalars = entries.withColumn("kind", kind).filter(~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"))
    rows = scalars.select(
        "candidate_id", F.lit(stage).alias("stage_name"), "source_file", F.col("key").alias("name"), F.col("value").cast("string").alias("value"), "kind"
    )
    counts = rows.groupBy("source_file").agg(F.count("*").alias("records"))
    no = F.lit(False)
    files = parsed.join(counts, "source_file", "left").select(
        "source_file",
        F.coalesce("records", F.lit(0)).alias("records"),
        _verdict([F.col("record").isNull(), ~F.schema_of_variant("record").startswith("OBJECT"), no, no, F.col("records").isNull()]).alias("reason"),
    )
    return Judged(rows, files)
