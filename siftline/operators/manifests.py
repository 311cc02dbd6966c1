"""Candidate manifests: keys, score joins, audits, file checks, new rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.keys import candidate_key, posix_path, sanitize, stem
from siftline.functions.rules import compile_rules
from siftline.operators.quality import (
    assert_empty,
    duplicate_keys,
    require_columns,
)
from siftline.ordering import add_index, first_per_key, last_per_key
from siftline.schemas import FILE_RECORD, MANIFEST, MANIFEST_REQUIRED


def validate_manifest(df: DataFrame) -> DataFrame:
    """The manifest itself; raises on missing columns or repeated ids."""
    require_columns(df, MANIFEST_REQUIRED)
    assert_empty(duplicate_keys(df, "candidate_id"), "manifest has duplicate ids")
    return df


def explode_files(df: DataFrame, column: str = "files", keep: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """One row per nested file; rows without files are kept with nulls."""
    return df.select(*keep, F.explode_outer(column).alias("_file")).select(*keep, "_file.*")


def key_lookup(manifest: DataFrame, order: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """(candidate_key, candidate_id): every known file key of each manifest row.

    Where two rows claim a key, the first in ``order`` keeps it.
    """
    names = [F.array(F.col(c)) for c in ("source_path", "derived_path") if c in manifest.columns]
    if "files" in manifest.columns:
        fields = set(manifest.schema["files"].dataType.elementType.names)
        names += [
            F.coalesce(F.col(f"files.{p}"), F.array().cast("array<string>"))
            for p in ("path", "app_volume_path", "workflow_path")
            if p in fields
        ]
    place = F.struct(*order).alias("_order")
    paths = manifest.select(F.explode(F.array_compact(F.concat(*names))).alias("_path"), "candidate_id", place)
    pairs = paths.select(candidate_key(F.col("_path")).alias("candidate_key"), "candidate_id", "_order")
    return first_per_key(pairs.filter("candidate_key <> ''"), ["candidate_key"], ["_order"]).drop("_order")


def attach_candidate_ids(
    scores: DataFrame,
    filename_col: str,
    manifest: DataFrame | None = None,
    order: Sequence[str] = ("candidate_id",),
) -> DataFrame:
    """Scores with a candidate id, mapped from the file name or derived from it."""
    if "candidate_id" in scores.columns:
        return scores
    return _map_keys(_with_key(scores, filename_col), manifest, order)


def _with_key(scores: DataFrame, filename_col: str) -> DataFrame:
    require_columns(scores, [filename_col])
    return scores.withColumn("candidate_key", candidate_key(F.col(filename_col).cast("string")))


def _map_keys(keyed: DataFrame, manifest: DataFrame | None, order: Sequence[str]) -> DataFrame:
    if manifest is None:
        return keyed.withColumnRenamed("candidate_key", "candidate_id")
    others = [c for c in keyed.columns if c != "candidate_key"]
    return keyed.join(key_lookup(manifest, order), "candidate_key", "left").select(
        *others, F.coalesce("candidate_id", "candidate_key").alias("candidate_id")
    )


def latest_scores(
    scores: DataFrame,
    metrics: Sequence[str],
    filename_col: str,
    score_order: Sequence[Column | str],
    manifest: DataFrame | None = None,
    order: Sequence[str] = ("candidate_id",),
) -> DataFrame:
    """Last score row of every candidate: (candidate_id, metrics).

    Rows are reduced to one per file key before the key look-up, so neither the
    look-up nor the second reduction sees how often a candidate was scored.
    """
    kept = [c for c in metrics if c != "candidate_id"]
    place = F.struct(*score_order).alias("_order")
    if "candidate_id" in scores.columns:
        rows = scores.select("candidate_id", *kept, place)
    else:
        keyed = _with_key(scores, filename_col).select("candidate_key", *kept, place)
        rows = _map_keys(last_per_key(keyed, ["candidate_key"], ["_order"]), manifest, order)
        if manifest is None:
            return rows.drop("_order")
    return last_per_key(rows, ["candidate_id"], ["_order"]).drop("_order")


def filter_with_audit(
    manifest: DataFrame,
    scores: DataFrame,
    rules: Mapping[str, object],
    filename_col: str,
    stage: str,
    score_order: Sequence[Column | str],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(retained manifest, retained scores, audit) of one filtering stage.

    Of several score rows per candidate the last in ``score_order`` counts; the
    outer join is one row to one row.
    """
    latest = latest_scores(scores, list(rules), filename_col, score_order, manifest)
    verdict = compile_rules(latest, rules)
    both = (
        manifest.select("candidate_id", F.lit(True).alias("_known"))
        .join(latest.withColumn("_scored", F.lit(True)), "candidate_id", "full_outer")
        .withColumn("_passed", F.when(F.col("_known") & F.col("_scored"), verdict))
    )
    shown = F.col("_known") & F.col("_scored")
    audit = both.select(
        "candidate_id",
        F.lit(stage).alias("stage_name"),
        F.coalesce("_passed", F.lit(False)).alias("passed"),
        F.when(F.col("_known").isNull(), "missing_manifest")
        .when(F.col("_scored").isNull(), "missing_score")
        .when(F.col("_passed"), "passed")
        .otherwise("filtered")
        .alias("reason"),
        *[F.when(shown, F.col(m)).alias(f"metric_{m}") for m in rules],
    )
    retained = audit.filter("passed").select("candidate_id")
    scored = attach_candidate_ids(scores, filename_col, manifest)
    return keep_ids(manifest, retained), keep_ids(scored, retained), audit


def keep_ids(df: DataFrame, ids: DataFrame, on: str = "candidate_id") -> DataFrame:
    """Rows whose id is in ``ids``."""
    return df.join(ids.select(on), on, "left_semi")


def drop_ids(df: DataFrame, ids: DataFrame, on: str = "candidate_id") -> DataFrame:
    """Rows whose id is not in ``ids``."""
    return df.join(ids.select(on), on, "left_anti")


def pending(manifest: DataFrame, reusable: DataFrame) -> DataFrame:
    """Manifest rows still to be run."""
    return drop_ids(manifest, reusable)


def attrition(manifest: DataFrame, audit: DataFrame | None, stage: str) -> DataFrame:
    """One row of candidate counts for a stage."""
    counted = ("input_candidates", "retained", "rejected", "failed", "partial", "succeeded")

    def marks(df: DataFrame, **conditions: Column) -> DataFrame:
        return df.select(
            *[F.coalesce(conditions.get(c, F.lit(False)), F.lit(False)).cast("bigint").alias(c) for c in counted]
        )

    states = {}
    if "candidate_status" in manifest.columns:
        states = {s: F.col("candidate_status") == s for s in ("failed", "partial", "succeeded")}
    rows = marks(manifest, input_candidates=F.lit(True), **states)
    if audit is not None and "passed" in audit.columns:
        rows = rows.unionByName(marks(audit, retained=F.col("passed"), rejected=~F.col("passed")))
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in counted])
    return totals.select(F.lit(stage).alias("stage_name"), *counted)


def diff_both(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Ids on one side only: (id, side) with side ``left`` or ``right``."""
    sides = left.select(F.col(on).alias("id"), F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(F.col(on).alias("id"), F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = sides.groupBy("id").agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return seen.filter("_l <> _r").select(
        "id", F.when(F.col("_l") == 1, "left").otherwise("right").alias("side")
    )


def strict_join(
    required: DataFrame,
    available: DataFrame,
    on: str = "candidate_id",
    allow_missing: bool = False,
    check: bool = True,
) -> DataFrame:
    """Join that raises on repeated or, unless allowed, missing ids.

    ``check=False`` skips the two checking jobs for inputs already validated.
    """
    require_columns(required, [on])
    require_columns(available, [on])
    if check:
        assert_empty(duplicate_keys(available, on), "available table has duplicate ids")
        if not allow_missing:
            lost = required.select(on).distinct().join(available.select(on), on, "left_anti")
            assert_empty(lost.orderBy(on), "missing required ids")
    return required.join(available, on, "inner" if allow_missing else "left")


def pair_by_candidate(references: DataFrame, models: DataFrame, check: bool = True) -> DataFrame:
    """Reference and first model (by file name) of each candidate.

    Both tables have candidate_id and file_name. With ``check`` a repeated
    reference or an id on one side only raises.
    """
    first = first_per_key(models, ["candidate_id"], ["file_name"])
    if check:
        assert_empty(duplicate_keys(references, "candidate_id"), "duplicate reference structures")
        assert_empty(diff_both(references, first, "candidate_id"), "pairing mismatch")
    renamed = [
        t.select("candidate_id", *[F.col(c).alias(f"{p}_{c}") for c in t.columns if c != "candidate_id"])
        for p, t in (("reference", references), ("model", first))
    ]
    return renamed[0].join(renamed[1], "candidate_id")


def inventory(required: DataFrame, present: DataFrame, on: str) -> DataFrame:
    """Status of every required or present id: valid, missing or unselected."""
    sides = diff_both(required, present, on).select(
        "id", F.when(F.col("side") == "left", "missing").otherwise("unselected").alias("status")
    )
    valid = required.select(F.col(on).alias("id")).join(
        present.select(F.col(on).alias("id")), "id", "left_semi"
    )
    return sides.unionByName(valid.distinct().withColumn("status", F.lit("valid")))


def merge_rows(reusable: DataFrame, new: DataFrame) -> DataFrame:
    """Reused and new manifest rows, ordered by id."""
    return reusable.unionByName(new, allowMissingColumns=True).orderBy("candidate_id")


# --- new manifest rows -------------------------------------------------------


def _optional_path(c: Column) -> Column:
    return F.when(c != "", posix_path(c))


def file_record(**fields: Column) -> Column:
    """One nested file record; unnamed fields are null and ``expected`` is true."""
    parts = []
    for f in FILE_RECORD.fields:
        value = fields.get(f.name, F.lit(True) if f.name == "expected" else F.lit(None))
        if f.name in ("workflow_path", "app_volume_path", "path"):
            value = _optional_path(value.cast("string"))
        parts.append(value.cast(f.dataType).alias(f.name))
    return F.struct(*parts)


def manifest_rows(df: DataFrame, **fields: Column) -> DataFrame:
    """Manifest rows from column expressions; unnamed fields are null."""
    out = []
    for f in MANIFEST.fields:
        value = fields.get(f.name)
        if value is None:
            value = {"files": F.array(), "manifest_schema_version": F.lit(1)}.get(f.name, F.lit(None))
        if f.name in ("source_path", "derived_path"):
            value = _optional_path(value.cast("string"))
        out.append(value.cast(f.dataType).alias(f.name))
    return df.select(*out)


def sequential_ids(
    df: DataFrame, order: Sequence[Column | str], fmt: str = "stage2_input_%06d", name: str = "candidate_id"
) -> DataFrame:
    """Numbered ids in ``order``, from 1."""
    indexed = add_index(df, order, 1, "_index")
    return indexed.withColumn(name, F.format_string(fmt, "_index")).drop("_index")


def manifest_from_listing(listing: DataFrame, stage: str = "Stage2Input") -> DataFrame:
    """Manifest rows of existing structures.

    ``listing`` has path, volume_name, artifact_id, file_path, media_type, size_bytes.
    """
    return manifest_rows(
        sequential_ids(listing, ["path"]),
        candidate_id=F.col("candidate_id"),
        stage_name=F.lit(stage),
        stage_role=F.lit("stage2_input"),
        operation_mode=F.lit("existing_structures"),
        candidate_status=F.lit("succeeded"),
        source_artifact_id=F.col("artifact_id"),
        source_path=F.col("path"),
        derived_path=F.col("path"),
        summary_json=F.to_json(F.struct(F.substring_index("path", "/", -1).alias("file_name"))),
        files=F.array(
            file_record(
                role=F.lit("structure"),
                volume_name=F.col("volume_name"),
                app_volume_path=F.col("path"),
                path=F.col("file_path"),
                media_type=F.col("media_type"),
                size_bytes=F.col("size_bytes"),
            )
        ),
    )


def manifest_from_outcomes(outcomes: DataFrame, stage: str, role: str, mode: str) -> DataFrame:
    """Manifest rows of worker outcomes (candidate_id, status, error[, outputs_json, files])."""
    extra = {}
    if "outputs_json" in outcomes.columns:
        extra["summary_json"] = F.col("outputs_json")
    if "files" in outcomes.columns:
        extra["files"] = F.coalesce("files", F.array().cast(T.ArrayType(FILE_RECORD)))
    return manifest_rows(
        outcomes,
        candidate_id=F.col("candidate_id"),
        stage_name=F.lit(stage),
        stage_role=F.lit(role),
        operation_mode=F.lit(mode),
        candidate_status=F.col("status"),
        error=F.col("error"),
        **extra,
    )


def expand_replicates(
    inputs: DataFrame, file_name: str, replicates: int, namespace: str | None = None
) -> DataFrame:
    """R named replicate runs of every input structure."""
    run = sanitize(stem(F.col(file_name)))
    if namespace:
        run = F.concat(F.lit(f"{namespace}-"), run)
    return (
        inputs.withColumn("run_name", run)
        .withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
        .withColumn("replicate_run_name", F.format_string("%s-r%03d", "run_name", "replicate"))
    )


# --- file checks -------------------------------------------------------------


def expected_file_errors(
    manifest: DataFrame, listing: DataFrame, volumes: Sequence[str], workflow_volume: str
) -> DataFrame:
    """(candidate_id, problem, volume_name, path, ...) of expected files that are not there.

    ``listing`` holds the files that exist: volume_name, path, size_bytes.
    """
    def given(c: str) -> Column:
        return F.nullif(F.col(c), F.lit(""))

    files = (
        explode_files(manifest)
        .filter(F.col("role").isNotNull() | F.col("expected").isNotNull())
        .filter(F.coalesce("expected", F.lit(True)))
        .select(
            F.coalesce(F.nullif(F.col("candidate_id"), F.lit("")), F.lit("<unknown>")).alias("candidate_id"),
            F.when(given("workflow_path").isNotNull(), F.lit(workflow_volume))
            .otherwise(given("volume_name"))
            .alias("volume_name"),
            F.coalesce(*[given(c) for c in ("workflow_path", "app_volume_path", "path")]).alias("path"),
            F.col("size_bytes").alias("expected_size"),
        )
    )
    there = listing.select(
        "volume_name", "path", F.col("size_bytes").alias("actual_size"), F.lit(True).alias("_there")
    )
    parts = F.split("path", "/")
    unsafe = F.exists(parts, lambda p: p.isin("", ".", ".."))
    problem = (
        F.when(F.col("volume_name").isNull() | F.col("path").isNull(), "no_volume_or_path")
        .when(~F.col("volume_name").isin(*volumes), "volume_not_mounted")
        .when(unsafe, "invalid_path")
        .when(F.col("_there").isNull(), "missing")
        .when(F.col("expected_size") != F.col("actual_size"), "wrong_size")
    )
    return (
        files.join(there, ["volume_name", "path"], "left")
        .withColumn("problem", problem)
        .filter("problem is not null")
        .select("candidate_id", "problem", "volume_name", "path", "expected_size", "actual_size")
    )


def reusable_ids(
    manifest: DataFrame, listing: DataFrame, volumes: Sequence[str], workflow_volume: str
) -> DataFrame:
    """Succeeded candidates whose expected files are all present."""
    done = manifest.filter("candidate_status = 'succeeded' and candidate_id <> ''")
    errors = expected_file_errors(done, listing, volumes, workflow_volume)
    return drop_ids(done.select("candidate_id"), errors)


def fixed_positions_for(structures: DataFrame, lookup: DataFrame, default: str | None = None) -> DataFrame:
    """Fixed positions per candidate: by id, else file key, else source key, else default.

    ``lookup`` is (candidate_key, fixed_positions), unique per key.
    """
    known = lookup.filter("fixed_positions <> ''")
    keyed = structures.withColumns(
        {
            "_k0": F.col("candidate_id"),
            "_k1": candidate_key(F.col("file_name")),
            "_k2": candidate_key(F.nullif(F.col("source_path"), F.lit(""))),
        }
    )
    for i in range(3):
        side = known.select(
            F.col("candidate_key").alias(f"_k{i}"), F.col("fixed_positions").alias(f"_v{i}")
        )
        keyed = keyed.join(side, f"_k{i}", "left")
    found = F.coalesce("_v0", "_v1", "_v2", F.lit(default).cast("string"))
    return keyed.select(*structures.columns, found.alias("fixed_positions")).filter(
        "fixed_positions is not null"
    )


def job_outcomes(jobs: DataFrame, files: DataFrame, worker_error: str | None = None) -> DataFrame:
    """Status of every job from the presence of its expected score file."""
    there = files.select(F.col("path").alias("expected_score_file"), F.lit(True).alias("_there")).distinct()
    ok = F.col("_there").isNotNull() & F.lit(not worker_error)
    status = F.when(ok, "succeeded").otherwise("failed")
    return jobs.join(there, "expected_score_file", "left").select(
        "candidate_id",
        status.alias("status"),
        F.when(~ok, F.lit(worker_error or None).cast("string")).alias("error"),
    )


def resolve_tasks(
    tasks: DataFrame, order: Sequence[str], lookups: Mapping[str, tuple[DataFrame, str, str]]
) -> DataFrame:
    """Replace task columns by looked-up values and number the tasks from 1.

    ``lookups`` maps a column to (table, key, value), where the table has one row
    per key. A null or unknown key gives null.
    """
    out = add_index(tasks, order, 1, "index")
    for column, (table, key, value) in lookups.items():
        side = table.select(F.col(key).alias(column), F.col(value).alias("_value"))
        out = out.join(side, column, "left").drop(column).withColumnRenamed("_value", column)
    return out
