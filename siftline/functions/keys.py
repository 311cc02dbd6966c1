"""Candidate keys, paths, identifiers and hashes as native column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Id columns in order of preference.
ID_COLUMNS = (
    "candidate_id",
    "target_name",
    "reference",
    "reference_pdb",
    "pdb_name",
    "description",
    "filename",
    "name",
    "id",
)

# The end of a lower-case file name that is not part of its key: score suffixes,
# each at most once, then a replicate mark, then the file suffix.
_KEY_END = (
    r"(?=[_.])(?:_model)?(?:_scores)?(?:_ranking_scores)?(?:_confidences)?(?:_summary_confidences)?"
    r"(?:_seed-[0-9]+_sample-[0-9]+_model)?(?:(?<!\A)\.[^.]+)?\z"
)


def blank_to_null(c: Column) -> Column:
    """Empty text and null both mean "no value"."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def _parts(c: Column) -> Column:
    return F.filter(F.split(c, "/"), lambda p: (p != "") & (p != "."))


def posix_path(c: Column) -> Column:
    """Forward slashes, no empty or ``.`` parts; ``..`` is kept; empty gives ``.``."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    root = F.when(c.rlike(r"\A//(?!/)"), "//").when(c.startswith("/"), "/").otherwise("")
    path = F.concat(root, F.array_join(_parts(c), "/"))
    return F.when(path == "", ".").otherwise(path)


def basename(c: Column) -> Column:
    """Last path part after ``\\`` is turned into ``/``."""
    return F.coalesce(F.try_element_at(_parts(F.replace(c, F.lit("\\"), F.lit("/"))), F.lit(-1)), F.when(c.isNotNull(), ""))


def _file_name(c: Column) -> Column:
    # No array functions here: they would take the expression out of code generation.
    last = F.substring_index(c, "/", -1)
    cut = F.substring_index(F.regexp_replace(c, r"(?:/+\.?)+\z", ""), "/", -1)
    cut = F.when(cut == ".", F.lit("")).otherwise(cut)
    return F.when(last.isin("", "."), cut).otherwise(last)


def stem(c: Column) -> Column:
    """Last part of a slash path without its last suffix."""
    return F.regexp_replace(_file_name(c), r"(?<!\A)\.[^.]+\z", "")


def candidate_key(c: Column) -> Column:
    """Structure stem behind a collision-safe file name."""
    key = F.regexp_replace(F.lower(_file_name(c)), _KEY_END, "")
    return F.substring_index(F.substring_index(key, "__", -1), "_refold-", -1)


def row_key(df: DataFrame, columns: Sequence[str] = ID_COLUMNS) -> Column:
    """Key of the first id column that ``df`` has and that is not empty, zero or false; empty if none."""
    kinds = dict(df.dtypes)
    blank = {"string": F.lit(""), "boolean": F.lit(False)}
    present = [F.nullif(F.col(c), blank.get(kinds[c], F.lit(0))).cast("string") for c in columns if c in kinds]
    if not present:
        return F.lit("")
    return F.coalesce(candidate_key(F.coalesce(*present)), F.lit(""))


def sanitize(c: Column, sep: str = "_") -> Column:
    """Path parts joined by ``sep`` with ``..`` resolved; null if nothing is left."""
    parts = _parts(F.trim(c))
    resolved = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda kept, p: F.when(
            p == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        ).otherwise(F.array_append(kept, p)),
    )
    resolved = F.when(F.array_contains(parts, ".."), resolved).otherwise(parts)
    return F.nullif(F.array_join(resolved, sep), F.lit(""))


def normal_basename(c: Column) -> Column:
    return sanitize(F.try_element_at(_parts(posix_path(c)), F.lit(-1)))


def _json(struct: Column) -> Column:
    """Compact JSON with lower-case hex in control-character escapes."""
    text = F.to_json(struct, {"ignoreNullFields": "false"})
    lowered = text
    for code in (0x0B, 0x0E, 0x0F, 0x1A, 0x1B, 0x1C, 0x1D, 0x1E, 0x1F):
        lowered = F.regexp_replace(
            lowered, rf"((?<!\\)(?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}"
        )
    return F.when(text.rlike(r"\\u00[01][0-9A-F]"), lowered).otherwise(text)


def json_text(c: Column) -> Column:
    """One value as JSON text."""
    wrapped = _json(F.struct(c.alias("v")))
    return F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)


def _candidate_id(**fields: Column) -> Column:
    ordered = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.concat(F.lit("cand_"), F.substring(F.sha2(_json(ordered), 256), 1, 16))


def initial_id(stage: Column, artifact: Column, path: Column, base: Column | None = None) -> Column:
    """Deterministic id of a source candidate."""
    name = path if base is None else F.coalesce(F.nullif(base, F.lit("")), path)
    return _candidate_id(
        kind=F.lit("initial"),
        stage_name=stage,
        source_artifact_id=artifact,
        source_path=posix_path(path),
        basename=normal_basename(name),
    )


def derived_id(parent: Column, stage: Column, mode: Column, base: Column) -> Column:
    """Deterministic id of a candidate derived from another one."""
    return _candidate_id(
        kind=F.lit("derived"),
        parent_candidate_id=parent,
        stage_name=stage,
        operation_mode=mode,
        derived_basename=normal_basename(base),
    )


def safe_name(c: Column, limit: int = 180, kept: int = 160) -> Column:
    """Record name usable as a file name; long names end in a hash of the raw name."""
    flat = sanitize(F.replace(c, F.lit(" "), F.lit("_@_")))
    name = F.regexp_replace(flat, r"[^A-Za-z0-9._@-]+", "_")
    name = F.regexp_replace(name, r"\A[._-]+|[._-]+\z", "")
    name = F.nullif(F.regexp_replace(name, r"__+", "_"), F.lit(""))
    short = F.concat(F.substring(name, 1, kept), F.lit("_"), F.substring(F.sha2(c, 256), 1, 16))
    return F.when(F.length(name) > limit, short).otherwise(name)


def seed_slice(c: Column, start: int = 1, length: int = 6) -> Column:
    """``length`` letters from zero-based ``start``."""
    return F.substring(c, start + 1, length)


def offset_name(c: Column, prefix: str = "RNA") -> Column:
    """Name from a one-based position."""
    return F.concat(F.lit(prefix), (c.cast("bigint") - 1).cast("string"))


def prefix_ids(df: DataFrame, run_id: str, columns: Sequence[str]) -> DataFrame:
    """Put the run id before the named id columns; a null id stays null."""
    return df.withColumns({c: F.concat(F.lit(f"{run_id}_"), F.col(c).cast("string")) for c in columns})


def hit_id(fields: Column) -> Column:
    """Target name with its start and end."""
    return F.concat(fields[0], F.lit("/"), fields[6], F.lit("-"), fields[7])


def hit_name(description: Column) -> Column:
    """Description up to the first space."""
    return F.substring_index(description, " ", 1)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def cache_path(kind: str, digest: Column) -> Column:
    """``kind/ab/abcd...`` for a digest ``abcd...``."""
    return F.concat_ws("/", F.lit(kind), F.substring(digest, 1, 2), digest)


def framed_hash(*fragments: Column) -> Column:
    """Hash of ordered JSON fragments, each after its 8-byte big-endian length."""
    framed = []
    for fragment in fragments:
        data = json_text(fragment).cast("binary")
        framed += [F.unhex(F.lpad(F.hex(F.octet_length(data)), 16, "0")), data]
    return F.sha2(F.concat(*framed), 256)


def int_list(c: Column) -> Column:
    """Comma-separated integers as an array; empty items are skipped."""
    items = F.transform(F.split(c, ","), lambda x: F.trim(x))
    return F.transform(F.filter(items, lambda x: x != ""), lambda x: x.cast("int"))


def strip_replicate(c: Column) -> Column:
    """Structure name without a ``_<digits>`` replicate suffix."""
    return F.regexp_replace(c, r"(?s)\A(.+)_[0-9]+\z", "$1")


def redact(c: Column, secret: Column) -> Column:
    """Replace every occurrence of a non-empty secret."""
    hidden = F.replace(c, secret, F.lit("[function-call-id-redacted]"))
    return F.when(F.length(secret) > 0, hidden).otherwise(c)
