"""Fixed schemas of the tables the operators exchange."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _B, _I = (
    T.StringType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.IntegerType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


FILE_RECORD = _struct(
    ("role", _S),
    ("workflow_path", _S),
    ("volume_name", _S),
    ("app_volume_path", _S),
    ("path", _S),
    ("media_type", _S),
    ("size_bytes", _L),
    ("expected", _B),
)
MANIFEST = _struct(
    ("candidate_id", _S),
    ("parent_candidate_id", _S),
    ("stage_name", _S),
    ("stage_role", _S),
    ("operation_mode", _S),
    ("candidate_status", _S),
    ("source_artifact_id", _S),
    ("source_path", _S),
    ("derived_path", _S),
    ("status_reason", _S),
    ("error", _S),
    ("summary_json", _S),
    ("files", T.ArrayType(FILE_RECORD)),
    ("manifest_schema_version", _I),
)
# summary_json and manifest_schema_version may be absent from older manifests
MANIFEST_REQUIRED = tuple(
    f.name for f in MANIFEST if f.name not in ("summary_json", "manifest_schema_version")
)
RANKED = _struct(
    ("design", _S),
    ("filename", _S),
    ("rank_score", _D),
    ("dockq", _D),
    ("iptm", _D),
    ("interface_score", _D),
)
PITA = _struct(("RefSeq", _S), ("microRNA", _S), ("Sites", _S), ("Score", _S))
TARGETSCAN = _struct(("refseq", _S), ("siRNA", _S), ("targetscan_score", _S))
FASTA = _struct(("header", _S), ("sequence", _S))
FASTA_STATS = _struct(("file", _S), ("num_seqs", _L), ("sum_len", _L))
RMSD_SERIES = _struct(("time_ns", _D), ("rmsd", _D))
GYRATION_SERIES = _struct(("time_ns", _D), ("rg", _D))
RMSF_SERIES = _struct(("residue_index", _D), ("rmsf", _D))
RANKING = _struct(("seed", _L), ("sample_index", _I), ("ranking_score", _D))
OUTCOME = _struct(("candidate_id", _S), ("status", _S), ("error", _S))

# Job states and their groups.
TRACKED_STATES = ("queued", "running", "finalizing", "cancel_requested")
ACTIVE_STATES = (*TRACKED_STATES, "state_unknown")
TERMINAL_STATES = ("succeeded", "partial", "failed", "cancelled")
RECONCILABLE_STATES = (*TRACKED_STATES, "blocked")

#: The states that may follow each state of a job; None stands for a job without any.
#: An end is final, an unknown state is only resolved as a failure, and only waiting or running jobs can be cancelled.
_OPEN_STATES = ("queued", "running", "finalizing", "blocked")
NEXT_STATES: dict[str | None, tuple[str, ...]] = {
    None: ("queued",),
    "queued": (*_OPEN_STATES, "cancel_requested", "state_unknown", *TERMINAL_STATES),
    "running": (*_OPEN_STATES, "cancel_requested", "state_unknown", *TERMINAL_STATES),
    "finalizing": (*_OPEN_STATES, "state_unknown", *TERMINAL_STATES),
    "blocked": (*_OPEN_STATES, "state_unknown", *TERMINAL_STATES),
    "cancel_requested": ("cancel_requested", "blocked", "state_unknown", *TERMINAL_STATES),
    "state_unknown": ("state_unknown", "failed"),
}
