import pytest
from conftest import rows
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from siftline.operators import manifests as m
from siftline.operators import quality as q
from siftline.schemas import MANIFEST
from siftline.sources.sinks import write_table
from siftline.sources.tables import read_manifest

FILES = "files array<struct<role string, workflow_path string, volume_name string, app_volume_path string, path string, media_type string, size_bytes bigint, expected boolean>>"


def file(role="structure", flow=None, volume=None, app=None, path=None, size=None, expected=True):
    return (role, flow, volume, app, path, None, size, expected)


@pytest.fixture
def manifest(frame):
    return frame(
        f"candidate_id string, candidate_status string, source_path string, derived_path string, {FILES}",
        ("cand-a", "succeeded", "in/a.pdb", None, [file(path="out/a_model.cif")]),
        ("cand-b", "succeeded", "in/b.pdb", "", []),
        ("cand-c", "failed", "in/c.pdb", None, None),
    )


def test_audit_fixture(frame, manifest):
    scores = frame(
        "description string, iptm double, n int",
        ("a", 0.1, 0), ("a_model.cif", 0.9, 1), ("b.pdb", 0.9, 0), ("b.pdb", 0.5, 1), ("stranger", 0.9, 0),
    )
    kept, kept_scores, audit = m.filter_with_audit(manifest, scores, {"iptm": "> 0.7"}, "description", "stage1", ["n"])
    assert rows(audit) == [
        ("cand-a", "stage1", True, "passed", 0.9),
        ("cand-b", "stage1", False, "filtered", 0.5),
        ("cand-c", "stage1", False, "missing_score", None),
        ("stranger", "stage1", False, "missing_manifest", None),
    ]
    assert rows(kept, "candidate_id") == [("cand-a",)]
    assert rows(kept_scores, "candidate_id", "iptm") == [("cand-a", 0.1), ("cand-a", 0.9)]
    assert rows(m.attrition(manifest, audit, "stage1")) == [("stage1", 3, 1, 3, 1, 0, 2)]


def test_audit_ignores_bad_metric_of_overwritten_or_unknown_rows(frame, manifest):
    scores = frame("candidate_id string, iptm string, n int", ("cand-a", "x", 0), ("cand-a", "0.9", 1), ("other", "x", 0))
    audit = m.filter_with_audit(manifest, scores, {"iptm": "> 0.7"}, "none", "s", ["n"])[2]
    assert audit.count() == 4
    bad = frame("candidate_id string, iptm string, n int", ("cand-a", "x", 0))
    with pytest.raises(PySparkException):
        m.filter_with_audit(manifest, bad, {"iptm": "> 0.7"}, "none", "s", ["n"])[2].collect()


def test_audit_without_candidates(frame, manifest):
    empty = manifest.limit(0)
    scores = frame("description string, iptm double, n int", ("a", 0.9, 0))
    kept, _, audit = m.filter_with_audit(empty, scores, {"iptm": "> 0.7"}, "description", "s", ["n"])
    assert kept.count() == 0
    assert rows(audit, "candidate_id", "reason") == [("a", "missing_manifest")]


def test_attrition_statuses(frame):
    manifest = frame("candidate_id string, candidate_status string", ("a", "succeeded"), ("b", "failed"), ("c", "partial"))
    audit = frame("candidate_id string, passed boolean", ("a", True), ("b", False))
    assert rows(m.attrition(manifest, audit, "s")) == [("s", 3, 1, 1, 1, 1, 1)]
    assert rows(m.attrition(manifest.drop("candidate_status").limit(0), None, "s")) == [("s", 0, 0, 0, 0, 0, 0)]


def test_key_lookup_first_wins(frame):
    manifest = frame(
        f"candidate_id string, source_path string, derived_path string, {FILES}, o int",
        ("two", "x/a.pdb", None, [file(app="y/b_model.cif", flow="z/c.pdb")], 2),
        ("one", "x/a.pdb", "d.pdb", None, 1),
    )
    assert rows(m.key_lookup(manifest, ["o"]), "candidate_key", "candidate_id") == [
        ("a", "one"), ("b", "two"), ("c", "two"), ("d", "one"),
    ]


def test_attach_keeps_given_ids_and_needs_a_column(frame):
    given = frame("candidate_id string", ("x",))
    assert m.attach_candidate_ids(given, "nope") is given
    with pytest.raises(ValueError):
        m.attach_candidate_ids(frame("a string", ("x",)), "description")


def test_strict_join(frame):
    left = frame("candidate_id string, l int", ("a", 1), ("b", 2))
    right = frame("candidate_id string, r int", ("a", 10))
    with pytest.raises(ValueError, match="missing required"):
        m.strict_join(left, right)
    assert rows(m.strict_join(left, right, allow_missing=True)) == [("a", 1, 10)]
    with pytest.raises(ValueError, match="duplicate"):
        m.strict_join(left, right.union(right))
    assert rows(m.strict_join(left.limit(1), right)) == [("a", 1, 10)]
    with pytest.raises(ValueError):
        m.strict_join(left, frame("other string", ("a",)))


def test_pairs(frame):
    refs = frame("candidate_id string, file_name string", ("b", "rb"), ("a", "ra"))
    models = frame("candidate_id string, file_name string", ("a", "m2"), ("a", "m1"), ("b", "m3"))
    assert rows(m.pair_by_candidate(refs, models)) == [("a", "ra", "m1"), ("b", "rb", "m3")]
    with pytest.raises(ValueError, match="mismatch"):
        m.pair_by_candidate(refs.filter("candidate_id = 'a'"), models)
    with pytest.raises(ValueError, match="duplicate"):
        m.pair_by_candidate(refs.union(refs), models)


def test_inventory_and_sets(frame):
    need, have = frame("id string", ("a",), ("b",)), frame("id string", ("b",), ("c",))
    assert rows(m.inventory(need, have, "id")) == [("a", "missing"), ("b", "valid"), ("c", "unselected")]
    assert rows(m.diff_both(need, have, "id")) == [("a", "left"), ("c", "right")]


def test_file_checks(frame):
    manifest = frame(
        f"candidate_id string, candidate_status string, {FILES}",
        ("ok", "succeeded", [file(volume="app", app="a/ok", size=3)]),
        ("flow", "succeeded", [file(volume="app", flow="w/f", app="a/gone")]),
        ("gone", "succeeded", [file(volume="app", path="a/gone"), file(volume="app", path="x", expected=False)]),
        ("size", "succeeded", [file(volume="app", path="a/ok", size=4)]),
        ("bare", "succeeded", [file(volume="app")]),
        ("unsafe", "succeeded", [file(volume="app", path="../x")]),
        ("mount", "succeeded", [file(volume="other", path="x")]),
        ("none", "succeeded", []),
        ("failed", "failed", []),
    )
    listing = frame("volume_name string, path string, size_bytes bigint", ("app", "a/ok", 3), ("wf", "w/f", 1))
    errors = m.expected_file_errors(manifest, listing, ["app", "wf"], "wf")
    assert rows(errors, "candidate_id", "problem") == [
        ("bare", "no_volume_or_path"),
        ("gone", "missing"),
        ("mount", "volume_not_mounted"),
        ("size", "wrong_size"),
        ("unsafe", "invalid_path"),
    ]
    assert rows(m.reusable_ids(manifest, listing, ["app", "wf"], "wf")) == [("flow",), ("none",), ("ok",)]


def test_new_rows_and_round_trip(spark, frame, tmp_path):
    listing = frame(
        "path string, volume_name string, artifact_id string, file_path string, media_type string, size_bytes bigint",
        ("v/b.pdb", "vol", "art", "b.pdb", None, 2), ("v/a.pdb", "vol", "art", "a.pdb", None, 1),
    )
    made = m.manifest_from_listing(listing)
    assert made.schema.names == MANIFEST.names
    assert rows(made, "candidate_id", "source_path", "summary_json") == [
        ("stage2_input_000001", "v/a.pdb", '{"file_name":"a.pdb"}'),
        ("stage2_input_000002", "v/b.pdb", '{"file_name":"b.pdb"}'),
    ]
    write_table(made, str(tmp_path / "m"))
    back = read_manifest(spark, str(tmp_path / "m"))
    assert rows(back) == rows(made)
    write_table(made.unionByName(made), str(tmp_path / "d"))
    with pytest.raises(ValueError, match="duplicate"):
        read_manifest(spark, str(tmp_path / "d"))
    outcomes = frame("candidate_id string, status string, error string", ("z", "failed", "boom"))
    new = m.manifest_from_outcomes(outcomes, "s", "role", "mode")
    merged = m.merge_rows(made, new)
    assert [r["candidate_id"] for r in merged.collect()] == ["stage2_input_000001", "stage2_input_000002", "z"]
    assert rows(m.pending(merged, made), "candidate_id", "error", "files") == [("z", "boom", [])]


def test_replicates(frame):
    got = m.expand_replicates(frame("f string", ("in/My run.pdb",)), "f", 2, "ns")
    assert rows(got, "run_name", "replicate_run_name") == [
        ("ns-My run", "ns-My run-r001"), ("ns-My run", "ns-My run-r002"),
    ]


def test_fixed_positions(frame):
    structures = frame(
        "candidate_id string, file_name string, source_path string",
        ("a", "x.pdb", None), ("b", "y_model.pdb", None), ("c", "q.pdb", "in/z.pdb"), ("d", "q.pdb", ""),
    )
    lookup = frame("candidate_key string, fixed_positions string", ("a", "A1"), ("y", "B2"), ("z", "C3"), ("d", ""))
    got = m.fixed_positions_for(structures, lookup, "D4")
    assert rows(got, "candidate_id", "fixed_positions") == [("a", "A1"), ("b", "B2"), ("c", "C3"), ("d", "D4")]
    assert m.fixed_positions_for(structures, lookup).count() == 3


def test_job_outcomes(frame):
    jobs = frame("candidate_id string, expected_score_file string", ("a", "a.sc"), ("b", "b.sc"))
    files = frame("path string", ("a.sc",))
    assert rows(m.job_outcomes(jobs, files)) == [("a", "succeeded", None), ("b", "failed", None)]
    assert rows(m.job_outcomes(jobs, files, "died")) == [("a", "failed", "died"), ("b", "failed", "died")]


def test_resolve_tasks(frame):
    tasks = frame("o int, pdb string, script string", (1, "p", "s"), (0, "p", None), (2, "q", "zz"))
    pdbs = frame("k string, v string", ("p", "/p"), ("q", "/q"))
    scripts = frame("k string, v string", ("s", "/s"))
    got = m.resolve_tasks(tasks, ["o"], {"pdb": (pdbs, "k", "v"), "script": (scripts, "k", "v")})
    assert rows(got, "index", "pdb", "script") == [(1, "/p", None), (2, "/p", "/s"), (3, "/q", None)]


def test_quality(frame):
    ids = frame("id string", ("ok-1",), ("dup",), ("dup",), ("bad id",), (None,), ("a" * 241,))
    got = rows(q.unique_safe_ids(ids, "id"), "id", "problem")
    assert got == [(None, "unsafe"), ("a" * 241, "unsafe"), ("bad id", "unsafe"), ("dup", "duplicate")]
    seqs = frame("k int, s string", (1, "ACG"), (2, ""), (3, None), (4, "acg"), (5, "ACGUX" * 2000), (6, "AC\n"))
    assert rows(q.check_alphabet(seqs, "k", "s", "rna")) == [
        (2, "empty"), (3, "empty"), (4, "alphabet"), (5, "too_long"), (6, "alphabet"),
    ]
    names = frame("n string", ("a b",), ("a_@_b",), ("--",), ("fine",))
    assert rows(q.check_names(names, "n")) == [(None, "no_safe_characters", 1), ("a_@_b", "collision", 2)]
    tasks = frame("binary string, script string", ("rosetta_scripts", None), ("relax", None), ("rosetta_scripts", "x"))
    assert rows(q.require_field(tasks, F.col("binary") == "rosetta_scripts", "script", ["binary"])) == [("rosetta_scripts",)]
    assert q.value_counts(tasks, "absent").count() == 0
    with pytest.raises(ValueError):
        q.require_columns(tasks, ["absent"])
