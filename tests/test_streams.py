import datetime as d

import pytest
from conftest import rows
from pyspark.sql import functions as F

from siftline.streaming import jobs as j


@pytest.fixture
def stream(spark, tmp_path):
    """Write frames as successive files; return a stream that reads one per batch."""

    def build(*frames):
        for i, df in enumerate(frames):
            df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return j.read_parquet_stream(spark, str(tmp_path / "in"), frames[0].schema, maxFilesPerTrigger="1")

    return build


def at(minute, day=1):
    return d.datetime(2024, 1, day, 0, minute)


def test_tail(frame, stream):
    logs = frame("ts timestamp, line string", (at(0), "id fc-9"), (at(5), "fc-9 fc-9"), (at(9), "x"))
    tail = j.tail_logs(stream(logs), "ts", "line", F.lit("fc-9"), F.lit(at(1)), F.lit(at(9)))
    assert rows(j.drain(tail, "t"), "line") == [("[function-call-id-redacted] [function-call-id-redacted]",)]


def test_submissions(frame, stream):
    s = "o string, k string, n int, hash string"
    a, b = frame(s, ("u", "1", 2, "h2"), ("u", "2", 1, "x")), frame(s, ("u", "1", 1, "h1"), ("u", "1", 3, "h1"), ("u", "2", 4, "x"))
    got = j.drain_updates(j.first_submissions(stream(a, b), ["o", "k"], ["n"], "hash"), "s", ["o", "k"])
    assert rows(got) == [("u", "1", 1, "h1", 3, True), ("u", "2", 1, "x", 2, False)]
    bad = j.conflicting_submissions(a.unionByName(b), got, ["o", "k"], "hash")
    assert rows(bad, "n") == [(2,)]


def test_states(frame, stream):
    s = "job string, n int, state string"
    a = frame(s, ("a", 1, "queued"), ("a", 3, "succeeded"), ("b", 1, "queued"))
    b = frame(s, ("a", 2, "running"), ("a", 4, "running"), ("a", 5, "failed"), ("b", 2, "running"))
    got = j.drain_updates(j.job_states(stream(a, b), "job", "state", ["n"]), "st", ["job"])
    assert rows(got) == [("a", "succeeded", 3, True, 5), ("b", "running", 2, False, 2)]
    batch = j.job_states(a.unionByName(b), "job", "state", ["n"])
    assert rows(batch) == rows(got)
    assert rows(j.rejected_events(a.unionByName(b), batch, "job", ["n"]), "n") == [(4,), (5,)]


def test_sticky_states_give_way_to_ends_only(frame):
    s = "job string, state string, n int"
    events = frame(s, ("a", "cancel_requested", 1), ("a", "running", 2), ("b", "state_unknown", 1), ("b", "running", 2), ("b", "failed", 3), ("c", "running", 1))
    assert rows(j.job_states(events, "job", "state", ["n"]), "job", "state", "closed") == [
        ("a", "cancel_requested", False), ("b", "failed", True), ("c", "running", False),
    ]


def test_windowed_counts_drop_late_rows(frame, stream):
    s = "ts timestamp, k string, bad boolean"
    first = frame(s, (at(1), "a", True), (at(2), "a", False), (at(31), "a", False))
    # rows are late against the watermark of the batch before
    middle, late = frame(s, (at(32), "a", False)), frame(s, (at(3), "a", False), (at(59), "a", True))
    got = j.drain(j.windowed_counts(stream(first, middle, late), "ts", ["k"], "10 minutes", "5 minutes", bad=F.col("bad")), "w")
    assert rows(got) == [(at(0), "a", 2, 1), (at(30), "a", 2, 0)]


def test_sessions(frame, stream):
    s = "ts timestamp, u string"
    events = frame(s, (at(0), "a"), (at(5), "a"), (at(30), "a"), (at(0, 2), "a"))
    closed = j.drain(j.session_windows(stream(events, frame(s, (at(0, 5), "b"))), "u", "ts", 600, "1 minute"), "se")
    assert rows(j.cap_sessions(closed, "12 minutes")) == [
        ("a", at(0), at(15), 2, at(12)), ("a", at(30), at(40), 1, at(40)), ("a", at(0, 2), at(10, 2), 1, at(10, 2)),
    ]


def test_incremental_audit(spark, frame, tmp_path):
    manifest = frame("candidate_id string, source_path string", ("A", "in/a.pdb"), ("B", "in/b.pdb"), ("C", "in/c.pdb"))
    s = "filename string, iptm string, n int"
    folder = str(tmp_path / "scores")
    out, state = str(tmp_path / "audit"), str(tmp_path / "state")

    def land(*data):
        frame(s, *data).coalesce(1).write.mode("append").parquet(folder)
        scores = j.read_parquet_stream(spark, folder, spark.read.parquet(folder).schema)
        return j.incremental_audit(scores, manifest, {"iptm": "> 0.7"}, "filename", "s", ["n"], out, state)

    audit = land(("a_model.cif", "0.1", 0), ("a.pdb", "0.9", 1), ("x.pdb", "junk", 0))
    assert rows(audit, "candidate_id", "reason") == [("A", "passed"), ("x", "missing_manifest")]
    audit = land(("b.pdb", "0.5", 0), ("a.pdb", "0.2", 5))
    latest = j.latest_audit(audit)
    assert rows(latest, "candidate_id", "reason") == [("A", "filtered"), ("B", "filtered"), ("x", "missing_manifest")]
    assert rows(j.unscored(manifest, audit), "candidate_id") == [("C",)]
    assert j.retained(manifest, latest).count() == 0
    # a score that is earlier in the order does not count, however late it lands
    audit = land(("a.pdb", "0.9", 4), ("b.pdb", "0.9", -1))
    assert rows(j.latest_audit(audit), "candidate_id", "reason") == [("A", "filtered"), ("B", "filtered"), ("x", "missing_manifest")]
