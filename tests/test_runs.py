import datetime as d

import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import graph as g
from siftline.operators import runs as r
from siftline.operators.workers import run_chunks, run_rows


def test_status_folds(frame):
    df = frame("k string, s string", ("a", "succeeded"), ("a", "succeeded"), ("b", "succeeded"), ("b", "failed"), ("c", "failed"))
    got = r.stage_status(df, ["k"], F.col("s") == "succeeded")
    assert rows(got, "k", "status") == [("a", "succeeded"), ("b", "partial"), ("c", "failed")]
    counts = frame("req int, use int, fail int", (0, 0, 0), (2, 2, 0), (2, 2, 1), (2, 1, 0), (2, 0, 2))
    status = r.fold_status(F.col("req"), F.col("use"), F.col("fail"))
    assert [x[0] for x in counts.select(status).collect()] == ["failed", "succeeded", "partial", "partial", "failed"]
    dock = frame("returncode string, dockq string", ("0", "0.5"), ("0", ""), ("1", "0.5"), ("0", None))
    assert r.usable_rows(dock).count() == 1


def test_completion(frame):
    expected = frame("input_id string, file string", ("a", "x"), ("a", "y"), ("b", "x"))
    seen = frame("input_id string, file string", ("a", "x"), ("a", "x"), ("b", "x"), ("c", "x"))
    assert rows(r.completion(expected, seen, "input_id", "file")) == [("a", 2, 1, False), ("b", 1, 1, True)]


def test_active_counts(frame):
    jobs = frame("owner_user_id string, workload string, state string", ("u1", "md", "running"), ("u1", "fold", "queued"), ("u2", "md", "state_unknown"), ("u2", "md", "succeeded"), ("u3", "md", "blocked"))
    limits = frame("scope string, name string, limit bigint", ("user", None, 2), ("user", "u2", 5), ("workload", "md", 2), ("global", None, 10))
    assert rows(r.active_counts(jobs, limits)) == [
        ("global", None, 3, 10, False), ("user", "u1", 2, 2, True), ("user", "u2", 1, 5, False),
        ("workload", "fold", 1, None, None), ("workload", "md", 2, 2, True),
    ]


def test_blocked_and_usage(frame):
    jobs = frame("state string, blocking_category string, blocked_at int", ("blocked", "quota", 5), ("blocked", "quota", 3), ("blocked", None, 1), ("running", "quota", 1))
    assert rows(r.blocked_summary(jobs)) == [("quota", 2, 3)]
    files = frame("size int, kind string", (5, "a"), (None, "a"), (7, "b"))
    assert rows(r.usage(files, "size", b=F.col("kind") == "b")) == [(2, 12, 1, 7)]
    assert rows(r.usage(files.limit(0), "size")) == [(0, 0)]


def test_nest_children(frame):
    jobs = frame("job_id string", ("a",), ("b",))
    ops = frame("job_id string, ordinal int, op string", ("a", 2, "two"), ("a", 0, "zero"), ("a", 1, "one"))
    got = r.nest_children(jobs, ops, "job_id", "ordinal", F.col("op"))
    assert rows(got) == [("a", 0, ["zero", "one", "two"]), ("b", 0, [])]
    paged = r.nest_children(jobs, ops, "job_id", "ordinal", F.col("op"), block=2)
    assert rows(paged) == [("a", 0, ["zero", "one"]), ("a", 1, ["two"]), ("b", 0, [])]


def test_latest_call(frame):
    calls = frame("node_id string, call_id string, status string, submitted_at int", ("n", "a", "ok", 1), ("n", "b", "ok", 2), ("n", "c", "bad", 2))
    assert rows(r.latest_call(calls), "call_id") == [("c",)]
    assert rows(r.latest_call(calls, statuses=["ok"]), "call_id") == [("b",)]
    assert r.latest_call(calls, statuses=[]).count() == 0


def test_current_stage(frame):
    jobs = frame("job_id string, state string", ("open", "running"), ("fail", "failed"), ("fail2", "failed"), ("stop", "cancelled"), ("done", "succeeded"), ("new", "queued"))
    stages = frame(
        "job_id string, operation string, ordinal int, completed_at int, outcome string",
        ("open", "a", 0, None, None), ("open", "b", 1, 5, "done"), ("fail", "a", 0, 1, "failed"), ("fail", "b", 1, 2, "done"),
        ("fail2", "a", 0, 1, "done"), ("stop", "a", 0, 1, "cancelled"), ("stop", "b", 1, 1, "done"), ("done", "a", 0, 1, "failed"), ("done", "b", 1, 2, "done"),
    )
    assert rows(r.current_stage(jobs, stages), "job_id", "operation") == [
        ("done", "b"), ("fail", "a"), ("fail2", "a"), ("new", None), ("open", "a"), ("stop", "a"),
    ]


def test_lists(frame):
    jobs = frame(
        "job_id string, workload string, state string, created_at int, completed_at int, run_name string, intermediates_cleaned_at int",
        ("a", "md", "succeeded", 1, 5, "r", None), ("b", "md", "partial", 2, 9, "r", None), ("c", "md", "failed", 3, 1, "r", None),
        ("d", "md", "succeeded", 4, 1, None, None), ("e", "md", "succeeded", 5, 1, "r", 3), ("f", "x", "succeeded", 6, 1, "r", None),
    )
    assert rows(r.retention(jobs, "md", F.lit(5)), "job_id") == [("a",)]
    assert [x["job_id"] for x in r.in_states(jobs, ["succeeded", "partial"], "md").collect()] == ["a", "b", "d", "e"]


def test_selector(frame):
    t = "artifact_id string, producing_node_id string, kind string, metadata map<string,string>, files array<struct<path string, role string>>"
    df = frame(
        t,
        ("1", "n", "table", {"s": "x"}, [("a.csv", "score"), ("b.txt", "log")]),
        ("2", "n", "table", {}, [("a.csv", "log"), ("b.txt", "score")]),
        ("3", "n", "dir", None, []),
        ("4", "other", "table", {"s": "x"}, [("a.csv", "score")]),
    )
    assert rows(r.select_artifacts(df, "n"), "artifact_id") == [("1",), ("2",), ("3",)]
    assert rows(r.select_artifacts(df, "n", glob="*.csv", role="score"), "artifact_id") == [("1",)]
    assert rows(r.select_artifacts(df, "n", glob="[ab].*"), "artifact_id") == [("1",), ("2",)]
    assert rows(r.select_artifacts(df, "n", metadata={"s": "x"}), "artifact_id") == [("1",)]


def test_windows(frame):
    at = lambda m, s=0: d.datetime(2024, 1, 1, 10, m, s)
    df = frame(
        "i int, since timestamp_ntz, until timestamp_ntz, started timestamp_ntz, ended timestamp_ntz",
        (1, at(0), at(10), at(2), at(8)), (2, at(0), at(1), at(2), at(8)), (3, at(0), at(16), at(2), None),
        (4, at(5), at(5), at(2), at(8)), (5, at(5), None, at(2), at(8)), (6, None, None, at(2), at(8)), (7, at(4), at(9), at(2), None),
    )
    got = r.clamp_window(df, "since", "until", "started", "ended", F.lit(at(6)).cast("timestamp_ntz"))
    assert rows(got, "i", "problem", "bounded_since", "bounded_until") == [
        (1, None, at(1, 59), at(8, 1)), (2, "outside", None, None), (3, "too_long", None, None), (4, "invalid", None, None),
        (5, "incomplete", None, None), (6, None, None, None), (7, None, at(4), at(6, 1)),
    ]


def test_sessions_like_spark(spark):
    """Sparse, dense and exactly one gap apart: a gap of 1800 s ends a session."""
    ev = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).alias("u"),
        F.timestamp_seconds(F.abs(F.xxhash64("id")) % 400_000).alias("ts"),
    )
    edge = spark.createDataFrame([(99, 0), (99, 1800), (99, 3599), (99, 5398)], "u bigint, s bigint")
    ev = ev.unionByName(edge.select("u", F.timestamp_seconds("s").alias("ts")))
    want = ev.groupBy("u", F.session_window("ts", "1799999999 microseconds")).agg(F.count("*").alias("n"), F.min("ts"), F.max("ts"))
    got = r.user_sessions(ev, "u", "ts", 1800, 10**9)
    assert rows(got, "u", "session_start", "last_seen", "events") == rows(want, "u", "min(ts)", "max(ts)", "n")


def test_run_counts(frame):
    a, b = frame("run string", ("x",), ("x",), ("y",)), frame("run string", ("x",))
    assert rows(r.run_counts(a, b, "run")) == [("x", 2, 1), ("y", 1, 0)]


@pytest.fixture
def dag(frame):
    edges = [("c", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("b", "a")]
    return frame("node string", *[(n,) for n in "abcde"]), frame("node string, dependency string", *edges)


def test_ready_and_done(frame, dag):
    nodes, edges = dag
    done = frame("node string", ("a",), ("b",))
    known = frame("node string", ("a",), ("b",), ("e",))
    assert rows(g.ready_steps(nodes, edges, known, done)) == [("c",)]
    assert rows(g.ready_steps(nodes, edges, done.limit(0), done.limit(0))) == [("a",)]
    assert rows(g.all_done(nodes, done)) == [(False, 3)]
    assert rows(g.all_done(done, done)) == [(True, 0)]


def test_ancestors(frame, dag):
    nodes, edges = dag
    none = frame("node string", ("zzz",))
    assert rows(g.terminal_nodes(nodes, edges)) == [("d",), ("e",)]
    assert rows(g.ancestors(nodes, edges, none)) == [(n,) for n in "abcde"]
    assert rows(g.ancestors(nodes, edges, frame("node string", ("c",), ("e",)))) == [("c",), ("d",), ("e",)]
    assert rows(g.ancestors(nodes, edges, frame("node string", ("d",), ("b",)))) == [("b",), ("d",), ("e",)]


def test_bad_edges(frame, dag):
    nodes, edges = dag
    assert g.bad_edges(nodes, edges).count() == 0
    more = edges.unionByName(frame("node string, dependency string", ("a", "d"), ("e", "ghost"), ("e", "e")))
    assert rows(g.bad_edges(nodes, more)) == [("a", "cycle"), ("b", "cycle"), ("c", "cycle"), ("d", "cycle"), ("e", "cycle"), ("ghost", "unknown")]
    loop = edges.unionByName(frame("node string, dependency string", ("a", "b")))
    assert rows(g.cyclic_nodes(nodes, loop)) == [("a",), ("b",)]


def test_lineage(spark, frame):
    chain = spark.range(200).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("up"))
    star = spark.range(1000, 1300).select("id", F.when(F.col("id") > 1000, F.lit(1000)).alias("up"))
    got = g.lineage(chain.unionByName(star), "id", "up").collect()
    assert {r["node"]: (r["root"], r["depth"]) for r in got} == (
        {i: (0, i) for i in range(200)} | {i: (1000, min(i - 1000, 1)) for i in range(1000, 1300)}
    )
    odd = frame("id string, up string", ("a", "b"), ("b", "a"), ("c", "a"), ("d", "gone"), ("e", "d"))
    assert rows(g.lineage(odd, "id", "up")) == [("a", None, None), ("b", None, None), ("c", None, None), ("d", "d", 0), ("e", "d", 1)]


def test_outputs(frame):
    nodes = frame("node string, status string", ("a", "succeeded"), ("b", "succeeded"), ("c", "failed"), ("d", "succeeded"), ("e", None))
    outputs = frame("node string, artifact_id string", ("a", "1"), ("b", "1"), ("b", "2"), ("c", "1"))
    assert rows(g.outputs_complete(nodes, outputs, frame("artifact_id string", ("1",)))) == [
        ("a", True), ("b", False), ("c", False), ("d", True), ("e", False),
    ]


def test_workers(frame):
    df = frame("candidate_id string, x int", ("a", 4), ("b", 0), ("c", 2))

    def work(row):
        return {"y": 8 // row["x"]}

    got = run_rows(df, work, outputs=T.StructType([T.StructField("y", T.IntegerType())]))
    assert rows(got, "candidate_id", "status", "y") == [("a", "succeeded", 2), ("b", "failed", None), ("c", "succeeded", 4)]
    assert "zero" in rows(got.filter("status = 'failed'"), "error")[0][0]


def test_chunk_workers(spark):
    def work(chunk: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": [len(chunk)], "first": [chunk["id"].iloc[0]]})

    got = run_chunks(spark.range(10), [F.desc("id")], 4, work, "n bigint, first bigint")
    assert rows(got) == [(2, 1), (4, 5), (4, 9)]
