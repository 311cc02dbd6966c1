"""Every registered query: plan shape, SQL pairing, and the skew rules."""

import re
from pathlib import Path

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siftline.plans.registry import ORACLES, QUERIES, Tables

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables are not here")
NAMES = sorted(QUERIES)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_plan(spark, name):
    plan = plan_of(entry.queries()[name](spark, str(DATA)))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        # run_rows is itself a worker in Python
        assert banned not in plan or (name, banned) == ("worker_rows", "MapInPandas"), f"{banned} in {name}"


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["candidate_id", "stage_name", "passed", "reason", "metric_l_extendedprice", "metric_l_discount"]
    assert {r[0] for r in df.select("reason").distinct().collect()} == {"passed", "filtered", "missing_score", "missing_manifest"}


def read_columns(plan, table):
    found = re.findall(rf"FileScan parquet \[([^\]]*)\][^\n]*{table}\.parquet", plan)
    return [{c.split("#")[0] for c in columns.split(",")} for columns in found]


def test_scans_are_pruned_and_filtered(spark):
    q = entry.queries()
    plan = plan_of(q["latest_per_key"](spark, str(DATA)))
    assert read_columns(plan, "events") == [{"event_id", "ts", "user_id", "event_type"}]
    assert "In(event_type" in plan
    plan = plan_of(q["seq_stats"](spark, str(DATA)))
    assert read_columns(plan, "documents") == [{"text", "source"}]
    plan = plan_of(q["status_counts"](spark, str(DATA)))
    assert read_columns(plan, "orders") == [{"o_orderstatus"}]


def test_latest_scores_reduce_before_the_join(spark):
    """The score rows are combined by key below the look-up join."""
    plan = plan_of(entry.queries()["audit_filter"](spark, str(DATA)))
    at_scan = plan.rindex("lineitem.parquet")
    joins = [m.start() for m in re.finditer("Join", plan[:at_scan])]
    assert "partial_max(struct" in plan[joins[-1] : at_scan]


@pytest.mark.parametrize("parts", [1, 8])
def test_results_do_not_depend_on_partitions(spark, parts):
    """One user holds a third of all events; any split gives the same rows."""
    from siftline.operators import runs, series, search
    from siftline.plans import screens

    t = Tables(spark, str(DATA))
    skewed = t.events.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id")))

    def results(events):
        t.__dict__["events"] = events
        calls = events.select(F.col("user_id").alias("node_id"), F.col("event_id").alias("call_id"), F.col("ts").alias("submitted_at"))
        hits = search.parse_hits(screens._hit_lines(t)).select("event_type", "hit_id", "e_value", "score", "event_id")
        return [
            rows(runs.latest_call(calls)),
            rows(series.is_increasing(events, ["user_id"], "event_id", "value")),
            rows(runs.user_sessions(events, idle_seconds=3600)),
            rows(search.merge_top_k(search.join_hits(screens._alignments(t), hits, ["event_id"], ["event_type"]), 9, ["event_type"]), "hit_id", "rank"),
        ]

    assert results(skewed.repartition(parts)) == results(skewed)


@pytest.mark.parametrize("name", ["file_errors", "reusable_candidates", "flat_files", "artifact_selector"])
def test_manifests_gather_their_files_without_a_sort_of_all(spark, monkeypatch, name):
    from siftline import ordering

    monkeypatch.setattr(ordering, "materialise", lambda df, label: pytest.fail(f"{label} is written"))
    assert "rangepartitioning" not in plan_of(QUERIES[name](spark, str(DATA)))
