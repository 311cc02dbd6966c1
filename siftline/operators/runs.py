"""Questions over run and job ledgers."""

from __future__ import annotations

import fnmatch
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.ordering import last_per_key, ordered_groups
from siftline.schemas import ACTIVE_STATES


def fold_status(requested: Column, usable: Column, failed: Column | None = None) -> Column:
    """succeeded, partial or failed from counts."""
    clean = F.lit(True) if failed is None else failed == 0
    return (
        F.when(requested < 1, "failed")
        .when((usable >= requested) & clean, "succeeded")
        .when(usable > 0, "partial")
        .otherwise("failed")
    )


def stage_status(df: DataFrame, by: Sequence[str], succeeded: Column) -> DataFrame:
    """Status of each group of outcomes."""
    n, good = F.count("*"), F.count_if(succeeded)
    return df.groupBy(*by).agg(
        n.alias("requested"), good.alias("usable"), fold_status(n, good).alias("status")
    )


def usable_rows(df: DataFrame, code: str = "returncode", score: str = "dockq") -> DataFrame:
    """Rows that ended well and have a score; both columns are text."""
    return df.filter((F.col(code) == "0") & (F.col(score) != ""))


def completion(expected: DataFrame, observed: DataFrame, key: str, file: str) -> DataFrame:
    """Per input: are all required files there?"""
    seen = observed.select(key, file).distinct().withColumn("_seen", F.lit(True))
    joined = expected.select(key, file).join(seen, [key, file], "left")
    return joined.groupBy(key).agg(
        F.count("*").alias("required"),
        F.count("_seen").alias("present"),
        F.bool_and(F.col("_seen").isNotNull()).alias("completed"),
    )


def active_counts(
    jobs: DataFrame, limits: DataFrame | None = None, user: str = "owner_user_id", workload: str = "workload", state: str = "state"
) -> DataFrame:
    """Active jobs per user, per workload and overall: (scope, name, active[, limit, reached]).

    ``limits`` is (scope, name, limit); a null name is the default of its scope.
    """
    active = jobs.filter(F.col(state).isin(*ACTIVE_STATES)).select(
        F.col(user).cast("string").alias("_user"), F.col(workload).cast("string").alias("_workload")
    )
    counts = active.groupingSets([["_user"], ["_workload"], []], "_user", "_workload").agg(
        F.count("*").alias("active"), F.grouping_id().alias("_id")
    )
    # grouping_id has one bit per column that is aggregated away
    out = counts.select(
        F.when(F.col("_id") == 1, "user").when(F.col("_id") == 2, "workload").otherwise("global").alias("scope"),
        F.when(F.col("_id") == 1, F.col("_user")).when(F.col("_id") == 2, F.col("_workload")).alias("name"),
        "active",
    )
    if limits is None:
        return out
    named = limits.filter("name is not null").select("scope", "name", F.col("limit").alias("_own"))
    default = limits.filter("name is null").select("scope", F.col("limit").alias("_default"))
    joined = out.join(named, ["scope", "name"], "left").join(default, "scope", "left")
    return joined.select(
        "scope", "name", "active", F.coalesce("_own", "_default").alias("limit")
    ).withColumn("reached", F.col("active") >= F.col("limit"))


def blocked_summary(
    jobs: DataFrame, category: str = "blocking_category", since: str = "blocked_at", state: str = "state"
) -> DataFrame:
    """Blocked jobs per category: count and oldest time."""
    blocked = jobs.filter(
        (F.col(state) == "blocked") & F.col(category).isNotNull() & F.col(since).isNotNull()
    )
    return blocked.groupBy(F.col(category).alias("category")).agg(
        F.count("*").alias("n"), F.min(since).alias("oldest")
    )


def usage(df: DataFrame, size: str, **splits: Column) -> DataFrame:
    """Entries and bytes, overall and for each named condition, in one row."""
    out = []
    for name, wanted in {"total": F.lit(True), **splits}.items():
        keep = wanted & F.col(size).isNotNull()
        out.append(F.count_if(keep).alias(f"{name}_entries"))
        out.append(F.coalesce(F.sum(F.when(keep, F.col(size))), F.lit(0)).alias(f"{name}_bytes"))
    return df.agg(*out)


def nest_children(
    parents: DataFrame, children: DataFrame, key: str, order: str, item: Column, name: str = "children", **sizes: int
) -> DataFrame:
    """Parents with their ordered children: (parent columns, segment, children).

    A parent without children has an empty array in segment 0; children stand in
    segments of ``block``, from 0.
    """
    grouped = ordered_groups(children, [key], [order], item, **sizes).withColumnRenamed("items", name)
    kind = grouped.schema[name].dataType
    return parents.join(grouped, key, "left").select(
        *parents.columns,
        F.coalesce("segment", F.lit(0)).cast("bigint").alias("segment"),
        F.coalesce(F.col(name), F.array().cast(kind)).alias(name),
    )


def latest_call(
    calls: DataFrame, key: str = "node_id", order: Sequence[str] = ("submitted_at", "call_id"), statuses: Sequence[str] | None = None
) -> DataFrame:
    """Latest call of each node, optionally among some statuses."""
    if statuses is not None:
        calls = calls.filter(F.col("status").isin(*statuses)) if statuses else calls.limit(0)
    return last_per_key(calls, [key], order)


def current_stage(
    jobs: DataFrame,
    stages: DataFrame,
    key: str = "job_id",
    order: str = "ordinal",
    done: str = "completed_at",
    outcome: str = "outcome",
    state: str = "state",
) -> DataFrame:
    """Stage to show for each job: (key, state, stage columns).

    The last open stage; else, for a failed or cancelled job, the last stage
    with that outcome; else the last stage. All four candidates of a job come
    from one aggregate over its stages.
    """
    columns = [c for c in stages.columns if c != key]
    row = F.struct(*columns)
    picks = {
        "_open": F.col(done).isNull(),
        "_failed": F.col(outcome) == "failed",
        "_cancelled": F.col(outcome) == "cancelled",
        "_last": F.lit(True),
    }
    best = stages.groupBy(key).agg(
        *[F.max_by(row, F.when(cond, F.col(order))).alias(n) for n, cond in picks.items()]
    )
    joined = jobs.select(key, state).join(best, key, "left")
    chosen = F.coalesce(
        F.col("_open"),
        F.when(F.col(state) == "failed", F.col("_failed")),
        F.when(F.col(state) == "cancelled", F.col("_cancelled")),
        F.col("_last"),
    )
    return joined.withColumn("_s", chosen).select(key, state, *[F.col(f"_s.{c}").alias(c) for c in columns])


def in_states(
    jobs: DataFrame, states: Sequence[str], workload: str | None = None, order: Sequence[str] = ("created_at", "job_id")
) -> DataFrame:
    """Jobs in some states, optionally of one workload, in order."""
    kept = jobs.filter(F.col("state").isin(*states))
    if workload is not None:
        kept = kept.filter(F.col("workload") == workload)
    return kept.orderBy(*order)


def retention(jobs: DataFrame, workload: str, before: Column) -> DataFrame:
    """Finished runs of a workload whose intermediate files may be removed."""
    return jobs.filter(
        (F.col("workload") == workload)
        & F.col("state").isin("succeeded", "partial")
        & (F.col("completed_at") <= before)
        & F.col("run_name").isNotNull()
        & F.col("intermediates_cleaned_at").isNull()
    ).orderBy("completed_at", "job_id")


def glob_pattern(glob: str) -> str:
    """Regular expression of a shell pattern, for ``rlike``."""
    return r"\A" + fnmatch.translate(glob).replace(r"\Z", r"\z")


def select_artifacts(
    df: DataFrame,
    producer: str,
    kind: str | None = None,
    glob: str | None = None,
    role: str | None = None,
    metadata: Mapping[str, str] | None = None,
) -> DataFrame:
    """Artifacts of a producer; path pattern and role must match on the same file."""
    keep = F.col("producing_node_id") == producer
    if kind is not None:
        keep = keep & (F.col("kind") == kind)
    for name, value in (metadata or {}).items():
        keep = keep & (F.try_element_at(F.col("metadata"), F.lit(name)) == value)
    if glob is not None or role is not None:
        pattern = glob_pattern(glob) if glob is not None else None

        def match(f: Column) -> Column:
            ok = F.lit(True)
            if pattern is not None:
                ok = ok & f["path"].rlike(pattern)
            if role is not None:
                ok = ok & (f["role"] == role)
            return F.coalesce(ok, F.lit(False))

        keep = keep & F.exists("files", match)
    return df.filter(keep)


def clamp_window(
    df: DataFrame, since: str, until: str, started: str, ended: str, now: Column, max_minutes: int = 15
) -> DataFrame:
    """Requested log window cut to the stage, one second wider on both sides.

    Adds bounded_since, bounded_until and problem: ``incomplete``, ``invalid``,
    ``too_long`` or ``outside``; the bounds are null unless the window is usable.
    """
    second = F.expr("INTERVAL 1 SECOND")
    low = F.greatest(F.col(since), F.col(started) - second)
    high = F.least(F.col(until), F.coalesce(F.col(ended), now) + second)
    problem = (
        F.when(F.col(since).isNull() & F.col(until).isNull(), F.lit(None).cast("string"))
        .when(F.col(since).isNull() | F.col(until).isNull(), "incomplete")
        .when(F.col(since) >= F.col(until), "invalid")
        .when(F.col(until) > F.col(since) + F.expr(f"INTERVAL {max_minutes} MINUTES"), "too_long")
        .when(low >= high, "outside")
    )
    asked = F.col(since).isNotNull() & F.col(until).isNotNull()
    return df.withColumn("problem", problem).withColumns(
        {
            "bounded_since": F.when(asked & F.col("problem").isNull(), low),
            "bounded_until": F.when(asked & F.col("problem").isNull(), high),
        }
    )


def run_counts(all_rows: DataFrame, accepted: DataFrame, by: str) -> DataFrame:
    """Trajectories and accepted designs per run; a run without any has 0."""
    sides = all_rows.select(by, F.lit(1).alias("_all"), F.lit(0).alias("_ok")).unionByName(
        accepted.select(by, F.lit(0).alias("_all"), F.lit(1).alias("_ok"))
    )
    return sides.groupBy(by).agg(
        F.sum("_all").alias("total_trajectories"), F.sum("_ok").alias("passing_designs")
    )


def user_sessions(
    df: DataFrame, user: str = "user_id", ts: str = "ts", idle_seconds: int = 30 * 86400, absolute_seconds: int = 90 * 86400
) -> DataFrame:
    """Sessions per user, closed by an idle gap, and when each expires.

    Events within one slot of the idle length always share a session, so they
    are first reduced to a row per (user, slot). Only slots reach the window,
    and their number is set by the time span, not by the number of events.
    """
    from pyspark.sql import Window

    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = idle_seconds * 1_000_000
    slots = (
        df.select(F.col(user), micros.alias("_t"))
        .groupBy(user, F.floor(F.col("_t") / F.lit(gap)).alias("_slot"))
        .agg(F.min("_t").alias("_from"), F.max("_t").alias("_to"), F.count("*").alias("_n"))
    )
    line = Window.partitionBy(user).orderBy("_slot")
    fresh = F.col("_from") - F.lag("_to").over(line) >= gap
    numbered = slots.withColumn("_fresh", F.coalesce(fresh, F.lit(True)).cast("int")).withColumn(
        "_session", F.sum("_fresh").over(line.rowsBetween(Window.unboundedPreceding, 0))
    )
    grouped = numbered.groupBy(user, "_session").agg(
        F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.sum("_n").alias("events")
    )
    expiry = F.least(F.col("_to") + gap, F.col("_from") + absolute_seconds * 1_000_000)
    return grouped.select(
        user,
        F.timestamp_micros("_from").alias("session_start"),
        F.timestamp_micros("_to").alias("last_seen"),
        F.timestamp_micros(expiry).alias("expires_at"),
        "events",
    )
