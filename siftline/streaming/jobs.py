"""Streams of logs, submissions, state events, sessions and score files.

Every stateful step is a built-in streaming aggregate: Spark combines a
micro-batch by key before the shuffle, so a hot key costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.functions.keys import redact
from siftline.functions.rules import compile_rules
from siftline.operators.manifests import drop_ids, keep_ids, latest_scores
from siftline.ordering import last_per_key
from siftline.schemas import TERMINAL_STATES
from siftline.session import materialise, new_path


def read_parquet_stream(spark: SparkSession, path: str, schema: T.StructType, **options: str) -> DataFrame:
    return spark.readStream.schema(schema).options(**options).parquet(path)


def drain(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Process what is available, write it as Parquet and read that back."""
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_updates(stream: DataFrame, label: str, keys: Sequence[str]) -> DataFrame:
    """Process what is available in update mode; returns the last row of every key.

    A micro-batch overwrites its own folder, so a repeated batch changes nothing.
    """
    spark = stream.sparkSession
    out, state = new_path(spark, label), new_path(spark, f"{label}-state")

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return last_per_key(spark.read.schema(schema).parquet(out), keys, ["batch"]).drop("batch")


def tail_logs(stream: DataFrame, ts: str, line: str, secret: Column, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Log rows of ``[since, until)`` with the secret removed; no state."""
    if since is not None:
        stream = stream.filter(F.col(ts) >= since)
    if until is not None:
        stream = stream.filter(F.col(ts) < until)
    return stream.withColumn(line, redact(F.col(line), secret))


def first_submissions(stream: DataFrame, keys: Sequence[str], order: Sequence[str], payload: str) -> DataFrame:
    """First submission per key, how many followed, and whether a payload differed.

    Works on a batch or a stream (update mode).
    """
    first = F.min_by(F.struct(*order, payload), F.struct(*order)).alias("_first")
    return (
        stream.groupBy(*keys)
        .agg(
            first,
            F.count("*").alias("submissions"),
            (F.min(payload) != F.max(payload)).alias("conflict"),
        )
        .select(*keys, "_first.*", "submissions", "conflict")
    )


def conflicting_submissions(submissions: DataFrame, first: DataFrame, keys: Sequence[str], payload: str) -> DataFrame:
    """Submissions whose payload differs from the first one under their key.

    Only keys known to conflict are looked at.
    """
    accepted = first.filter("conflict").select(*keys, F.col(payload).alias("_accepted"))
    return submissions.join(accepted, list(keys)).filter(F.col(payload) != F.col("_accepted")).drop("_accepted")


def job_states(
    events: DataFrame,
    key: str,
    state: str,
    order: Sequence[str],
    terminal: Sequence[str] = TERMINAL_STATES,
    sticky: Sequence[str] = ("cancel_requested", "state_unknown"),
) -> DataFrame:
    """Current state per job: the first terminal event, else a sticky one, else the latest event.

    A terminal state is never left, so later events are rejected; ``closed``
    says that it was reached. ``sticky`` states give way to terminal ones and to
    each other (the latest counts) but not to others. Works on a batch or a
    stream (update mode).
    """
    place = F.struct(*order)
    row = F.struct(state, *order)
    grouped = events.groupBy(key).agg(
        F.min_by(row, F.when(F.col(state).isin(*terminal), place)).alias("_end"),
        F.max_by(row, F.when(F.col(state).isin(*sticky), place)).alias("_held"),
        F.max_by(row, place).alias("_last"),
        F.count("*").alias("events"),
    )
    current = F.coalesce("_end", "_held", "_last")
    return grouped.withColumn("_now", current).select(
        key,
        F.col(f"_now.{state}").alias(state),
        *[F.col(f"_now.{c}").alias(c) for c in order],
        F.col("_end").isNotNull().alias("closed"),
        "events",
    )


def rejected_events(events: DataFrame, states: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Events after the job had ended."""
    ends = states.filter("closed").select(key, F.struct(*order).alias("_end"))
    return events.join(ends, key).filter(F.struct(*order) > F.col("_end")).drop("_end")


def session_windows(stream: DataFrame, user: str, ts: str, idle_seconds: int = 30 * 86400, late: str = "1 hour") -> DataFrame:
    """Idle-gap sessions per user, emitted once they are closed.

    An event exactly one idle gap after the last one opens a new session, while
    Spark's windows would still touch; hence the gap is a microsecond shorter.
    ``get_session`` has sessions merged inside each task first, so that a hot user
    does not send all rows to one task.
    """
    micros = idle_seconds * 1_000_000 - 1
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.session_window(ts, f"{micros} microseconds").alias("_w"), user)
        .agg(F.count("*").alias("events"))
        .select(
            user,
            F.col("_w.start").alias("session_start"),
            (F.col("_w.end") + F.expr("INTERVAL 0.000001 SECOND")).alias("idle_expiry"),
            "events",
        )
    )


def cap_sessions(sessions: DataFrame, absolute: str = "90 days") -> DataFrame:
    """Apply the absolute limit to the expiry of a session."""
    limit = F.col("session_start") + F.expr(f"INTERVAL {absolute}")
    return sessions.withColumn("expires_at", F.least("idle_expiry", limit))


def windowed_counts(stream: DataFrame, ts: str, keys: Sequence[str], size: str, late: str, **conditions: Column) -> DataFrame:
    """Rows per tumbling window and key, and per named condition; late rows drop."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, size).alias("_w"), *keys)
        .agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in conditions.items()])
        .select(F.col("_w.start").alias("window_start"), *keys, "n", *conditions)
    )


def incremental_audit(
    scores: DataFrame,
    manifest: DataFrame,
    rules: Mapping[str, object],
    filename_col: str,
    stage: str,
    score_order: Sequence[str],
    path: str,
    checkpoint: str,
) -> DataFrame:
    """Audit the score files that have landed against a static manifest.

    Runs to the end of the available files; calling again with the same folders
    takes up only new files. Returns all audit rows so far, with their batch and
    their place in ``score_order`` (column ``place``); ``latest_audit`` gives the
    row that counts, the one of the last score by that order, however the scores
    were split over files and batches. Candidates without a score are those of
    ``unscored``. The manifest's ids are written once, before the first batch.
    """
    spark = scores.sparkSession
    known = materialise(manifest.select("candidate_id", F.lit(True).alias("_known")), "audit-keys")
    kinds = {f.name: f.dataType for f in scores.schema.fields}
    place = T.StructType([T.StructField(c, kinds[c]) for c in score_order])

    def save(batch: DataFrame, number: int) -> None:
        latest = latest_scores(batch.withColumn("_place", F.struct(*score_order)), [*rules, "_place"], filename_col, score_order, manifest)
        passed = F.when(F.col("_known"), compile_rules(latest, rules))
        joined = latest.join(known, "candidate_id", "left").withColumn("_passed", passed)
        joined.select(
            "candidate_id",
            F.lit(stage).alias("stage_name"),
            F.coalesce("_passed", F.lit(False)).alias("passed"),
            F.when(F.col("_known").isNull(), "missing_manifest")
            .when(F.col("_passed"), "passed")
            .otherwise("filtered")
            .alias("reason"),
            F.col("_place").alias("place"),
        ).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        scores.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType(
        [
            T.StructField("candidate_id", T.StringType()),
            T.StructField("stage_name", T.StringType()),
            T.StructField("passed", T.BooleanType()),
            T.StructField("reason", T.StringType()),
            T.StructField("place", place),
            T.StructField("batch", T.LongType()),
        ]
    )
    return spark.read.schema(schema).parquet(path)


def latest_audit(audit: DataFrame) -> DataFrame:
    """Of each candidate, the audit row of its last score by ``place``; then of the last batch."""
    return last_per_key(audit, ["candidate_id"], ["place", "batch"])


def unscored(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """Manifest rows no score has arrived for."""
    return drop_ids(manifest, audit)


def retained(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """Manifest rows whose audit passed."""
    return keep_ids(manifest, audit.filter("passed"))
