"""Job states, submissions, sessions and log tails as streams whose state ends.

Keyed steps replay each key's events in order (``replay``); what follows them in
the same query is built in. Every function takes streaming DataFrames and gives
one for append mode, to be started inside ``replay.rocks_state``; ``run`` does that.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.schemas import NEXT_STATES, TERMINAL_STATES
from siftline.session import new_path
from siftline.streaming import replay

_SECOND = 1_000_000
_BUCKETS = 4096
ACCEPTED, REJECTED, REPEATED, CONFLICT = "accepted", "rejected", "repeated", "conflict"


def run(stream: DataFrame, path: str, state: str) -> DataFrame:
    """Process what is available into Parquet files in ``path``; calling again goes on from there."""
    spark = stream.sparkSession
    with replay.rocks_state(spark):
        query = (
            stream.writeStream.outputMode("append")
            .format("parquet")
            .option("path", path)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def drain(stream: DataFrame, label: str) -> DataFrame:
    spark = stream.sparkSession
    return run(stream, new_path(spark, label), new_path(spark, f"{label}-state"))


def job_transitions(
    stream: DataFrame,
    key: str,
    ts: str,
    order: str,
    state: str,
    late: str,
    kept_seconds: int,
    quiet_seconds: int,
    legal: Mapping[str | None, Sequence[str]] = NEXT_STATES,
    terminal: Sequence[str] = TERMINAL_STATES,
) -> DataFrame:
    """Every event with the state before and after it, ``accepted`` or ``rejected``.

    Events of a job are taken by ``ts``, then by ``order``. An event is accepted if
    its state may follow the current one by ``legal``; else the state stays. A
    job is forgotten ``kept_seconds`` after it ended, and ``quiet_seconds`` after
    its last accepted event if it has not; a later event finds no job, so that
    only a first state is accepted. Events come out once the watermark has passed
    them. A null state is never accepted.
    """
    following = {k: frozenset(v) for k, v in legal.items()}
    ends = frozenset(terminal)

    def step(current: tuple | None, at: int, row: tuple) -> tuple:
        place, wanted = row
        before = current[0] if current else None
        if wanted is not None and wanted in following.get(before, ()):
            return (wanted, at), [(at, place, wanted, before, wanted, ACCEPTED)]
        return current, [(at, place, wanted, before, before, REJECTED)]

    def until(current: tuple) -> int:
        return current[1] + (kept_seconds if current[0] in ends else quiet_seconds) * _SECOND

    kind = stream.schema[order].dataType.simpleString()
    out = f"{ts} timestamp, {order} {kind}, {state} string, before string, after string, outcome string"
    return replay.in_order(stream, [key], ts, [order, state], late, step, "state string, at bigint", out, until, event_time=ts)


def submissions(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: str,
    payload: str,
    late: str,
    held_seconds: int,
    unique: Sequence[str] = (),
    buckets: int = _BUCKETS,
) -> DataFrame:
    """Every submission as ``accepted``, ``repeated`` or ``conflict``, with the one it was held against.

    The first under a key by ``ts``, then by ``order``, is accepted and holds the key
    for ``held_seconds``; another with the same payload repeats it, one with another
    payload is a conflict. A submission at or after that time is accepted anew.
    Rows delivered more than once, equal in ``unique``, are first reduced to one
    within the watermark. Rows behind the watermark are dropped. The states of
    keys are kept in ``buckets`` (``replay.in_order``; 0: each by itself).
    """
    stream = stream.withWatermark(ts, late)
    if unique:
        stream = stream.dropDuplicatesWithinWatermark(list(unique))

    def step(held: tuple | None, at: int, row: tuple) -> tuple:
        place, content = row
        if held is None:
            return (place, content, at), [(at, place, content, place, ACCEPTED)]
        return held, [(at, place, content, held[0], REPEATED if held[1] == content else CONFLICT)]

    kinds = {c: stream.schema[c].dataType.simpleString() for c in (order, payload)}
    state = f"place {kinds[order]}, content {kinds[payload]}, at bigint"
    out = f"{ts} timestamp, {order} {kinds[order]}, {payload} {kinds[payload]}, held_by {kinds[order]}, outcome string"

    def until(held: tuple) -> int:
        return held[2] + held_seconds * _SECOND

    return replay.in_order(stream, keys, ts, [order, payload], None, step, state, out, until, event_time=ts, buckets=buckets)


def sessions(stream: DataFrame, user: str, ts: str, late: str, idle_seconds: int, absolute_seconds: int) -> DataFrame:
    """Sessions of each user, once they are over: start, last event, end and events.

    A session ends ``idle_seconds`` after its last event or ``absolute_seconds`` after
    its start, whichever is first; an event at or after that time opens a new one.
    ``operators.sessions.split_sessions`` is the same for a table.
    """

    def step(held: tuple | None, at: int, row: tuple) -> tuple:
        return ((at, at, 1) if held is None else (held[0], at, held[2] + 1)), []

    def until(held: tuple) -> int:
        return min(held[1] + idle_seconds * _SECOND, held[0] + absolute_seconds * _SECOND)

    def close(held: tuple) -> list[tuple]:
        return [(held[0], held[1], until(held), held[2])]

    out = "session_start timestamp, last_seen timestamp, expires_at timestamp, events bigint"
    return replay.in_order(stream, [user], ts, [], late, step, "start bigint, last bigint, events bigint", out, until, close)


def state_attrition(transitions: DataFrame, ts: str, size: str) -> DataFrame:
    """Of the stream of ``job_transitions``: changes into each state and rejected events per window."""
    return (
        transitions.groupBy(F.window(ts, size).alias("w"), "after")
        .agg(
            F.count_if(F.col("outcome") == ACCEPTED).alias("accepted"),
            F.count_if((F.col("outcome") == ACCEPTED) & ~F.col("after").eqNullSafe(F.col("before"))).alias("changes"),
            F.count_if(F.col("outcome") == REJECTED).alias("rejected"),
        )
        .select(F.col("w.start").alias("window_start"), "after", "accepted", "changes", "rejected")
    )


def stage_tail(
    logs: DataFrame,
    stages: DataFrame,
    key: str,
    ts: str,
    started: str,
    ended: str,
    late: str,
    late_stages: str,
    longest: str,
    margin: str = "1 second",
) -> DataFrame:
    """Log rows with the stage of the same job in whose bounds they lie, ``margin`` wider on both sides.

    Both are streams. A row in no stage comes out with nulls, once no stage that
    could hold it can arrive any more; one in several stages comes out with each.
    A stage row may arrive as late as ``late_stages`` behind the newest start, so
    that finished stages can be sent; stages are cut at ``longest``, which bounds
    how long they are held. Log rows behind the watermark are dropped.
    """
    left = logs.withWatermark(ts, late).withColumnRenamed(key, "_key")
    right = stages.withWatermark(started, late_stages)
    low = F.col(started) - F.expr(f"INTERVAL {margin}")
    most = F.col(started) + F.expr(f"INTERVAL {longest}") + F.expr(f"INTERVAL {margin}")
    inside = (F.col(ts) >= low) & (F.col(ts) <= most) & (F.col(ts) <= F.col(ended) + F.expr(f"INTERVAL {margin}"))
    joined = left.join(right, (F.col("_key") == F.col(key)) & inside, "left_outer")
    return joined.drop(key).withColumnRenamed("_key", key)
