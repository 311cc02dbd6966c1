"""Sessions that an idle gap or an absolute limit ends, split without ordering a user in one task.

All events are numbered in one range-partitioned sort. An event's next start is
the first event beyond the absolute limit, which a second sort finds for all
events at once; the starts that count are those on the chain from a session's
first event, and chains are followed by pointer doubling, in rounds that grow with
the logarithm of the number of sessions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftline.ordering import BLOCK, add_index, with_previous
from siftline.session import materialise


def _running_total(df: DataFrame, position: str, value: str, name: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` up to each row by a dense ``position``: within blocks, then over the blocks' sums."""
    cut = df.withColumn("_block", F.floor(F.col(position) / block))
    inside = Window.partitionBy("_block").orderBy(position)
    # a row for each block
    sums = cut.groupBy("_block").agg(F.sum(value).alias("_sum"))
    before = sums.select("_block", (F.sum("_sum").over(Window.orderBy("_block")) - F.col("_sum")).alias("_before"))
    return cut.join(before, "_block").withColumn(name, F.col("_before") + F.sum(value).over(inside)).select(*df.columns, name)


def follow(pointers: DataFrame, roots: DataFrame) -> DataFrame:
    """All ``i`` that can be reached from ``roots`` by ``pointers`` ``(i, j)``, with j > i, one for each i.

    Each round takes all steps of the round before twice, so a chain of n steps
    takes log2(n) rounds; every round is written, and plans do not grow.
    """
    reached, steps = materialise(roots.select("i").distinct(), "starts"), pointers
    while not steps.isEmpty():
        further = reached.join(steps, "i").select(F.col("j").alias("i"))
        reached = materialise(reached.unionByName(further).distinct(), "starts")
        twice = steps.select("i", F.col("j").alias("k")).join(steps.select(F.col("i").alias("k"), "j"), "k")
        steps = materialise(twice.select("i", "j"), "steps")
    return reached


def split_sessions(df: DataFrame, user: str = "user_id", ts: str = "ts", idle_seconds: int = 30 * 86400, absolute_seconds: int = 90 * 86400) -> DataFrame:
    """``(user, session_start, last_seen, expires_at, events)`` of every session, open or over.

    A session ends ``idle_seconds`` after its last event or ``absolute_seconds``
    after its first one, whichever is earlier; an event at or after that time
    opens a new session. Rows without a time are ignored; a null user is one user.
    """
    idle, longest = idle_seconds * 1_000_000, absolute_seconds * 1_000_000
    events = df.select(F.col(user).alias("u"), F.unix_micros(F.col(ts).cast("timestamp")).alias("t")).filter("t is not null")
    events = materialise(add_index(events, ["u", "t"], 0, "i", "total"), "session-events")
    # a run of events without an idle gap
    gap = F.col("previous").isNull() | (F.col("t") - F.col("previous") >= idle)
    fresh = with_previous(events, ["u"], "i", "t").withColumn("fresh", gap.cast("bigint")).drop("previous")
    runs = materialise(_running_total(fresh, "i", "fresh", "run"), "session-runs")
    # only runs that last beyond the limit have further starts in them
    ends = runs.groupBy("run").agg(F.min("t").alias("_from"), F.max("t").alias("_to")).filter(F.col("_to") - F.col("_from") >= longest)
    # each event's limit is put in order with the events: in front of it stand the limits of the
    # events before it and all events before the limit, so the difference is the next start's number
    both = runs.select("u", "t", F.lit(1).alias("kind"), "i").unionByName(runs.select("u", F.col("t") + longest, F.lit(0).alias("kind"), "i").toDF("u", "t", "kind", "i"))
    placed = add_index(both, ["u", "t", "kind", "i"], 0, "at").filter("kind = 0").select("i", (F.col("at") - F.col("i")).alias("j"))
    capped = runs.join(ends, "run").filter(F.col("t") + longest <= F.col("_to")).select("i")
    pointers = materialise(placed.join(capped, "i"), "steps")
    starts = add_index(follow(pointers, runs.filter("fresh = 1").select("i")), ["i"], 0, "n")
    following = starts.select((F.col("n") - 1).alias("n"), F.col("i").alias("next"))
    spans = starts.join(following, "n", "left").select("i", "next")
    first = spans.join(runs.select("i", "u", F.col("t").alias("start"), "total"), "i").withColumn("next", F.coalesce("next", "total"))
    last = runs.select(F.col("i").alias("last_i"), F.col("t").alias("last"))
    done = first.withColumn("last_i", F.col("next") - 1).join(last, "last_i")
    return done.select(
        F.col("u").alias(user),
        F.timestamp_micros("start").alias("session_start"),
        F.timestamp_micros("last").alias("last_seen"),
        F.timestamp_micros(F.least(F.col("last") + idle, F.col("start") + longest)).alias("expires_at"),
        (F.col("next") - F.col("i")).alias("events"),
    )
