"""Streams with state that ends, bound to the test tables; events arrive in several files.

A slice of the events lands, the query runs to its end and stops; then the next
one lands and the query goes on from its checkpoint. Arrival is shuffled within
the time that the watermark allows for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import sessions
from siftline.plans.ledgers import STATES
from siftline.plans.registry import Tables, query
from siftline.schemas import NEXT_STATES, TERMINAL_STATES
from siftline.session import new_path
from siftline.streaming import jobs, states

_LATE = 3600  # seconds
_SLICES = 3
_US = 1_000_000

Build = Callable[[Callable[[str], DataFrame]], DataFrame]


def in_arrivals(t: Tables, events: dict[str, DataFrame], build: Build, label: str) -> DataFrame:
    """Run ``build(streams by name)`` over tables with a column ``ts`` that land slice by slice."""
    spark = t.spark
    folder, out, state = (new_path(spark, f"{label}-{x}") for x in ("in", "out", "state"))
    first, last = t.events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    width = ((last or 0) - (first or 0)) // _SLICES + 1
    result = None
    for i in range(_SLICES):
        for name, table in events.items():
            arrival = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(_LATE * _US * 9 // 10))
            # what arrives after the last slice's end is part of it
            part = F.least(F.floor((arrival - F.lit(first or 0)) / F.lit(width)), F.lit(_SLICES - 1))
            table.filter(part == i).write.mode("append").parquet(f"{folder}/{name}")
        result = states.run(build(lambda name: jobs.read_parquet_stream(spark, f"{folder}/{name}", events[name].schema)), out, state)
    return result


def _micros(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.unix_micros(c) for c in names})


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


#: Rows that the watermark has passed at the end.
_SEEN = f"epoch_us(ts) <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - {_LATE * _US} FROM events)"

JOB_STATES = f"""CASE WHEN event_id % 11 = 0 THEN 'cancel_requested' WHEN event_id % 13 = 0 THEN 'state_unknown'
  WHEN event_id % 7 = 0 THEN 'failed' ELSE {STATES} END"""
_KEPT, _QUIET = 6 * 3600, 4 * 86400

_LEGAL = ", ".join(f"({'NULL' if a is None else repr(a)}, {b!r})" for a, bs in NEXT_STATES.items() for b in bs)
_ENDS = ", ".join(map(repr, TERMINAL_STATES))
_REPLAYED = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS t, {JOB_STATES} AS state,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {_SEEN}),
legal(f, g) AS (VALUES {_LEGAL}),
r AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BIGINT AS t, NULL::VARCHAR AS state, NULL::VARCHAR AS before, NULL::VARCHAR AS after, 0::BIGINT AS until, false AS ok FROM e
UNION ALL
SELECT user_id, n, event_id, t, state, before, CASE WHEN ok THEN state ELSE before END,
  CASE WHEN ok THEN t + CASE WHEN state IN ({_ENDS}) THEN {_KEPT * _US} ELSE {_QUIET * _US} END ELSE until END, ok
FROM (SELECT x.*, EXISTS (SELECT 1 FROM legal WHERE f IS NOT DISTINCT FROM x.before AND g = x.state) AS ok
  FROM (SELECT e.user_id, e.n, e.event_id, e.t, e.state, CASE WHEN e.t < r.until THEN r.after END AS before, r.until FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) x)),
f AS (SELECT user_id, t AS ts, event_id, state, before, after, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome FROM r WHERE n > 0)
"""


def _transitions(events: DataFrame) -> DataFrame:
    named = events.select("user_id", "ts", "event_id", F.expr(JOB_STATES).alias("state"))
    return states.job_transitions(named, "user_id", "ts", "event_id", "state", f"{_LATE} seconds", _KEPT, _QUIET)


@query(_REPLAYED + "SELECT * FROM f")
def stream_transitions(t: Tables) -> DataFrame:
    found = in_arrivals(t, {"events": _events(t)}, lambda s: _transitions(s("events")), "transitions")
    return _micros(found, "ts")


@query(
    _REPLAYED
    + f""", w AS (SELECT ts // 21600000000 * 21600000000 AS window_start, after, count(*) FILTER (outcome = 'accepted') AS accepted,
  count(*) FILTER (outcome = 'accepted' AND after IS DISTINCT FROM before) AS changes, count(*) FILTER (outcome = 'rejected') AS rejected FROM f GROUP BY ALL)
SELECT * FROM w WHERE window_start + 21600000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - {_LATE * _US} FROM events)"""
)
def stream_state_attrition(t: Tables) -> DataFrame:
    def build(s: Callable[[str], DataFrame]) -> DataFrame:
        return states.state_attrition(_transitions(s("events")), "ts", "6 hours")

    return _micros(in_arrivals(t, {"events": _events(t)}, build, "attrition"), "window_start")


_HELD = 5 * 86400


@query(
    f"""WITH RECURSIVE s AS (SELECT user_id, event_type, event_id, epoch_us(ts) AS t, floor(value / 25)::BIGINT AS request,
  row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events WHERE {_SEEN}),
r AS (SELECT *, event_id AS held_by, request AS held, t AS since FROM s WHERE n = 1
UNION ALL
SELECT s.*, CASE WHEN s.t < r.since + {_HELD * _US} THEN r.held_by ELSE s.event_id END, CASE WHEN s.t < r.since + {_HELD * _US} THEN r.held ELSE s.request END,
  CASE WHEN s.t < r.since + {_HELD * _US} THEN r.since ELSE s.t END
FROM r JOIN s ON s.user_id = r.user_id AND s.event_type = r.event_type AND s.n = r.n + 1)
SELECT user_id, event_type, t AS ts, event_id, request, held_by,
  CASE WHEN held_by = event_id THEN 'accepted' WHEN held = request THEN 'repeated' ELSE 'conflict' END AS outcome FROM r"""
)
def stream_submissions(t: Tables) -> DataFrame:
    # every row is delivered twice, as a sender that retries would do
    rows = _events(t).withColumn("request", F.floor(F.col("value") / 25)).select("user_id", "event_type", "ts", "event_id", "request")

    def build(s: Callable[[str], DataFrame]) -> DataFrame:
        return states.submissions(s("events"), ["user_id", "event_type"], "ts", "event_id", "request", f"{_LATE} seconds", _HELD, ["event_id"])

    return _micros(in_arrivals(t, {"events": rows.unionByName(rows)}, build, "submissions"), "ts")


_IDLE, _LONGEST = 12 * 3600, 24 * 3600
_GREEDY = f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, t, n, t AS start FROM e WHERE n = 1
UNION ALL
SELECT e.user_id, e.t, e.n, CASE WHEN e.t >= least(r.t + {_IDLE * _US}, r.start + {_LONGEST * _US}) THEN e.t ELSE r.start END
FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1),
s AS (SELECT user_id, start AS session_start, max(t) AS last_seen, least(max(t) + {_IDLE * _US}, start + {_LONGEST * _US}) AS expires_at, count(*) AS events
  FROM r GROUP BY user_id, start)
"""


@query(_GREEDY + "SELECT * FROM s")
def split_sessions(t: Tables) -> DataFrame:
    found = sessions.split_sessions(_events(t), "user_id", "ts", _IDLE, _LONGEST)
    return _micros(found, "session_start", "last_seen", "expires_at")


@query(_GREEDY + f"SELECT * FROM s WHERE expires_at <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - {_LATE * _US} FROM events)")
def stream_ended_sessions(t: Tables) -> DataFrame:
    def build(s: Callable[[str], DataFrame]) -> DataFrame:
        return states.sessions(s("events"), "user_id", "ts", f"{_LATE} seconds", _IDLE, _LONGEST)

    rows = _events(t).select("event_id", "user_id", "ts")
    return _micros(in_arrivals(t, {"events": rows}, build, "sessions"), "session_start", "last_seen", "expires_at")


_MARK = f"""least((SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events WHERE event_type <> 'purchase') - {_LATE * _US},
  (SELECT epoch_us(max(ts)) // 1000 * 1000 FROM events WHERE event_type = 'purchase') - {_LATE * _US})"""


@query(
    f"""WITH l AS (SELECT user_id, event_id, epoch_us(ts) AS ts, replace(props, 'k', '[function-call-id-redacted]') AS line FROM events WHERE event_type <> 'purchase'),
s AS (SELECT user_id, event_id AS stage, epoch_us(ts) AS started, epoch_us(ts) + floor(value * 3600)::BIGINT * 1000000 AS ended FROM events WHERE event_type = 'purchase'),
j AS (SELECT l.*, stage, started FROM l LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= started - 1000000 AND l.ts <= ended + 1000000 AND l.ts <= started + 86401000000)
SELECT * FROM j WHERE stage IS NOT NULL OR ts + 1000000 < {_MARK}"""
)
def stream_stage_tail(t: Tables) -> DataFrame:
    events = _events(t)
    logs = events.filter("event_type <> 'purchase'").select("user_id", "event_id", "ts", "props")
    stages = events.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("owner"), "event_id", "ts", (F.col("ts") + F.make_dt_interval(secs=F.floor(F.col("value") * 3600))).alias("ended")
    )

    def build(s: Callable[[str], DataFrame]) -> DataFrame:
        lines = jobs.tail_logs(s("logs"), "ts", "props", F.lit("k")).withColumnsRenamed({"props": "line", "user_id": "owner"})
        runs = s("stages").withColumnsRenamed({"event_id": "stage", "ts": "started"})
        late = f"{_LATE} seconds"
        found = states.stage_tail(lines, runs, "owner", "ts", "started", "ended", late, late, "24 hours")
        return found.select(F.col("owner").alias("user_id"), "event_id", "ts", "line", "stage", "started")

    return _micros(in_arrivals(t, {"logs": logs, "stages": stages}, build, "stage-tail"), "ts", "started")
