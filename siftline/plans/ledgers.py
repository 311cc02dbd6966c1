"""Ledger, graph and stream operators bound to the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.operators import graph, runs
from siftline.plans.registry import Tables, query
from siftline.session import new_path
from siftline.streaming import jobs as streams

STATES = """CASE event_type WHEN 'click' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'finalizing'
  WHEN 'signup' THEN 'succeeded' ELSE 'blocked' END"""


def event_jobs(t: Tables) -> DataFrame:
    return t.events.select(
        F.col("event_id").alias("job_id"),
        F.col("user_id").alias("owner_user_id"),
        F.col("event_type").alias("workload"),
        F.expr(STATES).alias("state"),
        F.col("ts").alias("created_at"),
        "value",
        "props",
    )


@query(
    """WITH j AS (SELECT user_id::VARCHAR AS u, event_type AS w FROM events WHERE event_type IN ('click', 'view', 'purchase')),
c AS (SELECT CASE WHEN grouping(u) = 0 THEN 'user' WHEN grouping(w) = 0 THEN 'workload' ELSE 'global' END AS scope,
    coalesce(u, w) AS name, count(*) AS active FROM j GROUP BY GROUPING SETS ((u), (w), ())),
l AS (SELECT *, CASE scope WHEN 'user' THEN CASE WHEN name = '3' THEN 1000 ELSE 40 END WHEN 'workload' THEN 2000 ELSE 100000 END::BIGINT AS "limit" FROM c)
SELECT scope, name, active, "limit", active >= "limit" AS reached FROM l"""
)
def grouping_limits(t: Tables) -> DataFrame:
    limits = t.spark.createDataFrame(
        [("user", None, 40), ("user", "3", 1000), ("workload", None, 2000), ("global", None, 100000)],
        "scope string, name string, limit bigint",
    )
    return runs.active_counts(event_jobs(t), limits)


@query(
    """SELECT 'user-' || (length(props) - 6) AS category, count(*) AS n, epoch_us(min(ts)) AS oldest
FROM events WHERE event_type = 'error' GROUP BY 1"""
)
def blocked_summary(t: Tables) -> DataFrame:
    jobs = event_jobs(t).select(
        "state",
        F.concat(F.lit("user-"), F.length("props") - 6).alias("blocking_category"),
        F.unix_micros(F.col("created_at").cast("timestamp")).alias("blocked_at"),
    )
    return runs.blocked_summary(jobs)


@query(
    """SELECT count(*) AS total_entries, sum(length(props))::BIGINT AS total_bytes,
  count(*) FILTER (event_type = 'view') AS staging_entries, sum(length(props)) FILTER (event_type = 'view')::BIGINT AS staging_bytes,
  count(*) FILTER (event_type = 'error') AS reclaimable_entries, sum(length(props)) FILTER (event_type = 'error')::BIGINT AS reclaimable_bytes
FROM events"""
)
def storage_usage(t: Tables) -> DataFrame:
    files = t.events.select("event_type", F.length("props").cast("bigint").alias("bytes"))
    return runs.usage(
        files, "bytes", staging=F.col("event_type") == "view", reclaimable=F.col("event_type") == "error"
    )


@query(
    """SELECT user_id AS node_id, event_id AS call_id, event_type AS status FROM events WHERE event_type IN ('error', 'purchase')
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
)
def latest_per_key(t: Tables) -> DataFrame:
    calls = t.events.select(
        F.col("user_id").alias("node_id"),
        F.col("event_id").alias("call_id"),
        F.col("event_type").alias("status"),
        F.col("ts").alias("submitted_at"),
    )
    return runs.latest_call(calls, statuses=["error", "purchase"]).drop("submitted_at")


@query(
    """WITH e AS (SELECT user_id, event_id, event_type, value < 1 AS open,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cancelled' ELSE 'done' END AS outcome FROM events),
j AS (SELECT DISTINCT user_id, CASE WHEN user_id < 50 THEN 'failed' WHEN user_id < 100 THEN 'cancelled' ELSE 'running' END AS state FROM events),
r AS (SELECT j.user_id, state, event_id, event_type, row_number() OVER (PARTITION BY j.user_id ORDER BY
    CASE WHEN open THEN 0 WHEN outcome = state THEN 1 ELSE 2 END, event_id DESC) AS rn FROM j JOIN e ON j.user_id = e.user_id)
SELECT user_id AS job_id, state, event_id AS ordinal, event_type AS operation FROM r WHERE rn = 1"""
)
def stage_now(t: Tables) -> DataFrame:
    state = F.expr("CASE WHEN user_id < 50 THEN 'failed' WHEN user_id < 100 THEN 'cancelled' ELSE 'running' END")
    jobs = t.events.select(F.col("user_id").alias("job_id"), state.alias("state")).distinct()
    stages = t.events.select(
        F.col("user_id").alias("job_id"),
        F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("operation"),
        F.when(F.col("value") >= 1, F.col("ts")).alias("completed_at"),
        F.expr("CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'cancelled' ELSE 'done' END").alias("outcome"),
    )
    return runs.current_stage(jobs, stages).select("job_id", "state", "ordinal", "operation")


@query(
    """SELECT o_custkey, count(*) AS requested, count(*) FILTER (o_orderstatus = 'F') AS usable,
  CASE WHEN bool_and(o_orderstatus = 'F') THEN 'succeeded' WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'failed' END AS status
FROM orders GROUP BY o_custkey"""
)
def status_fold(t: Tables) -> DataFrame:
    return runs.stage_status(t.orders, ["o_custkey"], F.col("o_orderstatus") == "F")


@query(
    """SELECT o_custkey AS input_id, count(*) AS required, count(k) AS present, count(*) = count(k) AS completed
FROM orders LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) ON k = o_orderkey GROUP BY o_custkey"""
)
def input_completion(t: Tables) -> DataFrame:
    expected = t.orders.select(F.col("o_custkey").alias("input_id"), F.col("o_orderkey").alias("file"))
    observed = t.lineitem.select(F.col("l_orderkey").alias("file")).distinct().join(expected, "file")
    return runs.completion(expected, observed, "input_id", "file")


@query(
    """SELECT event_id FROM events WHERE user_id = 0 AND props <> '' """
)
def usable_rows(t: Tables) -> DataFrame:
    rows = t.events.select(
        "event_id", F.col("user_id").cast("string").alias("returncode"), F.col("props").alias("dockq")
    )
    return runs.usable_rows(rows).select("event_id")


@query(
    """SELECT o_orderkey, o_orderstatus, 0::BIGINT AS segment,
  coalesce(string_agg(l_linenumber || ':' || lpad(l_partkey::VARCHAR, 9, '0') || ':' || l_quantity::BIGINT, ' '
    ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) , '') AS lines
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderstatus"""
)
def children_nest(t: Tables) -> DataFrame:
    item = F.struct(
        "l_linenumber", F.lpad(F.col("l_partkey").cast("string"), 9, "0").alias("part"), F.col("l_quantity").cast("bigint").alias("n")
    )
    lines = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    nested = runs.nest_children(
        t.orders.select("o_orderkey", "o_orderstatus"), lines, "o_orderkey", "l_linenumber", item
    )
    shown = F.transform(
        "children", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["part"], x["n"].cast("string"))
    )
    return nested.select("o_orderkey", "o_orderstatus", "segment", F.array_join(shown, " ").alias("lines"))


def _turn(conv: str = "conv_id", turn: str = "turn") -> F.Column:
    return F.concat_ws(":", F.col(conv).cast("string"), F.col(turn).cast("string"))


def _turn_nodes(t: Tables) -> DataFrame:
    return t.conversations.select(_turn().alias("node"), "role")


def _turn_edges(t: Tables) -> DataFrame:
    return t.conversations.filter("turn > 0").select(
        _turn().alias("node"), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string")).alias("dependency")
    )


@query(
    """SELECT a.conv_id || ':' || a.turn AS node FROM conversations a
LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - 1
WHERE a.role = 'user' AND (b.conv_id IS NULL OR b.role <> 'user')"""
)
def ready_steps(t: Tables) -> DataFrame:
    nodes = _turn_nodes(t)
    done = nodes.filter("role <> 'user'")
    return graph.ready_steps(nodes, _turn_edges(t), done, done)


@query(
    """SELECT count(*) = 0 AS all_done, count(*) AS open FROM conversations WHERE role = 'user'"""
)
def all_done(t: Tables) -> DataFrame:
    nodes = _turn_nodes(t)
    return graph.all_done(nodes, nodes.filter("role <> 'user'"))


@query(
    """WITH RECURSIVE up AS (
  SELECT conv_id, turn, role FROM conversations QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)
  UNION ALL SELECT c.conv_id, c.turn, c.role FROM up JOIN conversations c ON c.conv_id = up.conv_id AND c.turn = up.turn - 1
  WHERE up.role <> 'system' AND NOT (up.role = 'assistant' AND up.conv_id > 50))
SELECT conv_id || ':' || turn AS node FROM up"""
)
def ancestors(t: Tables) -> DataFrame:
    done = t.conversations.filter("role = 'system' or (role = 'assistant' and conv_id > 50)")
    return graph.ancestors(_turn_nodes(t), _turn_edges(t), done.select(_turn().alias("node")))


@query(
    """WITH RECURSIVE down AS (
  SELECT conv_id, turn, conv_id || ':0' AS root, 0 AS depth FROM conversations WHERE turn = 0
  UNION ALL SELECT c.conv_id, c.turn, root, depth + 1 FROM down JOIN conversations c ON c.conv_id = down.conv_id AND c.turn = down.turn + 1)
SELECT conv_id || ':' || turn AS node, root, depth::BIGINT AS depth FROM down"""
)
def lineage(t: Tables) -> DataFrame:
    nodes = t.conversations.select(_turn().alias("candidate_id"))
    edges = _turn_edges(t).select(F.col("node").alias("candidate_id"), F.col("dependency").alias("parent_candidate_id"))
    return graph.lineage(nodes.join(edges, "candidate_id", "left"))


@query(
    """WITH m AS (SELECT conv_id, min(role) FILTER (turn = 0) AS first, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id || ':-1' AS node, 'unknown' AS problem FROM m
UNION ALL SELECT c.conv_id || ':' || turn, 'cycle' FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE first = 'system' AND last > 0"""
)
def bad_edges(t: Tables) -> DataFrame:
    conv = t.conversations
    before = F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - 1).cast("string"))
    edges = conv.select(_turn().alias("node"), before.alias("dependency"))
    ends = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    starts = conv.filter("turn = 0 and role = 'system'").select("conv_id", "turn").join(ends, "conv_id").filter("last > 0")
    back = starts.select(_turn().alias("node"), _turn(turn="last").alias("dependency"))
    return graph.bad_edges(_turn_nodes(t), edges.unionByName(back))


@query(
    """WITH m AS (SELECT conv_id, min(role) FILTER (turn = 0) AS first, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT c.conv_id || ':' || turn AS node, (SELECT min(x.conv_id || ':' || x.turn) FROM conversations x WHERE x.conv_id = c.conv_id) AS component
FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE first = 'system' AND last > 0
UNION ALL SELECT c.conv_id || ':' || turn, c.conv_id || ':0' FROM conversations c JOIN m ON c.conv_id = m.conv_id WHERE first = 'system' AND last = 0"""
)
def cycle_members(t: Tables) -> DataFrame:
    """Conversations that begin with the system lead from their first turn to their last, and even ones to the next."""
    conv = t.conversations
    ends = conv.groupBy("conv_id").agg(F.max("turn").alias("last"))
    starts = conv.filter("turn = 0 and role = 'system'").select("conv_id", "turn").join(ends, "conv_id")
    back = starts.select(_turn().alias("node"), _turn(turn="last").alias("dependency"))
    # what stands between two cycles is on neither
    bridge = conv.filter("turn = 0 and conv_id % 2 = 0").select(_turn().alias("node"), (F.col("conv_id") + 1).alias("conv_id")).join(ends, "conv_id")
    bridges = bridge.select("node", _turn(turn="last").alias("dependency"))
    return graph.strong_components(_turn_nodes(t), _turn_edges(t).unionByName(back).unionByName(bridges))


@query(
    """SELECT o_orderkey AS node, o_orderstatus = 'F' AND NOT EXISTS (
  SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)) AS complete
FROM orders"""
)
def outputs_complete(t: Tables) -> DataFrame:
    nodes = t.orders.select(
        F.col("o_orderkey").alias("node"), F.when(F.col("o_orderstatus") == "F", "succeeded").otherwise("failed").alias("status")
    )
    outputs = t.lineitem.select(F.col("l_orderkey").alias("node"), F.col("l_partkey").alias("artifact_id"))
    kept = t.part.filter("p_size <= 45").select(F.col("p_partkey").alias("artifact_id"))
    return graph.outputs_complete(nodes, outputs, kept)


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 43200000000, true)::INT AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, epoch_us(max(ts)) AS last_seen,
  least(epoch_us(max(ts)) + 43200000000, epoch_us(min(ts)) + 86400000000) AS expires_at, count(*) AS events
FROM n GROUP BY user_id, s"""
)
def session_expiry(t: Tables) -> DataFrame:
    found = runs.user_sessions(t.events, idle_seconds=12 * 3600, absolute_seconds=24 * 3600)
    return found.select(
        "user_id", *[F.unix_micros(c).alias(c) for c in ("session_start", "last_seen", "expires_at")], "events"
    )


@query(
    """WITH e AS (SELECT event_id, epoch_us(ts) AS t, (user_id - 75) * 60000000 AS off, value FROM events),
w AS (SELECT event_id, t + off AS since, t + off + floor(value * 6)::BIGINT * 1000000 AS until, t - 60000000 AS started, t + 600000000 AS ended FROM e),
p AS (SELECT *, greatest(since, started - 1000000) AS lo, least(until, ended + 1000000) AS hi FROM w),
q AS (SELECT *, CASE WHEN since >= until THEN 'invalid' WHEN until - since > 900000000 THEN 'too_long' WHEN lo >= hi THEN 'outside' END AS problem FROM p)
SELECT event_id, problem, CASE WHEN problem IS NULL THEN lo END AS bounded_since, CASE WHEN problem IS NULL THEN hi END AS bounded_until FROM q"""
)
def log_windows(t: Tables) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    since = at + (F.col("user_id") - 75) * 60_000_000
    rows = t.events.select(
        "event_id",
        F.timestamp_micros(since).alias("since"),
        F.timestamp_micros(since + F.floor(F.col("value") * 6) * 1_000_000).alias("until"),
        F.timestamp_micros(at - 60_000_000).alias("started"),
        F.timestamp_micros(at + 600_000_000).alias("ended"),
    )
    cut = runs.clamp_window(rows, "since", "until", "started", "ended", F.current_timestamp())
    return cut.select(
        "event_id", "problem", *[F.unix_micros(c).alias(c) for c in ("bounded_since", "bounded_until")]
    )


@query("""SELECT event_id, replace(props, 'k": ' || left(user_id::VARCHAR, 1), '[function-call-id-redacted]') AS line FROM events""")
def redacted_lines(t: Tables) -> DataFrame:
    from siftline.functions.keys import redact

    secret = F.concat(F.lit('k": '), F.substring(F.col("user_id").cast("string"), 1, 1))
    return t.events.select("event_id", redact(F.col("props"), secret).alias("line"))


# --- streams: the tables are read as file streams and run to their end -----------


def event_stream(t: Tables) -> DataFrame:
    schema = t.events.schema
    stream = streams.read_parquet_stream(t.spark, f"{t.folder}/events.parque*", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    """SELECT event_id, replace(props, 'k', '[function-call-id-redacted]') AS props FROM events
WHERE ts >= TIMESTAMP '2024-01-02' AND ts < TIMESTAMP '2024-01-08'"""
)
def stream_tail(t: Tables) -> DataFrame:
    bounds = [F.lit(x).cast("timestamp") for x in ("2024-01-02", "2024-01-08")]
    tail = streams.tail_logs(event_stream(t), "ts", "props", F.lit("k"), *bounds)
    return streams.drain(tail.select("event_id", "props"), "tail")


@query(
    """WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS h, event_type, count(*) AS n, count(*) FILTER (value > 20) AS large
  FROM events GROUP BY ALL)
SELECT epoch_us(h) AS window_start, event_type, n, large FROM w
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"""
)
def stream_attrition(t: Tables) -> DataFrame:
    counts = streams.windowed_counts(
        event_stream(t), "ts", ["event_type"], "1 hour", "10 minutes", large=F.col("value") > 20
    )
    closed = streams.drain(counts, "attrition")
    return closed.withColumn("window_start", F.unix_micros("window_start"))


_KEYS = ["user_id", "event_type", "bucket"]


def _submissions(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_type", F.floor(F.col("value") / 25).alias("bucket"), "event_id", "props")


_FIRST = """
WITH s AS (SELECT user_id, event_type, floor(value / 25)::BIGINT AS bucket, event_id, props FROM events),
f AS (SELECT user_id, event_type, bucket, min(event_id) AS event_id, arg_min(props, event_id) AS props,
  count(*) AS submissions, min(props) <> max(props) AS conflict FROM s GROUP BY ALL)
"""


@query(_FIRST + "SELECT * FROM f")
def stream_idempotent(t: Tables) -> DataFrame:
    first = streams.first_submissions(_submissions(event_stream(t)), _KEYS, ["event_id"], "props")
    return streams.drain_updates(first, "submissions", _KEYS)


@query(
    _FIRST
    + """SELECT s.user_id, s.event_type, s.bucket, s.event_id FROM s JOIN f
  ON s.user_id = f.user_id AND s.event_type = f.event_type AND s.bucket = f.bucket WHERE s.props <> f.props"""
)
def conflicting_submissions(t: Tables) -> DataFrame:
    rows = _submissions(t.events)
    first = streams.first_submissions(rows, _KEYS, ["event_id"], "props")
    return streams.conflicting_submissions(rows, first, _KEYS, "props").select(*_KEYS, "event_id")


_STATES_SQL = f"""
WITH e AS (SELECT user_id, event_id, CASE WHEN value > 100 THEN {STATES} ELSE 'running' END AS state FROM events),
d AS (SELECT user_id, min(event_id) AS ended FROM e WHERE state = 'succeeded' GROUP BY user_id)
"""


def _state_events(events: DataFrame) -> DataFrame:
    state = F.when(F.col("value") > 100, F.expr(STATES)).otherwise("running")
    return events.select("user_id", "event_id", state.alias("state"))


@query(
    _STATES_SQL
    + """SELECT e.user_id, arg_max(state, event_id) FILTER (event_id <= coalesce(ended, event_id)) AS state,
  max(event_id) FILTER (event_id <= coalesce(ended, event_id)) AS event_id, bool_or(ended IS NOT NULL) AS closed, count(*) AS events
FROM e LEFT JOIN d ON e.user_id = d.user_id GROUP BY e.user_id"""
)
def stream_state(t: Tables) -> DataFrame:
    states = streams.job_states(_state_events(event_stream(t)), "user_id", "state", ["event_id"])
    return streams.drain_updates(states, "states", ["user_id"])


@query(_STATES_SQL + "SELECT e.user_id, event_id, state FROM e JOIN d ON e.user_id = d.user_id WHERE event_id > ended")
def rejected_events(t: Tables) -> DataFrame:
    events = _state_events(t.events)
    states = streams.job_states(events, "user_id", "state", ["event_id"])
    return streams.rejected_events(events, states, "user_id", ["event_id"])


@query(
    """WITH last AS (SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1),
c AS (SELECT c_custkey FROM customer),
a AS (SELECT 'c-' || user_id AS candidate_id, c_custkey IS NOT NULL AS known, value > 20 AS good FROM last LEFT JOIN c ON c_custkey = user_id)
SELECT candidate_id, known AND good AS passed, CASE WHEN NOT known THEN 'missing_manifest' WHEN good THEN 'passed' ELSE 'filtered' END AS reason FROM a
UNION ALL SELECT 'c-' || c_custkey, false, 'missing_score' FROM c WHERE c_custkey NOT IN (SELECT user_id FROM events)"""
)
def stream_audit(t: Tables) -> DataFrame:
    manifest = t.customer.select(
        F.concat(F.lit("c-"), F.col("c_custkey")).alias("candidate_id"),
        F.concat(F.lit("in/c-"), F.col("c_custkey"), F.lit(".pdb")).alias("source_path"),
    )
    scores = event_stream(t).select(
        F.concat(F.lit("x__c-"), F.col("user_id"), F.lit("_model.pdb")).alias("filename"), "value", "event_id"
    )
    spark = t.spark
    audit = streams.incremental_audit(
        scores, manifest, {"value": "> 20"}, "filename", "stage1", ["event_id"],
        new_path(spark, "audit"), new_path(spark, "audit-state"),
    )
    rest = streams.unscored(manifest, audit).select(
        "candidate_id", F.lit(False).alias("passed"), F.lit("missing_score").alias("reason")
    )
    latest = streams.latest_audit(audit)
    return latest.select("candidate_id", "passed", "reason").unionByName(rest)


@query(
    """WITH g AS (SELECT user_id, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) >= 43200000000, true)::INT AS fresh FROM events),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS session_start, least(epoch_us(max(ts)) + 43200000000, epoch_us(min(ts)) + 86400000000) AS expires_at,
  count(*) AS events FROM n GROUP BY user_id, s
HAVING max(ts) + INTERVAL 12 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""
)
def stream_sessions(t: Tables) -> DataFrame:
    closed = streams.session_windows(event_stream(t), "user_id", "ts", 12 * 3600)
    capped = streams.cap_sessions(streams.drain(closed, "sessions"), "24 hours")
    return capped.select(
        "user_id", *[F.unix_micros(c).alias(c) for c in ("session_start", "expires_at")], "events"
    )
