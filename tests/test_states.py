"""Streams with state that ends, and session splitting, against slow replays."""

import datetime as d
import random

import pytest
from conftest import rows
from pyspark.sql import Row as SqlRow
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftline.operators import sessions
from siftline.schemas import NEXT_STATES, TERMINAL_STATES
from siftline.streaming import jobs, replay, states

ZERO = d.datetime(2024, 1, 1)


def at(seconds):
    return ZERO + d.timedelta(seconds=seconds)


def seconds(ts):
    return (ts - ZERO).total_seconds()


@pytest.fixture
def arrive(spark, tmp_path):
    """Land frames one after the other and run the query to its end after each."""

    def run(frames, build):
        folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
        found = None
        for df in frames:
            df.write.mode("append").parquet(folder)
            found = states.run(build(jobs.read_parquet_stream(spark, folder, df.schema)), out, state)
        return found, state

    return run


def slow_transitions(events, kept, quiet):
    held, out = {}, []
    for t, n, job, wanted in sorted(events):
        state, until = held.get(job, (None, None))
        if until is not None and t >= until:
            state = None
        if wanted in NEXT_STATES.get(state, ()):
            held[job] = (wanted, t + (kept if wanted in TERMINAL_STATES else quiet))
            out.append((job, n, wanted, state, wanted, "accepted"))
        else:
            out.append((job, n, wanted, state, state, "rejected"))
    return out


def test_transitions_equal_a_replay_in_order(frame, arrive):
    rng = random.Random(4)
    names = [s for s in NEXT_STATES if s] + ["no such state", "queued", "running", "queued"]
    events = [(float(rng.randrange(5000)), i, f"j{rng.randrange(12)}", rng.choice([*names, None])) for i in range(500)]
    schema = "ts timestamp, n int, job string, state string"
    # arrival is up to 300 s out of order, over four files
    arrival = sorted(events, key=lambda e: e[0] + rng.random() * 299)
    parts = [frame(schema, *[(at(t), n, j, s) for t, n, j, s in arrival[i : i + 130]]) for i in range(0, 500, 130)]
    parts.append(frame(schema, (at(99_999), 999, "last", "queued")))
    found, _ = arrive(parts, lambda s: states.job_transitions(s, "job", "ts", "n", "state", "300 seconds", 200, 900))
    got = rows(found, "job", "n", "state", "before", "after", "outcome")
    wanted = slow_transitions(events, 200, 900)
    assert {r[1]: r for r in got} == {r[1]: r for r in wanted}
    assert len(got) == len(events)
    assert {r[5] for r in wanted} == {"accepted", "rejected"}


def test_ended_jobs_are_forgotten(spark, frame, arrive):
    schema = "ts timestamp, n int, job string, state string"
    first = frame(schema, (at(0), 1, "a", "queued"), (at(10), 2, "a", "succeeded"), (at(12), 3, "a", "running"), (at(0), 4, "b", "queued"))
    late = frame(schema, (at(500), 5, "c", "queued"))
    # too late, then anew, then past everything
    more = frame(schema, (at(20), 6, "a", "queued"), (at(600), 7, "a", "queued"), (at(700), 8, "c", "running"))
    found, path = arrive([first, late, more], lambda s: states.job_transitions(s, "job", "ts", "n", "state", "60 seconds", 100, 100_000))
    got = {r.n: r.outcome for r in found.collect()}
    assert got == {1: "accepted", 2: "accepted", 3: "rejected", 4: "accepted", 5: "accepted", 7: "accepted"}
    kept = spark.read.format("statestore").option("path", path).option("stateVarName", "state").load()
    assert rows(kept.select(F.col("key.job").alias("k"), F.col("value.state").alias("s"))) == [("a", "queued"), ("b", "queued"), ("c", "queued")]


def test_state_of_an_ended_job_leaves_the_store(spark, frame, arrive):
    schema = "ts timestamp, n int, job string, state string"
    parts = [frame(schema, (at(0), 1, "a", "queued"), (at(10), 2, "a", "failed")), frame(schema, (at(50), 3, "b", "queued")), frame(schema, (at(500), 4, "c", "queued"))]

    def held(path):
        kept = spark.read.format("statestore").option("path", path).option("stateVarName", "state").load()
        return sorted(r[0] for r in kept.select("key.job").collect())

    build = lambda s: states.job_transitions(s, "job", "ts", "n", "state", "10 seconds", 100, 100_000)
    _, path = arrive(parts[:2], build)
    assert held(path) == ["a"]
    _, path = arrive(parts[2:], build)
    assert held(path) == ["b"]


def test_attrition_follows_transitions_in_one_query(frame, arrive):
    schema = "ts timestamp, n int, job string, state string"
    events = [(0, 1, "a", "queued"), (5, 2, "a", "running"), (6, 3, "a", "queued"), (61, 4, "a", "cancel_requested"), (62, 5, "a", "running"), (63, 6, "b", "failed"), (130, 7, "b", "queued"), (500, 8, "z", "queued")]
    parts = [frame(schema, *[(at(t), n, j, s) for t, n, j, s in events[i : i + 3]]) for i in (0, 3, 6)]

    def build(s):
        return states.state_attrition(states.job_transitions(s, "job", "ts", "n", "state", "30 seconds", 100, 1000), "ts", "1 minute")

    found, _ = arrive(parts, build)
    assert rows(found) == sorted(
        [(at(0), "queued", 2, 2, 0), (at(0), "running", 1, 1, 0), (at(60), "cancel_requested", 1, 1, 1), (at(60), None, 0, 0, 1), (at(120), "queued", 1, 1, 0)],
        key=lambda r: [(x is not None, str(x)) for x in r],
    )


def test_submissions(spark, frame, arrive):
    schema = "ts timestamp, n int, owner string, k string, hash string"
    first = frame(schema, (at(5), 2, "u", "1", "h2"), (at(5), 1, "u", "1", "h1"), (at(9), 3, "u", "2", None), (at(5), 1, "u", "1", "h1"))
    second = frame(schema, (at(7), 4, "u", "1", "h1"), (at(9), 3, "u", "2", None), (at(20), 5, "u", "2", None), (at(400), 6, "v", "1", "x"))
    third = frame(schema, (at(8), 7, "u", "1", "h9"), (at(104), 8, "u", "1", "h9"), (at(401), 9, "u", "1", "h9"), (at(2000), 10, "w", "1", "x"))
    found, path = arrive([first, second, third], lambda s: states.submissions(s, ["owner", "k"], "ts", "n", "hash", "300 seconds", 100, ["n"]))
    got = {r.n: (r.held_by, r.outcome) for r in found.collect()}
    # 7 lies behind the watermark; 8 comes before its key is free, 9 after
    assert got == {
        1: (1, "accepted"), 2: (1, "conflict"), 4: (1, "repeated"), 3: (3, "accepted"), 5: (3, "repeated"),
        8: (1, "conflict"), 6: (6, "accepted"), 9: (9, "accepted"),
    }
    assert found.count() == 8
    kept = spark.read.format("statestore").option("path", path).option("stateVarName", "state").load()
    assert kept.count() == 0


def slow_sessions(events, idle, longest):
    out = {}
    for user, t in sorted(events, key=lambda e: (str(e[0]), e[1])):
        runs = out.setdefault(user, [])
        if not runs or t >= min(runs[-1][1] + idle, runs[-1][0] + longest):
            runs.append([t, t, 0])
        runs[-1][1] = t
        runs[-1][2] += 1
    return sorted((str(u), s, last, min(last + idle, s + longest), n) for u, runs in out.items() for s, last, n in runs)


def found_sessions(df):
    return sorted((str(r.u), seconds(r.session_start), seconds(r.last_seen), seconds(r.expires_at), r.events) for r in df.collect())


@pytest.mark.parametrize(("idle", "longest"), [(50, 120), (10, 1000), (1000, 7), (30, 30)])
def test_split_sessions(frame, idle, longest):
    rng = random.Random(idle)
    # one busy user with limits inside one long run, ties, and users with single events
    events = [("hot", rng.randrange(4000)) for _ in range(600)] + [(f"u{rng.randrange(30)}", rng.randrange(3000)) for _ in range(200)]
    events += [("tie", 5)] * 4 + [("tie", 5 + longest)] * 2 + [(None, 1), (None, 2)]
    df = frame("u string, ts timestamp, idle int, i int", *[(u, at(t), 1, 2) for u, t in events], ("x", None, 1, 1))
    assert found_sessions(sessions.split_sessions(df, "u", "ts", idle, longest)) == slow_sessions(events, idle, longest)


def test_split_sessions_of_no_rows(frame):
    assert sessions.split_sessions(frame("u string, ts timestamp"), "u", "ts", 5, 5).count() == 0


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = sessions.materialise
    monkeypatch.setattr(sessions, "materialise", lambda df, label: written.append(label) or keep(df, label))
    steps = keep(spark.range(5000).selectExpr("id AS i", "id + 1 AS j"), "steps")
    got = sessions.follow(steps, spark.range(1).selectExpr("id AS i"))
    assert got.count() == 5001
    assert written.count("starts") <= 14


def test_streamed_sessions_equal_those_of_a_table(frame, arrive):
    rng = random.Random(9)
    events = [(f"u{rng.randrange(4)}", rng.randrange(3000)) for _ in range(400)]
    arrival = sorted(events, key=lambda e: e[1] + rng.random() * 99)
    parts = [frame("u string, ts timestamp", *[(u, at(t)) for u, t in arrival[i : i + 150]]) for i in range(0, 400, 150)]
    parts.append(frame("u string, ts timestamp", ("z", at(9999))))
    found, _ = arrive(parts, lambda s: states.sessions(s, "u", "ts", "100 seconds", 20, 200))
    assert found_sessions(found) == slow_sessions(events, 20, 200)


def test_log_rows_meet_their_stage(spark, frame, tmp_path):
    logs, stages = "job string, ts timestamp, line string", "job string, stage string, started timestamp, ended timestamp"
    arrivals = [
        (frame(logs, ("a", at(99), "before"), ("a", at(98), "too early"), ("a", at(150), "in"), ("b", at(150), "other job")), frame(stages, ("a", "s1", at(100), at(200)))),
        (frame(logs, ("a", at(201), "after"), ("a", at(202), "too late"), ("a", at(190), "both")), frame(stages, ("a", "s2", at(185), at(195)), ("z", "s", at(1000), at(1001)))),
        (frame(logs, ("a", at(5000), "end")), frame(stages, ("z", "s", at(5000), at(5001)))),
    ]
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    found = None
    for log, stage in arrivals:
        log.write.mode("append").parquet(str(tmp_path / "l"))
        stage.write.mode("append").parquet(str(tmp_path / "s"))
        left, right = (jobs.read_parquet_stream(spark, str(tmp_path / x), df.schema) for x, df in (("l", log), ("s", stage)))
        found = states.run(states.stage_tail(left, right, "job", "ts", "started", "ended", "60 seconds", "120 seconds", "1 hour"), out, state)
    assert rows(found, "line", "stage") == [
        ("after", "s1"), ("before", "s1"), ("both", "s1"), ("both", "s2"), ("in", "s1"), ("other job", None), ("too early", None), ("too late", None),
    ]
    held = spark.read.format("statestore").option("path", state).option("joinSide", "left").load()
    assert rows(held.select("value.line")) == [("end",)]


def test_the_store_setting_is_put_back(spark):
    before = spark.conf.get(replay._PROVIDER, None)
    with replay.rocks_state(spark):
        assert "RocksDB" in spark.conf.get(replay._PROVIDER)
    assert spark.conf.get(replay._PROVIDER, None) == before


class _Counted:
    """A key's state in memory that counts the calls on it."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, set()

    def getListState(self, name, schema):  # noqa: N802
        return _CountedVar(self, name)

    getValueState = getListState  # noqa: N815

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(sorted(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)


class _CountedVar:
    def __init__(self, handle, name):
        self.handle, self.name = handle, name

    def __getattr__(self, call):
        def act(*args):
            self.handle.calls += 1
            held = self.handle.held
            if call == "get":
                return held.get(self.name, iter(()) if self.name == "waiting" else None)
            if call == "appendValue":
                held.setdefault(self.name, []).append(args[0])
            elif call in ("put", "update"):
                held[self.name] = args[0]
            else:
                assert call == "clear"
                held.pop(self.name, None)

        return act


def test_a_keys_turn_makes_few_calls_on_its_state(spark):
    handle = _Counted()
    out = "k int, ts timestamp, n int"
    work = replay._InOrder(
        lambda held, at, row: ((at,), [(at, row[0])]), lambda held: held[0] + 10_000_000, lambda held: [], 2, T.StructType.fromDDL("at bigint"), T.StructType.fromDDL(out)
    )
    work.init(handle)
    came = [(1, at(i), i * 1_000_000, i) for i in reversed(range(30))]
    assert list(work.handleInputRows((1,), iter(came), None)) == []
    assert handle.calls <= 3
    assert handle.timers == {0}
    assert len(handle.held["waiting"]) == 1

    class Mark:
        def getCurrentWatermarkInMs(self):  # noqa: N802
            return 20_000

    handle.calls = 0
    got = list(work.handleExpiredTimer((1,), Mark(), None))
    assert handle.calls <= 5
    assert [tuple(r) for r in got] == [(1, d.datetime(1970, 1, 1, 0, 0, i, tzinfo=d.timezone.utc), i) for i in range(21)]
    assert handle.held["state"] == (20_000_000,)
    assert max(handle.timers) == 21_000


def slow_submissions(events, held_seconds):
    held, out = {}, []
    for t, n, key, content in sorted(events, key=lambda e: (e[0], e[1])):
        if key not in held or t >= held[key][0] + held_seconds:
            held[key] = (t, n, content)
        _, first, kept = held[key]
        out.append((key, n, content, first, "accepted" if first == n else "repeated" if kept == content else "conflict"))
    return out


@pytest.mark.parametrize("buckets", [0, 3])
def test_submissions_in_buckets_equal_a_replay_in_order(spark, frame, arrive, buckets):
    rng = random.Random(11)
    owners, kinds = [*range(40), None], ["a", "b", None]
    events = [(float(rng.randrange(4000)), i, (rng.choice(owners), rng.choice(kinds)), rng.choice([1, 2, None])) for i in range(700)]
    schema = "ts timestamp, n int, owner int, kind string, content int"
    arrival = sorted(events, key=lambda e: e[0] + rng.random() * 299)
    parts = [frame(schema, *[(at(t), n, *key, c) for t, n, key, c in arrival[i : i + 200]] * 2) for i in range(0, 700, 200)]
    parts.append(frame(schema, (at(4500), 999, 0, "a", 1)))
    found, path = arrive(parts, lambda s: states.submissions(s, ["owner", "kind"], "ts", "n", "content", "300 seconds", 900, ["n"], buckets))
    got = {r.n: ((r.owner, r.kind), r.n, r.content, r.held_by, r.outcome) for r in found.collect()}
    wanted = slow_submissions(events, 900)
    assert got == {r[1]: r for r in wanted}
    assert found.count() == len(events)
    assert {r[4] for r in wanted} == {"accepted", "repeated", "conflict"}
    kept = spark.read.format("statestore").option("path", path).option("stateVarName", "state").load().count()
    # the keys that are still held
    open_keys = {key for t, n, key, c in events if any(r[1] == n and r[4] == "accepted" for r in wanted) and t + 900 > 4200}
    assert len(open_keys) > 20
    assert kept == len(open_keys) if buckets == 0 else kept == buckets


def test_keys_that_are_no_plain_values_stand_by_themselves(frame, arrive):
    schema = "ts timestamp, n int, k double, content int"
    nan = float("nan")
    first = frame(schema, (at(1), 1, nan, 1), (at(2), 2, 0.5, 1))
    second = frame(schema, (at(3), 3, -nan, 2), (at(4), 4, 0.5, 1), (at(999), 5, 7.0, 1))
    found, _ = arrive([first, second], lambda s: states.submissions(s, ["k"], "ts", "n", "content", "10 seconds", 500, buckets=1))
    assert {r.n: (r.held_by, r.outcome) for r in found.collect()} == {1: (1, "accepted"), 2: (2, "accepted"), 3: (1, "conflict"), 4: (2, "repeated")}


class _CountedTimers(_Counted):
    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_calls_on_a_buckets_state_do_not_grow_with_its_keys(spark):
    handle = _CountedTimers()
    step = lambda held, at, row: ((at,) if held is None else held, [(at, row[0])])
    work = replay._InBuckets(step, lambda held: held[0] + 50_000_000, lambda held: [], 1, 2, T.StructType.fromDDL("k int, ts timestamp, n int"))
    work.init(handle)

    def turn(rows):
        handle.calls = 0
        assert list(work.handleInputRows((0,), iter(rows), None)) == []
        return handle.calls

    class Mark:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.ms

    def fire(ms):
        handle.calls = 0
        expired = sorted(x for x in handle.timers if x <= ms)
        out = [r for _ in expired for r in work.handleExpiredTimer((0,), Mark(ms), None)]
        handle.timers -= set(expired)
        return len(expired), handle.calls, sorted((r.k, r.n) for r in out)

    assert turn([SqlRow(0, k, at(s), s * 1_000_000, k + s) for k in range(500) for s in (30, 10)]) <= 3
    assert turn([SqlRow(0, k, at(s), s * 1_000_000, k + s) for k in range(500) for s in (5,)]) <= 4
    # one timer, by the first row
    assert handle.timers == {5_000}
    expired, calls, out = fire(20_000)
    assert (expired, calls <= 5) == (1, True)
    assert out == sorted((k, k + s) for k in range(500) for s in (5, 10))
    assert handle.timers == {30_000}
    # the same states are not written again
    assert fire(40_000) == (1, 4, [(k, k + 30) for k in range(500)])
    # all states end at 55 s and leave the store
    assert handle.timers == {55_000}
    assert "state" in handle.held
    assert fire(60_000)[::2] == (1, [])
    assert "state" not in handle.held
    assert handle.timers == set()
