"""Events of each key replayed in order, with state that ends, as one streaming step.

Rows of a key wait until the watermark has passed them and are then taken in the
order of their time, so the result does not depend on files or micro-batches. A
key's state has an end of its own: an event at or after it finds no state, and
once the watermark has passed it, a timer removes it. Rows behind the watermark
are dropped, as in every Spark aggregate.

One key's events are taken one after the other, by one task: use keys with
bounded traffic, such as jobs, submissions or session owners. The rows that a
watermark sets free come out of a task together, so set
``spark.sql.shuffle.partitions`` by the rows between two watermarks.

Every call on the state is a message to the JVM. Where keys are many and have few
rows each, they are dealt to buckets, and calls are made for a bucket.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Row as SqlRow
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
#: Types whose values are the same key in Python whenever they are in Spark; others have no buckets.
_PLAIN = frozenset(("boolean", "tinyint", "smallint", "int", "bigint", "date", "string", "binary"))

Row = tuple
#: state (None if there is none), time in microseconds, the row's values -> new state, rows out
Step = Callable[[Row | None, int, Row], tuple[Row | None, list[Row]]]


@contextmanager
def rocks_state(spark: SparkSession) -> Iterator[None]:
    """Start streams in here: keyed state with timers needs the RocksDB store."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class _InOrder(StatefulProcessor):
    """Each call on the state is a message to the JVM, so a key's turn makes few of them.

    The rows of a key that came together wait as one packed value, and the key's
    own timers say when something is due.
    """

    def __init__(self, step: Step, until: Callable[[Row], int | None], close: Callable[[Row], list[Row]], width: int, state: T.StructType, out: T.StructType) -> None:
        self.step, self.until, self.close_state = step, until, close
        self.width, self.state_type = width, state
        self.row = SqlRow(*out.names)
        self.times = [i for i, f in enumerate(out.fields) if isinstance(f.dataType, T.TimestampType)]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.state = handle.getValueState("state", self.state_type)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[SqlRow]:  # noqa: ANN001, N802, N803
        # by place: after the keys and the time itself stand the time as a number and the values
        came = [tuple(None if v != v else v for v in r[-self.width :]) for r in rows]
        came = [r for r in came if r[0] is not None]
        if came:
            self.waiting.appendValue((pickle.dumps(came),))
            first = math.ceil(min(r[0] for r in came) / 1000)
            armed = list(self.handle.listTimers())
            if not armed or first < min(armed):
                # a later timer stays: it finds what is due by then, or nothing
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[SqlRow]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [r for part in self.waiting.get() for r in pickle.loads(part[0])]
        held = self.state.get()
        before = None if held is None else tuple(held)
        state, rest, found = self._replay(before, waiting, mark)
        if len(rest) < len(waiting):
            # a state that ends behind the watermark and before all that waits is done with
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if state is None:
            if before is not None:
                self.state.clear()
        elif state != before:
            self.state.update(state)
        if ahead := self._ahead(state, rest):
            self.handle.registerTimer(math.ceil(min(ahead) / 1000))
        for r in found:
            yield self._row((*key, *r))

    def _replay(self, state: Row | None, waiting: list[Row], mark: int) -> tuple[Row | None, list[Row], list[Row]]:
        """Of one key: the state once the rows up to the watermark are taken, the rows that wait on, and the rows out."""
        due = sorted((r for r in waiting if r[0] <= mark), key=_order)
        found: list[Row] = []
        for row in due:
            state, out = self._ended(state, row[0])
            found += out
            state, out = self.step(state, row[0], row[1:])
            found += out
        state, out = self._ended(state, mark)
        return state, [r for r in waiting if r[0] > mark], found + out

    def _ahead(self, state: Row | None, rest: list[Row]) -> list[int]:
        """Times at which a key has something to do."""
        end = None if state is None else self.until(state)
        return [r[0] for r in rest] + ([] if end is None else [end])

    def _row(self, values: Row) -> SqlRow:
        shown = list(values)
        for i in self.times:
            if isinstance(shown[i], int):
                shown[i] = _EPOCH + timedelta(microseconds=shown[i])
        return self.row(*shown)

    def _ended(self, state: Row | None, now: int) -> tuple[Row | None, list[Row]]:
        if state is None:
            return None, []
        end = self.until(state)
        return (None, self.close_state(state)) if end is not None and now >= end else (state, [])

    def close(self) -> None:
        pass


class _InBuckets(_InOrder):
    """A turn is that of a bucket of keys, with one packed state and one timer, so calls do not grow with the keys.

    What waits and what is held are dictionaries by key; a bucket's rows between
    two watermarks are in memory at once.
    """

    def __init__(self, step: Step, until: Callable[[Row], int | None], close: Callable[[Row], list[Row]], keys: int, width: int, out: T.StructType) -> None:
        super().__init__(step, until, close, width, T.StructType.fromDDL("held binary"), out)
        self.keys = keys

    def handleInputRows(self, key, rows, timerValues) -> Iterator[SqlRow]:  # noqa: ANN001, N802, N803
        # by place: the bucket, the keys, the time itself, the time as a number and the values
        came: dict[Row, list[Row]] = {}
        for r in rows:
            row = tuple([None if v != v else v for v in r[-self.width :]])
            if row[0] is not None:
                came.setdefault(r[1 : self.keys + 1], []).append(row)
        if came:
            self.waiting.appendValue((pickle.dumps(came),))
            first = math.ceil(min(r[0] for part in came.values() for r in part) / 1000)
            armed = list(self.handle.listTimers())
            if not armed or first < min(armed):
                for at in armed:
                    self.handle.deleteTimer(at)
                self.handle.registerTimer(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[SqlRow]:  # noqa: ANN001, N802, N803
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        waiting: dict[Row, list[Row]] = {}
        for part in self.waiting.get():
            for k, came in pickle.loads(part[0]).items():
                waiting.setdefault(k, []).extend(came)
        held = self.state.get()
        before = {} if held is None else pickle.loads(held[0])
        states, rest, due = {}, {}, []
        for k in {**before, **waiting}:
            state, later, found = self._replay(before.get(k), waiting.get(k, []), mark)
            if state is not None:
                states[k] = state
            if later:
                rest[k] = later
            if ahead := self._ahead(state, later):
                due.append(min(ahead))
            for r in found:
                yield self._row((*k, *r))
        if rest != waiting:
            self.waiting.put([(pickle.dumps(rest),)]) if rest else self.waiting.clear()
        if states != before:
            self.state.update((pickle.dumps(states),)) if states else self.state.clear()
        if due:
            self.handle.registerTimer(math.ceil(min(due) / 1000))


def _order(row: Row) -> tuple:
    return tuple((v is not None, v if v is not None else 0) for v in row)


def in_order(
    stream: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    late: str | None,
    step: Step,
    state: str,
    out: str,
    until: Callable[[Row], int | None] = lambda state: None,
    close: Callable[[Row], list[Row]] = lambda state: [],
    event_time: str = "",
    buckets: int = 0,
) -> DataFrame:
    """Rows that ``step`` gives, called for the rows of each key in order of ``ts``, then of ``values``.

    ``state`` and ``out`` are the schemas of a key's state and of the rows out,
    which follow the keys. ``until`` says when a state ends (microseconds), and
    ``close`` what comes out then. Times are passed as microseconds, also for
    timestamp columns of ``out``. ``event_time`` names the column of ``out`` by
    which a following step may have a watermark. Rows without a time are ignored.
    ``late`` is None if the stream has its watermark already.

    With ``buckets``, keys are dealt by hash to that many groups whose states are
    packed as one: for many keys with few rows each, and micro-batches that touch
    most of them. The number belongs to the checkpoint and must not change with it.
    """
    shape = {f.name: f.dataType for f in stream.schema.fields}
    kind = T.StructType([*[T.StructField(c, shape[c]) for c in keys], *T.StructType.fromDDL(out).fields])
    marked = stream if late is None else stream.withWatermark(ts, late)
    columns = [*keys, ts, F.unix_micros(F.col(ts)).alias("_at"), *values]
    if buckets and all(shape[c].simpleString() in _PLAIN for c in keys):
        grouped = marked.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *columns).groupBy("_bucket")
        work = _InBuckets(step, until, close, len(keys), 1 + len(values), kind)
    else:
        grouped = marked.select(*columns).groupBy(*keys)
        work = _InOrder(step, until, close, 1 + len(values), T.StructType.fromDDL(state), kind)
    return grouped.transformWithState(work, kind, "append", "EventTime", eventTimeColumnName=event_time)
