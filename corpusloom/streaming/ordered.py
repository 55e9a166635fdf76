"""Folds over a stream's events in the order of their times, with late and refused events as outputs of their own."""

from __future__ import annotations

import contextlib
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from types import SimpleNamespace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from corpusloom.plans.scratch import Scratch, new_path
from corpusloom.registry import query
from corpusloom.streaming.sessions import _BEGIN, _take, intake_events

_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: Parts of a stream's keys, and events for which the queries' streams have one.
SLOTS, SLOT_EVENTS = 1024, 4096


@dataclass(frozen=True)
class Fold:
    """A fold over a key's events: ``begin`` makes a state, and ``step`` takes a state, the key, a time in microseconds and an event (a dict) and gives the next state and output rows.

    States are what JSON can hold. ``late`` gives the output of an event that came after
    the watermark had passed it, and ``expired`` that of a state for which ``ttl`` seconds
    have passed since its last event; ``schema`` is that of all outputs.
    """

    begin: Callable[[], Any]
    step: Callable[[Any, Any, int, dict], tuple[Any, list[tuple]]]
    schema: str
    late: Callable[[Any, int, dict], tuple] | None = None
    ttl: int | None = None
    expired: Callable[[Any, Any, int], tuple] | None = None

    def names(self) -> list[str]:
        return [c.split()[0] for c in self.schema.split(", ")]

    def take(self, key: Any, state: Any, last: int | None, at: int, event: dict) -> tuple[Any, list[tuple]]:
        """One event; a state whose time has run out by then ends first."""
        out = self.end(key, state, last, at)
        state, more = self.step(self.begin() if out or last is None else state, key, at, event)
        return state, out + more

    def end(self, key: Any, state: Any, last: int | None, now: int, strictly: bool = False) -> list[tuple]:
        """The output of a state that is over at ``now``."""
        if self.ttl is None or last is None:
            return []
        over = last + self.ttl * 1_000_000
        return [self.expired(key, state, over)] if over < now or over == now and not strictly else []


def _events(rows: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """(key, at, nth, event): the time in microseconds loses its watermark, so that Spark hands late events over instead of dropping them."""
    return rows.select(F.col(key).alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(order).cast("long").alias("nth"), F.to_json(F.struct(*rows.columns)).alias("event"))


class OrderedProcessor(StatefulProcessor):
    """Holds events until the watermark has passed them and then folds them in their order, for all keys of a slot.

    One list state has the waiting events and one the keys' states and last times, each
    read and written as a whole; one timer of event time wakes the slot when its next event
    is due or the time of its next key runs out.
    """

    def __init__(self, fold: Fold, kind: str):
        self.fold, self.kind = fold, kind

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"key {self.kind}, at long, nth long, event string")
        self.held = handle.getListState("held", f"key {self.kind}, state string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed, out, fresh = timerValues.getCurrentWatermarkInMs() * 1000, [], []
        for part in rows:
            for r in part.itertuples(index=False):
                k = None if r.key is None or r.key != r.key else r.key
                if r.at < passed:
                    out += [self.fold.late(k, int(r.at), json.loads(r.event))] if self.fold.late else []
                else:
                    fresh.append((k, int(r.at), int(r.nth), r.event))
        if fresh:
            self.waiting.appendList(fresh)
            self._wake(min(x[1] for x in fresh) // 1000 + 1, -1)
        yield pd.DataFrame(out, columns=self.fold.names())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        mark = timerValues.getCurrentWatermarkInMs()
        passed, out = mark * 1000, []
        due, left = [], []
        for x in self.waiting.get():
            (due if x[1] < passed else left).append(tuple(x))
        held = {k: (json.loads(state), last) for k, state, last in self.held.get()}
        for k, at, _, event in sorted(due, key=lambda x: x[1:]):
            state, last = held.get(k, (None, None))
            state, more = self.fold.take(k, state, last, at, json.loads(event))
            out += more
            held[k] = state, at
        for k, (state, last) in list(held.items()):
            over = self.fold.end(k, state, last, passed, strictly=True)
            if over:
                out += over
                del held[k]
        _put(self.waiting, left)
        _put(self.held, [(k, json.dumps(state), last) for k, (state, last) in held.items()])
        times = [x[1] for x in left] + ([last + self.fold.ttl * 1_000_000 for _, last in held.values()] if self.fold.ttl is not None else [])
        if times:
            self._wake(min(times) // 1000 + 1, mark)
        yield pd.DataFrame(out, columns=self.fold.names())

    def _wake(self, at: int, mark: int) -> None:
        """One timer later than ``mark``, the earliest: those before it go off in this batch, and then set the next one."""
        before = [x for x in self.handle.listTimers() if x > mark]
        if before and min(before) <= at:
            return
        for x in before:
            self.handle.deleteTimer(x)
        self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def _put(state, rows: list[tuple]) -> None:
    if rows:
        state.put(rows)
    else:
        state.clear()


@contextlib.contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Streams that begin in here keep their state in RocksDB, which list states and timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def fold_stream(events: DataFrame, key: str, time: str, order: str, fold: Fold, delay: str = "10 minutes", slots: int = SLOTS) -> DataFrame:
    """The fold's outputs over a stream: those of fold_table for any cut into micro-batches, as far as the watermark has come.

    Events up to ``delay`` behind the newest wait for the watermark; later ones are the
    fold's late output. Keys are dealt to ``slots`` by their hash, and a slot's waiting
    events and states are read at once, since a key by itself costs many calls between
    Python and the state store: some thousands of them should fall to a slot. A running
    stream keeps its number. To be started within stateful().
    """
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    dealt = _events(rows, key, time, order).withColumn("slot", F.pmod(F.xxhash64("key"), F.lit(slots)))
    return dealt.groupBy("slot").transformWithStateInPandas(OrderedProcessor(fold, events.schema[key].dataType.simpleString()), fold.schema, "append", "EventTime")


def fold_table(events: DataFrame, key: str, time: str, order: str, fold: Fold, until: int | None = None) -> DataFrame:
    """The same over a table: each key's events in the order of time, then ``order``; states over before ``until`` (microseconds) end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, last, begun = None, None, None, False
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if not begun or r.key != current:
                    out += fold.end(current, state, last, until, strictly=True) if begun and until is not None else []
                    current, state, last, begun = r.key, None, None, True
                state, more = fold.take(r.key, state, last, int(r.at), json.loads(r.event))
                out += more
                last = int(r.at)
            yield pd.DataFrame(out, columns=fold.names())
        if begun and until is not None:
            yield pd.DataFrame(fold.end(current, state, last, until, strictly=True), columns=fold.names())

    return _events(events, key, time, order).repartition("key").sortWithinPartitions("key", "at", "nth").mapInPandas(run, fold.schema)


def intake_fold(ttl: int = 1800) -> Fold:
    """The intake machine: decisions, and as ``rejects`` what it refuses, as stale events and those of closed sessions, and what came late."""

    def step(state: list, key: str, at: int, event: dict) -> tuple[list, list[tuple]]:
        row = SimpleNamespace(ordinal=event["ordinal"], kind=event["kind"], field=event.get("field"), value=event.get("value"), expected=event.get("expected"))
        after, (_, nth, phase, revision, decision, accepted) = _take(key, tuple(state), row)
        return list(after), [(key, at, nth, phase, revision, decision, "decisions" if accepted else "rejects")]

    late = lambda key, at, e: (key, at, e["ordinal"], None, None, "reject_late", "rejects")
    over = lambda key, state, at: (key, at, None, state[0], state[1], "expired", "ended")
    return Fold(lambda: list(_BEGIN), step, "session string, at long, ordinal long, phase string, revision long, decision string, output string", late, ttl, over)


def limiter_fold(most: int, seconds: int) -> Fold:
    """At most ``most`` admitted events of a key in any such span; the state is the list of admitted times."""
    span = seconds * 1_000_000

    def step(times: list[int], key: Any, at: int, event: dict) -> tuple[list[int], list[tuple]]:
        times = [t for t in times if at - t < span]
        if len(times) < most:
            return [*times, at], [(key, event["nth"], True, 0.0)]
        return times, [(key, event["nth"], False, (times[0] + span - at) / 1e6)]

    return Fold(list, step, "key long, nth long, admitted boolean, retry_after double", lambda key, at, e: (key, e["nth"], None, None))


def arrivals(rows: DataFrame, parts: Sequence[str], path: str) -> None:
    """Write rows as the files of a stream, those of each condition after those before it."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").json(path)


def run_through(spark: SparkSession, path: str, schema: str, build: Callable[[DataFrame], DataFrame], base: str, sink: Callable[[DataFrame, int], None] | None = None, files: int | None = 1) -> DataFrame | None:
    """Read all files of ``path``, some or all (None) at a time, and write what ``build`` makes of them: to a table that is returned, or by ``sink``."""
    source = spark.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", str(files)) if files else source
    with stateful(spark):
        out = build(source.json(path)).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint")
        running = (out.foreachBatch(sink) if sink else out.format("parquet").option("path", f"{base}/out")).start()
        running.awaitTermination()
    return None if sink else spark.read.parquet(f"{base}/out")


def run_parts(rows: DataFrame, parts: Sequence[str], end: tuple, schema: str, build: Callable[[DataFrame, int], DataFrame], base: str) -> DataFrame:
    """The output of a stream of which the rows of each condition arrive after those before it, and ``end`` last.

    Every part is written in as many files as ``rows`` has tasks, and the stream, which goes
    on from its checkpoint, reads those at once. ``build`` gets the stream and its slots.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    rows = scratch.keep(rows, "stream-rows")
    slots = max(16, rows.count() // SLOT_EVENTS)
    for part in (*map(rows.where, parts), spark.createDataFrame([end], schema)):
        part.write.mode("append").json(f"{base}/in")
        out = run_through(spark, f"{base}/in", schema, lambda s: build(s, slots), base, files=None)
    scratch.discard()
    return out


_FAR = "2100-01-01 00:00:00"
_INTAKE = "session string, ordinal long, kind string, field string, value string, expected long, ts string"


def timed_intake(t) -> DataFrame:
    """The event table as intake events with their times; every fifth expects a revision of its own making."""
    rows = intake_events(t, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    return rows.withColumn("expected", F.when(F.col("ordinal") % 5 == 0, F.col("ordinal")))


@query("stm_05_stream_intake")
def _(t):
    """A month of intake events as a stream of ten-day parts with a late straggler of each session of the first day: decisions, rejects and ended sessions."""
    straggler = "ts < '2024-01-02' AND ordinal = 2"
    days = [f"ts >= '2024-01-{a:02d}' AND ts < '2024-01-{b:02d}'" for a, b in ((1, 11), (11, 21))] + ["ts >= '2024-01-21'"]
    parts = [f"{days[0]} AND NOT ({straggler})", days[1], f"{days[2]} OR {straggler}"]
    rows = timed_intake(t).select(*(c.split()[0] for c in _INTAKE.split(", ")))
    build = lambda s, slots: fold_stream(s, "session", "ts", "ordinal", intake_fold(), "2 days", slots)
    out = run_parts(rows, parts, ("-", 0, "start", None, None, None, _FAR), _INTAKE, build, new_path(t.spark, "intake-stream"))
    return out.where("session <> '-'")


_LIMITED = "user_id long, nth long, ts string"


@query("stm_06_stream_limit")
def _(t):
    """The limiter over the event table as a stream of three parts; its rows are those of stm_06_rate_limit."""
    rows = t.events.select("user_id", F.col("event_id").alias("nth"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
    parts = ["ts < '2024-01-12'", "ts >= '2024-01-12' AND ts < '2024-01-20'", "ts >= '2024-01-20'"]
    build = lambda s, slots: fold_stream(s, "user_id", "ts", "nth", limiter_fold(2, 3600), "1 day", slots)
    out = run_parts(rows, parts, (-1, -1, _FAR), _LIMITED, build, new_path(t.spark, "limit-stream"))
    return out.where("nth >= 0").select(F.col("nth").alias("event_id"), "admitted", "retry_after")
