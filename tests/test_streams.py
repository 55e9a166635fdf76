"""Streams against their batch forms, for several cuts into micro-batches and over restarts."""

from __future__ import annotations

import json
import random
import time
from types import SimpleNamespace

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import queries
from corpusloom.plans.scratch import new_path
from corpusloom.streaming import ordered, sessions
from corpusloom.streaming.upserts import LastWrites

KINDS = ["start", "set", "set", "set", "correct", "confirm", "result", "close"]
START = 1_704_067_200


def stamp(seconds):
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(START + seconds))


def intake(rng, n):
    """Events (session, ordinal, kind, field, value, expected, ts) within some hours; some expect a revision."""
    rows = []
    for i in range(n):
        rows.append((f"s{rng.randrange(5)}", i, rng.choice(KINDS), rng.choice([*sessions.SLOTS, "odd"]), rng.choice(["v", None]), rng.choice([None, None, 0, 1, 7]), stamp(rng.randrange(6 * 3600))))
    return rows


def in_parts(spark, rows, schema, cut, path):
    for i in range(0, len(rows), cut):
        spark.createDataFrame(rows[i : i + cut], schema).coalesce(1).write.mode("append").json(path)
        time.sleep(0.05)


def passed(parts, delay):
    """The watermark, in microseconds, before each part is read."""
    out, newest = [], None
    for part in parts:
        out.append(None if newest is None else (newest - delay) * 1_000_000)
        newest = max([newest or 0, *(seconds(r) for r in part)])
    return out


def seconds(row):
    import calendar

    return calendar.timegm(time.strptime(row[-1], "%Y-%m-%d %H:%M:%S"))


@pytest.mark.parametrize("cut", [7, 40, 200])
def test_intake_of_any_cut_equals_the_fold(spark, cut):
    """Shuffled within the delay nothing is late, whatever the cut; ended sessions come too."""
    base = new_path(spark, "test-intake")
    rows = sorted(intake(random.Random(4), 120), key=lambda r: (r[-1], r[1]))
    rows = [r for i in range(0, 120, 6) for r in random.Random(i).sample(rows[i : i + 6], 6)]
    in_parts(spark, rows, ordered._INTAKE, cut, f"{base}/in")
    spark.createDataFrame([("-", 0, "start", None, None, None, ordered._FAR)], ordered._INTAKE).coalesce(1).write.mode("append").json(f"{base}/in")
    fold = ordered.intake_fold(1800)
    out = ordered.run_through(spark, f"{base}/in", ordered._INTAKE, lambda s: ordered.fold_stream(s, "session", "ts", "ordinal", fold, "2 hours"), base)
    table = spark.createDataFrame(rows, ordered._INTAKE)
    want = ordered.fold_table(table, "session", "ts", "ordinal", fold, until=(START + 10**7) * 1_000_000).collect()
    assert sorted(map(str, out.where("session <> '-'").collect())) == sorted(map(str, want))
    kinds = {(r.output, r.decision) for r in want}
    assert {("rejects", "reject_stale"), ("ended", "expired"), ("decisions", "ask_place")} <= kinds and len(want) > 120


def test_fold_by_hand(spark):
    """A stale event is refused; half an hour without events ends a session, and the next event begins another."""
    events = [("s", 1, "start", None, None, None, stamp(0)), ("s", 2, "set", "date", "x", 5, stamp(10)), ("s", 3, "set", "date", "x", 0, stamp(20)), ("s", 4, "set", "place", "y", 1, stamp(1820)), ("q", 1, "start", None, None, None, stamp(0))]
    out = ordered.fold_table(spark.createDataFrame(events, ordered._INTAKE), "session", "ts", "ordinal", ordered.intake_fold(1800), until=(START + 2000) * 1_000_000)
    at = lambda s: (START + s) * 1_000_000
    assert sorted(map(tuple, out.where("session = 's'").collect()), key=lambda r: (r[1], r[2] is not None)) == [
        ("s", at(0), 1, "collecting", 0, "ask_date", "decisions"), ("s", at(10), 2, "collecting", 0, "reject_stale", "rejects"), ("s", at(20), 3, "collecting", 1, "ask_place", "decisions"),
        ("s", at(1820), None, "collecting", 1, "expired", "ended"), ("s", at(1820), 4, "collecting", 0, "reject_stale", "rejects"),
    ]
    assert sorted(r.decision for r in out.where("session = 'q'").collect()) == ["ask_date", "expired"]


def test_late_events_are_rejects(spark):
    """An event behind the watermark of the parts before it is refused as late and changes no state."""
    base = new_path(spark, "test-late")
    parts = [[("s", 1, "start", None, None, None, stamp(0)), ("s", 2, "set", "date", "x", None, stamp(4000))], [("s", 9, "close", None, None, None, stamp(3300)), ("s", 3, "set", "place", "y", None, stamp(3700)), ("s", 4, "set", "purpose", "z", None, stamp(9000))]]
    for part in parts:
        in_parts(spark, part, ordered._INTAKE, 10, f"{base}/in")
    in_parts(spark, [("-", 0, "start", None, None, None, ordered._FAR)], ordered._INTAKE, 1, f"{base}/in")
    fold = ordered.intake_fold(7200)
    out = ordered.run_through(spark, f"{base}/in", ordered._INTAKE, lambda s: ordered.fold_stream(s, "session", "ts", "ordinal", fold, "10 minutes"), base).where("session = 's'")
    marks = passed(parts, 600)
    late = [r for part, mark in zip(parts, marks) for r in part if mark is not None and seconds(r) * 1_000_000 < mark]
    assert [r[1] for r in late] == [9]
    assert [(r.ordinal, r.output) for r in out.where("decision = 'reject_late'").collect()] == [(9, "rejects")]
    assert [(r.ordinal, r.decision) for r in out.where("output = 'decisions'").orderBy("at").collect()] == [(1, "ask_date"), (3, "ask_date"), (2, "ask_purpose"), (4, "ask_confirm")]
    assert out.where("output = 'ended'").count() == 1


@pytest.mark.parametrize("cut", [5, 60])
def test_limiter_of_any_cut(spark, cut):
    rng = random.Random(8)
    rows = sorted((rng.randrange(3), i, stamp(rng.randrange(900))) for i in range(100))
    rows = sorted(rows, key=lambda r: r[2])
    base = new_path(spark, "test-limit")
    in_parts(spark, rows, ordered._LIMITED, cut, f"{base}/in")
    in_parts(spark, [(-1, -1, ordered._FAR)], ordered._LIMITED, 1, f"{base}/in")
    out = ordered.run_through(spark, f"{base}/in", ordered._LIMITED, lambda s: ordered.fold_stream(s, "user_id", "ts", "nth", ordered.limiter_fold(4, 60), "5 minutes"), base).where("nth >= 0")
    table = spark.createDataFrame(rows, ordered._LIMITED).withColumn("ts", F.col("ts").cast("timestamp"))
    want = sessions.rate_limit(table, "user_id", "nth", "ts", 4, 60).select("nth", "admitted", "retry_after")
    assert sorted(map(tuple, out.select("nth", "admitted", "retry_after").collect())) == sorted(map(tuple, want.collect())) and 0 < want.where("admitted").count() < 100


def test_limit_query_equals_the_table_s(spark, sf_dir):
    one, two = (queries()[n](spark, sf_dir).select("event_id", "admitted", "retry_after").collect() for n in ("stm_06_stream_limit", "stm_06_rate_limit"))
    assert sorted(map(tuple, one)) == sorted(map(tuple, two))


def test_intake_query(spark, sf_dir):
    """All rows of the query: late ones by the watermarks of its parts, the rest by the fold without them."""
    from corpusloom.registry import Tables

    out = queries()["stm_05_stream_intake"](spark, sf_dir).collect()
    rows = ordered.timed_intake(Tables(spark, sf_dir))
    late = {(r.session, r.ordinal) for r in rows.where("ts < '2024-01-02' AND ordinal = 2").collect()}
    assert {(r.session, r.ordinal) for r in out if r.decision == "reject_late"} == late and late
    kept = rows.where("NOT (ts < '2024-01-02' AND ordinal = 2)")
    want = ordered.fold_table(kept, "session", "ts", "ordinal", ordered.intake_fold(), until=4 * 10**15).collect()
    assert sorted(map(str, (r for r in out if r.decision != "reject_late"))) == sorted(map(str, want))


SCHEMA = "k long, at long, v string"


class Dies(LastWrites):
    """Dies once between writing a batch and its ledger entry."""

    deaths = 1

    def commit(self, batch, held):
        if batch == 2 and Dies.deaths:
            Dies.deaths = 0
            raise RuntimeError("killed")
        super().commit(batch, held)


def test_killed_between_write_and_commit(spark):
    base = new_path(spark, "test-upserts")
    rng = random.Random(3)
    rows = [(rng.randrange(30), rng.randrange(1000), f"v{i}") for i in range(200)] + [(None, 1, "none"), (5, None, "unordered")]
    in_parts(spark, rows, SCHEMA, 50, f"{base}/in")
    sink = Dies(spark, f"{base}/table", "k", "at", ["v"], SCHEMA, buckets=4)
    with pytest.raises(Exception, match="killed"):
        ordered.run_through(spark, f"{base}/in", SCHEMA, lambda s: s, base, sink.merge)
    assert sink._entries() == [0, 1]
    seen = sink.table().count()
    ordered.run_through(spark, f"{base}/in", SCHEMA, lambda s: s, base, sink.merge)  # the checkpoint repeats batch 2
    assert sink._entries() == list(range(5)) and seen <= sink.table().count()
    want = {}
    for k, at, v in rows:
        if k is not None:
            want[k] = max(want.get(k, (False, 0, "")), (at is not None, at or 0, v))
    assert {r.k: (r.at, r.v) for r in sink.table().collect()} == {k: (at if has else None, v) for k, (has, at, v) in want.items()}
    before = sorted(map(tuple, sink.table().collect()))
    assert not sink.merge(spark.createDataFrame([(1, 9999, "again")], SCHEMA), 3)
    assert sorted(map(tuple, sink.table().collect())) == before
    assert sink.merge(spark.createDataFrame([(k, 10_000, "all") for k in range(30)], SCHEMA), 9) and sink.vacuum() >= 1
    assert {r.v for r in sink.table().collect()} == {"all"}


class Handle:
    """A processor's state in lists, with a count of the calls."""

    def __init__(self):
        self.calls, self.timers, self.lists = 0, [], {}

    def getListState(self, name, schema):  # noqa: N802
        rows = self.lists.setdefault(name, [])
        took = lambda change: lambda *x: (setattr(self, "calls", self.calls + 1), change(*x))[1]
        return SimpleNamespace(get=took(lambda: iter(list(rows))), appendList=took(rows.extend), put=took(lambda new: rows.__setitem__(slice(None), new)), clear=took(rows.clear))

    def listTimers(self):  # noqa: N802
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)


def test_calls_of_many_keys():
    """A thousand keys of a slot take as many calls to the state store as one, and one timer."""
    calls = []
    for n in (1, 1000):
        handle, processor = Handle(), ordered.OrderedProcessor(ordered.limiter_fold(2, 3600), "long")
        processor.init(handle)
        rows = pd.DataFrame([(i, 1_000_000 * (i % 50 + 1), i, json.dumps({"nth": i})) for i in range(n)], columns=["key", "at", "nth", "event"])
        now = lambda ms: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)
        assert sum(len(x) for x in processor.handleInputRows((0,), iter([rows]), now(0))) == 0
        assert handle.timers == [1001]
        handle.timers.clear()
        out = pd.concat(processor.handleExpiredTimer((0,), now(60_000), None))
        assert sorted(out["nth"]) == list(range(n)) and out["admitted"].all() and not handle.timers and len(handle.lists["held"]) == n
        calls.append(handle.calls)
    assert calls[0] == calls[1] < 10
