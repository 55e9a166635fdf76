"""State by key over events: sessions, an intake machine, rate limits, replays.

Each has a batch form, a fold over a key's ordered events, and where it makes sense a
streaming form. Streams carry a watermark, by default of ten minutes; later events are
dropped by Spark. That policy is this library's own.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.registry import query

#: Seconds after which a session without events is over.
TTL_SECONDS = 1800


def sessions(events: DataFrame, key: str, time: str, gap: str = "30 minutes", watermark: str | None = None) -> DataFrame:
    """(key, start, end, n) of runs of events with less than ``gap`` between neighbours; for tables and streams."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, watermark) if watermark else rows
    grouped = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expired(states: DataFrame, updated: str, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """The sessions that time has run out for."""
    return states.where(F.unix_seconds(now) - F.unix_seconds(F.col(updated).cast("timestamp")) >= ttl)


def trailing_rate(events: DataFrame, key: str, time: str, seconds: int) -> DataFrame:
    """Each event with the number of its key's events in the seconds before it, itself included."""
    at = F.unix_micros(F.col(time).cast("timestamp"))
    span = Window.partitionBy(key).orderBy("_at").rangeBetween(-seconds * 1_000_000 + 1, 0)
    return events.withColumn("_at", at).withColumn("n_recent", F.count("*").over(span)).drop("_at")


def rate_limit(events: DataFrame, key: str, order: str, time: str, most: int, seconds: int) -> DataFrame:
    """(key, order, admitted, retry_after): at most ``most`` admitted events in any such span.

    Denied events don't count, so admission depends on all admissions before: a fold
    over each key's events in their order, in Arrow batches with a bounded queue.
    """

    span = seconds * 1_000_000

    def begin() -> deque:
        return deque()

    def step(queue: deque, row) -> tuple[deque, tuple]:
        while queue and row.x_at - queue[0] >= span:
            queue.popleft()
        if len(queue) < most:
            queue.append(row.x_at)
            return queue, (row.x_key, row.x_order, True, 0.0)
        return queue, (row.x_key, row.x_order, False, (queue[0] + span - row.x_at) / 1e6)

    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = events.select(F.col(key).alias("_key"), F.col(order).alias("_order"), at.alias("_at"))
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, order)}
    names = [key, order, "admitted", "retry_after"]
    return fold_by_key(rows, "_key", ["_at", "_order"], begin, step, names, f"{key} {kinds[key]}, {order} {kinds[order]}, admitted boolean, retry_after double")


def fold_by_key(rows: DataFrame, key: str, order: Sequence[str], begin: Callable, step: Callable, names: Sequence[str], schema: str, tasks: int | None = None) -> DataFrame:
    """Fold each key's rows in their order: ``step`` takes a state and a row, and gives both the next state and a result.

    Rows are dealt by key, to ``tasks`` if given, and sorted by Spark; a task then runs through them in Arrow
    batches and holds one state, however many rows a key has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, started = None, None, False
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False, name="Row"):
                if not started or row[0] != current:
                    current, state, started = row[0], begin(), True
                state, result = step(state, row)
                out.append(result)
            yield pd.DataFrame(out, columns=list(names))

    own = rows.withColumnsRenamed({c: _plain(c) for c in rows.columns}).select(_plain(key), *(_plain(c) for c in rows.columns if c != key))
    dealt = own.repartition(tasks, _plain(key)) if tasks else own.repartition(_plain(key))
    return dealt.sortWithinPartitions(_plain(key), *(_plain(c) for c in order)).mapInPandas(run, schema)


def _plain(name: str) -> str:
    """A name that a named tuple can have."""
    return "x" + name if name.startswith("_") else name


#: What an intake session collects, in the order in which it asks.
SLOTS = ("date", "place", "purpose")
_STATE = "phase string, revision long, slots map<string,string>, result string"
_OUT = "session string, ordinal long, phase string, revision long, decision string, accepted boolean"


def advance(state: tuple, kind: str, field: str | None, value: str | None, expected: int | None) -> tuple[tuple, str, bool]:
    """The next state, the decision and whether the event was accepted.

    A state is (phase, revision, slots, result). Setting or correcting a slot drops the
    result and raises the revision; an event made for another revision is stale.
    """
    phase, revision, slots, result = state
    if phase == "closed":
        return state, "reject_closed", False
    if expected is not None and expected != revision:
        return state, "reject_stale", False
    if kind == "start":
        return ("collecting", revision, slots, result), next_decision("collecting", slots, result), True
    if kind in ("set", "correct"):
        if field not in SLOTS or not value:
            return state, "reject_slot", False
        if kind == "set" and field in slots:
            return state, "reject_filled", False
        slots = slots | {field: value}
        return ("collecting", revision + 1, slots, None), next_decision("collecting", slots, None), True
    if kind == "confirm":
        if next_decision(phase, slots, result) != "ask_confirm":
            return state, "reject_incomplete", False
        return ("ready", revision, slots, result), "run", True
    if kind == "result":
        if phase != "ready":
            return state, "reject_result", False
        return ("answered", revision, slots, value or ""), "answer", True
    if kind == "close":
        return ("closed", revision, slots, None), "bye", True
    return state, "reject_unknown", False


def next_decision(phase: str, slots: dict, result: str | None) -> str:
    """What to do in a state: ask for the first missing slot, ask to confirm, run, or answer."""
    missing = [s for s in SLOTS if s not in slots]
    if phase == "ready":
        return "run"
    if phase == "answered":
        return "answer"
    return f"ask_{missing[0]}" if missing else "ask_confirm"


def next_decision_column(phase: str, slots: str) -> Column:
    """The same over columns."""
    ask = F.lit("ask_confirm")
    for slot in reversed(SLOTS):
        ask = F.when(~F.map_contains_key(slots, F.lit(slot)), f"ask_{slot}").otherwise(ask)
    return F.when(F.col(phase) == "ready", "run").when(F.col(phase) == "answered", "answer").otherwise(ask)


_BEGIN = ("collecting", 0, {}, None)


def _take(session: str, state: tuple, row) -> tuple[tuple, tuple]:
    expected = None if row.expected is None or row.expected != row.expected else int(row.expected)
    field, value = (None if x is None or x != x else x for x in (row.field, row.value))
    state, decision, accepted = advance(state, row.kind, field, value, expected)
    return state, (session, int(row.ordinal), state[0], state[1], decision, accepted)


_COLUMNS = ["session", "ordinal", "phase", "revision", "decision", "accepted"]


def replay(events: DataFrame) -> DataFrame:
    """Fold the events (session, ordinal, kind, field, value, expected) of each session in their order."""

    return fold_by_key(events.select("session", "ordinal", "kind", "field", "value", "expected"), "session", ["ordinal"], lambda: _BEGIN, lambda state, row: _take(row.session, state, row), _COLUMNS, _OUT)


def intake_stream(events: DataFrame, ttl: int | None = TTL_SECONDS) -> DataFrame:
    """The same over a stream: state by session, which ends after ``ttl`` seconds without events, if given.

    With a time limit Spark goes on making batches when no events come, to see which
    sessions are over.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        phase, revision, slots, result = state.get if state.exists else _BEGIN
        now = (phase, revision, dict(slots), result)
        out = []
        for row in pd.concat(list(batches)).sort_values("ordinal").itertuples():
            now, result = _take(key[0], now, row)
            out.append(result)
        state.update(now)
        if ttl is not None:
            state.setTimeoutDuration(ttl * 1000)
        yield pd.DataFrame(out, columns=_COLUMNS)

    return events.groupBy("session").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout if ttl is None else GroupStateTimeout.ProcessingTimeTimeout)


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """The rows whose key isn't done."""
    return rows.join(done.select(key), key, "left_anti")


def rehydrated(stored: DataFrame, computed: DataFrame, key: str, value: str) -> DataFrame:
    """(key, trusted): whether a stored value equals the one computed anew."""
    both = computed.select(key, F.col(value).alias("_new")).join(stored.select(key, F.col(value).alias("_old")), key, "left")
    return both.select(key, F.col("_new").eqNullSafe(F.col("_old")).alias("trusted"))


def latest(log: DataFrame, key: str, order: str, values: list[str]) -> DataFrame:
    """The last entry of each key."""
    return log.groupBy(key).agg(F.max_by(F.struct(*values), order).alias("x")).select(key, "x.*")


def intake_events(t, *more: Column) -> DataFrame:
    """The event table as intake events: one session for each user and day; ``more`` columns of events go with them."""
    order = Window.partitionBy("session").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "click", "set").when(F.col("event_type") == "view", "correct").when(F.col("event_type") == "purchase", "confirm").otherwise("result")
    rows = t.events.withColumn("session", F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "MMdd")))
    slot = F.get(F.array(*map(F.lit, SLOTS)), F.col("event_id") % 3)
    return rows.select("session", F.row_number().over(order).cast("long").alias("ordinal"), kind.alias("kind"), slot.alias("field"), F.col("value").cast("string").alias("value"), F.lit(None).cast("long").alias("expected"), *more)


@query("stm_01_intake_replay")
def _(t):
    return replay(intake_events(t))


@query("stm_02_revisions")
def _(t):
    out = replay(intake_events(t))
    return out.groupBy("session").agg(F.max("revision").alias("revision"), F.count_if("accepted").alias("n_accepted"))


@query("stm_03_next_decision", "SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'run' WHEN event_type = 'error' THEN 'answer' WHEN user_id % 2 = 0 THEN 'ask_place' ELSE 'ask_date' END AS decision FROM events")
def _(t):
    phase = F.when(F.col("event_type") == "purchase", "ready").when(F.col("event_type") == "error", "answered").otherwise("collecting")
    slots = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("date"), F.lit("x"))).otherwise(F.create_map(F.lit("purpose"), F.lit("x")))
    rows = t.events.select("event_id", phase.alias("phase"), slots.alias("slots"))
    return rows.select("event_id", next_decision_column("phase", "slots").alias("decision"))


@query("stm_04_stale_events")
def _(t):
    stale = intake_events(t).withColumn("expected", F.when(F.col("ordinal") % 4 == 0, F.lit(99)))
    return replay(stale).groupBy("decision").agg(F.count("*").alias("n"))


@query("stm_05_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, count(DISTINCT k) AS n_sessions, count(*) AS n FROM s GROUP BY user_id""")
def _(t):
    return sessions(t.events, "user_id", "ts").groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.sum("n").alias("n"))


@query("stm_05_expired", "SELECT user_id FROM events GROUP BY user_id HAVING epoch(TIMESTAMP '2024-01-31 00:00:00') - floor(epoch(max(ts))) >= 1800")
def _(t):
    states = t.events.groupBy("user_id").agg(F.max("ts").alias("updated"))
    return expired(states, "updated", F.lit("2024-01-31 00:00:00").cast("timestamp")).select("user_id")


@query("stm_06_trailing_rate", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3599999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS n_recent FROM events")
def _(t):
    return trailing_rate(t.events, "user_id", "ts", 3600).select("event_id", "n_recent")


@query("stm_06_rate_limit")
def _(t):
    return rate_limit(t.events, "user_id", "event_id", "ts", 2, 3600).select("event_id", "admitted", "retry_after")


@query("stm_07_resume", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def _(t):
    return resume(t.events, t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("event_id")), "event_id").select("event_id")


@query("stm_08_10_final_states")
def _(t):
    return latest(replay(intake_events(t)), "session", "ordinal", ["phase", "revision", "decision"])


@query("stm_09_rehydration", "SELECT doc_id, NOT contains(text, chr(10)) AND l IS NOT NULL AS trusted FROM documents LEFT JOIN (SELECT doc_id, 1 AS l FROM labels) USING (doc_id)")
def _(t):
    """Stored digests are of the labelled texts without their line ends."""
    new = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    old = t.documents.join(t.labels, "doc_id").select("doc_id", F.sha2(F.replace("text", F.lit("\n"), F.lit("")), 256).alias("h"))
    return rehydrated(old, new, "doc_id", "h")


@query("stm_11_last_write", "SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def _(t):
    return latest(t.events, "user_id", "event_id", ["event_type"])
