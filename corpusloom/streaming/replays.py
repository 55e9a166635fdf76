"""Records rebuilt from several logs, merged in their order and compared with what was stored."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.registry import query
from corpusloom.streaming.sessions import fold_by_key

#: Rounds of rewriting after which a record has failed.
MOST_REWRITES = 2
#: Events whose rows one task sorts and merges; a task holds a few copies of them.
TASK_EVENTS = 1 << 17
_ENTRY = ("record", "sequence", "body", "draft", "verdict")
_STATE = ("record", "status", "rewrites", "draft")


def tasks_for(n: int) -> int:
    """How many tasks rows of ``n`` events are dealt to, so that a task's memory doesn't grow with their number."""
    return max(1, -(-n // TASK_EVENTS))


def merge_logs(logs: Mapping[str, DataFrame], tasks: int | None = None) -> DataFrame:
    """(record, sequence, log, body, draft, verdict, entry) of several logs with these columns, a row for each entry of a record.

    ``entry`` is first; of entries with a sequence that the record has already, which
    are told by their log and body, repeat where all is equal and conflict where not: of
    these the first by log and body counts. Null records are left out. Records are dealt
    to ``tasks``, by default as many as the session has it.
    """
    rows = None
    for name, log in logs.items():
        own = log.select(*_ENTRY).withColumn("log", F.lit(name))
        rows = own if rows is None else rows.union(own)
    rows = rows.where("record IS NOT NULL AND sequence IS NOT NULL")
    rows = rows.repartition(tasks, "record") if tasks else rows
    counted = rows.groupBy("record", "sequence", "log", "body", "draft", "verdict").agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy("record", "sequence").orderBy("log", "body", "draft", "verdict"))
    counted = counted.withColumn("_nth", nth)
    each = counted.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))))
    entry = F.when(F.col("_copy") > 1, "repeat").when(F.col("_nth") > 1, "conflict").otherwise("first")
    return each.select("record", "sequence", "log", "body", "draft", "verdict", entry.alias("entry"))


def gaps(entries: DataFrame) -> DataFrame:
    """(record, first, last) of the sequence numbers, from 1, that a record's entries lack."""
    own = entries.select("record", "sequence").distinct()
    before = F.coalesce(F.lag("sequence").over(Window.partitionBy("record").orderBy("sequence")), F.lit(0).cast("long"))
    return own.withColumn("_b", before).where(F.col("sequence") > F.col("_b") + 1).select("record", (F.col("_b") + 1).alias("first"), (F.col("sequence") - 1).alias("last"))


def advance_record(state: tuple, log: str, body: str, draft: str | None, verdict: str | None, most: int = MOST_REWRITES) -> tuple[tuple, str | None]:
    """The next (status, rewrites, draft) and what is wrong with the entry, which then changes nothing.

    A draft is taken when one is needed; its verdict is null if it's valid. A review is
    taken of the draft that waits for it: ``pass`` accepts the record. An invalid draft and
    any other verdict cost a rewrite.
    """
    status, rewrites, held = state
    spent = lambda: ("failed" if rewrites + 1 > most else "needs_draft", rewrites + 1, None)
    if log == "drafts":
        if status != "needs_draft":
            return state, "out_of_turn"
        return (("needs_review", rewrites, body) if verdict is None else spent()), None
    if status != "needs_review":
        return state, "out_of_turn"
    if draft != held:
        return state, "unlinked"
    return (("accepted", rewrites, held) if verdict == "pass" else spent()), None


def replay_logs(logs: Mapping[str, DataFrame], stored: DataFrame, most: int = MOST_REWRITES, tasks: int | None = None) -> DataFrame:
    """(record, sequence, log, entry, status, rewrites, problem): each entry with the record's state after it.

    ``logs``: ``drafts`` and ``reviews``. Repeats and conflicts change nothing. The stored state
    (record, status, rewrites, draft) is merged in behind a record's last entry; its
    problem names the fields that differ from the replay, and a record without entries is
    compared with one that needs its first draft. Rows of a record run through one task
    in their order, and only its state is held; ``tasks`` are those of merge_logs.
    """
    none = lambda kind: F.lit(None).cast(kind)
    entries = merge_logs(logs, tasks).withColumns({"last": F.lit(0), "rewrites": none("long")})
    state = stored.where("record IS NOT NULL").select("record", none("long").alias("sequence"), F.lit("state").alias("log"), F.col("status").alias("body"), "draft", none("string").alias("verdict"), F.lit("stored").alias("entry"), F.lit(1).alias("last"), F.col("rewrites").cast("long"))
    begin = lambda: ("needs_draft", 0, None)
    plain = lambda x: None if x is None or x != x else x

    def step(now: tuple, row) -> tuple[tuple, tuple]:
        if row.entry == "stored":
            theirs = (plain(row.body), None if plain(row.rewrites) is None else int(row.rewrites), plain(row.draft))
            wrong = [n for n, a, b in zip(_STATE[1:], now, theirs) if a != b]
            return now, (row.record, None, row.log, row.entry, now[0], now[1], ",".join(wrong) or None)
        problem = None
        if row.entry == "first":
            now, problem = advance_record(now, row.log, row.body, plain(row.draft), plain(row.verdict), most)
        return now, (row.record, int(row.sequence), row.log, row.entry, now[0], now[1], problem)

    schema = "record long, sequence long, log string, entry string, status string, rewrites long, problem string"
    order = ["last", "sequence", "log", "body", "draft", "verdict", "entry"]
    return fold_by_key(entries.unionByName(state), "record", order, begin, step, [c.split()[0] for c in schema.split(", ")], schema, tasks)


def event_logs(t, tasks: int = 1) -> tuple[dict[str, DataFrame], DataFrame]:
    """Logs of users' events: clicks, views and signups are drafts, purchases reviews; errors leave gaps, high values come twice, and signups are in both logs. Stored states are made of customers."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t.events.repartition(tasks, "user_id").withColumn("sequence", F.row_number().over(order).cast("long"))
    kind = F.col("event_type").isin("click", "view", "signup")
    rows = rows.withColumn("_d", F.last(F.when(kind, F.col("event_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    common = [F.col("user_id").alias("record"), "sequence", F.col("event_id").cast("string").alias("body")]
    drafts = rows.where(kind).select(*common, F.lit(None).cast("string").alias("draft"), F.when(F.col("value") < 20, "too low").alias("verdict"), "value")
    linked = F.when(F.col("value") < 90, F.col("_d")).otherwise(F.col("event_id")).cast("string").alias("draft")
    reviews = rows.where(F.col("event_type").isin("purchase", "signup")).select(*common, linked, F.when(F.col("value") > 60, "pass").otherwise("revise").alias("verdict"), "value")
    twice = lambda df: df.drop("value").union(df.where("value > 95").drop("value"))
    status = F.when(F.col("c_mktsegment") == "BUILDING", "accepted").when(F.col("c_mktsegment") == "MACHINERY", "failed").otherwise("needs_draft")
    stored = t.customer.join(t.events.select(F.col("user_id").alias("c_custkey")).distinct(), "c_custkey", "left_semi")
    stored = stored.select(F.col("c_custkey").alias("record"), status.alias("status"), (F.col("c_nationkey") % 3).alias("rewrites"), F.lit(None).cast("string").alias("draft"))
    return {"drafts": twice(drafts), "reviews": twice(reviews)}, stored


@query("stm_08_replayed_logs")
def _(t):
    tasks = tasks_for(t.events.count())
    logs, stored = event_logs(t, tasks)
    return replay_logs(logs, stored, 40, tasks)


@query("stm_08_gaps", """
WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), k AS (SELECT user_id, n, coalesce(lag(n) OVER (PARTITION BY user_id ORDER BY n), 0) AS b FROM e WHERE event_type <> 'error')
SELECT user_id AS record, b + 1 AS first, n - 1 AS last FROM k WHERE n > b + 1""")
def _(t):
    tasks = tasks_for(t.events.count())
    return gaps(merge_logs(event_logs(t, tasks)[0], tasks))
