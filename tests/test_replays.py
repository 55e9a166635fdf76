"""Logs replayed over the tables, against a plain version."""

from __future__ import annotations

from collections import Counter

import pytest

from corpusloom.catalog import queries
from corpusloom.registry import Tables
from corpusloom.streaming import replays


def plain_replay(drafts, reviews, stored, most=2):
    """Rows (record, sequence, log, entry, status, rewrites, problem) by loops over sorted entries."""
    entries = [(r.record, r.sequence, log, r.body, r.draft, r.verdict) for log, rows in (("drafts", drafts), ("reviews", reviews)) for r in rows if r.record is not None]
    out, states = [], {}
    key = lambda e: (e[0], e[1], e[2], e[3], e[4] or "", e[5] or "")
    seen, first = set(), {}
    for e in sorted(entries, key=key):
        entry = "repeat" if e in seen else "conflict" if first.setdefault(e[:2], e) != e else "first"
        seen.add(e)
        state = states.get(e[0], {"status": "needs_draft", "rewrites": 0, "draft": None})
        problem = None
        if entry == "first":
            wants = "needs_draft" if e[2] == "drafts" else "needs_review"
            if state["status"] != wants:
                problem = "out_of_turn"
            elif e[2] == "reviews" and e[4] != state["draft"]:
                problem = "unlinked"
            elif e[2] == "drafts" and e[5] is None:
                state = state | {"status": "needs_review", "draft": e[3]}
            elif e[2] == "reviews" and e[5] == "pass":
                state = state | {"status": "accepted"}
            else:
                n = state["rewrites"] + 1
                state = {"status": "failed" if n > most else "needs_draft", "rewrites": n, "draft": None}
        states[e[0]] = state
        out.append((*e[:3], entry, state["status"], state["rewrites"], problem))
    for s in stored:
        state = states.get(s.record, {"status": "needs_draft", "rewrites": 0, "draft": None})
        wrong = [f for f in ("status", "rewrites", "draft") if state[f] != getattr(s, f)]
        out.append((s.record, None, "state", "stored", state["status"], state["rewrites"], ",".join(wrong) or None))
    return out


def test_replay_of_the_tables(spark, sf_dir):
    logs, stored = replays.event_logs(Tables(spark, sf_dir))
    want = plain_replay(logs["drafts"].collect(), logs["reviews"].collect(), stored.collect(), 40)
    assert Counter(map(tuple, queries()["stm_08_replayed_logs"](spark, sf_dir).collect())) == Counter(want)
    assert {r[3] for r in want} == {"first", "repeat", "conflict", "stored"} and {"out_of_turn", "unlinked"} <= {r[6] for r in want}


def test_by_hand(spark):
    entry = "record long, sequence long, body string, draft string, verdict string"
    drafts = [(1, 1, "d1", None, None), (1, 4, "d2", None, None), (1, 4, "d2", None, None), (1, 9, "d3", None, None), (2, 1, "a", None, "bad"), (2, 2, "b", None, "bad"), (2, 3, "c", None, "bad"), (2, 4, "d", None, None), (None, 1, "x", None, None)]
    reviews = [(1, 2, "r1", "other", "pass"), (1, 3, "r2", "d1", "revise"), (1, 5, "r3", "d2", "pass"), (1, 5, "r4", "d2", "revise"), (2, 9, "r", None, "pass")]
    stored = [(1, "accepted", 1, "d2"), (2, "failed", 3, "x"), (3, "needs_draft", 0, None), (4, "accepted", None, None)]
    logs = {"drafts": spark.createDataFrame(drafts, entry), "reviews": spark.createDataFrame(reviews, entry)}
    out = replays.replay_logs(logs, spark.createDataFrame(stored, "record long, status string, rewrites long, draft string")).collect()
    one = sorted((r.sequence or 99, r.entry, r.status, r.rewrites, r.problem) for r in out if r.record == 1)
    assert one == [
        (1, "first", "needs_review", 0, None), (2, "first", "needs_review", 0, "unlinked"), (3, "first", "needs_draft", 1, None), (4, "first", "needs_review", 1, None), (4, "repeat", "needs_review", 1, None),
        (5, "conflict", "accepted", 1, None), (5, "first", "accepted", 1, None), (9, "first", "accepted", 1, "out_of_turn"), (99, "stored", "accepted", 1, None),
    ]
    assert [(r.record, r.status, r.problem) for r in sorted(out, key=lambda r: r.record) if r.entry == "stored"] == [(1, "accepted", None), (2, "failed", "draft"), (3, "needs_draft", None), (4, "needs_draft", "status,rewrites")]
    assert sorted(map(tuple, replays.gaps(replays.merge_logs(logs)).collect())) == [(1, 6, 8), (2, 5, 8)]


@pytest.mark.parametrize("name", ["stm_08_gaps", "stm_08_replayed_logs"])
def test_tasks_grow_with_events(spark, sf_dir, monkeypatch, name):
    """A task has as many events however many there are, whatever Spark would join."""
    few = queries()[name](spark, sf_dir)
    want = Counter(map(tuple, few.collect()))
    monkeypatch.setattr(replays, "TASK_EVENTS", 100)
    many = queries()[name](spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    assert (few.rdd.getNumPartitions(), many.rdd.getNumPartitions()) == (1, -(-n // 100))
    assert Counter(map(tuple, many.collect())) == want
