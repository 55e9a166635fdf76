"""Scores and grades of replies, and the intake machine's rows over the tables, against plain versions."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import oracle_sql, queries
from corpusloom.operators import scoring
from corpusloom.operators.claims import ClaimGrammar
from corpusloom.registry import Tables
from corpusloom.streaming import sessions

RULES = scoring.ScoreRules(
    grammar=ClaimGrammar(labels={"status": "status", "grade": "grade"}, value="[A-Z]", forward=" is ", denied=" *not"), special=r"<\|[a-z]+\|>", foreign="[é]{2}", severe="harm", entities="@[a-z]+|[0-9]{6,}",
    dates="[0-9]{4}-[0-9]{2}-[0-9]{2}", causal="because", softened="perhaps", fact_axis="facts", rule_axis="rules", story_axis="story", chat_axis="chat", fabricated=2,
)


def scored(spark, **x):
    row = {"axis": "chat", "prompt": "status is A", "reply": "fine", "facts": {}, "rule_holds": None, "cut_off": False} | x
    df = spark.createDataFrame([tuple(row.values())], "axis string, prompt string, reply string, facts map<string,string>, rule_holds boolean, cut_off boolean")
    return scoring.score_replies(df, RULES).first().asDict()


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ({}, {"generation_clean": True, "nonempty": True, "input_fact_violation": False, "task_confusion": False, "repetition": False, "fact_contract_pass": None, "rule_contract_pass": None, "grounded_fact_pass": False, "noncausal_pass": None, "output_characters": 4, "json_parse": False}),
        ({"reply": " \n"}, {"nonempty": False, "generation_clean": False, "output_characters": 0}), ({"reply": None, "prompt": None}, {"nonempty": False, "input_fact_violation": None, "grounded_fact_pass": None}),
        ({"reply": "ok <|end|>"}, {"special_or_control": True, "generation_clean": False}), ({"cut_off": True}, {"generation_clean": False}), ({"reply": "Plain. Bééb here"}, {"foreign_sentence": True}), ({"reply": "no harm"}, {"severe_safety": True}),
        ({"reply": "ask @bob"}, {"sensitive_entity": True}), ({"reply": "ask @bob", "prompt": "who is @bob"}, {"sensitive_entity": False}), ({"reply": "on 2024-01-02", "prompt": "on 2024-01-02"}, {"unsupported_full_date": False}), ({"reply": "on 2024-01-03"}, {"unsupported_full_date": True}),
        ({"reply": "status is B"}, {"input_fact_violation": True, "grounded_fact_pass": False, "task_confusion": True, "fabricated_values": False}), ({"reply": "status is A"}, {"input_fact_violation": False, "grounded_fact_pass": True}),
        ({"reply": "grade is B. status is C"}, {"fabricated_values": True}), ({"reply": "One. Two. One."}, {"repetition": True}), ({"reply": "a b c d " * 2}, {"repetition": False}), ({"reply": "a b c d " * 3}, {"repetition": True}),
        ({"axis": "facts", "facts": {"grade": "Z"}, "reply": "grade is Z"}, {"fact_contract_pass": True, "task_confusion": None}), ({"axis": "facts", "facts": {"grade": "Z", "status": "A"}, "reply": "grade is Z"}, {"fact_contract_pass": False}),
        ({"axis": "rules", "rule_holds": False, "reply": "status is A not"}, {"rule_contract_pass": True}), ({"axis": "rules", "rule_holds": True, "reply": "status is A not"}, {"rule_contract_pass": False}), ({"axis": "rules"}, {"rule_contract_pass": None}),
        ({"axis": "story", "reply": "because of it"}, {"noncausal_pass": False}), ({"axis": "story", "reply": "perhaps because of it"}, {"noncausal_pass": True}), ({"reply": '{"a": [1]}'}, {"json_parse": True}),
    ],
)
def test_scores(spark, given, want):
    got = scored(spark, **given)
    assert {k: got[k] for k in want} == want


@pytest.fixture(scope="module")
def duck(sf_dir):
    own = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        own.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return own


def test_graded_turns(spark, sf_dir, duck):
    """Errors and omissions by the SQL of the claims' queries, all else by loops over the replies."""
    errors = {(c, t): [x for x in e.split(",") if x and not x.startswith("unprovided:")] for c, e, t in duck.sql(f"SELECT conv_id, errors, turn FROM ({oracle_sql()['grd_18_claim_errors']})").fetchall()}
    omitted = {(c, t): "claim_source" in o.split(",") for c, o, t in duck.sql(f"SELECT conv_id, omitted, turn FROM ({oracle_sql()['grd_19_scoped_facts']})").fetchall()}
    texts = defaultdict(list)
    for c, t, x in duck.sql("SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant' ORDER BY conv_id, turn").fetchall():
        texts[c].append((t, x))
    want = {}
    for c, own in texts.items():
        so_far = True
        for n, (t, x) in enumerate(own):
            lines = [v for v in x.split("\n") if v.strip(" ")]
            plain = re.sub(r"(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+", r"\1", x)
            parts = [v for v in re.split(r"[.!?\n]+", plain) if v.strip(" ")]
            asked = any(v.strip(" ").endswith("?") and "the" in v for v in re.split(r"(?<=[.?!])", x))
            clean = not errors[c, t] and not omitted.get((c, t), False)
            so_far = so_far and clean
            passed = bool(x.strip()) and len(lines) >= 1 and len(parts) >= 3 and len(x) <= 4000 and clean and not asked
            want[c, t] = (errors[c, t], ["source"] if omitted.get((c, t)) else [], len(lines), len(parts), passed, so_far if n else None)
    got = {(r.conv_id, r.turn): (r.errors, r.omissions, r.n_lines, r.n_sentences, r.passed, r.followup_consistent) for r in queries()["grd_06_graded_turns"](spark, sf_dir).collect()}
    assert got == want and {v[4] for v in want.values()} == {True, False}


#: The intake machine as a table: event kind to a test, the decision that refuses, and the change.
FILLED = ("date", "place", "purpose")


def machine(events):
    """Rows (ordinal, phase, revision, decision, accepted) of one session's events."""
    phase, revision, slots, out = "collecting", 0, {}, []
    ask = lambda: next((f"ask_{s}" for s in FILLED if s not in slots), "ask_confirm")
    for e in sorted(events, key=lambda e: e.ordinal):
        refused = None
        if phase == "closed":
            refused = "reject_closed"
        elif e.expected is not None and e.expected != revision:
            refused = "reject_stale"
        elif e.kind in ("set", "correct") and (e.field not in FILLED or not e.value):
            refused = "reject_slot"
        elif e.kind == "set" and e.field in slots:
            refused = "reject_filled"
        elif e.kind == "confirm" and (phase in ("ready", "answered") or ask() != "ask_confirm"):
            refused = "reject_incomplete"
        elif e.kind == "result" and phase != "ready":
            refused = "reject_result"
        decision = refused
        if not refused:
            if e.kind in ("set", "correct"):
                slots[e.field] = e.value
                revision += 1
            phase = {"start": "collecting", "set": "collecting", "correct": "collecting", "confirm": "ready", "result": "answered", "close": "closed"}[e.kind]
            decision = {"confirm": "run", "result": "answer", "close": "bye"}.get(e.kind) or ask()
        out.append((e.ordinal, phase, revision, decision, refused is None))
    return out


def by_session(events):
    own = defaultdict(list)
    for e in events.collect():
        own[e.session].append(e)
    return {s: machine(v) for s, v in own.items()}


def test_machine_s_rows(spark, sf_dir):
    events = sessions.intake_events(Tables(spark, sf_dir))
    want = by_session(events)
    assert Counter(map(tuple, queries()["stm_01_intake_replay"](spark, sf_dir).collect())) == Counter((s, *r) for s, rows in want.items() for r in rows)
    assert {(r.session, r.revision, r.n_accepted) for r in queries()["stm_02_revisions"](spark, sf_dir).collect()} == {(s, max(r[2] for r in rows), sum(r[4] for r in rows)) for s, rows in want.items()}
    assert {tuple(r) for r in queries()["stm_08_10_final_states"](spark, sf_dir).collect()} == {(s, *rows[-1][1:4]) for s, rows in want.items()}
    stale = events.withColumn("expected", F.when(F.col("ordinal") % 4 == 0, F.lit(99).cast("long")))
    counts = Counter(r[3] for rows in by_session(stale).values() for r in rows)
    assert dict(map(tuple, queries()["stm_04_stale_events"](spark, sf_dir).collect())) == counts and counts["reject_stale"]
