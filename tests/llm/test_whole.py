"""Identifiers of other forms than the base ones and single tokens with a digit."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import pii
from corpusloom.llm._store import Scratch
from tests.llm import brute

OTHERS = [
    ("mail", "email", "jane@localhost"), ("mail", "email", "jane.doe(at)example.com"), ("mail", "email", "jane[AT]example[dot]com"), ("phone", "phone", "(017) 555-7713"), ("phone", "phone", "017 555 77 13"),
    ("card", "card", "4111 1111 1111 1112"), ("phone", "phone", "555-1234-77"), ("card", "card", "12-34567"),
]


def test_contexts_find_joined_identifiers(spark):
    base = {"mail": "someone{}@example.com", "phone": "+1 (98{}) 555-2480", "card": "{}"}
    cards = ["4111 1111 1111 1111", "5555 5555 5555 4444", "4012 8888 8888 1881", "3782 822463 10005", "6011 1111 1111 1117"]
    rows = [(5 * n + i, f"words and {cue}: {cards[i] if cue == 'card' else form.format(i)} end") for n, (cue, form) in enumerate(base.items()) for i in range(5)]
    rows += [(100 + i, f"words and {cue}: {value} 2 times. But ordinary {value} too") for i, (cue, _, value) in enumerate(OTHERS)]
    rows += [(200, "and card: 12-34567 10.0.0.1 end")]
    text = dict(rows)
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [len(out[i].base) for i in range(15)] == [1] * 15 and not any(out[i].found for i in range(15))
    for i, (_, kind, value) in enumerate(OTHERS):
        assert [(f.kind, text[100 + i][f.start : f.end]) for f in out[100 + i].found] == [(kind, value)]
    assert [text[200][f.start : f.end] for f in out[200].found] == ["12-34567"]


def plain_patterns(rows, occurrences, support, rounds):
    """induce_patterns by loops: (cue, kind) -> score, with cues as (side, tokens)."""
    n, total = Counter(), Counter()
    for value, kind, cue in occurrences:
        n[cue, value, kind] += 1
    for text in rows:
        for size in (1, 2):
            total.update(tuple(text[i : i + size]) for i in range(len(text) - size + 1))
    values = defaultdict(set)
    for cue, value, _ in n:
        values[cue].add(value)
    cues = {c for c, v in values.items() if len(v) >= support and total[c[1]]}
    sure = {(v, k) for _, v, k in n if k and any(c in cues for c, w, j in n if (w, j) == (v, k))}
    trust, out, last = {x: 1.0 for x in sure}, {}, None
    for _ in range(rounds):
        held, out = Counter(), {}
        for (cue, value, _), m in n.items():
            held[cue, value] += m
        for cue in cues:
            for kind in {k for _, k in trust}:
                own = {v: trust[v, kind] for c, v in held if c == cue and (v, kind) in trust}
                if sum(x >= 0.5 for x in own.values()) >= support:
                    out[cue, kind] = min(1.0, sum(held[cue, v] * x for v, x in own.items()) / total[cue[1]])
        now = (len(out), sorted(out))
        if now == last:
            break
        last = now
        fresh = defaultdict(lambda: 1.0)
        for cue, value, kind in {(c, v, k) for (c, v, j) in n if j is None for (d, k) in out if d == c}:
            fresh[value, kind] *= max(1e-9, 1 - out[cue, kind])
        best = {}
        for (value, kind), p in fresh.items():
            if value not in {v for v, _ in sure}:
                best[value] = max(best.get(value, (0, "")), (1 - p, kind))
        trust = {x: 1.0 for x in sure} | {(v, k): x for v, (x, k) in best.items()}
    return out


def test_patterns_equal_plain_ones(spark):
    """Scores of bootstrapped contexts, against loops over the same graph."""
    rng = random.Random(4)
    texts, spans = [], []
    for i in range(120):
        words = [rng.choice(["call", "at", "no.", "by", "the", "id"]) for _ in range(8)]
        at = rng.randrange(2, 7)
        value = f"v{rng.randrange(25)}"
        words[at] = value
        texts.append(words)
        spans.append((value, "phone" if int(value[1:]) % 3 == 0 else None, words, at))
    plain, rows = [], []
    code = {}
    for value, kind, w, at in spans:
        for side, tokens in ((0, w[at - 1 : at]), (0, w[at - 2 : at]), (1, w[at + 1 : at + 2]), (1, w[at + 1 : at + 3])):
            if tokens and (side == 0 or len(tokens) == (2 if tokens is not w[at + 1 : at + 2] else 1)):
                plain.append((value, kind, (side, tuple(tokens))))
                rows.append((value, kind, side, tokens))
    df = spark.createDataFrame(rows, "value string, kind string, side long, tokens array<string>")
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    base = F.when(F.size("tokens") == 1, F.element_at(hashed, 1)).otherwise(F.xxhash64(hashed))
    df = df.withColumn("cue", base.bitwiseAND(F.lit(-2)).bitwiseOR(F.col("side")))
    code = {r.cue: (r.side, tuple(r.tokens)) for r in df.select("cue", "side", "tokens").distinct().collect()}
    corpus = spark.createDataFrame([(" ".join(w),) for w in texts], "text string")
    scratch = Scratch(spark)
    got = {(code[r.cue], r.kind): r.score for r in pii.induce_patterns(corpus, df.select("value", "kind", "cue"), scratch, 3, 8).collect()}
    want = plain_patterns(texts, plain, 3, 8)
    assert set(got) == set(want) and len(want) >= 4
    for x, score in want.items():
        assert got[x] == pytest.approx(score, rel=1e-6)


def test_hidden_identifiers_are_found(spark):
    """Of identifiers that recur in contexts, those hidden from the seeds are found with their kinds; elsewhere none is claimed."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = []
    for i in range(400):
        lead, value, after = [("reach me by phone:", phone(), "any day"), ("write to mail:", f"{word()}{i}@{word()}.org", "soon"), (word(), phone(), word()), ("token =", f'"{rng.randrange(16**38):038x}a1"', word())][i % 4]
        rows.append((i, f"{word()} {word()} {lead} {value} {after} {word()}"))
    rows += [(1000 + i, f"{word()} item {rng.randrange(10**6)} {word()}") for i in range(200)]
    rows += [(2000, 'token = "short7key"'), (2001, "sha 00ff00ff00ff00ff00ff00ff00ff00ff00ff00aa by me")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hidden = F.pmod(F.xxhash64("value"), F.lit(4)) == 0
    told = {r.kind: r for r in pii.hidden_recall(df, hidden).collect()}
    assert told["email"].n_right == told["email"].n_hidden > 10 and told["email"].n_wrong == 0
    assert 0.35 * told["phone"].n_hidden < told["phone"].n_right < told["phone"].n_hidden and told["phone"].n_wrong == 0  # half stand in no context
    out = {r.doc_id: r.found for r in pii.find_personal_data(df).collect()}
    assert all([f.kind for f in out[i]] == ["secret"] for i in range(3, 400, 4)) and [f.kind for f in out[2000]] == ["secret"]
    assert not any(out[i] for i in out if i >= 1000 and i != 2000)


def test_many_matches_are_placed(spark):
    """Lists of matches longer than a block."""
    text = " ".join(f"é{i}@x.org" for i in range(1000))
    (row,) = spark.createDataFrame([(text,)], "t string").select(pii.base_spans(F.col("t")).alias("s")).collect()
    assert [(s.start, s.end) for s in row.s] == [(a, b) for a, _, _, b in brute.personal(text)] and len(row.s) == 1000
