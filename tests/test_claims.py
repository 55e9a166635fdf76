"""Claims, their errors and omissions, by hand and against plain versions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import claims

#: A small grammar of Korean claims, written for these tests.
GRAMMAR = claims.ClaimGrammar(
    labels={"status": "상태", "grade": "등급"}, value="[A-Z][0-9]?", forward=r"(?:는|은|가|이)? *:? *", backward=r"(?:가|이)? *",
    frames={"reported": "들은 말로는", "historical": "작년에는", "hypothetical": "만일", "current": "지금은"}, denied=r"(?:가|이)? *아[니닙]", doubted=r"수 있|모르",
    supposed="(?:이)?라면", retold=r"(?:이)?라(?:고|는) *(?:말|주장|전)", quoted="'[^']*'|“[^”]*”", swapped=r"(?:가|이)? *아니라 *", mended=", *아니, *", bridge=12,
)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("상태는 F입니다, 등급은 Z일 수 있습니다.", [("status", "F", "current", "asserted"), ("grade", "Z", "current", "uncertain")]),
        ("등급은 Z일 수 있습니다, 상태는 F입니다.", [("grade", "Z", "current", "uncertain"), ("status", "F", "current", "asserted")]),
        ("친구는 '상태는 F'라고 말했습니다.", [("status", "F", "reported", "asserted")]),
        ("친구는 '상태는 F이고 등급은 Z'라고 전했다", [("status", "F", "reported", "asserted"), ("grade", "Z", "reported", "asserted")]),
        ("“상태는 F”라는 주장은 틀렸습니다", [("status", "F", "reported", "asserted")]),
        ("'상태는 F' 등급은 Z", [("status", "F", "current", "asserted"), ("grade", "Z", "current", "asserted")]),
        ("F가 상태입니다", [("status", "F", "current", "asserted")]),
        ("F가 상태, Z가 등급", [("status", "F", "current", "asserted"), ("grade", "Z", "current", "asserted")]),
        ("상태는 F 등급", [("status", "F", "current", "asserted")]),
        ("상태는 F가 아닙니다. 등급은 Z", [("status", "F", "current", "denied"), ("grade", "Z", "current", "asserted")]),
        ("상태는 F가 아니라 G입니다", [("status", "F", "current", "denied"), ("status", "G", "current", "asserted")]),
        ("상태는 F가 아니라 Z가 등급입니다", [("status", "F", "current", "denied"), ("grade", "Z", "current", "asserted")]),
        ("상태는 F, 아니, G입니다", [("status", "F", "superseded", "asserted"), ("status", "G", "current", "asserted")]),
        ("만일 상태가 F라면", [("status", "F", "hypothetical", "asserted")]),
        ("상태가 F라면 좋다", [("status", "F", "hypothetical", "asserted")]),
        ("작년에는 상태가 F, 지금은 상태가 G", [("status", "F", "historical", "asserted"), ("status", "G", "current", "asserted")]),
        ("들은 말로는 상태가 F", [("status", "F", "reported", "asserted")]),
        ("상태 그 뜻밖의 F", [("status", "F", "current", "uncertain")]), ("상태 그 아주 길고 긴 뜻밖의 말 뒤에 F", []),
        ("아무 말도 없다", []), ("", []), (None, []),
    ],
)
def test_claims(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(claims.claims(F.col("t"), GRAMMAR).alias("c")).first()
    assert [(c.role, c.value, c.scope, c.polarity) for c in row.c] == want
    for c in row.c:
        assert c.value in text[c.start : c.end] and len(text) >= c.end


def test_many_claims_of_one_sentence(spark):
    """A sentence of more matches than one fold holds, with letters beyond the basic plane."""
    text = "\U0001f600 " + " ".join(f"상태는 F{i % 10}이고" for i in range(500))
    row = spark.createDataFrame([(text,)], "t string").select(claims.claims(F.col("t"), GRAMMAR).alias("c")).first()
    assert [text[c.start : c.end] for c in row.c] == [f"상태는 F{i % 10}" for i in range(500)]


FACTS = [(1, "status", "F"), (1, "grade", "Z"), (1, "weight", "3"), (2, "status", "G"), (3, "tag", "A"), (3, "tag", "B")]
COUNTED = claims.ClaimGrammar(labels={"status": "status", "grade": "grade", "weight": "weight", "whole": "record", "tag": "tag"}, value=r"(?:[A-Z]|[0-9]+(?:,[0-9]+)?)\b", forward=" (?:is |of )?", denied=" *not", frames={"historical": "once"}, bridge=9)


def errors(spark, texts):
    rows = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(texts)], "id int, n int, t string")
    facts = spark.createDataFrame(FACTS, "id int, role string, value string")
    codes = claims.claim_errors(claims.claim_rows(rows, ["id", "n"], "t", COUNTED), facts, ["id", "n"], ["id"], wholes=["whole"])
    mentions = rows.selectExpr("id", "n", "explode(regexp_extract_all(t, '<([A-Z])>', 1)) AS value")
    codes = codes.union(claims.unprovided(mentions, facts, ["id", "n"], ["id"])).union(claims.unsupported(rows, ["id", "n"], "t", {"fate": "will surely"}, "can't be said"))
    return [r.errors for r in claims.by_key(codes, rows, ["id", "n"]).orderBy("n").collect()]


def test_claim_errors(spark):
    texts = [
        (1, "The status is F and the grade is Z. weight of 3"), (1, "weight of 3,0. weight is 4"), (1, "status is Z"), (1, "status is Q"), (1, "status is F not"), (1, "status is Q not"), (1, "record is F"), (1, "once status is Q"),
        (1, "status so far Q"), (2, "grade is Z. grade is G"), (9, "status is F"), (3, "tag is A. tag is B. tag is C"), (1, "<F> and <X> and <X>"), (1, "It will surely rain"), (1, "That it will surely rain can't be said. Fine"), (1, None), (1, ""),
        (1, "status is Q. status is Q"),
    ]
    assert errors(spark, texts) == [
        [], ["confused:weight:3,0", "confused:weight:4"], ["swapped:status:grade"], ["confused:status:Q"], ["denied:status:F"], [], ["part_as_whole:whole:status"], [],
        [], ["swapped:grade:status", "unfounded:grade:Z"], ["unfounded:status:F"], ["confused:tag:C"], ["unprovided:X"], ["unsupported:fate"], [], [], [], ["confused:status:Q"],
    ]


def test_numbers_are_compared_as_numbers(spark):
    rows = spark.createDataFrame([(1, "weight of 03"), (1, "weight of 30")], "id int, t string")
    facts = spark.createDataFrame([(1, "weight", "3.0")], "id int, role string, value string")
    found = claims.claim_errors(claims.claim_rows(rows, ["id"], "t", COUNTED), facts, ["id"]).collect()
    assert [r.code for r in found] == ["confused:weight:30"]


def test_facts_by_path(spark):
    rows = spark.createDataFrame([(1, '{"a": {"b": "x", "n": 3}, "c": [null, "y"]}'), (2, "no json"), (3, None)], "id int, d string")
    found = claims.facts_by_path(rows, ["id"], "d", {"b": "$.a.b", "n": "$.a.n", "first": "$.c[0]", "second": "$.c[1]", "none": "$.z"})
    assert sorted(map(tuple, found.collect())) == [(1, "b", "x"), (1, "n", "3"), (1, "second", "y")]


GUARDS = claims.Guards(breaks="[,;]", negated="not|never", supposed="if |suppose", quoted='"[^"]*"')


def test_omitted_facts(spark):
    """A mention that is negated, supposed or quoted states nothing; two facts of one value need two mentions."""
    need = [("a", "F", None), ("b", "F", None), ("c", "3.5", None), ("d", "Z", "grade"), ("e", None, None)]
    cases = [
        ("F and F weigh 3.5. grade is Z", []), ("F weighs 3.5. grade is Z", ["b"]), ("F, not F, weighs 3.5. grade is Z", ["b"]), ("If so, F; if F weighs 3.5, grade is Z", ["b", "c"]),
        ('F and "F" weigh 3.5. grade is Z not', ["b", "d"]), ("F F 3x5. once grade is Z", ["c", "d"]), ("Z F F 3.5", ["d"]), ("", ["a", "b", "c", "d"]), (None, ["a", "b", "c", "d"]),
    ]
    sentence = r"(?:[^\n.!?]|\.(?=[0-9]))+"
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "id int, t string")
    required = spark.createDataFrame([(i, *x) for i in range(len(cases)) for x in need], "id int, name string, value string, role string")
    grammar = claims.ClaimGrammar(labels=COUNTED.labels, value=COUNTED.value, forward=COUNTED.forward, denied=COUNTED.denied, frames=COUNTED.frames, sentence=sentence)
    guards = claims.Guards(breaks=GUARDS.breaks, negated=GUARDS.negated, supposed=GUARDS.supposed, quoted=GUARDS.quoted, sentence=sentence)
    found = claims.omitted_facts(rows, ["id"], "t", required, grammar, guards).collect()
    assert [sorted(r.name for r in found if r.id == i) for i in range(len(cases))] == [want for _, want in cases]


def test_mentions_are_placed(spark):
    rows = spark.createDataFrame([(1, "é F. x F\nF not, F")], "id int, t string")
    values = spark.createDataFrame([(1, "F"), (1, "(F"), (1, ""), (2, "x")], "id int, value string")
    found = claims.free_mentions(rows, ["id"], "t", values, GUARDS).collect()
    assert sorted((r.value, r.start, r.end) for r in found) == [("F", 2, 3), ("F", 7, 8), ("F", 16, 17)]
