"""Claims, intents, slots, tool calls, particles and chat tokens, against plain Python or by hand."""

from __future__ import annotations

import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.catalog import queries
from corpusloom.functions import chat, dialogue


def told(spark, values, column):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", column.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def test_particles_by_reading(spark):
    text, wrong = dialogue.repair_after_readings(F.col("v"))
    assert told(spark, ["甲는 戊은 좋고 乙으로 丙로", "甲은 戊는", "", None], text) == ["甲은 戊는 좋고 乙로 丙으로", "甲은 戊는", "", None]
    assert told(spark, ["甲는 戊은 좋고 乙으로 丙로", "甲은 戊는", ""], wrong) == [4, 0, 0]


def test_generic_names(spark):
    text, n = dialogue.replace_names(F.col("v"))
    values = ["김철수 씨는 왔다. 이영희님께서는 갔다", "박민수씨에게는 말하고 최지우 님과 갔다", "아무도 없다", None]
    assert told(spark, values, text) == ["이 사람은 왔다. 이 사람은 갔다", "이 사람에게는 말하고 이 사람과 갔다", "아무도 없다", None]
    assert told(spark, values, n) == [2, 2, 0, None]


def by_table(clauses, topic, rules):
    """Acts and clauses of a turn that is already cut into clauses with their kinds."""
    out = []
    for kind, clause in clauses:
        topic, act = rules.moves.get((topic, kind), (topic, None))
        out += [(act, clause)] if act else []
    return out


INTENTS = [
    # turn, intent before, intent, text, acts
    ("of it", None, "unclear", "", ["lost"]),
    ("of it", "period", "period", "of it", ["went on"]),
    ("Of it. And so", "chart", "period", "of it\nand so", ["went on", "went on"]),
    ("of it", "talk", "talk", "", []),
    ("of it", "unclear", "unclear", "", ["lost"]),
    ("The words. of", None, "unclear", "", ["lost", "lost"]), ("Two words. of", None, "talk", "", ["talked"]),
    ("whether?\nof it. Some other", None, "period", "whether\nof it", ["asked", "asked", "talked"]),
    ("a  strange\t story. of", "period", "period", "of", ["named", "asked"]),
    ("a street. is it 3.5", None, "chart", "", ["named", "talked"]),
    ("without the whe of", "period", "talk", "", []),
    ("to be? why", "period", "period", "to be", ["went on", "talked"]),
    ("the street\n\n", None, "chart", "", ["named"]),
    ("  ", None, None, None, None), (None, "period", None, None, None),
]


def test_intents(spark):
    df = spark.createDataFrame([(i, t, b) for i, (t, b, *_) in enumerate(INTENTS)], "i int, t string, b string")
    got = {r.i: r.x for r in df.select("i", dialogue.resolve_intent(F.col("t"), F.col("b"), dialogue._INTENTS).alias("x")).collect()}
    for i, (text, _, intent, said, acts) in enumerate(INTENTS):
        assert got[i] is None if intent is None else tuple(got[i]) == (intent, said, acts), text


def test_intents_of_conversations(spark, sf_dir):
    """Clauses and their kinds by Spark, the walk through the table in Python, over all user turns."""
    p = dialogue._INTENTS
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").orderBy("conv_id", "turn").collect():
        clauses = [c.strip(" ") for c in re.split(p.breaks, re.sub(p.cut, " ", re.sub("[ \\t\\r\\f]+", " ", r.text).lower()))]
        kinds = [(next((k for k, form in p.kinds.items() if re.search(form, c)), "other"), c) for c in clauses if c]
        turns.setdefault(r.conv_id, []).append((r.turn, kinds, re.search(p.cut, r.text.lower())))
    want = {}
    for conv, own in turns.items():
        before = None
        for turn, kinds, was_cut in own:
            acts = lambda topic: by_table(kinds, p.after_cut if was_cut else topic, p)  # noqa: B023, E731
            intent = lambda found: next((name for act, name in p.outcomes.items() if act in [a for a, _ in found]), p.otherwise)
            found = acts(p.starts.get(before, p.start))
            want[conv, turn] = (intent(found), "\n".join(c for a, c in found if a in p.taken), "went on" in [a for a, _ in found])
            before = intent(acts(p.start))
    got = {(r.conv_id, r.turn): (r.intent, r.period_text, r.from_before) for r in queries()["str_26_intents"](spark, sf_dir).collect()}
    assert got == want and len({x[0] for x in want.values()}) >= 2


def test_slots(spark):
    values = [
        ("1990년 5월 7일 양력 7시 5분 서울", {"date": "1990-05-07", "time": "07:05", "place": "서울", "calendar": "solar"}, [], None), ("1990년 2월 30일 부산", {"place": "부산"}, [], None),
        ("1990년 5월 7일 또는 1991년 1월 1일", {}, [], "multiple dates"), ("9시부터 11시 음력 윤달", {"hours": "09-11", "calendar": "lunar", "leap_month": "true"}, [], None),
        ("오후 2시부터 5시", {"hours": "14-17"}, [], None), ("오전 12시부터 3시", {"hours": "00-03"}, [], None), ("오후 11시부터 12시", {}, [], None), ("저녁 7시 30분", {"time": "19:30"}, [], None), ("오후 14시부터 15시", {}, [], None),
        ("오후 12시 5분", {"time": "12:05"}, [], None), ("양력 윤달", {"calendar": "solar"}, [], None), ("평달", {}, [], None), ("음력 평달", {"calendar": "lunar", "leap_month": "false"}, [], None), ("25시부터 26시", {}, [], None),
        ("2시부터 5시, 3시부터 4시", {}, [], "multiple times"), ("시각은 모릅니다 7시 5분", {}, ["time"], None), ("서울 아니면 부산", {}, [], "multiple places"), ("해외 서울", {}, [], None), ("양력인지 음력인지", {}, [], None), ("", {}, [], None),
    ]
    got = told(spark, [v[0] for v in values], dialogue.extract_slots(F.col("v"), dialogue._SLOTS))
    for (text, *want), x in zip(values, got):
        assert [x.slots, x.unknown, x.error] == want, text


ONE = "<tool_call>\n<function=f>\n<parameter=a>\nx\ny\n</parameter>\n<parameter=b>\n2\n</parameter>\n</function>\n</tool_call>"


def test_tool_calls(spark):
    want = F.array(F.struct(F.lit("f").alias("name"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("x\ny")).alias("arguments")))
    cases = [
        (ONE, None), ("so: " + ONE + "\n ", None), (ONE + ONE, "count"), (ONE + " end", "text after the last call"), (ONE.replace("=f>", "=g>"), "name"), (ONE.replace("<parameter=b", "?<parameter=b"), "text between parameters"),
        (ONE.replace("2", "3"), "arguments"), (ONE.replace("=b>", "=a>"), "repeated parameter"), ("none", "count"), ("", "count"),
        (ONE + "<tool_call>junk</tool_call>", "text after the last call"), (ONE + " text </tool_call>", "text after the last call"), ("junk</tool_call>" + ONE, None), (ONE + "\n</tool_call>\n", "text after the last call"),
    ]
    assert told(spark, [c for c, _ in cases], dialogue.tool_call_problem(F.col("v"), want)) == [p for _, p in cases]
    (found,) = told(spark, [ONE], dialogue.tool_calls(F.col("v")))
    assert [(c.name, [tuple(a) for a in c.arguments]) for c in found] == [("f", [("a", "x\ny"), ("b", "2")])]


def test_typed_arguments(spark):
    call = lambda **p: "<tool_call>\n<function=f>\n" + "".join(f"<parameter={k}>\n{v}\n</parameter>\n" for k, v in p.items()) + "</function>\n</tool_call>"
    kinds = {"n": "integer", "x": "number", "s": "string", "b": "boolean", "o": "object", "l": "array"}
    good = {"n": "2", "x": "2", "s": "2", "b": "true", "o": '{"z": 1, "a": [null]}', "l": "[1, 2]"}
    cases = [
        (good, {"n": "2", "x": "2.0", "s": "2", "b": "true", "o": '{"a":[null],"z":1}', "l": "[1,2]"}, None), (good | {"x": "2.50", "s": "null", "b": "null"}, {"n": "2", "x": "2.5", "s": "null", "b": "null", "o": '{"a":[null],"z":1}', "l": "[1,2]"}, None),
        (good | {"n": "2.5"}, None, "kind"), (good | {"n": '"2"'}, None, "kind"), (good | {"b": "yes"}, None, "kind"), (good | {"o": "[1]"}, None, "kind"), (good | {"l": "{"}, None, "kind"), (good | {"q": "1"}, None, "unknown argument"),
        ({k: v for k, v in good.items() if k != "l"}, None, "missing argument"),
    ]
    got = told(spark, [call(**c) for c, *_ in cases], dialogue.typed_arguments(F.get(dialogue.tool_calls(F.col("v")), F.lit(0)), kinds))
    assert [(x.values, x.problem) for x in got] == [(v, p) for _, v, p in cases]


def test_chat_tokens(spark, sf_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in queries()["str_27_chat_tokens"](spark, sf_dir).collect():
        text, spoken = "", []
        for role, said in turns[r.conv_id]:
            text += f"<|im_start|>{role}\n"
            if role == "assistant":
                spoken.append((len(text), len(text) + len(said) + 11))
            text += f"{said}<|im_end|>\n"
        found = own.encode(text, add_special_tokens=False)
        mask = [any(a <= x < b for a, b in spoken) for x, _ in found.offsets]
        assert (r.n_tokens, r.n_assistant, r.ids_crc32) == (len(found.ids), sum(mask), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in found.ids)))
    odd = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", "é\U0001f600")], "k int, n int, role string, t string")
    (row,) = chat.render_chat(odd, "k", "n", "role", "t").collect()
    assert row.rendered[row.spoken[0].start : row.spoken[0].end] == "é\U0001f600<|im_end|>\n"
