"""Claims, intents, slots, tool calls and particles in dialogue texts, as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import let
from corpusloom.functions.text import has_final_consonant, labelled_values, repair_particle
from corpusloom.registry import query

#: Particles that follow a closed and an open syllable (fixed values of the language).
PARTICLES = (("은", "는"), ("이", "가"), ("을", "를"), ("과", "와"))
#: Readings of the ten stems and twelve branches (fixed values).
READINGS = dict(zip("甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥", "갑을병정무기경신임계자축인묘진사오미신유술해"))


def _closed(syllable: str) -> str:
    """How a Hangul syllable ends: ``open``, ``rieul`` or ``closed``."""
    return {0: "open", 8: "rieul"}.get((ord(syllable) - 0xAC00) % 28, "closed")


def repair_after_readings(c: Column, readings: Mapping[str, str] = READINGS) -> tuple[Column, Column]:
    """The text with the particles that the readings of the letters before them ask for, and how many were wrong.

    Letters of one ending form a class, so each particle is one replacement inside the JVM.
    """
    by = {k: "".join(x for x, r in readings.items() if _closed(r) == k) for k in ("open", "rieul", "closed")}
    shut = by["closed"] + by["rieul"]
    rules = [(f"([{by['open']}]){a}", b) for a, b in PARTICLES] + [(f"([{shut}]){b}", a) for a, b in PARTICLES]
    rules += [(f"([{by['open'] + by['rieul']}])으로", "로"), (f"([{by['closed']}])로", "으로")]
    wrong = sum((F.regexp_count(c, F.lit(rule)) for rule, _ in rules), F.lit(0))
    for rule, right in rules:
        c = F.regexp_replace(c, rule, "$1" + right)
    return c, wrong


def replace_names(c: Column, generic: str = "이 사람", titles: Sequence[str] = ("씨", "님"), honorific: Mapping[str, str] = {"께서는": "은", "께": "에게"}) -> tuple[Column, Column]:  # noqa: B006
    """Titled names as a generic one with the particle it asks for, and how many there were.

    Honorific particles become the plain ones that ``honorific`` names; others stay.
    """
    name = rf"(?<![가-힣])[가-힣]{{2,4}}\s*(?:{'|'.join(titles)})"
    place = 1 if _closed(generic[-1]) == "open" else 0
    after = {p: pair[place] for pair in PARTICLES for p in pair} | dict(honorific)
    count = F.regexp_count(c, F.lit(name))
    for particle in sorted(after, key=lambda p: (-len(p), p)):
        c = F.regexp_replace(c, name + particle, generic + after[particle])
    return F.regexp_replace(c, name, generic), count


@dataclass(frozen=True)
class IntentRules:
    """How turns are read: all forms and names are the caller's.

    ``cut`` is left out first. ``breaks`` stand between clauses. A clause's kind is the
    first of ``kinds`` whose form it shows, else ``other``. ``moves`` is a table
    {(topic, kind): (topic after it, act)}; a pair that isn't in it keeps the topic and
    has no act. ``outcomes`` names the turn's intent by its acts, the first that was done;
    clauses of the acts in ``taken`` are the turn's text. ``starts`` gives the first topic
    by the intent of the turn before, and ``start`` that without one, or where something
    was cut out.
    """

    kinds: Mapping[str, str]
    breaks: str
    moves: Mapping[tuple[str, str], tuple[str, str | None]]
    outcomes: Mapping[str, str]
    otherwise: str
    start: str
    after_cut: str
    starts: Mapping[str, str]
    taken: Sequence[str]
    cut: str | None = None
    other: str = "other"


def resolve_intent(prompt: Column, previous: Column, rules: IntentRules) -> Column:
    """(intent, text, acts) of a turn; ``previous`` is the intent of the user's turn before, or null.

    A fold over the clauses in their order, whose steps are looked up in the rules' table.
    ``text`` has the taken clauses, one to a line. A blank or null turn has no intent.
    """
    table = F.create_map(*(F.lit(x) if isinstance(x, str) else x for (topic, kind), (after, act) in rules.moves.items() for x in (f"{topic} {kind}", F.struct(F.lit(after).alias("topic"), F.lit(act).cast("string").alias("act")))))
    low = F.lower(F.regexp_replace(prompt, "[ \\t\\r\\f]+", " "))
    was_cut = low.rlike(rules.cut) if rules.cut else F.lit(False)
    kept = F.regexp_replace(low, rules.cut, " ") if rules.cut else low
    first = F.when(was_cut, rules.after_cut).otherwise(F.coalesce(F.create_map(*(F.lit(x) for pair in rules.starts.items() for x in pair))[previous], F.lit(rules.start)) if rules.starts else F.lit(rules.start))

    def kind(clause: Column) -> Column:
        out = F.lit(rules.other)
        for name, form in reversed(rules.kinds.items()):
            out = F.when(clause.rlike(form), name).otherwise(out)
        return out

    def step(s: Column, clause: Column) -> Column:
        def moved(to: Column) -> Column:
            act = F.array(F.struct(to["act"].alias("act"), clause.alias("clause")))
            return F.struct(F.coalesce(to["topic"], s["topic"]).alias("topic"), F.when(to["act"].isNotNull(), F.concat(s["acts"], act)).otherwise(s["acts"]).alias("acts"))

        return let(table[F.concat_ws(" ", s["topic"], kind(clause))], moved)

    def told(s: Column) -> Column:
        acts = F.transform(s["acts"], lambda x: x["act"])
        intent = F.lit(rules.otherwise)
        for act, name in reversed(rules.outcomes.items()):
            intent = F.when(F.array_contains(acts, act), name).otherwise(intent)
        said = F.transform(F.filter(s["acts"], lambda x: x["act"].isin(*rules.taken)), lambda x: x["clause"])
        return F.struct(intent.alias("intent"), F.array_join(said, "\n").alias("text"), acts.alias("acts"))

    clauses = F.filter(F.transform(F.split(kept, rules.breaks), lambda x: F.trim(x)), lambda x: x != "")
    begun = F.struct(first.alias("topic"), F.array().cast("array<struct<act:string,clause:string>>").alias("acts"))
    return F.when(F.trim(prompt) != "", F.aggregate(clauses, begun, step, told))


def resolve_intents(turns: DataFrame, key: str, order: str, text: str, rules: IntentRules) -> DataFrame:
    """User turns with their intents; the turn before, read without its own predecessor, gives the topic to begin with."""
    alone = turns.withColumn("_alone", resolve_intent(F.col(text), F.lit(None).cast("string"), rules)["intent"])
    before = alone.withColumn("_before", F.lag("_alone").over(Window.partitionBy(key).orderBy(order)))
    return before.withColumn("i", resolve_intent(F.col(text), F.col("_before"), rules)).select(*turns.columns, "i.*")


@dataclass(frozen=True)
class SlotForms:
    """How slots are written; all forms are the caller's.

    ``date``, ``time`` and ``hours`` have three, two and two groups: year, month, day; hour,
    minute; first and last hour. ``half_days``: a word right before an hour to the hours it
    adds to the clock's twelve. ``choices``: slot to words and their values, ``only_with``:
    slot to the (slot, value) that it needs. ``places``, without those where ``abroad`` is named.
    """

    date: str
    time: str
    hours: str
    half_days: Mapping[str, int]
    choices: Mapping[str, Mapping[str, str]]
    places: Sequence[str]
    only_with: Mapping[str, tuple[str, str]]
    abroad: str | None = None
    unknown_time: str | None = None


def extract_slots(c: Column, forms: SlotForms) -> Column:
    """(slots, unknown, error): a map of what one utterance states, the slots stated as unknown, and why it's refused.

    Two dates, times or places make the utterance ambiguous: it's refused with no slots.
    A choice of which two words are named is left out, and so is a slot without the one
    it needs. A word for half a day moves the hours behind it, both of a range; hours
    beyond the day, or a range that ends before it begins, state nothing.
    """
    f = forms
    half = "|".join(sorted(f.half_days, key=len, reverse=True))
    added = F.create_map(*(F.lit(x) for pair in f.half_days.items() for x in pair))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    every = lambda form, g: F.array_compact(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(f"(?:(?:{half})\\s*)?(?:{form})"), F.lit(0)), g)))

    def hour(x: Column, form: str, group: int) -> Column:
        """The hour of a group, on the clock of 24; null if there's none such."""
        named, n = F.regexp_extract(x, f"^({half})", 1), F.regexp_extract(x, form, group).try_cast("int")
        moved = F.when((named != "") & (n <= 12), n % 12 + added[named]).when(named == "", n)
        return F.when(moved < 24, moved)

    def clock(x: Column) -> Column:
        return let(hour(x, f.time, 1), lambda h: F.when(h.isNotNull(), F.concat_ws(":", two(h), two(F.regexp_extract(x, f.time, 2)))))

    def hours(x: Column) -> Column:
        ends = F.struct(hour(x, f.hours, 1).alias("a"), hour(x, f.hours, 2).alias("b"))
        return let(ends, lambda e: F.when(e["a"] <= e["b"], F.concat_ws("-", two(e["a"]), two(e["b"]))))

    day = lambda x: F.concat_ws("-", F.regexp_extract(x, f.date, 1), two(F.regexp_extract(x, f.date, 2)), two(F.regexp_extract(x, f.date, 3)))
    dates = F.filter(every(f.date, day), lambda x: x.try_cast("date").isNotNull())
    places = F.filter(F.array(*map(F.lit, f.places)), lambda x: F.contains(c, x))
    if f.abroad:
        places = F.when(c.rlike(f.abroad), F.array().cast("array<string>")).otherwise(places)
    unknown = c.rlike(f.unknown_time) if f.unknown_time else F.lit(False)

    def choice(words: Mapping[str, str]) -> Column:
        named = F.array_distinct(F.transform(F.filter(F.array(*(F.struct(F.lit(w).alias("w"), F.lit(v).alias("v")) for w, v in words.items())), lambda x: F.contains(c, x["w"])), lambda x: x["v"]))
        return F.when(F.size(named) == 1, F.get(named, F.lit(0)))

    def told(s: Column) -> Column:
        error = F.when(F.size(s["dates"]) > 1, "multiple dates").when((F.size(s["times"]) > 1) | (F.size(s["hours"]) > 1), "multiple times").when(F.size(s["places"]) > 1, "multiple places")
        exact = (F.size(s["times"]) == 1) & (F.size(s["hours"]) == 0) & ~unknown
        slots = {"date": F.get(s["dates"], F.lit(0)), "time": F.when(exact, F.get(s["times"], F.lit(0))), "hours": F.when((F.size(s["hours"]) == 1) & ~unknown, F.get(s["hours"], F.lit(0))), "place": F.get(s["places"], F.lit(0))}
        slots |= {k: choice(v) for k, v in f.choices.items()}
        slots |= {k: F.when(slots[other] == value, slots[k]) for k, (other, value) in f.only_with.items()}
        whole = F.map_filter(F.create_map(*(x for k, v in slots.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
        empty = F.create_map().cast("map<string,string>")
        return F.struct(
            F.when(error.isNotNull(), empty).otherwise(whole).alias("slots"), F.when(unknown & error.isNull(), F.array(F.lit("time"))).otherwise(F.array().cast("array<string>")).alias("unknown"), error.alias("error"),
        )

    return let(F.struct(dates.alias("dates"), every(f.time, clock).alias("times"), every(f.hours, hours).alias("hours"), places.alias("places")), told)


_CALL = r"(?s)<tool_call>\n<function=([^>\n]+)>\n(.*?)</function>\n</tool_call>"
_PARAMETER = r"(?s)<parameter=([^>\n]+)>\n(.*?)\n</parameter>\n"


def tool_calls(c: Column) -> Column:
    """(name, arguments, residue, repeated) of each tool call in a model's output.

    ``arguments``: array of (name, value) as written; ``residue``: what stands between
    the parameters; ``repeated``: whether one is given twice.
    """

    def parameters(body: Column) -> Column:
        one = lambda x: F.struct(F.regexp_extract(x, _PARAMETER, 1).alias("name"), F.regexp_extract(x, _PARAMETER, 2).alias("value"))
        return F.transform(F.regexp_extract_all(body, F.lit(_PARAMETER), F.lit(0)), one)

    def call(x: Column) -> Column:
        made = lambda b: let(parameters(b), lambda a: F.struct(
            F.regexp_extract(x, _CALL, 1).alias("name"), a.alias("arguments"), F.regexp_replace(b, _PARAMETER, "").alias("residue"),
            (F.size(F.array_distinct(F.transform(a, lambda p: p["name"]))) < F.size(a)).alias("repeated"),
        ))
        return let(F.regexp_extract(x, _CALL, 2), made)

    return F.transform(F.regexp_extract_all(c, F.lit(_CALL), F.lit(0)), call)


#: JSON kinds of arguments, by what the value's schema may be (fixed values of the engine's names).
_KINDS = {"integer": "BIGINT", "number": "BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "object": "OBJECT.*", "array": "ARRAY.*"}


def typed_arguments(call: Column, kinds: Mapping[str, str]) -> Column:
    """(values, problem) of a tool call's arguments by their ``kinds``: string, integer, number, boolean, object or array.

    A string is as written; all else is read as JSON and written again, so that 2 and 2.0
    are one number and the order of an object's keys is none. null is a value of every
    kind but string. ``problem``: an argument that is given twice, has no kind, is missing
    or isn't of its kind; then there are no values.
    """

    def read(a: Column) -> Column:
        json = F.try_parse_json(a["value"])
        value = F.lit(None).cast("string")
        for name, kind in kinds.items():
            text = F.try_variant_get(json, "$", "double").cast("string") if kind == "number" else json.cast("string")
            shape = F.schema_of_variant(json)
            typed = a["value"] if kind == "string" else F.when(shape == "VOID", "null").when(shape.rlike(f"^(?:{_KINDS[kind]})$"), text)
            value = F.when(a["name"] == name, typed).otherwise(value)
        return F.struct(a["name"].alias("name"), value.alias("value"))

    def told(rows: Column) -> Column:
        names, known = F.transform(rows, lambda a: a["name"]), F.array(*map(F.lit, sorted(kinds)))
        problem = (
            F.when(call["repeated"], "repeated argument").when(F.size(F.array_except(names, known)) > 0, "unknown argument")
            .when(F.size(F.array_except(known, names)) > 0, "missing argument").when(F.exists(rows, lambda a: a["value"].isNull()), "kind")
        )
        return F.struct(F.when(problem.isNull(), F.map_from_entries(rows)).alias("values"), problem.alias("problem"))

    return let(F.transform(call["arguments"], read), told)


def tool_call_problem(c: Column, expected: Column) -> Column:
    """Why an output doesn't hold the ``expected`` calls (array of name and a map of arguments), or null.

    The calls must be as many, in their order, with nothing but white space after the
    last whole call, nothing between parameters, and the same names and values.
    """
    after = F.element_at(F.split(c, _CALL, -1), -1)

    def compare(calls: Column) -> Column:
        pairs = F.arrays_zip(calls.alias("got"), expected.alias("want"))
        bad = lambda test: F.exists(pairs, test)
        sorted_ = lambda m: F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))))
        return (
            F.when(F.size(calls) != F.size(expected), "count").when((F.size(calls) > 0) & after.rlike(r"\S"), "text after the last call")
            .when(bad(lambda p: p["got"]["name"] != p["want"]["name"]), "name").when(bad(lambda p: p["got"]["residue"] != ""), "text between parameters")
            .when(bad(lambda p: p["got"]["repeated"]), "repeated parameter").when(bad(lambda p: F.array_sort(p["got"]["arguments"]) != sorted_(p["want"]["arguments"])), "arguments")
        )

    return let(tool_calls(c), compare)


@query("str_14_final_consonant", "SELECT c_custkey, c_custkey % 28 <> 0 AS closed FROM customer")
def _(t):
    """Every Hangul syllable in turn as the last letter."""
    return t.customer.select("c_custkey", has_final_consonant(F.concat("c_name", _syllable("c_custkey"))).alias("closed"))


def _syllable(key: str) -> Column:
    """The Hangul syllable of a number, by its UTF-8 bytes."""
    code = F.lit(0xAC00) + F.pmod(F.col(key), F.lit(11172))
    byte = lambda shift, mark, bits: F.lpad(F.hex(F.shiftright(code, shift).bitwiseAND(bits).bitwiseOR(mark)), 2, "0")
    return F.decode(F.unhex(F.concat(byte(12, 0xE0, 0x0F), byte(6, 0x80, 0x3F), byte(0, 0x80, 0x3F))), "UTF-8")


@query("str_15_subject_particles", """
SELECT c_custkey, n || (CASE WHEN c_custkey % 28 <> 0 THEN '은' ELSE '는' END) || ' 왔고 ' || n || (CASE WHEN c_custkey % 28 <> 0 THEN '은' ELSE '는' END) || ' 갔다' AS repaired
FROM (SELECT c_custkey, '고객' || chr((44032 + c_custkey % 11172)::INT) AS n FROM customer)""")
def _(t):
    rows = t.customer.select("c_custkey", F.concat(F.lit("고객"), _syllable("c_custkey")).alias("n"))
    text = F.concat("n", F.lit("은 왔고 "), "n", F.lit("는 갔다"))
    return rows.select("c_custkey", repair_particle(text, F.col("n"), "은", "는").alias("repaired"))


_LETTERS = "".join(READINGS)


@query("str_16_particles_by_reading", f"""
WITH x AS (SELECT o_orderkey, substring('{_LETTERS}', (o_orderkey % 22)::INT + 1, 1) AS w, substring('{"".join(READINGS.values())}', (o_orderkey % 22)::INT + 1, 1) AS r FROM orders),
y AS (SELECT *, (ascii(r) - 44032) % 28 AS f FROM x)
SELECT o_orderkey, w || (CASE WHEN f = 0 THEN '는 ' ELSE '은 ' END) || w || (CASE WHEN f IN (0, 8) THEN '로' ELSE '으로' END) AS repaired,
    ((CASE WHEN f = 0 THEN 0 ELSE 1 END) + (CASE WHEN f IN (0, 8) THEN 1 ELSE 0 END))::INT AS n FROM y""")
def _(t):
    letter = F.substring(F.lit(_LETTERS), (F.col("o_orderkey") % 22 + 1).cast("int"), F.lit(1))
    repaired, wrong = repair_after_readings(F.concat(letter, F.lit("는 "), letter, F.lit("으로")))
    return t.orders.select("o_orderkey", repaired.alias("repaired"), wrong.alias("n"))


@query("str_17_generic_names", "SELECT c_custkey, '어제 이 사람' || (CASE c_custkey % 4 WHEN 0 THEN '은' WHEN 1 THEN '에게' WHEN 2 THEN '과' ELSE '' END) || ' ' || c_name AS text, 1 AS n FROM customer")
def _(t):
    k = F.col("c_custkey") % 4
    particle = F.when(k == 0, "께서는").when(k == 1, "께").when(k == 2, "와").otherwise("")
    text, n = replace_names(F.concat(F.lit("어제 김철수 씨"), particle, F.lit(" "), F.col("c_name")))
    return t.customer.select("c_custkey", text.alias("text"), n.alias("n"))


@query("str_21_labelled_values", "SELECT o_orderkey, o_orderstatus AS status, split_part(o_orderpriority, chr(32), 1) AS priority, o_orderkey::VARCHAR AS key FROM orders")
def _(t):
    text = F.format_string("주문 key: %s, status：%s, priority : %s;", F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    rows = t.orders.select("o_orderkey", labelled_values(text, ["key", "status", "priority", "missing"]).alias("m"))
    return rows.select("o_orderkey", *(F.col("m")[k].alias(k) for k in ("status", "priority", "key")))


#: Topics and acts of invented texts: words with "whe" or "str" stand for two topics, short clauses of function words for follow-ups.
_MOVES = {
    **{(topic, "when"): ("when", "asked") for topic in ("none", "talk", "when", "what", "when before", "what before")},
    **{(topic, "what"): ("what", "named") for topic in ("none", "talk", "when", "what", "when before", "what before")},
    **{(topic, "other"): ("talk", "talked") for topic in ("none", "talk", "when", "what", "when before", "what before")},
    ("when", "follow"): ("when", "asked"), ("what", "follow"): ("what", "asked"), ("when before", "follow"): ("when before", "went on"), ("what before", "follow"): ("what before", "went on"), ("none", "follow"): ("none", "lost"),
}
_INTENTS = IntentRules(
    kinds={"when": "whe|tomorrow", "what": "str", "follow": "^(?:of|and|to|is|the)(?: [a-z]+)?$"}, breaks=r"[.!?;]+(?:\s+|$)|\n+", moves=_MOVES,
    outcomes={"asked": "period", "went on": "period", "lost": "unclear", "named": "chart"}, otherwise="talk", start="none", after_cut="talk", starts={"period": "when before", "chart": "what before", "talk": "talk"}, taken=("asked", "went on"), cut="without the [a-z]+",
)


@query("str_26_intents")
def _(t):
    users = t.conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    found = resolve_intents(users, "conv_id", "turn", "prompt", _INTENTS)
    return found.select("conv_id", "turn", "intent", F.col("text").alias("period_text"), F.array_contains("acts", "went on").alias("from_before"))


@query("str_28_tool_calls", """
SELECT o_orderkey, 'look_up' AS name, CASE WHEN k NOT IN (4, 7) THEN o_orderkey END AS key, CASE WHEN k NOT IN (4, 7) THEN o_totalprice END AS price, CASE WHEN k NOT IN (4, 7) THEN o_orderstatus END AS status,
    CASE WHEN k NOT IN (4, 7) THEN o_totalprice > 100000 END AS large, CASE k WHEN 4 THEN 'repeated argument' WHEN 7 THEN 'kind' END AS bad,
    CASE WHEN k IN (1, 5, 6) THEN 'text after the last call' WHEN k = 2 THEN 'text between parameters' WHEN k IN (3, 7) THEN 'arguments' WHEN k = 4 THEN 'repeated parameter' END AS problem
FROM (SELECT *, o_orderkey % 8 AS k FROM orders)""")
def _(t):
    """Orders written as calls, some spoilt: text behind, half a call behind, a word for a number."""
    k, key, status = F.col("o_orderkey") % 8, F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    price, large = F.col("o_totalprice").cast("string"), (F.col("o_totalprice") > 100000).cast("string")
    parameter = lambda name, value: F.concat(F.lit(f"<parameter={name}>\n"), value, F.lit("\n</parameter>\n"))
    extra = F.when(k == 2, F.lit("and\n")).when(k == 4, parameter("key", key)).otherwise("")
    behind = F.when(k == 1, "\nDone.").when(k == 5, "\n<tool_call>junk</tool_call>").when(k == 6, " text </tool_call>").otherwise("\n")
    said = parameter("key", F.when(k == 7, F.concat(F.lit("no. "), key)).otherwise(key))
    text = F.concat(F.lit("I look.\n<tool_call>\n<function=look_up>\n"), said, extra, parameter("price", price), parameter("status", status), parameter("large", large), F.lit("</function>\n</tool_call>"), behind)
    pairs = {"key": key, "price": price, "status": F.when(k == 3, F.lit("?")).otherwise(status), "large": large}
    want = F.array(F.struct(F.lit("look_up").alias("name"), F.create_map(*(x for n, v in pairs.items() for x in (F.lit(n), v))).alias("arguments")))
    rows = t.orders.select("o_orderkey", F.get(tool_calls(text), F.lit(0)).alias("c"), tool_call_problem(text, want).alias("problem"))
    rows = rows.withColumn("a", typed_arguments(F.col("c"), {"key": "integer", "price": "number", "status": "string", "large": "boolean"}))
    value = lambda name, kind: F.col("a.values")[name].cast(kind).alias(name)
    return rows.select("o_orderkey", "c.name", value("key", "long"), value("price", "double"), value("status", "string"), value("large", "boolean"), F.col("a.problem").alias("bad"), "problem")


#: Forms of Korean birth particulars, written for this query.
_SLOTS = SlotForms(
    date=r"([0-9]{4})년 *([0-9]{1,2})월 *([0-9]{1,2})일", time=r"([0-9]{1,2})시 *([0-9]{1,2})분", hours=r"([0-9]{1,2})시부터 *([0-9]{1,2})시", half_days={"오전": 0, "오후": 12, "저녁": 12},
    choices={"calendar": {"음력": "lunar", "양력": "solar"}, "leap_month": {"윤달": "true", "평달": "false"}}, places=("서울", "부산", "대구", "인천"), only_with={"leap_month": ("calendar", "lunar")}, abroad="해외", unknown_time="시각은? 모",
)


@query("udf_07_slots", """
SELECT o_orderkey, CASE WHEN k <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN k = 0 THEN lpad(((a % 12) + 12)::VARCHAR, 2, '0') || ':05' WHEN k = 2 THEN lpad(a::VARCHAR, 2, '0') || ':05' END AS time,
    CASE WHEN a = 11 AND k IN (1, 5) THEN NULL WHEN k = 1 THEN (a + 12)::VARCHAR || '-' || (a + 13)::VARCHAR WHEN k = 5 THEN lpad(a::VARCHAR, 2, '0') || '-' || lpad((a + 1)::VARCHAR, 2, '0') END AS hours,
    CASE WHEN k <> 3 THEN '부산' END AS place, CASE WHEN k = 0 THEN 'lunar' WHEN k IN (1, 5) THEN 'solar' END AS calendar, CASE WHEN k = 0 THEN 'true' END AS leap_month, CASE WHEN k = 4 THEN 'time' ELSE '' END AS unknown, CASE WHEN k = 3 THEN 'multiple dates' END AS error
FROM (SELECT o_orderkey, o_orderdate, o_orderkey % 6 AS k, 1 + o_orderkey // 6 % 11 AS a FROM orders)""")
def _(t):
    """Birth particulars with every hour of both half days; a leap month counts in the lunar calendar alone."""
    k, day = F.col("o_orderkey") % 6, lambda d: F.date_format(d, "yyyy년 M월 d일")
    a = (1 + F.floor(F.col("o_orderkey") / 6) % 11).cast("int")
    span = F.format_string("%d시부터 %d시", a, a + 1)
    rest = (
        F.when(k == 0, F.format_string(" 음력 윤달 저녁 %d시 5분", a)).when(k == 1, F.concat(F.lit(" 양력 윤달 오후 "), span)).when(k == 2, F.format_string(" 양력인지 음력인지 %d시 5분", a)).when(k == 3, F.concat(F.lit(" 또는 "), day(F.date_add("o_orderdate", 1))))
        .when(k == 4, " 7시 5분 그러나 시각은 모릅니다").otherwise(F.concat(F.lit(" 양력 오전 "), span))
    )
    rows = t.orders.select("o_orderkey", extract_slots(F.concat(day("o_orderdate"), rest, F.lit(" 부산에서")), _SLOTS).alias("s"))
    slot = lambda name, alias: F.col("s.slots")[name].alias(alias)
    return rows.select("o_orderkey", slot("date", "day"), slot("time", "time"), slot("hours", "hours"), slot("place", "place"), slot("calendar", "calendar"), slot("leap_month", "leap_month"), F.array_join("s.unknown", ",").alias("unknown"), "s.error")
