"""Scores of replies by many metrics at once, and grades of turns from their claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import let
from corpusloom.functions.text import has_repetition, nonempty_lines, repeated_word_ngrams, sentences, words
from corpusloom.operators.claims import _CLAIMS, _FACTS, _GRAMMAR, _GUARDS, ClaimGrammar, _facts_of, by_key, claim_errors, claim_rows, claims, omitted_facts, unsupported
from corpusloom.registry import query


@dataclass(frozen=True)
class ScoreRules:
    """What replies are scored by; all forms and names are the caller's.

    ``fact_axis``, ``rule_axis``, ``story_axis`` and ``chat_axis`` are the axes on which the
    contract of typed facts, that of a rule's polarity, the ban on causal statements and
    that on claims hold; elsewhere those metrics don't apply and are null.
    """

    grammar: ClaimGrammar
    special: str
    foreign: str
    severe: str
    entities: str
    dates: str
    causal: str
    softened: str
    fact_axis: str
    rule_axis: str
    story_axis: str
    chat_axis: str
    fabricated: int = 4


def repeats(c: Column, width: int = 4, times: int = 3) -> Column:
    """Whether a sentence comes twice, or a run of ``width`` words so many times."""

    def often(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, F.lit(width)), " "))
        same = lambda g: F.exists(F.sequence(F.lit(0), F.greatest(F.size(g) - times, F.lit(0))), lambda i: F.coalesce(F.get(g, i) == F.get(g, i + (times - 1)), F.lit(False)))
        return (F.size(w) >= width + times - 1) & let(F.array_sort(grams), same)

    return has_repetition(c) | let(words(F.lower(c)), often)


def _stated(c: Column, g: ClaimGrammar) -> Column:
    """Current asserted claims, in the order of the text."""
    return F.filter(claims(c, g), lambda x: (x["scope"] == "current") & (x["polarity"] == "asserted") & (x["kind"] != "loose"))


def _first(stated: Column) -> Column:
    """Role to the first value stated of it."""
    roles = F.array_distinct(F.transform(stated, lambda x: x["role"]))
    return F.map_from_arrays(roles, F.transform(roles, lambda r: F.get(F.filter(stated, lambda x: x["role"] == r), F.lit(0))["value"]))


def _agree(mine: Column, theirs: Column) -> Column:
    """Whether all roles of ``theirs`` have the same value in ``mine``; null if there are none."""
    return F.when(F.size(theirs) > 0, F.forall(F.map_entries(theirs), lambda e: F.coalesce(mine[e["key"]] == e["value"], F.lit(False))))


def score_replies(pairs: DataFrame, rules: ScoreRules) -> DataFrame:
    """``pairs`` (axis, prompt, reply, facts, rule_holds, cut_off, ...) with the metrics of each reply.

    ``facts`` is a map of roles to expected values, ``rule_holds`` whether the rule holds by
    the reference, null if there's none. Metrics that don't apply are null. Every metric
    is of one row, so nothing is shuffled; claims of prompt and reply are read once. A
    null reply is empty, a null prompt states nothing.
    """
    g = rules.grammar
    reply, prompt = F.coalesce("reply", F.lit("")), F.coalesce("prompt", F.lit(""))
    rows = pairs.withColumns({"_r": _stated(reply, g), "_p": _stated(prompt, g)}).withColumns({"_mine": _first(F.col("_r")), "_theirs": _first(F.col("_p"))})
    fresh = lambda form: F.size(F.array_except(F.regexp_extract_all(reply, F.lit(form), F.lit(0)), F.regexp_extract_all(prompt, F.lit(form), F.lit(0)))) > 0
    values = lambda c: F.transform(c, lambda x: x["value"])
    on = lambda axis, c: F.when(F.col("axis") == axis, c)
    special, cut = reply.rlike(rules.special), F.coalesce("cut_off", F.lit(False))
    nonempty = F.trim(reply, F.lit(" \t\n\r")) != ""
    denied = F.exists(claims(reply, g), lambda x: (x["scope"] == "current") & (x["polarity"] == "denied"))
    metrics = {
        "generation_clean": nonempty & ~special & ~cut, "nonempty": nonempty, "cut_off": cut, "special_or_control": special, "foreign_sentence": F.exists(sentences(reply), lambda s: s.rlike(rules.foreign)),
        "severe_safety": reply.rlike(rules.severe), "sensitive_entity": fresh(rules.entities), "unsupported_full_date": fresh(rules.dates),
        "input_fact_violation": F.when(F.size("_theirs") > 0, F.exists("_r", lambda x: F.coalesce(F.col("_theirs")[x["role"]] != x["value"], F.lit(False)))),
        "fabricated_values": F.size(F.array_except(values(F.col("_r")), values(F.col("_p")))) >= rules.fabricated, "task_confusion": on(rules.chat_axis, F.size("_r") > 0), "repetition": repeats(reply),
        "fact_contract_pass": on(rules.fact_axis, _agree(F.col("_mine"), F.col("facts"))), "rule_contract_pass": on(rules.rule_axis, F.when(F.col("rule_holds").isNotNull(), F.col("rule_holds") == ~denied)),
        "grounded_fact_pass": _agree(F.col("_mine"), F.col("_theirs")), "noncausal_pass": on(rules.story_axis, ~reply.rlike(rules.causal) | reply.rlike(rules.softened)),
        "json_parse": F.try_parse_json(F.when(nonempty, reply)).isNotNull(), "output_characters": F.length(F.trim(reply, F.lit(" \t\n\r"))),
    }
    return rows.withColumns(metrics).drop("_r", "_p", "_mine", "_theirs")


@dataclass(frozen=True)
class TurnRules:
    """Least lines and sentences of a reply, forms of questions for what is known already, and the largest share of repeated six-word runs."""

    lines: int
    sentences: int
    reasked: str
    negated: str
    claims: Mapping[str, str]
    repeated: float = 0.35
    marks: Sequence[str] = ("confused:", "swapped:", "part_as_whole:")
    unfounded: Sequence[str] = ("unfounded:", "unprovided:", "unsupported:")


def grade_turns(turns: DataFrame, keys: Sequence[str], on: Sequence[str], facts: DataFrame, required: DataFrame, grammar: ClaimGrammar, guards, rules: TurnRules, wholes: Sequence[str] = ()) -> DataFrame:
    """(keys, ...) grades of each reply of ``turns`` (keys, reply, cut_off, over_budget).

    ``on`` are the keys of a conversation, which ``facts`` (on, role, value) have, and the
    last of ``keys`` orders its replies; ``required`` (keys, name, value, role) are the
    facts that each must state. Errors and omissions come from claims as rows, joined by
    key. A reply passes if it isn't empty, short, cut off or over budget, and has no error,
    no omission and no question for what is known. ``followup_consistent`` is null for a first reply, and
    else whether this one and all before it are without errors and omissions.
    """
    keys, on = list(keys), list(on)
    rows = turns.withColumn("reply", F.coalesce("reply", F.lit("")))
    codes = claim_errors(claim_rows(rows, keys, "reply", grammar), facts, keys, on, wholes).union(unsupported(rows, keys, "reply", rules.claims, rules.negated))
    omitted = omitted_facts(rows, keys, "reply", required, grammar, guards).groupBy(*keys).agg(F.array_sort(F.collect_list("name")).alias("omissions"))
    graded = rows.join(by_key(codes, rows, keys), keys).join(omitted, keys, "left").withColumn("omissions", F.coalesce("omissions", F.array().cast("array<string>")))
    reply = F.col("reply")
    some = lambda marks: F.exists("errors", lambda e: e.rlike("^(?:" + "|".join(marks) + ")"))
    clean = (F.size("errors") == 0) & (F.size("omissions") == 0)
    graded = graded.withColumns({
        "nonempty": F.trim(reply, F.lit(" \t\n\r")) != "", "n_lines": F.size(nonempty_lines(reply)), "n_sentences": F.size(sentences(reply)), "label_confusion": some(rules.marks), "unsupported_fact": some(rules.unfounded),
        "reasked": F.exists(F.filter(F.split(reply, "(?<=[.?!])"), lambda s: F.trim(s).endswith("?")), lambda s: s.rlike(rules.reasked)), "repeated_ratio": F.round(repeated_word_ngrams(reply), 6), "_clean": clean,
    })
    before = Window.partitionBy(*on).orderBy(keys[-1])
    long_enough = (F.col("n_lines") >= rules.lines) & (F.col("n_sentences") >= rules.sentences)
    passed = F.col("nonempty") & long_enough & ~F.coalesce("cut_off", F.lit(False)) & ~F.coalesce("over_budget", F.lit(False)) & F.col("_clean") & ~F.col("reasked")
    consistent = F.when(F.row_number().over(before) > 1, F.min("_clean").over(before.rowsBetween(Window.unboundedPreceding, 0)))
    return graded.withColumns({"long_enough": long_enough, "repetitive": F.col("repeated_ratio") > rules.repeated, "passed": passed, "followup_consistent": consistent}).drop("_clean", "reply")


_RULES = ScoreRules(
    grammar=_GRAMMAR, special=r"<\|[a-z]+\|>|[\x00-\x08]", foreign="[À-ÖØ-öø-ÿ]{2}", severe=" die ", entities=r"@[a-z]+|https?://[a-z.]+|[0-9]{6,}", dates="[0-9]{4}-[0-9]{2}-[0-9]{2}", causal=" by ", softened=" or ",
    fact_axis="en", rule_axis="de", story_axis="fr", chat_axis="es",
)
_METRICS = (
    "generation_clean", "nonempty", "cut_off", "special_or_control", "foreign_sentence", "severe_safety", "sensitive_entity", "unsupported_full_date", "input_fact_violation", "fabricated_values", "task_confusion",
    "repetition", "fact_contract_pass", "rule_contract_pass", "grounded_fact_pass", "noncausal_pass", "json_parse", "output_characters",
)

_PAIRS = """,
pairs AS (SELECT c.conv_id, c.turn, c.text AS reply, p.text AS prompt, p.turn AS asked, d.lang AS axis, contains(d.text, ' nicht ') AS denies, d.text IS NOT NULL AS known FROM conversations c
    LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1 AND p.role = 'user' LEFT JOIN documents d ON d.doc_id = c.conv_id WHERE c.role = 'assistant'),
stated AS (SELECT conv_id, turn, role, value, sn * 1000000 + i AS nth FROM claims WHERE scope = 'current' AND polarity = 'asserted'),
firsts AS (SELECT conv_id, turn, role, arg_min(value, nth) AS value FROM stated GROUP BY ALL),
denials AS (SELECT DISTINCT conv_id, turn FROM claims WHERE scope = 'current' AND polarity = 'denied')"""


@query("grd_07_reply_scores", _CLAIMS + _FACTS + _PAIRS + r""",
said AS (SELECT conv_id, turn, list_filter(list_transform(string_split_regex(regexp_replace(reply, '(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+', '\1', 'g'), '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '') AS sents,
    list_filter(string_split_regex(lower(reply), '[ \n\t\r]+'), lambda w: w <> '') AS w FROM pairs),
grams AS (SELECT conv_id, turn, max(n) AS most FROM (SELECT conv_id, turn, g, count(*) AS n FROM (SELECT conv_id, turn, unnest(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) AS g FROM said) GROUP BY ALL) GROUP BY ALL),
m AS (SELECT p.conv_id, p.turn, axis, trim(reply, ' ' || chr(9) || chr(10) || chr(13)) <> '' AS nonempty, length(reply) >= 1500 AS cut_off, regexp_matches(reply, '<\|[a-z]+\|>|[\x00-\x08]') AS special_or_control,
    len(list_filter(sents, lambda s: regexp_matches(s, '[À-ÖØ-öø-ÿ]{2}'))) > 0 AS foreign_sentence, contains(reply, ' die ') AS severe_safety,
    len(list_filter(regexp_extract_all(reply, '@[a-z]+|https?://[a-z.]+|[0-9]{6,}'), lambda x: NOT list_contains(regexp_extract_all(coalesce(prompt, ''), '@[a-z]+|https?://[a-z.]+|[0-9]{6,}'), x))) > 0 AS sensitive_entity,
    len(list_filter(regexp_extract_all(reply, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), lambda x: NOT list_contains(regexp_extract_all(coalesce(prompt, ''), '[0-9]{4}-[0-9]{2}-[0-9]{2}'), x))) > 0 AS unsupported_full_date,
    CASE WHEN EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id = p.conv_id AND f.turn = p.asked) THEN EXISTS (SELECT 1 FROM stated s JOIN firsts f ON f.conv_id = s.conv_id AND f.role = s.role WHERE s.conv_id = p.conv_id AND s.turn = p.turn AND f.turn = p.asked AND f.value <> s.value) END AS input_fact_violation,
    (SELECT count(DISTINCT s.value) FROM stated s WHERE s.conv_id = p.conv_id AND s.turn = p.turn AND NOT EXISTS (SELECT 1 FROM stated q WHERE q.conv_id = p.conv_id AND q.turn = p.asked AND q.value = s.value)) >= 4 AS fabricated_values,
    CASE WHEN axis = 'es' THEN EXISTS (SELECT 1 FROM stated s WHERE s.conv_id = p.conv_id AND s.turn = p.turn) END AS task_confusion,
    len(list_distinct(sents)) < len(sents) OR coalesce(most, 0) >= 3 AS repetition,
    CASE WHEN axis = 'en' AND EXISTS (SELECT 1 FROM facts e WHERE e.conv_id = p.conv_id) THEN NOT EXISTS (SELECT 1 FROM facts e LEFT JOIN firsts f ON f.conv_id = e.conv_id AND f.role = e.role AND f.turn = p.turn WHERE e.conv_id = p.conv_id AND coalesce(f.value <> e.value, TRUE)) END AS fact_contract_pass,
    CASE WHEN axis = 'de' THEN denies = EXISTS (SELECT 1 FROM denials x WHERE x.conv_id = p.conv_id AND x.turn = p.turn) END AS rule_contract_pass,
    CASE WHEN EXISTS (SELECT 1 FROM firsts f WHERE f.conv_id = p.conv_id AND f.turn = p.asked) THEN NOT EXISTS (SELECT 1 FROM firsts e LEFT JOIN firsts f ON f.conv_id = e.conv_id AND f.role = e.role AND f.turn = p.turn WHERE e.conv_id = p.conv_id AND e.turn = p.asked AND coalesce(f.value <> e.value, TRUE)) END AS grounded_fact_pass,
    CASE WHEN axis = 'fr' THEN NOT contains(reply, ' by ') OR contains(reply, ' or ') END AS noncausal_pass, FALSE AS json_parse, length(trim(reply, ' ' || chr(9) || chr(10) || chr(13))) AS output_characters
    FROM pairs p JOIN said USING (conv_id, turn) LEFT JOIN grams g ON g.conv_id = p.conv_id AND g.turn = p.turn)
SELECT *, nonempty AND NOT special_or_control AND NOT cut_off AS generation_clean FROM m""")
def _(t):
    """Every reply by what the user said just before; a document of the conversation's number gives axis, facts and rule."""
    users = t.conversations.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt"))
    facts = _facts_of(t).groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "value"))).alias("facts"))
    about = t.documents.select(F.col("doc_id").alias("conv_id"), F.col("lang").alias("axis"), (~F.contains("text", F.lit(" nicht "))).alias("rule_holds"))
    pairs = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"), (F.length("text") >= 1500).alias("cut_off"))
    pairs = pairs.join(users, ["conv_id", "turn"], "left").join(about, "conv_id", "left").join(facts, "conv_id", "left").withColumn("facts", F.coalesce("facts", F.create_map().cast("map<string,string>")))
    return score_replies(pairs, _RULES).select("conv_id", "turn", "axis", *_METRICS)


_TURN = TurnRules(lines=1, sentences=3, reasked="the", negated=" by ", claims={"origin": " from "})


@query("grd_06_graded_turns")
def _(t):
    """Every reply by the facts of the document of the conversation's number, of which it must state the first source."""
    turns = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("reply"), (F.length("text") > 4000).alias("cut_off"), F.lit(False).alias("over_budget"))
    facts = _facts_of(t)
    required = turns.select("conv_id", "turn").join(facts.where("role = 'source'"), "conv_id").select("conv_id", "turn", F.lit("source").alias("name"), "value", "role")
    return grade_turns(turns, ["conv_id", "turn"], ["conv_id"], facts, required, _GRAMMAR, _GUARDS, _TURN, ["place"])
