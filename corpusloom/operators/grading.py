"""Graders of model outputs, and gates over their aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import nonempty_lines, sentences
from corpusloom.operators.quality import reasons
from corpusloom.registry import query


def fabricated(output: Column, granted: Column, form: str) -> Column:
    """Mentioned values that weren't granted, sorted."""
    return F.array_sort(F.array_except(F.regexp_extract_all(output, F.lit(form), F.lit(0)), granted))


def contradictions(output: Column, facts: Column, form: str) -> Column:
    """Labels whose value in a text differs from the facts (a map); ``form`` has a group for each."""
    labels = F.regexp_extract_all(output, F.lit(form), F.lit(1))
    values = F.regexp_extract_all(output, F.lit(form), F.lit(2))
    pairs = F.arrays_zip(labels.alias("k"), values.alias("v"))
    wrong = F.filter(pairs, lambda p: F.coalesce(facts[p["k"]] != p["v"], F.lit(False)))
    return F.array_sort(F.array_distinct(F.transform(wrong, lambda p: p["k"])))


def claims(output: Column, claim: str, negation: str, exclude: str | None = None) -> Column:
    """Sentences that make a claim, without those negated or outside the scope."""
    keep = lambda s: s.rlike(claim) & ~s.rlike(negation) & (~s.rlike(exclude) if exclude else F.lit(True))
    return F.filter(sentences(output), keep)


def false_completion(output: Column, done: Column, claim: str, negation: str, exclude: str | None = None) -> Column:
    """Whether an output says that something is done which isn't."""
    return ~done & (F.size(claims(output, claim, negation, exclude)) > 0)


def reasked(output: Column, provided: Column, forms: Mapping[str, str]) -> Column:
    """Fields already provided for which a question asks again."""
    asked = F.filter(F.split(output, "(?<=[.?!])"), lambda s: F.trim(s).endswith("?"))
    matches = lambda form: lambda s: s.rlike(form)
    hits = reasons({field: F.exists(asked, matches(form)) for field, form in forms.items()})
    return F.array_sort(F.array_intersect(hits, provided))


def map_score(actual: Column, expected: Column) -> Column:
    """Keys that are missing, hallucinated or of another value."""
    keys = lambda m: F.map_keys(m)
    both = F.array_intersect(keys(actual), keys(expected))
    return F.struct(
        F.array_sort(F.array_except(keys(expected), keys(actual))).alias("missing"), F.array_sort(F.array_except(keys(actual), keys(expected))).alias("hallucinated"),
        F.array_sort(F.filter(both, lambda k: actual[k] != expected[k])).alias("mismatched"),
    )


def tri_state(scorable: Column, passed: Column) -> Column:
    return F.when(~scorable | passed.isNull(), "UNSCORABLE").when(passed, "PASS").otherwise("FAIL")


def risk(points: Mapping[str, tuple[Column, int]], levels: Sequence[tuple[int, str]]) -> Column:
    """Points of all risks that hold, and the first level that they reach."""
    total = sum((F.when(rule, weight).otherwise(0) for rule, weight in points.values()), F.lit(0))
    level = F.lit(levels[-1][1])
    for least, name in reversed(levels[:-1]):
        level = F.when(total >= least, name).otherwise(level)
    return F.struct(total.alias("points"), level.alias("severity"))


def gate(aggregate: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row of checks over a one-row aggregate, and whether all hold; null is a failure."""
    rows = aggregate.select(*(F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()))
    whole = F.lit(True)
    for n in checks:
        whole = whole & F.col(n)
    return rows.withColumn("passed", whole)


def no_regression(candidate: DataFrame, baseline: DataFrame, metrics: Sequence[str], tolerance: float) -> DataFrame:
    """(metric, delta, ok) of two one-row aggregates."""
    both = candidate.select(*(F.col(m).alias(f"c_{m}") for m in metrics)).crossJoin(F.broadcast(baseline.select(*(F.col(m).alias(f"b_{m}") for m in metrics))))
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (F.col(f"c_{m}") - F.col(f"b_{m}")).alias("delta")) for m in metrics))).alias("x")).select("x.*")
    return rows.withColumn("ok", F.col("delta") >= -tolerance)


def turn_grade(output: Column, previous: Column, most_chars: int) -> Column:
    """Predicates of one reply: empty, too long, a repeat of the one before, broken off, with a list."""
    return F.struct(
        (F.trim(output) == "").alias("empty"), (F.length(output) > most_chars).alias("too_long"), F.coalesce(F.lower(F.trim(output)) == F.lower(F.trim(previous)), F.lit(False)).alias("repeats"),
        (~F.rtrim(output).rlike(r"[.!?]$")).alias("broken_off"), output.rlike(r"(?m)^[ \t]*([-*]|[0-9]+[.)])[ \t]").alias("has_list"),
    )


def plan_response(prompt: Column, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The mode of the first rule whose pattern the prompt shows."""
    mode = F.lit(otherwise)
    for name, form in reversed(rules):
        mode = F.when(prompt.rlike(form), name).otherwise(mode)
    return mode


def fact_coverage(output: Column, required: Column) -> Column:
    """Required values that a text doesn't mention."""
    return F.filter(required, lambda v: ~output.contains(v))


_CAPS = "[A-Z][a-z]{4,}"


@query("grd_01_contradictions", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'type' ELSE '' END AS wrong FROM events")
def _(t):
    said = F.concat(F.lit("type="), F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("event_type")), F.lit(" user="), F.col("user_id").cast("string"))
    facts = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    return t.events.select("event_id", F.array_join(contradictions(said, facts, r"(type|user)=([a-z0-9]+)"), ",").alias("wrong"))


@query("grd_02_fabricated", f"SELECT doc_id, len(list_distinct(list_filter(regexp_extract_all(text, '{_CAPS}'), lambda x: NOT list_contains(regexp_extract_all(substring(text, 1, 400), '{_CAPS}'), x))))::INT AS n FROM documents")
def _(t):
    granted = F.regexp_extract_all(F.substring("text", 1, 400), F.lit(_CAPS), F.lit(0))
    return t.documents.select("doc_id", F.size(fabricated(F.col("text"), granted, _CAPS)).alias("n"))


@query("grd_03_reasked", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'date' ELSE '' END AS again FROM events")
def _(t):
    said = F.when(F.col("event_type").isin("click", "view"), "Fine. What is the date of birth?").otherwise("The date is known. Which place?")
    return t.events.select("event_id", F.array_join(reasked(said, F.array(F.lit("date"), F.lit("name")), {"date": "date", "place": "place"}), ",").alias("again"))


@query("grd_04_false_completion", r"SELECT doc_id, lang <> 'fr' AND len(list_filter(string_split_regex(regexp_replace(text, '(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+', '\1', 'g'), '[.!?\n]+'), lambda s: trim(s) <> '' AND regexp_matches(s, 'the ') AND NOT regexp_matches(s, 'and'))) > 0 AS bad FROM documents")
def _(t):
    return t.documents.select("doc_id", false_completion(F.col("text"), F.col("lang") == "fr", "the ", "and").alias("bad"))


@query("grd_05_slot_scores", "SELECT event_type, count(*) FILTER (event_id % 2 = 0) AS n_missing, count(*) FILTER (event_id % 3 = 0) AS n_hallucinated, count(*) FILTER (event_id % 5 = 0) AS n_mismatched FROM events GROUP BY event_type")
def _(t):
    expected = F.create_map(F.lit("a"), F.col("event_type"), F.lit("b"), F.lit("x"))
    entries = F.filter(F.array(
        F.struct(F.lit("a").alias("key"), F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).alias("value")),
        F.struct(F.when(F.col("event_id") % 2 != 0, "b").alias("key"), F.lit("x").alias("value")), F.struct(F.when(F.col("event_id") % 3 == 0, "c").alias("key"), F.lit("y").alias("value")),
    ), lambda e: e["key"].isNotNull())
    rows = t.events.select("event_type", map_score(F.map_from_entries(entries), expected).alias("s"))
    return rows.groupBy("event_type").agg(*(F.sum(F.size(f"s.{k}")).alias(f"n_{k}") for k in ("missing", "hallucinated", "mismatched")))


@query("grd_06_turn_grades", r"""
WITH a AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'assistant')
SELECT count(*) FILTER (trim(text) = '') AS n_empty, count(*) FILTER (length(text) > 300) AS n_long, count(*) FILTER (lower(trim(text)) = lower(trim(p))) AS n_repeats, count(*) FILTER (NOT regexp_matches(rtrim(text), '[.!?]$')) AS n_broken FROM a""")
def _(t):
    from pyspark.sql import Window

    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = t.conversations.where("role = 'assistant'").withColumn("p", before).select(turn_grade(F.col("text"), F.col("p"), 300).alias("g"))
    return rows.agg(*(F.count_if(f"g.{a}").alias(b) for a, b in (("empty", "n_empty"), ("too_long", "n_long"), ("repeats", "n_repeats"), ("broken_off", "n_broken"))))


@query("grd_07_generation_scores", r"""
SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[À-ÖØ-öø-ÿ]')) AS n_accented, count(*) FILTER (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) > 5) AS n_many_lines, count(*) FILTER (contains(text, '|')) AS n_table FROM documents GROUP BY lang""")
def _(t):
    text = F.col("text")
    scores = F.struct(text.rlike("[À-ÖØ-öø-ÿ]").alias("accented"), (F.size(nonempty_lines("text")) > 5).alias("many_lines"), text.contains("|").alias("table"))
    rows = t.documents.select("lang", scores.alias("s"))
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *(F.count_if(f"s.{k}").alias(f"n_{k}") for k in ("accented", "many_lines", "table")))


@query("grd_08_tri_state", "SELECT CASE WHEN l_tax > 0.07 THEN 'UNSCORABLE' WHEN l_quantity > 20 THEN 'PASS' ELSE 'FAIL' END AS verdict, count(*) AS n FROM lineitem GROUP BY 1")
def _(t):
    return t.lineitem.groupBy(tri_state(F.col("l_tax") <= 0.07, F.col("l_quantity") > 20).alias("verdict")).agg(F.count("*").alias("n"))


@query("grd_09_risk", "SELECT severity, count(*) AS n, sum(p)::BIGINT AS points FROM (SELECT p, CASE WHEN p >= 5 THEN 'high' WHEN p >= 2 THEN 'medium' ELSE 'low' END AS severity FROM (SELECT (l_discount > 0.08)::INT * 3 + (l_quantity < 10)::INT * 2 + (l_returnflag = 'R')::INT AS p FROM lineitem)) GROUP BY severity")
def _(t):
    points = {"discount": (F.col("l_discount") > 0.08, 3), "small": (F.col("l_quantity") < 10, 2), "returned": (F.col("l_returnflag") == "R", 1)}
    rows = t.lineitem.select(risk(points, [(5, "high"), (2, "medium"), (0, "low")]).alias("r")).select("r.*")
    return rows.groupBy("severity").agg(F.count("*").alias("n"), F.sum("points").alias("points"))


@query("grd_10_gate", "SELECT coalesce(avg(quality) >= 0.5, FALSE) AS quality, coalesce(avg(toxic) <= 0.2, FALSE) AS toxic, count(*) >= 10 AS enough, coalesce(avg(quality) >= 0.5, FALSE) AND coalesce(avg(toxic) <= 0.2, FALSE) AND count(*) >= 10 AS passed FROM labels")
def _(t):
    row = t.labels.agg(F.avg("quality").alias("q"), F.avg("toxic").alias("t"), F.count("*").alias("n"))
    return gate(row, {"quality": F.col("q") >= 0.5, "toxic": F.col("t") <= 0.2, "enough": F.col("n") >= 10})


@query("grd_11_no_regression", "WITH a AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE event_id % 2 = 0), b AS (SELECT avg(value) AS v, avg(user_id) AS u FROM events WHERE event_id % 2 = 1) SELECT 'v' AS metric, round(a.v - b.v, 9) AS delta, a.v - b.v >= -1.0 AS ok FROM a, b UNION ALL SELECT 'u', round(a.u - b.u, 9), a.u - b.u >= -1.0 FROM a, b")
def _(t):
    arm = lambda k: t.events.where(F.col("event_id") % 2 == k).agg(F.avg("value").alias("v"), F.avg("user_id").alias("u"))
    return no_regression(arm(0), arm(1), ["v", "u"], 1.0).withColumn("delta", F.round("delta", 9))


@query("grd_12_baseline_choice", "SELECT CASE WHEN avg(o_totalprice) FILTER (o_orderstatus = 'F') >= avg(o_totalprice) FILTER (o_orderstatus = 'O') - 500 THEN 'second' ELSE 'first' END AS chosen FROM orders")
def _(t):
    mean = lambda s: F.avg(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")))
    return t.orders.agg(F.when(mean("F") >= mean("O") - 500, "second").otherwise("first").alias("chosen"))


@query("grd_13_review_state", "SELECT CASE WHEN count(*) FILTER (toxic IS NULL) > 0 THEN 'pending' WHEN count(*) FILTER (toxic = 1) > 0 THEN 'blocked' ELSE 'ready' END AS state, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    state = F.when(F.count_if(F.col("toxic").isNull()) > 0, "pending").when(F.count_if(F.col("toxic") == 1) > 0, "blocked").otherwise("ready")
    return rows.agg(state.alias("state"), F.count("*").alias("n"))


@query("grd_14_audit", "SELECT count(*) FILTER (l_quantity <= 0) AS n_blockers, count(*) FILTER (l_discount > 0.09) AS n_warnings, count(*) FILTER (l_quantity <= 0) = 0 AS ok FROM lineitem")
def _(t):
    bad = F.count_if(F.col("l_quantity") <= 0)
    return t.lineitem.agg(bad.alias("n_blockers"), F.count_if(F.col("l_discount") > 0.09).alias("n_warnings"), (bad == 0).alias("ok"))


@query("grd_15_derived_checks", "SELECT count(*) FILTER ((n_chars = length(text)) <> (doc_id % 50 <> 0)) AS n_lies FROM documents")
def _(t):
    stored = t.documents.withColumn("stored", F.col("doc_id") % 50 != 0)
    return stored.agg(F.count_if((F.col("n_chars") == F.length("text")) != F.col("stored")).alias("n_lies"))


@query("grd_16_response_plan", "SELECT mode, count(*) AS n FROM (SELECT CASE WHEN contains(text, '?') THEN 'answer' WHEN regexp_matches(text, '[0-9]') THEN 'compute' ELSE 'chat' END AS mode FROM conversations WHERE role = 'user') GROUP BY mode")
def _(t):
    rows = t.conversations.where("role = 'user'").select(plan_response(F.col("text"), [("answer", r"\?"), ("compute", "[0-9]")], "chat").alias("mode"))
    return rows.groupBy("mode").agg(F.count("*").alias("n"))


@query("grd_17_matrices", "SELECT 100::BIGINT AS n, count(*) FILTER ((a + b) % 10 <> (b + a) % 10) AS n_mismatch FROM generate_series(0, 9) f(a), generate_series(0, 9) g(b)")
def _(t):
    from corpusloom.functions.dates import element_relation

    grid = t.spark.range(100).select((F.col("id") % 10).alias("a"), F.floor(F.col("id") / 10).alias("b"))
    kinds = ("same", "output", "wealth", "authority", "resource")
    oracle = t.spark.createDataFrame([(a, b, f"{kinds[(b // 2 - a // 2) % 5]}_{'even' if a % 2 == b % 2 else 'odd'}") for a in range(10) for b in range(10)], "a long, b long, relation string")
    rows = grid.withColumn("own", element_relation(F.col("a"), F.col("b"))).join(oracle, ["a", "b"])
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("own") != F.col("relation")).alias("n_mismatch"))


@query("grd_18_structural_errors", "SELECT doc_id, array_to_string(list_filter([CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN NOT regexp_matches(text, '[.!?]') THEN 'no_end' END], lambda x: x IS NOT NULL), ',') AS errors FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(reasons({"table": F.col("text").contains("|"), "no_end": ~F.col("text").rlike("[.!?]")}), ",").alias("errors"))


@query("grd_19_fact_coverage", "SELECT doc_id, array_to_string(list_filter(['the', 'ein', lang], lambda v: NOT contains(text, v)), ',') AS missing FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(fact_coverage(F.col("text"), F.array(F.lit("the"), F.lit("ein"), F.col("lang"))), ",").alias("missing"))


@query("grd_20_typed_contracts", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 0 AND 50 AS in_range, event_type IN ('click', 'view') AS allowed FROM events")
def _(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.select("event_id", k.between(0, 50).alias("in_range"), F.col("event_type").isin("click", "view").alias("allowed"))


@query("grd_21_stateful_case", "SELECT conv_id, bool_and(NOT coalesce(lower(trim(text)) = lower(trim(p)), FALSE) AND trim(text) <> '') AS passed FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY conv_id")
def _(t):
    from pyspark.sql import Window

    g = turn_grade(F.col("text"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")), 1 << 20)
    rows = t.conversations.select("conv_id", g.alias("g"))
    return rows.groupBy("conv_id").agg(F.bool_and(~F.col("g.repeats") & ~F.col("g.empty")).alias("passed"))


@query("grd_22_arm_target", "SELECT user_id, avg(value) > 45 AND count(*) > 50 AS reached FROM events GROUP BY user_id")
def _(t):
    return t.events.groupBy("user_id").agg(((F.avg("value") > 45) & (F.count("*") > 50)).alias("reached"))


@query("grd_23_scoped_completion", r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+', '\1', 'g'), '[.!?\n]+'), lambda s: trim(s) <> '' AND regexp_matches(s, 'the ') AND NOT regexp_matches(s, 'and') AND NOT regexp_matches(s, 'of'))) > 0 AS bad FROM documents")
def _(t):
    return t.documents.select("doc_id", false_completion(F.col("text"), F.lit(False), "the ", "and", "of").alias("bad"))
