"""Filters and data-quality signals with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.registry import query


def reasons(rules: dict[str, Column]) -> Column:
    """The names of all rules that hold, in the rules' order."""
    return F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))


def exclusion_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """For each reason: rows it is the first of, and rows it holds for at all."""
    rows = df.select(reasons(rules).alias("r")).where(F.size("r") > 0)
    each = rows.select(F.col("r")[0].alias("first"), F.explode("r").alias("reason"))
    return each.groupBy("reason").agg(F.count_if(F.col("reason") == F.col("first")).alias("n_primary"), F.count("*").alias("n_any"))


def contains_any(text: str, words: list[str]) -> Column:
    """Whether a text holds one of the words, whatever their case."""
    return F.col(text).rlike("(?i)" + "|".join(words))


#: Forms of sensitive text. Fixed values.
SENSITIVE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "url": r"https?://[^\s]+",
    "handle": r"(^|\s)@[A-Za-z0-9_]{3,}",
    "long_number": r"(^|[^0-9])[0-9]{13,19}([^0-9]|$)",
    "phone": r"\+[0-9][0-9 ()-]{8,}[0-9]",
    "control": r"[\x00-\x08\x0B\x0C\x0E-\x1F]",
}


def sensitive_tests(text: str) -> dict[str, Column]:
    """Whether a text shows each of the forms, by forms that need fewer steps.

    Where any part of a repeated beginning or end will do, one character stands for it; a
    character that a form can't do without is looked for first, which spares most texts the form.
    """
    t = F.col(text)
    return {
        "email": t.contains("@") & t.rlike(r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2}"),
        "url": t.contains("://") & t.rlike(r"https?://[^\s]"),
        "handle": t.contains("@") & t.rlike(r"(^|\s)@[A-Za-z0-9_]{3}"),
        "long_number": t.rlike(r"[0-9](?<![0-9]{2})[0-9]{12,18}(?![0-9])"),
        "phone": t.contains("+") & t.rlike(SENSITIVE["phone"]),
        "control": t.rlike(SENSITIVE["control"]),
    }


def sensitive_findings(text: str) -> Column:
    """The names of all forms that a text shows."""
    return reasons(sensitive_tests(text))


def text_flags(text: str, wanted: str = "A-Za-z", foreign: str = "À-ÖØ-öø-ÿ") -> dict[str, Column]:
    """Control characters, replacement characters, the wanted letters, and foreign ones without them."""
    own = F.col(text).rlike(f"[{wanted}]")
    return {
        "control": F.col(text).rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F]"), "replacement": F.col(text).contains("�"),
        "wanted": own, "foreign_only": F.col(text).rlike(f"[{foreign}]") & ~own,
    }


def severity(signals: Column, levels: dict[str, list[str]], otherwise: str = "low") -> Column:
    """The first level that has one of the signals."""
    out = None
    for level, names in levels.items():
        hit = F.arrays_overlap(signals, F.array(*map(F.lit, names)))
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return F.coalesce(out, F.lit(otherwise))


def foreign_characters(text: str, characters: str, allowed: list[str]) -> Column:
    """The distinct characters of a class that aren't allowed, sorted."""
    found = F.regexp_extract_all(F.col(text), F.lit(f"([{characters}])"), F.lit(1))
    return F.array_sort(F.array_except(found, F.array(*map(F.lit, allowed))))


def introduced(output: str, prompt: str, form: str) -> Column:
    """Matches in an output that its prompt doesn't have."""
    return F.array_except(F.regexp_extract_all(F.col(output), F.lit(form), F.lit(0)), F.regexp_extract_all(F.col(prompt), F.lit(form), F.lit(0)))


def ungrounded(output: str, before: str) -> Column:
    """The distinct words of an output, without signs at their ends, that don't occur in the earlier text."""
    from corpusloom.functions.columns import let
    from corpusloom.functions.text import words

    bare = F.transform(words(output), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{M}\p{N}]++|(?<![^\p{L}\p{M}\p{N}])[^\p{L}\p{M}\p{N}]++$", ""))
    return let(F.col(before), lambda b: F.filter(F.array_distinct(bare), lambda w: ~b.contains(w)))


def validate_messages(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Each conversation's structural faults, sorted."""
    from corpusloom.operators.projections import messages

    roles = F.transform("messages", lambda m: m["role"])
    faults = reasons({
        "blank": F.exists("messages", lambda m: F.trim(m["content"]) == ""), "first_not_user": ~F.array_contains(F.array(F.lit("user"), F.lit("system")), roles[0]),
        "last_not_assistant": F.element_at(roles, -1) != "assistant", "no_user": ~F.array_contains(roles, "user"),
    })
    return messages(turns, key).select(key, F.array_sort(faults).alias("faults"))


def rule_matches(df: DataFrame, key: str, tags: str, rules: DataFrame) -> DataFrame:
    """(key, rule) where a row's tags hold all of a rule's ``needs`` and none of its ``bars``.

    Rules are a table (rule, needs, bars), rows are (key, tags): tags are exploded and
    joined, so rows aren't compared with every rule.
    """
    needs = rules.select("rule", F.size("needs").alias("n"), F.explode("needs").alias("tag"))
    own = df.select(key, F.explode(tags).alias("tag")).distinct()
    met = own.join(needs, "tag").groupBy(key, "rule", "n").agg(F.count("*").alias("met")).where("met = n")
    barred = own.join(rules.select("rule", F.explode("bars").alias("tag")), "tag").select(key, "rule").distinct()
    return met.join(barred, [key, "rule"], "left_anti").select(key, "rule")


def cycle_consistent(year: str, month_index: str, stem: str) -> Column:
    """Whether a month's cycle position follows from its year's: (year stem * 2 + 2 + month) mod 10."""
    return F.pmod(F.pmod(F.col(year) - 4, F.lit(10)) * 2 + 2 + F.col(month_index), F.lit(10)) == F.col(stem)


@query("flt_01_reasons", """
WITH r AS (SELECT text LIKE '%http%' AS a, regexp_matches(text, '[0-9]{5}') AS b, length(text) > 6000 AS c FROM documents)
SELECT 'url' AS reason, count(*) FILTER (a) AS n_primary, count(*) FILTER (a) AS n_any FROM r HAVING count(*) FILTER (a) > 0
UNION ALL SELECT 'digits', count(*) FILTER (b AND NOT a), count(*) FILTER (b) FROM r HAVING count(*) FILTER (b) > 0
UNION ALL SELECT 'long', count(*) FILTER (c AND NOT a AND NOT b), count(*) FILTER (c) FROM r HAVING count(*) FILTER (c) > 0""")
def _(t):
    rules = {"url": F.col("text").contains("http"), "digits": F.col("text").rlike("[0-9]{5}"), "long": F.length("text") > 6000}
    return exclusion_report(t.documents, rules)


@query("flt_02_contains_any", "SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i)license|copyright|version')")
def _(t):
    return t.documents.where(contains_any("text", ["license", "copyright", "version"])).select("doc_id")


_EMAIL, _PHONE = SENSITIVE["email"], SENSITIVE["phone"]


@query("flt_03_core_patterns", f"SELECT count(*) FILTER (regexp_matches(text, '{_EMAIL}')) AS n_email, count(*) FILTER (regexp_matches(text, '{_PHONE}')) AS n_phone FROM documents")
def _(t):
    return t.documents.agg(F.count_if(F.col("text").rlike(_EMAIL)).alias("n_email"), F.count_if(F.col("text").rlike(_PHONE)).alias("n_phone"))


_CASES = ", ".join(f"CASE WHEN regexp_matches(text, '{form}') THEN '{name}' END" for name, form in SENSITIVE.items())


@query("flt_04_sensitive_findings", f"SELECT doc_id, array_to_string(list_filter([{_CASES}], lambda x: x IS NOT NULL), ',') AS findings FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(sensitive_findings("text"), ",").alias("findings"))


@query("flt_05_text_flags", r"""
SELECT count(*) FILTER (regexp_matches(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]')) AS control, count(*) FILTER (contains(text, chr(65533))) AS replacement,
    count(*) FILTER (regexp_matches(text, '[a-d]')) AS wanted, count(*) FILTER (regexp_matches(text, '[À-ÖØ-öø-ÿ]') AND NOT regexp_matches(text, '[a-d]')) AS foreign_only FROM documents""")
def _(t):
    return t.documents.agg(*(F.count_if(c).alias(n) for n, c in text_flags("text", "a-d").items()))


@query("flt_06_structure", "SELECT conv_id, turn FROM conversations WHERE role IN ('user', 'assistant', 'system') AND trim(coalesce(text, '')) <> '' AND turn >= 0")
def _(t):
    return t.conversations.where(F.col("role").isin("user", "assistant", "system") & (F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("turn") >= 0)).select("conv_id", "turn")


@query("flt_07_message_faults", """
SELECT conv_id, array_to_string(list_filter([CASE WHEN bool_or(trim(text) = '') THEN 'blank' END, CASE WHEN arg_min(role, turn) NOT IN ('user', 'system') THEN 'first_not_user' END,
    CASE WHEN arg_max(role, turn) <> 'assistant' THEN 'last_not_assistant' END, CASE WHEN NOT bool_or(role = 'user') THEN 'no_user' END], lambda x: x IS NOT NULL), ',') AS faults FROM conversations GROUP BY conv_id""")
def _(t):
    return validate_messages(t.conversations).select("conv_id", F.array_join("faults", ",").alias("faults"))


@query("flt_08_severity", """
WITH s AS (SELECT source, CASE WHEN contains(text, '@') THEN 'critical' WHEN contains(text, 'http') THEN 'high' WHEN n_chars > 5000 THEN 'medium' ELSE 'low' END AS severity FROM documents)
SELECT source, severity, count(*) AS n FROM s GROUP BY ALL""")
def _(t):
    signals = reasons({"mail": F.col("text").contains("@"), "link": F.col("text").contains("http"), "long": F.col("n_chars") > 5000})
    rows = t.documents.select("source", severity(signals, {"critical": ["mail"], "high": ["link"], "medium": ["long"]}).alias("severity"))
    return rows.groupBy("source", "severity").agg(F.count("*").alias("n"))


@query("flt_09_typed_range", "SELECT event_id FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS INT) BETWEEN 19 AND 80")
def _(t):
    return t.events.where(F.get_json_object("props", "$.k").try_cast("int").between(19, 80)).select("event_id")


@query("flt_10_foreign_characters", "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(text, '[À-ÖØ-öø-ÿ]'), lambda x: x NOT IN ('é', 'ü')))), '') AS found FROM documents")
def _(t):
    return t.documents.select("doc_id", F.array_join(foreign_characters("text", "À-ÖØ-öø-ÿ", ["é", "ü"]), "").alias("found"))


@query("flt_11_introduced", """
WITH c AS (SELECT conv_id, string_agg(text, chr(10)) FILTER (role = 'assistant') AS o, string_agg(text, chr(10)) FILTER (role <> 'assistant') AS i FROM conversations GROUP BY conv_id)
SELECT conv_id, len(list_distinct(list_filter(regexp_extract_all(coalesce(o, ''), '[A-Z][a-z]{2}'), lambda x: NOT list_contains(regexp_extract_all(coalesce(i, ''), '[A-Z][a-z]{2}'), x))))::INT AS n FROM c""")
def _(t):
    from corpusloom.operators.projections import joined_content, messages

    rows = messages(t.conversations).select("conv_id", joined_content("assistant").alias("o"), joined_content("assistant", False).alias("i"))
    return rows.select("conv_id", F.size(introduced("o", "i", "[A-Z][a-z]{2}")).alias("n"))


@query("flt_12_rules", """
WITH w AS (SELECT user_id, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AS p, bool_or(event_type = 'error') AS e, bool_or(event_type = 'signup') AS s FROM events GROUP BY user_id)
SELECT user_id, 'buyer' AS rule FROM w WHERE c AND p UNION ALL SELECT user_id, 'smooth' FROM w WHERE p AND NOT e UNION ALL SELECT user_id, 'joined' FROM w WHERE s AND c AND NOT e""")
def _(t):
    rules = t.spark.createDataFrame([("buyer", ["click", "purchase"], []), ("smooth", ["purchase"], ["error"]), ("joined", ["signup", "click"], ["error"])], "rule string, needs array<string>, bars array<string>")
    tags = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))
    return rule_matches(tags, "user_id", "tags", rules)


@query("flt_13_recomputed_rules", """
WITH r AS (SELECT l_returnflag, list_filter([CASE WHEN l_discount > 0.05 THEN 'cheap' END, CASE WHEN l_quantity < 25 THEN 'small' END], lambda x: x IS NOT NULL) AS own,
    list_filter([CASE WHEN round(l_discount, 1) > 0.05 THEN 'cheap' END, CASE WHEN l_extendedprice < 35000 THEN 'small' END], lambda x: x IS NOT NULL) AS given FROM lineitem)
SELECT l_returnflag, count(*) FILTER (own = given) AS n_equal, count(*) FILTER (len(list_filter(own, lambda x: NOT list_contains(given, x))) > 0) AS n_missing, count(*) FILTER (len(list_filter(given, lambda x: NOT list_contains(own, x))) > 0) AS n_extra FROM r GROUP BY l_returnflag""")
def _(t):
    """Rules that hold of the line items, against a set supplied from rounded discounts and from prices."""
    own = reasons({"cheap": F.col("l_discount") > 0.05, "small": F.col("l_quantity") < 25})
    given = reasons({"cheap": F.round("l_discount", 1) > 0.05, "small": F.col("l_extendedprice") < 35000})
    rows = t.lineitem.select("l_returnflag", F.array_sort(own).alias("own"), F.array_sort(given).alias("given"))
    lacks = lambda a, b: F.count_if(F.size(F.array_except(a, b)) > 0)
    return rows.groupBy("l_returnflag").agg(F.count_if(F.col("own") == F.col("given")).alias("n_equal"), lacks("own", "given").alias("n_missing"), lacks("given", "own").alias("n_extra"))


@query("flt_14_fact_consistency", "SELECT count(*) AS n, count(*) FILTER (o_totalprice > 0 AND o_orderstatus IN ('F', 'O', 'P')) AS n_valid FROM orders")
def _(t):
    facts = t.orders.select(F.struct("o_totalprice", "o_orderstatus").alias("f"))
    valid = (F.col("f.o_totalprice") > 0) & F.col("f.o_orderstatus").isin("F", "O", "P")
    return facts.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"))


@query("flt_15_cycle_relations", "SELECT count(*) FILTER (((((year(o_orderdate) - 4) % 10) * 2 + 2 + month(o_orderdate)) % 10) = day(o_orderdate) % 10) AS n_valid FROM orders")
def _(t):
    rows = t.orders.select(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), (F.dayofmonth("o_orderdate") % 10).alias("s"))
    return rows.agg(F.count_if(cycle_consistent("y", "m", "s")).alias("n_valid"))


@query("flt_16_safe_text", f"SELECT doc_id FROM documents WHERE NOT ({' OR '.join(f'''regexp_matches(text, '{f}')''' for f in SENSITIVE.values())})")
def _(t):
    return t.documents.where(F.size(sensitive_findings("text")) == 0).select("doc_id")


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of a table's schema, at any depth, whose last part is forbidden."""
    from pyspark.sql.types import ArrayType, MapType, StructType

    def walk(kind, path):
        if isinstance(kind, StructType):
            for f in kind:
                own = f"{path}.{f.name}" if path else f.name
                if f.name in names:
                    yield own
                yield from walk(f.dataType, own)
        elif isinstance(kind, ArrayType):
            yield from walk(kind.elementType, path)
        elif isinstance(kind, MapType):
            yield from walk(kind.valueType, path)

    return list(walk(df.schema, ""))


@query("flt_17_forbidden_fields", "SELECT * FROM (VALUES ('messages.content')) v(path)")
def _(t):
    from corpusloom.operators.projections import messages

    return t.spark.createDataFrame([(p,) for p in forbidden_fields(messages(t.conversations), {"content", "text"})], "path string")


@query("flt_18_risk_queue", """
SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN contains(text, '@') THEN 0 WHEN n_chars > 5000 THEN 1 ELSE 2 END, sha256('42|' || doc_id))::INT AS place FROM documents WHERE source <> 'src0' QUALIFY place <= 50""")
def _(t):
    risk = F.when(F.col("text").contains("@"), 0).when(F.col("n_chars") > 5000, 1).otherwise(2)
    rows = t.documents.where("source <> 'src0'").select("doc_id", risk.alias("risk"), F.sha2(F.concat(F.lit("42|"), F.col("doc_id").cast("string")), 256).alias("h"))
    from corpusloom.operators.ranking import ordinal

    return ordinal(rows.orderBy("risk", "h").limit(50), "risk", "h").select("doc_id", F.col("place"))


@query("flt_19_grounding", """
WITH p AS (SELECT conv_id, turn, role, list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda w: w <> '') AS w, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before FROM conversations)
SELECT conv_id, turn, len(list_filter(w, lambda x: NOT contains(before, regexp_replace(regexp_replace(x, '^[^\\pL\\pM\\pN]+', ''), '[^\\pL\\pM\\pN]+$', '')))) > 0 AS missing FROM p WHERE role = 'assistant'""")
def _(t):
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = t.conversations.withColumn("before", F.array_join(F.collect_list("text").over(before), "\n"))
    return rows.where("role = 'assistant'").select("conv_id", "turn", (F.size(ungrounded("text", "before")) > 0).alias("missing"))
