"""Claims of texts as rows: read from sentences with their scope, joined with facts, and judged."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.columns import let
from corpusloom.functions.spans import cut_at, pieces_of, spans_of
from corpusloom.registry import query

#: Sentences: what stands between sentence ends.
SENTENCE = r"[^\n.!?。！？]+"
_CLOSERS = r"^[\s'\"’”)\]]+"


@dataclass(frozen=True)
class ClaimGrammar:
    """How claims are written; all forms are the caller's regular expressions, without groups that capture.

    ``labels``: role to the form of its label. ``value``: the form of a value. ``forward``
    joins a label to the value behind it, ``backward`` a value to the label behind it.
    ``frames``: scope to the form of what puts claims behind it into that scope.
    ``denied``, ``supposed`` and ``retold`` stand right behind a claim, ``doubted`` anywhere
    in its tail. ``quoted`` is a quotation with its marks. ``swapped`` and ``mended`` lead
    from a wrong value to the right one ("not X but Y", "X, no, Y"). A label with neither
    link but with a value within ``bridge`` characters makes a loose claim.
    """

    labels: Mapping[str, str]
    value: str
    forward: str
    backward: str | None = None
    frames: Mapping[str, str] = field(default_factory=dict)
    denied: str | None = None
    doubted: str | None = None
    supposed: str | None = None
    retold: str | None = None
    quoted: str | None = None
    swapped: str | None = None
    mended: str | None = None
    bridge: int = 0
    sentence: str = SENTENCE


def _begins(text: Column, form: str | None) -> Column:
    return text.rlike(f"^(?:{form})") if form else F.lit(False)


def _named(text: Column, forms: Mapping[str, str]) -> Column:
    """The name of the first form that is the whole of ``text``."""
    out = F.lit(None).cast("string")
    for name, form in reversed(forms.items()):
        out = F.when(text.rlike(f"^(?:{form})$"), name).otherwise(out)
    return out


def _any(forms: Mapping[str, str]) -> str:
    return "|".join(f"(?:{f})" for f in forms.values())


def _segments(sentence: Column, g: ClaimGrammar) -> Column:
    """A sentence cut at its labels: each label with its role, the text up to the next one, and the claims' matches.

    ``got``: a value linked behind the label, within the text; ``back``: one linked
    before it, that the label before hasn't taken.
    """
    behind, before = f"^(?:{g.forward})({g.value})", f"({g.value})(?:{g.backward})$"

    def bodies(c: Column) -> Column:
        body = lambda s, i: F.coalesce(F.get(c["spans"], i + 1)["lead"], c["rest"])
        return F.transform(c["spans"], lambda s, i: F.struct(
            s["start"], s["end"], s["lead"], _named(s["value"], g.labels).alias("role"), body(s, i).alias("body"),
            F.regexp_extract(body(s, i), behind, 0).alias("got"), F.regexp_extract(body(s, i), behind, 1).alias("value"),
        ))

    def backs(a: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            last = F.get(a, i - 1)
            left = F.when(i > 0, F.substring(last["body"], F.length(last["got"]) + 1, F.length(last["body"]))).otherwise(s["lead"])
            found = lambda k: F.when(s["got"] == "", F.regexp_extract(left, before, k)).otherwise("") if g.backward is not None else F.lit("")
            return s.withField("back", found(0)).withField("back_value", found(1))

        return F.transform(a, add)

    return let(let(cut_at(sentence, _any(g.labels)), bodies), backs)


def _of_sentence(at: Column, sentence: Column, g: ClaimGrammar) -> Column:
    frames = F.transform(spans_of(sentence, _any(g.frames)), lambda s: F.struct(s["start"], _named(s["value"], g.frames).alias("scope"))) if g.frames else None
    quotes = F.filter(spans_of(sentence, g.quoted), lambda q: _begins(F.substring(sentence, q["end"] + 1, F.lit(64)), g.retold)) if g.quoted else None
    names = [n for n, on in (("frames", frames), ("quotes", quotes)) if on is not None]
    about = F.struct(_segments(sentence, g).alias("segments"), *([frames.alias("frames")] if g.frames else []), *([quotes.alias("quotes")] if g.quoted else []))

    def all_claims(b: Column) -> Column:
        def scope(start: Column, end: Column, tail: Column) -> Column:
            out = F.when(_begins(tail, g.supposed), "hypothetical").when(_begins(tail, g.retold), "reported")
            if "quotes" in names:
                out = out.when(F.exists(b["quotes"], lambda q: (q["start"] <= start) & (end <= q["end"])), "reported")
            if "frames" in names:
                out = out.when(F.lit(True), F.array_max(F.filter(b["frames"], lambda f: f["start"] < start))["scope"])
            return F.coalesce(out, F.lit("current"))

        def made(s: Column, value: Column, start: Column, end: Column, tail: Column, kind: str, taken: Column) -> Column:
            """A claim, and the one that corrects it; ``taken``: the last value of the tail belongs to the next label."""

            def told(t: Column) -> Column:
                polarity = F.when(_begins(t, g.denied), "denied").when(t.rlike(g.doubted) if g.doubted else F.lit(False), "uncertain").otherwise("asserted")
                right = lambda form: F.regexp_extract(t, f"^(?:{form})({g.value})", 1) if form else F.lit("")
                lead = lambda form: F.length(F.regexp_extract(t, f"^(?:{form})({g.value})", 0)) if form else F.lit(0)
                own = F.size(F.regexp_extract_all(t, F.lit(g.value), F.lit(0))) > F.when(taken, 1).otherwise(0)
                swapped, mended = right(g.swapped), right(g.mended)
                row = lambda v, x, y, z, p, k: F.struct(s["role"].alias("role"), v.alias("value"), (at + x).alias("start"), (at + y).alias("end"), z.alias("scope"), p.alias("polarity"), F.lit(k).alias("kind"))
                here = scope(start, end, t)
                first = row(value, start, end, F.when((mended != "") & (swapped == "") & own, "superseded").otherwise(here), F.lit("uncertain") if kind == "loose" else polarity, kind)
                if kind == "loose":
                    return F.array(first)
                skipped = F.length(tail) - F.length(t)
                last = end + skipped + F.when(swapped != "", lead(g.swapped)).otherwise(lead(g.mended))
                fresh = F.when(swapped != "", swapped).otherwise(mended)
                second = row(fresh, last - F.length(fresh), last, F.when(swapped != "", here).otherwise("current"), F.lit("asserted"), "corrected")
                return F.when((fresh != "") & own, F.array(first, second)).otherwise(F.array(first))

            return let(F.regexp_replace(tail, _CLOSERS, ""), told)

        def of_segment(s: Column, i: Column) -> Column:
            nothing = F.array().cast("array<struct<role:string,value:string,start:int,end:int,scope:string,polarity:string,kind:string>>")
            after = F.get(b["segments"], i + 1)
            taken = F.coalesce(after["back"] != "", F.lit(False))
            forward = made(s, s["value"], s["start"], s["end"] + F.length(s["got"]), F.substring(s["body"], F.length(s["got"]) + 1, F.length(s["body"])), "linked", taken)
            backward = made(s, s["back_value"], s["start"] - F.length(s["back"]), s["end"], s["body"], "linked", taken)
            out = F.when(s["got"] != "", forward).when(s["back"] != "", backward)
            if g.bridge:
                far = f"^(?:[\\s\\S]{{0,{g.bridge}}}?)({g.value})"
                left = F.when(taken, F.left(s["body"], F.length(s["body"]) - F.length(after["back"]))).otherwise(s["body"])
                reach = F.length(F.regexp_extract(left, far, 0))
                loose = made(s, F.regexp_extract(left, far, 1), s["start"], s["end"] + reach, F.lit(""), "loose", taken)
                out = out.when(reach > 0, loose)
            return F.coalesce(out, nothing)

        return F.flatten(F.transform(b["segments"], of_segment))

    return let(about, all_claims)


def claims(c: Column, grammar: ClaimGrammar) -> Column:
    """(role, value, start, end, scope, polarity, kind) of every claim of a text that a label has a value.

    A sentence is cut at its labels, and a claim's tail ends at the next one: what follows
    there says nothing of this claim. The value linked behind a label is the claim's, else
    the one linked before it. ``scope``: hypothetical or reported by what stands right
    behind, reported in a retold quotation, else that of the last frame before it, else
    current; a mended claim is superseded. ``polarity``: denied, uncertain or asserted.
    ``kind``: linked, loose, or corrected for the right value behind a wrong one, which
    isn't read so if the next label takes it. Places are code points of the text. A null
    or empty text has no claims.
    """
    text = F.coalesce(c, F.lit(""))
    return F.flatten(F.transform(spans_of(text, grammar.sentence), lambda s: _of_sentence(s["start"], s["value"], grammar)))


def claim_rows(rows: DataFrame, keys: Sequence[str], text: str, grammar: ClaimGrammar) -> DataFrame:
    """``keys`` and the fields of claims(): a row for each claim of each row's text."""
    return rows.select(*keys, F.explode(claims(F.col(text), grammar)).alias("_c")).select(*keys, "_c.*")


def facts_by_path(rows: DataFrame, keys: Sequence[str], document: str, paths: Mapping[str, str]) -> DataFrame:
    """(keys, role, value): what a column of JSON has at each role's path ($.a.b[0]); roles without a value, or with null, are left out."""
    found = F.array(*(F.struct(F.lit(role).alias("role"), F.try_variant_get("_d", path, "string").alias("value")) for role, path in paths.items()))
    return rows.select(*keys, F.try_parse_json(document).alias("_d")).select(*keys, F.explode(found).alias("_f")).select(*keys, "_f.role", "_f.value").where("value IS NOT NULL")


def _same(a: Column, b: Column) -> Column:
    """Equal as numbers where both are ones, else as texts."""
    x, y = a.try_cast("double"), b.try_cast("double")
    return F.when(x.isNotNull() & y.isNotNull(), x == y).otherwise(a == b)


def claim_errors(claimed: DataFrame, facts: DataFrame, keys: Sequence[str], on: Sequence[str] | None = None, wholes: Sequence[str] = ()) -> DataFrame:
    """(keys, code): what is wrong with claims (claim_rows) by the facts (on, role, value).

    ``on`` are the keys that facts have, all of ``keys`` unless named. Of current, linked or
    corrected claims that are asserted:

    * ``part_as_whole:role:other``: the role is one of ``wholes``, and the value that of another role;
    * ``swapped:role:other``: another role's value (the first such role by name), not the own one's;
    * ``confused:role:value``: the role has another value;
    * ``unfounded:role:value``: no fact has the role, or the value elsewhere.

    Of denied ones, ``denied:role:value`` where the fact is that value. Claims of other
    scopes, uncertain and loose ones are no errors. Numbers are compared as numbers, and
    of several facts of one role each is right. Claims and facts meet by key and role,
    and by key and value: no text is joined, and one key's claims are as many as its
    text has.
    """
    keys, on = list(keys), list(on or keys)
    current = claimed.where("scope = 'current' AND kind <> 'loose' AND polarity <> 'uncertain'").select(*keys, "role", "value", "polarity").distinct()
    own = facts.where("value IS NOT NULL").groupBy(*on, "role").agg(F.collect_set("value").alias("_right"))  # few values of one role and key
    known = current.join(own, [*on, "role"], "left")
    right = F.coalesce(F.exists("_right", lambda v: _same(F.col("value"), v)), F.lit(False))
    others = facts.groupBy(*on, "value").agg(F.min("role").alias("_other"))
    known = known.withColumn("_ok", right == (F.col("polarity") == "asserted")).where("NOT _ok").join(others, [*on, "value"], "left")
    elsewhere, has = F.col("_other").isNotNull(), F.col("_right").isNotNull()
    code = (
        F.when(F.col("polarity") == "denied", F.concat_ws(":", F.lit("denied"), "role", "value")).when(elsewhere & F.col("role").isin(*wholes), F.concat_ws(":", F.lit("part_as_whole"), "role", "_other"))
        .when(elsewhere, F.concat_ws(":", F.lit("swapped"), "role", "_other")).when(has, F.concat_ws(":", F.lit("confused"), "role", "value")).otherwise(F.concat_ws(":", F.lit("unfounded"), "role", "value"))
    )
    return known.select(*keys, code.alias("code"))


def unprovided(mentions: DataFrame, facts: DataFrame, keys: Sequence[str], on: Sequence[str] | None = None) -> DataFrame:
    """(keys, code) ``unprovided:value`` of mentioned values (keys, value) that no fact of their key (``on``) has."""
    on = list(on or keys)
    gone = mentions.select(*keys, "value").distinct().join(facts.select(*on, "value"), [*on, "value"], "left_anti")
    return gone.select(*keys, F.concat_ws(":", F.lit("unprovided"), "value").alias("code"))


def unsupported(rows: DataFrame, keys: Sequence[str], text: str, forms: Mapping[str, str], negated: str, sentence: str = SENTENCE) -> DataFrame:
    """(keys, code) ``unsupported:name`` where a sentence has the form of a statement that no fact can support, without a negation behind it."""
    said = F.regexp_extract_all(F.col(text), F.lit(sentence), F.lit(0))
    bad = lambda form: lambda s: F.exists(cut_tails(s, form), lambda tail: ~tail.rlike(negated))
    found = F.array(*(F.when(F.exists(said, bad(form)), F.lit(f"unsupported:{name}")) for name, form in forms.items()))
    return rows.select(*keys, F.explode(found).alias("code")).where("code IS NOT NULL")


def cut_tails(sentence: Column, form: str) -> Column:
    """What follows each match of ``form``, up to the next one."""
    return F.slice(F.split(sentence, form, -1), F.lit(2), F.greatest(F.size(F.split(sentence, form, -1)) - 1, F.lit(0)))


def by_key(codes: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, errors): the sorted distinct codes of every row's key, none for most."""
    found = codes.groupBy(*keys).agg(F.array_sort(F.collect_set("code")).alias("errors"))
    return rows.select(*keys).join(found, list(keys), "left").withColumn("errors", F.coalesce("errors", F.array().cast("array<string>")))


@dataclass(frozen=True)
class Guards:
    """What keeps a mention from counting: clauses (between ``breaks``) that show a ``negated`` or ``supposed`` form, and quotations."""

    breaks: str
    negated: str
    supposed: str
    quoted: str
    sentence: str = SENTENCE


def _sentence_rows(rows: DataFrame, keys: Sequence[str], text: str, sentence: str) -> DataFrame:
    found = rows.select(*keys, F.posexplode(spans_of(F.col(text), sentence)).alias("_n", "_s"))
    return found.select(*keys, "_n", F.col("_s.start").alias("_at"), F.col("_s.value").alias("_text"))


def guarded_spans(rows: DataFrame, keys: Sequence[str], text: str, guards: Guards) -> DataFrame:
    """(keys, _n, start, end): the guarded clauses and quotations of each sentence ``_n``, in code points of the text."""
    held = f"(?:{guards.negated})|(?:{guards.supposed})"
    clause = lambda s: F.filter(pieces_of(s, guards.breaks), lambda x: x["value"].rlike(held))
    own = _sentence_rows(rows, keys, text, guards.sentence)
    spans = own.select(*keys, "_n", "_at", F.explode(F.concat(clause(F.col("_text")), spans_of(F.col("_text"), guards.quoted))).alias("_x"))
    return spans.select(*keys, "_n", (F.col("_at") + F.col("_x.start")).alias("_start"), (F.col("_at") + F.col("_x.end")).alias("_end"))


def free_mentions(rows: DataFrame, keys: Sequence[str], text: str, values: DataFrame, guards: Guards) -> DataFrame:
    """(keys, value, start, end): where texts mention the values (keys, value) of their key, outside all guarded spans.

    Mentions and spans of a sentence meet by key and sentence, and those that overlap
    are dropped.
    """
    keys = list(keys)
    wanted = values.where("value <> ''").select(*keys, "value").distinct()
    own = _sentence_rows(rows, keys, text, guards.sentence).join(wanted, keys).where(F.contains("_text", F.col("value")))
    literal = F.concat(F.lit("\\Q"), F.col("value"), F.lit("\\E"))
    found = own.select(*keys, "_n", "_at", "value", F.explode(spans_of(F.col("_text"), literal)).alias("_x"))
    found = found.select(*keys, "_n", "value", (F.col("_at") + F.col("_x.start")).alias("start"), (F.col("_at") + F.col("_x.end")).alias("end"))
    spans = guarded_spans(rows, keys, text, guards)
    meet = [*(F.col(f"m.{k}") == F.col(f"g.{k}") for k in [*keys, "_n"]), F.col("start") < F.col("_end"), F.col("_start") < F.col("end")]
    return found.alias("m").join(spans.alias("g"), meet, "left_anti").drop("_n")


def omitted_facts(rows: DataFrame, keys: Sequence[str], text: str, required: DataFrame, grammar: ClaimGrammar, guards: Guards) -> DataFrame:
    """(keys, name): required facts that a text doesn't state.

    ``required``: (keys, name, value, role). With a role, a current, asserted, linked or
    corrected claim of that role and value states the fact. Without one it takes a free
    mention of the value of its own: of several facts of one value, the first by name
    have as many mentions as there are. Every text of a key is one; a key without a text
    states nothing, and null values are no facts.
    """
    keys = list(keys)
    required = required.where("value IS NOT NULL")
    literal, scoped = required.where("role IS NULL"), required.where("role IS NOT NULL")
    mentions = free_mentions(rows, keys, text, literal, guards).groupBy(*keys, "value").agg(F.count("*").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(*keys, "value").orderBy("name"))
    short = literal.withColumn("_nth", nth).join(mentions, [*keys, "value"], "left").where(F.col("_nth") > F.coalesce("_n", F.lit(0)))
    stated = claim_rows(rows, keys, text, grammar).where("scope = 'current' AND polarity = 'asserted' AND kind <> 'loose'").select(*keys, "role", "value")
    unsaid = scoped.join(stated, [*keys, "role", "value"], "left_anti")
    return short.select(*keys, "name").union(unsaid.select(*keys, "name"))


#: English function words that stand for labels and marks, since the tables' texts are invented.
_WORD = r"(?<![\p{L}])(?:%s)(?![\p{L}])"
_GRAMMAR = ClaimGrammar(
    labels={"article": _WORD % "the", "source": _WORD % "of|de", "place": _WORD % "in"}, value=_WORD % r"\p{L}{2,3}", forward=" ", backward=" ",
    frames={"hypothetical": _WORD % "that|que", "historical": _WORD % "was|und"}, denied=_WORD % "is|to", doubted=_WORD % "or|for|as",
)

#: The same claims by words: tokens are words and what stands between them, numbered in their sentence.
_CLAIMS = r"""
WITH s AS (SELECT conv_id, turn, unnest(x) AS said, generate_subscripts(x, 1) AS sn FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^\n.!?。！？]+') AS x FROM conversations)),
t AS (SELECT conv_id, turn, sn, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM (SELECT conv_id, turn, sn, regexp_extract_all(said, '\p{L}+|[^\p{L}]+') AS w FROM s)),
k AS (SELECT *, CASE word WHEN 'the' THEN 'article' WHEN 'of' THEN 'source' WHEN 'de' THEN 'source' WHEN 'in' THEN 'place' END AS role,
    CASE WHEN word IN ('that', 'que') THEN 'hypothetical' WHEN word IN ('was', 'und') THEN 'historical' END AS frame FROM t),
n AS (SELECT *, lead(word, 1) OVER w AS w1, lead(word, 2) OVER w AS w2, lead(role, 2) OVER w AS r2,
    lag(word, 1) OVER w AS b1, lag(word, 2) OVER w AS b2, lag(role, 2) OVER w AS q2, lag(word, 3) OVER w AS b3, lag(role, 4) OVER w AS q4,
    last_value(frame IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS scope_here,
    min(CASE WHEN role IS NOT NULL THEN i END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_label
    FROM k WINDOW w AS (PARTITION BY conv_id, turn, sn ORDER BY i)),
c AS (SELECT *, coalesce(role IS NOT NULL AND w1 = ' ' AND regexp_full_match(w2, '\p{L}{2,3}') AND r2 IS NULL, FALSE) AS fwd FROM n),
d AS (SELECT *, role IS NOT NULL AND NOT fwd AND b1 = ' ' AND regexp_full_match(b2, '\p{L}{2,3}') AND q2 IS NULL AND NOT (coalesce(b3, '') = ' ' AND q4 IS NOT NULL) AS back FROM c),
f AS (SELECT conv_id, turn, sn, i, role, CASE WHEN fwd THEN w2 ELSE b2 END AS value, CASE WHEN fwd THEN i + 3 ELSE i + 1 END AS tail, next_label, CASE WHEN fwd THEN i ELSE i - 2 END AS first FROM d WHERE fwd OR back),
g AS (SELECT f.conv_id, f.turn, f.sn, f.i, f.role, f.value,
    coalesce(max(CASE WHEN t.i = f.tail + 1 AND t.word IN ('is', 'to') THEN 1 END) FILTER (t.i < coalesce(f.next_label, 1000000)), 0) = 1 AS ends_in,
    coalesce(max(CASE WHEN t.i = f.tail AND t.word = ' ' THEN 1 END), 0) = 1 AS space,
    coalesce(max(CASE WHEN t.i >= f.tail AND t.i < coalesce(f.next_label, 1000000) AND t.word IN ('or', 'for', 'as') THEN 1 END), 0) = 1 AS doubt,
    arg_max(CASE WHEN k.frame IS NOT NULL THEN k.frame END, CASE WHEN k.frame IS NOT NULL AND k.i < f.first THEN k.i END) AS frame
    FROM f JOIN t USING (conv_id, turn, sn) JOIN k ON k.conv_id = t.conv_id AND k.turn = t.turn AND k.sn = t.sn AND k.i = t.i GROUP BY ALL),
claims AS (SELECT conv_id, turn, sn, i, role, value, coalesce(frame, 'current') AS scope, CASE WHEN ends_in AND space THEN 'denied' WHEN doubt THEN 'uncertain' ELSE 'asserted' END AS polarity FROM g)
"""


def _claims_of(t) -> DataFrame:
    return claim_rows(t.conversations.where("conv_id IS NOT NULL"), ["conv_id", "turn"], "text", _GRAMMAR)


@query("str_23_claims", _CLAIMS + "SELECT conv_id, turn, role, value, scope, polarity, count(*) AS n FROM claims GROUP BY ALL")
def _(t):
    return _claims_of(t).groupBy("conv_id", "turn", "role", "value", "scope", "polarity").agg(F.count("*").alias("n"))


#: What a document says first of each role, as JSON by path.
_PATHS = {"article": "$.first.article", "source": "$.first.source", "place": "$.said[0]"}
_FIRST = {"article": " the (\\p{L}{2,3}) ", "source": " (?:of|de) (\\p{L}{2,3}) ", "place": " in (\\p{L}{2,3}) "}
_FACTS = ", facts AS (SELECT doc_id AS conv_id, role, value FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS role, nullif(regexp_extract(text, '{f}', 1), '') AS value FROM documents" for r, f in _FIRST.items()) + ") WHERE value IS NOT NULL)"


def _facts_of(t) -> DataFrame:
    first = {role: F.nullif(F.regexp_extract("text", form, 1), F.lit("")) for role, form in _FIRST.items()}
    document = F.to_json(F.struct(F.struct(first["article"].alias("article"), first["source"].alias("source")).alias("first"), F.array(first["place"]).alias("said")))
    return facts_by_path(t.documents.select(F.col("doc_id").alias("conv_id"), document.alias("about")), ["conv_id"], "about", _PATHS)


@query("grd_18_claim_errors", _CLAIMS + _FACTS + r""",
own AS (SELECT DISTINCT claims.conv_id, claims.turn, claims.role, value, polarity FROM claims JOIN conversations v ON v.conv_id = claims.conv_id AND v.turn = claims.turn WHERE v.role = 'assistant' AND scope = 'current' AND polarity <> 'uncertain'),
others AS (SELECT conv_id, value, min(role) AS other FROM facts GROUP BY ALL),
judged AS (SELECT own.conv_id, own.turn, own.role, own.value, polarity, f.value AS fact, other FROM own LEFT JOIN facts f ON f.conv_id = own.conv_id AND f.role = own.role LEFT JOIN others o ON o.conv_id = own.conv_id AND o.value = own.value),
codes AS (SELECT conv_id, turn, CASE WHEN polarity = 'denied' THEN 'denied:' || role || ':' || value WHEN other IS NOT NULL AND role = 'place' THEN 'part_as_whole:' || role || ':' || other
    WHEN other IS NOT NULL THEN 'swapped:' || role || ':' || other WHEN fact IS NOT NULL THEN 'confused:' || role || ':' || value ELSE 'unfounded:' || role || ':' || value END AS code
    FROM judged WHERE CASE WHEN polarity = 'denied' THEN coalesce(fact = value, FALSE) ELSE coalesce(fact <> value, TRUE) END
    UNION SELECT conv_id, turn, 'unprovided:' || v FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, ' (ha|re|th|ed),', 1)) AS v FROM conversations WHERE role = 'assistant') m WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.conv_id = m.conv_id AND f.value = v)
    UNION SELECT conv_id, turn, 'unsupported:origin' FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\n.!?。！？]+')) AS x FROM conversations WHERE role = 'assistant') WHERE len(list_filter(string_split(x, ' from '), lambda p, i: i > 1 AND NOT contains(p, ' by '))) > 0)
SELECT c.conv_id, c.turn, coalesce(array_to_string(list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)), ','), '') AS errors FROM conversations c LEFT JOIN codes USING (conv_id, turn) WHERE c.role = 'assistant' GROUP BY c.conv_id, c.turn""")
def _(t):
    """Claims of replies against what the document of the conversation's number says first."""
    replies, keys = t.conversations.where("role = 'assistant'"), ["conv_id", "turn"]
    facts = _facts_of(t)
    mentions = replies.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(" (ha|re|th|ed),"), F.lit(1))).alias("value"))
    codes = claim_errors(claim_rows(replies, keys, "text", _GRAMMAR), facts, keys, ["conv_id"], wholes=["place"])
    codes = codes.union(unprovided(mentions, facts, keys, ["conv_id"])).union(unsupported(replies, keys, "text", {"origin": " from "}, " by "))
    return by_key(codes, replies, keys).select(*keys, F.array_join("errors", ",").alias("errors"))


_GUARDS = Guards(breaks=",", negated=" and ", supposed=" to ", quoted='"[^"]*"')


@query("grd_19_scoped_facts", _CLAIMS + _FACTS + r""",
replies AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'assistant'),
literal AS (SELECT doc_id AS conv_id, unnest(['early', 'later']) AS name, unnest([nullif(regexp_extract(text, ' (\p{L}{2}) ', 1), ''), nullif(regexp_extract(text, ' (\p{L}{2}), ', 1), '')]) AS value FROM documents),
clauses AS (SELECT conv_id, turn, unnest(string_split(x, ',')) AS said FROM (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[^\n.!?。！？]+')) AS x FROM replies)),
mentions AS (SELECT c.conv_id, c.turn, value, sum((length(said) - length(replace(said, value, ''))) // length(value)) AS n FROM clauses c JOIN (SELECT DISTINCT conv_id, value FROM literal WHERE value IS NOT NULL) l USING (conv_id) WHERE NOT contains(said, ' and ') AND NOT contains(said, ' to ') GROUP BY ALL),
short AS (SELECT r.conv_id, r.turn, name FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, value ORDER BY name) AS nth FROM literal WHERE value IS NOT NULL) l JOIN replies r USING (conv_id) LEFT JOIN mentions m ON m.conv_id = r.conv_id AND m.turn = r.turn AND m.value = l.value WHERE nth > coalesce(m.n, 0)),
unsaid AS (SELECT r.conv_id, r.turn, 'claim_' || role AS name FROM facts f JOIN replies r USING (conv_id) WHERE NOT EXISTS (SELECT 1 FROM claims c WHERE c.conv_id = r.conv_id AND c.turn = r.turn AND c.role = f.role AND c.value = f.value AND scope = 'current' AND polarity = 'asserted'))
SELECT conv_id, turn, string_agg(name, ',' ORDER BY name) AS omitted FROM (SELECT * FROM short UNION ALL SELECT * FROM unsaid) GROUP BY ALL""")
def _(t):
    """Facts of the document of the conversation's number that a reply doesn't state: two by mention, three by claim."""
    replies, keys = t.conversations.where("role = 'assistant'"), ["conv_id", "turn"]
    word = lambda form: F.nullif(F.regexp_extract("text", form, 1), F.lit(""))
    named = F.array(*(F.struct(F.lit(n).alias("name"), word(f).alias("value")) for n, f in (("early", r" (\p{L}{2}) "), ("later", r" (\p{L}{2}), "))))
    literal = t.documents.select(F.col("doc_id").alias("conv_id"), F.explode(named).alias("x")).select("conv_id", "x.name", "x.value", F.lit(None).cast("string").alias("role"))
    scoped = _facts_of(t).select("conv_id", F.concat(F.lit("claim_"), "role").alias("name"), "value", "role")
    required = replies.select(*keys).join(literal.union(scoped), "conv_id").select(*keys, "name", "value", "role")
    found = omitted_facts(replies, keys, "text", required, _GRAMMAR, _GUARDS)
    return found.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("omitted"))
