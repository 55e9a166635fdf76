"""Personal data by patterns and by bootstrapped contexts, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._columns import let
from corpusloom.llm._store import Scratch, materialise
from corpusloom.operators.spread import join_spread

KINDS = ("email", "ip", "card", "phone")
#: What else is looked for: it has no base form, only seeds among the candidates.
SECRET = "secret"
#: A secret that seeds: long, with letters and digits, behind a sign of assignment.
_SEED, _ASSIGNED = r"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/-]{20,}$", r"[=:]\s*[\"']?$"
#: What the kinds look like. Each finds what the plain form would, from the left, but
#: never tries the inside of a run again: ``\G`` and the look-behinds say where one begins.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without a match of this has none of the kind.
_HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

#: Tokens that may be identifiers: five characters at least, one of them a digit.
_CANDIDATE = r"(?<![A-Za-z0-9._%+@-])(?=[A-Za-z._%+@-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._%+@-]{3,}[A-Za-z0-9]"
#: Identifiers that aren't such tokens: words joined by @, dots or bracketed signs, and groups of digits with one separator or brackets between. None ends within a token.
_JOINED = (
    r"(?<![A-Za-z0-9._%+@-])(?:[A-Za-z0-9][A-Za-z0-9_%+-]*+(?:(?:[.@]|[(\[](?i:at|dot|@|\.)[)\]])[A-Za-z0-9_%+-]++)++(?<=[A-Za-z0-9])"
    r"|\+?+(?:[(\[][0-9]++[)\]]|[0-9]++)(?:[./-]?+[(\[][0-9]++[)\]]|\x20[(\[][0-9]++[)\]]|[./-][0-9]++|(?<=[)\]])[0-9]++|\x20[0-9]{2,}+){1,12}+)(?![A-Za-z0-9._%+@-]*[A-Za-z0-9])"
)
#: Tokens of a context: words with the signs that lead to a value, without quotes and brackets.
_TOKEN = r"[^\s=:\"'(\[<]++[=:]*+|[=:]++"
#: Characters before and after a span that its context may come from.
_LEFT = 48
#: Distinct identifiers a pattern needs, its least score, and the rounds of scoring at most.
SUPPORT, TRUST, ROUNDS = 3, 0.6, 8
#: Contexts that may be broadcast as a list of numbers, 8 MB.
BROADCAST_ROWS = 1_000_000
#: Matches whose places are summed one after another; longer lists go by blocks of so many.
_BLOCK = 64

_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string,left:string,right:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _spans(text: Column, pattern: str, kind: str | None) -> Column:
    """All matches with their places in code points, by the lengths of what lies between them."""
    rank = KINDS.index(kind) if kind else len(KINDS)
    both = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        span = F.struct(
            start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).cast("string").alias("kind"), end.alias("end"), x["m"].alias("value"),
            F.right(x["p"], F.lit(_LEFT)).alias("left"), F.substring(x["q"], 1, _LEFT).alias("right"),
        )
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def walk(some: Column, at: Column) -> Column:
        return F.aggregate(some, F.struct(at.alias("at"), _none().alias("out")), add, lambda s: s["out"])

    def by_blocks(pairs: Column) -> Column:
        """Lists grow within blocks alone, as appending copies the whole list."""
        size = lambda x: F.aggregate(x, F.lit(0), lambda n, y: n + F.length(y["p"]) + F.length(y["m"]))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _BLOCK).cast("int")), lambda i: F.slice(pairs, i * _BLOCK + 1, F.lit(_BLOCK)))
        more = lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        starts = lambda b: F.aggregate(F.transform(b, size), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), more, lambda s: s["out"])
        return let(blocks, lambda b: F.flatten(F.zip_with(b, starts(b), walk)))

    def placed(b: Column) -> Column:
        n = F.size(b["m"])
        pairs = F.arrays_zip(F.slice(b["p"], F.lit(1), n).alias("p"), b["m"].alias("m"), F.slice(b["p"], F.lit(2), n).alias("q"))
        return F.when(n <= _BLOCK, walk(pairs, F.lit(0))).otherwise(let(pairs, by_blocks))

    return let(both, placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str):
    """The check of a kind's match."""
    if kind == "ip":
        return lambda s: F.forall(F.split(s["value"], r"\."), lambda x: let(F.ltrim(x, F.lit("0")), lambda y: (F.length(y) <= 3) & (F.coalesce(F.substring(y, 1, 3).try_cast("int"), F.lit(0)) <= 255)))
    if kind == "card":
        return lambda s: F.call_function("luhn_check", _digits(s["value"]))
    if kind == "phone":
        return lambda s: F.length(_digits(s["value"])).between(10, 15)
    return None


def base_spans(text: Column) -> Column:
    """The matches of all kinds that pass their checks, by start and then kind."""
    found = []
    for kind in KINDS:
        spans = _spans(text, PATTERNS[kind], kind)
        spans = F.filter(spans, _valid(kind)) if _valid(kind) else spans
        found.append(F.when(text.rlike(_HINTS[kind]), spans).otherwise(_none()))
    return F.array_sort(F.concat(*found))


def _candidates(text: Column, base: Column) -> Column:
    """What looks like an identifier and lies outside the base spans; of two that overlap the joined one."""
    apart = lambda spans, others: F.filter(spans, lambda c: ~F.exists(others, lambda b: (c["start"] < b["end"]) & (c["end"] > b["start"])))
    tokens = F.when(text.rlike("[0-9]"), _spans(text, _CANDIDATE, None)).otherwise(_none())
    joined = F.filter(_spans(text, _JOINED, None), lambda c: c["end"] - c["start"] >= 5)
    return let(apart(joined, base), lambda j: F.concat(j, apart(apart(tokens, base), j)))


def _plain(text: Column) -> Column:
    """Lower case, with 0 for every digit."""
    low = F.lower(text)
    return F.when(low.rlike("[1-9]"), F.translate(low, "123456789", "000000000")).otherwise(low)


def _tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(_plain(text), F.lit(_TOKEN), F.lit(0)), lambda t: F.xxhash64(t))


def _cues(span: Column) -> Column:
    """The lexical patterns of a span's context, as hashes: one and two tokens before it, and after it.

    The last bit tells the side; without it a hash is that of the tokens wherever they
    stand. What is glued to a span is no context.
    """
    none = F.array().cast("array<bigint>")
    marked = lambda h, side: h.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side))
    before = lambda t: F.when(F.size(t) == 0, none).when(F.size(t) == 1, F.slice(t, -1, 1)).otherwise(F.array(F.element_at(t, -1), F.xxhash64(F.slice(t, -2, 2))))
    after = lambda t: F.when(F.size(t) == 0, none).when(F.size(t) == 1, F.slice(t, 1, 1)).otherwise(F.array(F.element_at(t, 1), F.xxhash64(F.slice(t, 1, 2))))
    free = span["right"].rlike(r"^[\s\"')\]>]")
    right = F.when(free, let(_tokens(span["right"]), after)).otherwise(none)
    return F.concat(F.transform(let(_tokens(span["left"]), before), lambda h: marked(h, 0)), F.transform(right, lambda h: marked(h, 1)))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _totals(rows: DataFrame, cues: DataFrame) -> DataFrame:
    """How often each of ``cues`` (base) stands in any text, whatever is beside it."""
    pairs = lambda t: F.when(F.size(t) > 1, F.transform(F.sequence(F.lit(1), F.size(t) - 1), lambda i: F.xxhash64(F.slice(t, i, F.lit(2))))).otherwise(F.array().cast("array<bigint>"))
    every = rows.select(F.explode(let(_tokens(F.col("text")), lambda t: F.concat(t, pairs(t)))).alias("base"))
    return every.select(F.col("base").bitwiseAND(F.lit(-2)).alias("base")).join(_small(cues), "base", "left_semi").groupBy("base").agg(F.count("*").alias("total"))


def induce_patterns(rows: DataFrame, occurrences: DataFrame, scratch: Scratch, support: int = SUPPORT, rounds: int = ROUNDS) -> DataFrame:
    """(cue, kind, score, support, n_rows): scored contexts of identifiers.

    ``occurrences`` (value, kind, cue): one row for each span and each of its cues; kind
    is null for what only looks like an identifier. Seeds are certain. In every round a
    pattern's score is the confidence of what it stands beside, over all its
    occurrences in ``rows``, ordinary words included; a value's confidence in a kind is
    the chance that one of its patterns is right, and it keeps its best kind alone. So
    values found by good patterns bring more patterns in the next round, until a round brings none or ``rounds`` are
    done. ``n_rows`` counts the occurrences with the cue.
    """
    edges = scratch.keep(occurrences.groupBy("cue", "value", "kind").agg(F.count("*").alias("n")), "pii-edges")
    cues = edges.groupBy("cue").agg(F.count_distinct("value").alias("values"), F.count("*").alias("held"), F.sum("n").alias("n_rows")).where(F.col("values") >= support)
    cues = scratch.keep(cues.select("cue", F.col("cue").bitwiseAND(F.lit(-2)).alias("base"), "held", "n_rows"), "pii-cues")
    totals = scratch.keep(_totals(rows, cues.select("base").distinct()), "pii-totals")
    n_edges = edges.count()
    edges = scratch.keep(join_spread(edges, cues.join(totals, "base").drop("base"), "cue", "held", n_edges, "value"), "pii-graph")
    sure = edges.where("kind IS NOT NULL").select("value", "kind").distinct().withColumn("confidence", F.lit(1.0))
    trust, patterns, last = sure, None, None
    for _ in range(rounds):
        known = edges.drop("kind").groupBy("cue", "value", "total", "held", "n_rows").agg(F.sum("n").alias("n")).join(trust, "value")
        patterns = known.groupBy("cue", "kind").agg(
            F.least(F.lit(1.0), F.sum(F.col("n") * F.col("confidence")) / F.max("total")).alias("score"), F.sum((F.col("confidence") >= 0.5).cast("long")).alias("support"),
            F.max("held").alias("held"), F.max("n_rows").alias("n_rows"),
        )
        patterns = scratch.keep(patterns.where(F.col("support") >= support), "pii-patterns")
        now = patterns.agg(F.count("*"), F.sum("support")).first()
        if now == last:
            break
        last = now
        guessed = join_spread(edges.where("kind IS NULL").select("cue", "value"), patterns, "cue", "held", n_edges, "value")
        guessed = guessed.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))).alias("confidence"))
        best = guessed.join(sure, "value", "left_anti").groupBy("value").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        trust = scratch.keep(sure.union(best.select("value", "b.kind", "b.confidence")), "pii-values")
    return patterns.drop("held")


def find_personal_data(docs: DataFrame, support: int = SUPPORT, trust: float = TRUST, rounds: int = ROUNDS, hidden: Column | None = None) -> DataFrame:
    """(doc_id, base, found) for each row of ``docs`` (doc_id, text).

    ``base``: spans that match a kind's form, by start, then kind. ``found``: more
    spans, of what looks like an identifier (tokens with a digit, words joined by @ or
    dots, groups of digits) and stands beside a pattern of ``support`` values and a
    score of ``trust`` at least; their kind is that of the best pattern. The base
    spans seed the patterns, and for one more kind, ``secret``, long values of letters
    and digits behind a sign of assignment. Starts and ends count code points.

    ``hidden``, a condition on ``value``, is for measuring: base spans of such values
    don't seed, and ``found`` also has those of them that patterns find.

    A null or empty text has no span. Every row is returned, repeated ones with equal
    spans; a null doc_id is kept; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("content", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    spans = let(base_spans(F.col("text")), lambda b: F.struct(b.alias("base"), _candidates(F.col("text"), b).alias("candidates")))
    spans = materialise(rows.select("id", "doc_id", "content", spans.alias("s")).select("id", "doc_id", "content", "s.base", "s.candidates"), "pii-spans")
    every = spans.select("id", "content", F.explode(F.concat("base", "candidates")).alias("s"))
    secret = F.col("s.kind").isNull() & F.col("s.value").rlike(_SEED) & F.col("s.left").rlike(_ASSIGNED)
    every = every.select("id", "content", "s.start", "s.end", F.col("s.kind").alias("base_kind"), F.when(secret, SECRET).otherwise(F.col("s.kind")).alias("kind"), F.lower("s.value").alias("value"), F.explode(_cues(F.col("s"))).alias("cue"))
    open_ = F.col("base_kind").isNull()
    if hidden is not None:
        open_ = open_ | F.coalesce(hidden, F.lit(False))
        every = every.withColumn("kind", F.when(F.col("base_kind").isNotNull() & F.coalesce(hidden, F.lit(False)), F.lit(None)).otherwise(F.col("kind")))
    every = scratch.keep(every, "pii-occurrences")
    patterns = induce_patterns(rows, every.select("value", "kind", "cue"), scratch, support, rounds).where(F.col("score") >= trust)
    more = join_spread(every.where(open_).drop("kind"), patterns, "cue", "n_rows", every.count(), "content")
    more = more.groupBy("id", "content", "start", "end").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, (*KINDS, SECRET))), F.col("kind")).cast("int") - 1
    more = more.groupBy("id", "content").agg(F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end"))).alias("found"))
    more = materialise(more, "pii-found")
    scratch.discard()
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    return spans.join(more, ["id", "content"], "left").select("doc_id", base.alias("base"), F.coalesce("found", none).alias("found"))


def hidden_recall(docs: DataFrame, hidden: Column, **how) -> DataFrame:
    """(kind, n_hidden, n_right, n_wrong): hidden base spans of ``docs``, those that patterns find with their kind, and with another one."""
    found = find_personal_data(docs, hidden=hidden, **how).withColumn("found", F.transform("found", lambda x: F.struct(x["start"], x["end"], x["kind"])))
    same = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    spans = found.distinct().join(same, "doc_id").select("text", F.explode("base").alias("b"), "found")
    spans = spans.withColumn("value", F.lower(F.substring("text", F.col("b.start") + 1, F.col("b.end") - F.col("b.start")))).where(hidden)
    got = F.get(F.filter("found", lambda x: (x["start"] == F.col("b.start")) & (x["end"] == F.col("b.end"))), F.lit(0))["kind"]
    told = spans.select(F.col("b.kind").alias("kind"), got.alias("got"))
    return told.groupBy("kind").agg(F.count("*").alias("n_hidden"), F.count_if(F.col("got") == F.col("kind")).alias("n_right"), F.count_if(F.col("got") != F.col("kind")).alias("n_wrong"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    spans = _joined(F.array_sort(F.concat("base", "found")))
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("found").cast("long").alias("n_found"), (F.size("base") + F.size("found")).cast("long").alias("n_spans"))
