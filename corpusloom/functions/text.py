"""Normalisation, n-grams, sentences and extraction over text columns."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.registry import query


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _form(name: str, fold: bool = False):
    @F.pandas_udf("string")
    def normal(texts: pd.Series) -> pd.Series:
        own = texts.map(lambda x: None if x is None else unicodedata.normalize(name, x))
        return own.map(lambda x: None if x is None else x.casefold()) if fold else own

    return normal


def nfc(c: str | Column) -> Column:
    """Canonical composition. All-ASCII texts, which it leaves alone, don't go to Python."""
    c = _col(c)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_form("NFC")(F.when(F.octet_length(c) != F.length(c), c)))


def nfkc(c: str | Column, fold: bool = False) -> Column:
    """Compatibility composition, case-folded if asked."""
    c = _col(c)
    plain = F.lower(c) if fold else c
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(_form("NFKC", fold)(F.when(F.octet_length(c) != F.length(c), c)))


def normalize_lines(c: str | Column) -> Column:
    """No control or replacement characters; white space collapsed in each line; no blank lines."""
    clean = F.regexp_replace(nfc(c), r"[\x00-\x08\x0B\x0C\x0E-\x1F�]", "")
    lines = F.transform(F.split(F.regexp_replace(clean, r"\r\n?", "\n"), "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \\t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def answer_key(c: str | Column, keep: str = "0-9a-z") -> Column:
    """NFKC, case-folded, and only the kept characters."""
    return F.regexp_replace(nfkc(c, fold=True), f"[^{keep}]", "")


def collapse(c: str | Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), "[ \\t\\n\\r\\x0B\\x0C]+", " "))


def transcript_key(c: str | Column) -> Column:
    """Digits as 0, then letters and digits alone."""
    return F.regexp_replace(F.regexp_replace(F.lower(_col(c)), "[0-9]", "0"), "[^0-9a-z]", "")


def char_ngrams(c: str | Column, width: int) -> Column:
    """Character n-grams with repeats, in one pass over the text; a shorter text has none."""
    return F.regexp_extract_all(_col(c), F.lit(f"(?s)(?=(.{{{width}}}))."), F.lit(1))


def repetition_ratio(c: str | Column, width: int = 4) -> Column:
    """The share of n-grams that repeat another; 0 for none."""
    from corpusloom.functions.columns import let

    return let(char_ngrams(c, width), lambda g: F.when(F.size(g) == 0, 0.0).otherwise(1 - F.size(F.array_distinct(g)) / F.size(g)))


def words(c: str | Column) -> Column:
    """Words between runs of spaces and line ends; none for a blank text."""
    return F.filter(F.split(_col(c), "[ \\n\\t\\r]+"), lambda w: w != "")


#: Words whose n-grams a task numbers at once, beside those of the last text.
NGRAM_WORDS = 1 << 20


def _repeated_shares(texts: list[list[str]], width: int) -> np.ndarray:
    """The share of repeated n-grams of each list of words; NaN where there are fewer than ``width``.

    Words are numbered, and so are pairs of neighbouring or overlapping n-grams of half the width, until
    they are as wide: equal numbers are equal n-grams.
    """
    sizes = np.array([len(w) for w in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    ids = pd.factorize(np.array([w for own in texts for w in own], object))[0].astype(np.int64)
    size = 1
    while size < width and len(ids):
        step = min(size, width - size)
        ids = pd.factorize(ids[: len(ids) - step] * np.int64(len(owner)) + ids[step:])[0].astype(np.int64)
        size += step
    first = np.flatnonzero(owner[: len(ids)] == owner[len(owner) - len(ids) :])
    grams = pd.factorize(owner[first] * np.int64(len(owner) + 1) + ids[first])[0]
    twin = (np.bincount(grams)[grams] > 1) if len(grams) else np.zeros(0)
    with np.errstate(invalid="ignore"):
        return np.bincount(owner[first], twin, len(texts)) / np.bincount(owner[first], minlength=len(texts))


def repeated_word_ngrams(c: str | Column, width: int = 6, short: float | None = 0.0) -> Column:
    """The share of word n-grams that occur more than once; ``short`` for texts of fewer words, null for null."""

    def shares(texts: pd.Series) -> pd.Series:
        out, held, n = [], [], 0
        for text in texts:
            held.append([w for w in re.split("[ \n\t\r]+", text or "") if w])
            n += len(held[-1])
            if n >= NGRAM_WORDS:
                out.append(_repeated_shares(held, width))
                held, n = [], 0
        found = np.concatenate([*out, _repeated_shares(held, width)]) if held else np.concatenate(out or [np.zeros(0)])
        return pd.Series([None if t is None else short if x != x else x for t, x in zip(texts, found.tolist())], dtype=object)

    return F.pandas_udf(shares, "double").asNondeterministic()(_col(c))


def sentences(c: str | Column) -> Column:
    """Parts between sentence ends and line ends, without list markers; blank ones go."""
    plain = F.regexp_replace(_col(c), r"(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+", "$1")
    return F.filter(F.transform(F.split(plain, "[.!?\\n]+"), lambda s: F.trim(s)), lambda s: s != "")


def has_repetition(c: str | Column) -> Column:
    """Whether a sentence comes twice."""
    from corpusloom.functions.columns import let

    return let(sentences(c), lambda s: F.size(F.array_distinct(s)) < F.size(s))


def nonempty_lines(c: str | Column) -> Column:
    return F.filter(F.transform(F.split(_col(c), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def has_final_consonant(c: str | Column) -> Column:
    """Whether a Hangul syllable at the end closes with a consonant; null for another ending."""
    code = F.ascii(F.right(_col(c), F.lit(1)))
    return F.when(code.between(0xAC00, 0xD7A3), F.pmod(code - 0xAC00, F.lit(28)) != 0)


def repair_particle(c: str | Column, name: str | Column, closed: str, open_: str) -> Column:
    """After ``name`` the particle that its last syllable asks for."""
    name = F.lit(name) if isinstance(name, str) else name
    forms = F.concat(name, F.lit(closed)), F.concat(name, F.lit(open_))
    right = F.when(has_final_consonant(name), forms[0]).otherwise(forms[1])
    return F.replace(F.replace(_col(c), forms[0], right), forms[1], right)


def mask_names(c: str | Column, names: list[str], generic: str) -> Column:
    """Names as whole words replaced by a generic one."""
    return F.regexp_replace(_col(c), r"(?<![A-Za-z])(" + "|".join(names) + r")(?![A-Za-z])", generic)


def letter_share(c: str | Column, letters: str, visible: str = r"[^\s]") -> Column:
    """The share of a class's letters in the visible characters of one text."""
    c = _col(c)
    total = F.length(F.regexp_replace(c, visible.replace("[^", "["), ""))
    return F.when(total == 0, 0.0).otherwise(F.length(F.regexp_replace(c, f"[^{letters}]", "")) / total)


def labelled_values(c: str | Column, labels: list[str]) -> Column:
    """A map of label to the word after ``label:``."""
    c = _col(c)
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.regexp_extract(c, k + r"[ \t]*[:：][ \t]*([^\s,;]+)", 1).alias("v")) for k in labels))
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"] != ""))


def iso_dates(c: str | Column) -> Column:
    """Dates in several written forms as ISO dates, in the order of the text; impossible ones go."""
    form = r"([12][0-9]{3})[-./年년 ]{1,2}([0-9]{1,2})[-./月월 ]{1,2}([0-9]{1,2})"
    found = F.regexp_extract_all(_col(c), F.lit(form), F.lit(0))
    iso = F.transform(found, lambda d: F.regexp_replace(d, form, "$1-$2-$3").try_cast("date"))
    return F.transform(F.filter(iso, lambda d: d.isNotNull()), lambda d: d.cast("string"))


def required_terms(c: str | Column, form: str, most: int = 8) -> Column:
    """The first distinct matches."""
    return F.slice(F.array_distinct(F.regexp_extract_all(_col(c), F.lit(form), F.lit(0))), 1, most)


def contract_ok(output: str, kind: str, value: str) -> Column:
    """Whether an output keeps its contract: exact, sentences, lines, comma_items or includes."""
    out, kind, value = F.col(output), F.col(kind), F.col(value)
    number = value.try_cast("int")
    return (
        F.when(kind == "exact", F.trim(out) == value).when(kind == "sentences", F.size(sentences(out)) == number).when(kind == "lines", F.size(nonempty_lines(out)) == number)
        .when(kind == "comma_items", F.size(F.split(out, ",")) == number).when(kind == "includes", out.contains(value))
    )


_ANY = "chr(32) || chr(9)"


@query("str_01_normalize_lines", """
SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(nfc_normalize(text), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x{FFFD}]', '', 'g'), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), lambda x: x <> ''), chr(10))) AS h FROM documents""")
def _(t):
    return t.documents.select("doc_id", F.sha2(normalize_lines("text"), 256).alias("h"))


@query("str_02_answer_key")
def _(t):
    return t.documents.select("doc_id", F.sha2(answer_key("text"), 256).alias("h"))


@query("str_03_nfkc_collapse", "SELECT doc_id, length(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g')))::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.length(collapse(nfkc("text"))).alias("n"))


@query("str_04_collapse_fold", "SELECT doc_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\x0B\\x0C]+', ' ', 'g')))) AS h FROM documents")
def _(t):
    return t.documents.select("doc_id", F.sha2(F.lower(collapse("text")), 256).alias("h"))


@query("str_05_transcript_key", "SELECT conv_id, turn, regexp_replace(regexp_replace(lower(text), '[0-9]', '0', 'g'), '[^0-9a-z]', '', 'g') AS k FROM conversations")
def _(t):
    return t.conversations.select("conv_id", "turn", transcript_key("text").alias("k"))


@query("str_06_char_ngrams", "SELECT conv_id, turn, len(list_distinct(list_transform(generate_series(1, length(text) - 4), lambda i: substring(text, i, 5))))::INT AS n FROM conversations WHERE length(text) >= 5")
def _(t):
    return t.conversations.where("length(text) >= 5").select("conv_id", "turn", F.size(F.array_distinct(char_ngrams("text", 5))).alias("n"))


@query("str_07_bigram_f1", """
WITH c AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user') AS a, string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant') AS b FROM conversations GROUP BY conv_id HAVING a IS NOT NULL AND b IS NOT NULL),
x AS (SELECT conv_id, g, count(*) AS n FROM (SELECT conv_id, unnest(list_transform(generate_series(1, length(a) - 1), lambda i: substring(a, i, 2))) AS g FROM c) GROUP BY ALL), y AS (SELECT conv_id, g, count(*) AS n FROM (SELECT conv_id, unnest(list_transform(generate_series(1, length(b) - 1), lambda i: substring(b, i, 2))) AS g FROM c) GROUP BY ALL),
m AS (SELECT conv_id, sum(least(x.n, y.n)) AS s FROM x JOIN y USING (conv_id, g) GROUP BY conv_id)
SELECT conv_id, round(2 * coalesce(s, 0) / (length(a) + length(b) - 2), 9) AS f1 FROM c LEFT JOIN m USING (conv_id)""")
def _(t):
    sides = t.conversations.groupBy("conv_id").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("turn", "text")))), lambda x: x["text"]), " ").alias(n) for r, n in (("user", "a"), ("assistant", "b"))))
    sides = sides.where("a <> '' AND b <> ''")
    count = lambda c, n: sides.select("conv_id", F.explode(char_ngrams(c, 2)).alias("g")).groupBy("conv_id", "g").agg(F.count("*").alias(n))
    both = count("a", "x").join(count("b", "y"), ["conv_id", "g"]).groupBy("conv_id").agg(F.sum(F.least("x", "y")).alias("s"))
    return sides.join(both, "conv_id", "left").select("conv_id", F.round(2 * F.coalesce("s", F.lit(0)) / (F.length("a") + F.length("b") - 2), 9).alias("f1"))


@query("str_08_repetition_ratio", "SELECT conv_id, turn, round(1 - len(list_distinct(g)) / len(g), 9) AS ratio FROM (SELECT conv_id, turn, list_transform(generate_series(1, length(text) - 3), lambda i: substring(text, i, 4)) AS g FROM conversations WHERE length(text) >= 4)")
def _(t):
    return t.conversations.where("length(text) >= 4").select("conv_id", "turn", F.round(repetition_ratio("text"), 9).alias("ratio"))


_W = "list_filter(string_split_regex(text, '[ \\n\\t\\r]+'), lambda w: w <> '')"


@query("str_09_repeated_ngrams", f"""
WITH w AS (SELECT doc_id, {_W} AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(generate_series(1, len(w) - 5), lambda i: array_to_string(w[i:i + 5], ' '))) AS g FROM w WHERE len(w) >= 6),
c AS (SELECT doc_id, g, count(*) AS n FROM g GROUP BY ALL) SELECT doc_id, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 9) AS ratio FROM c GROUP BY doc_id""")
def _(t):
    return t.documents.select("doc_id", F.round(repeated_word_ngrams("text", short=None), 9).alias("ratio")).where("ratio IS NOT NULL")


_SENT = r"list_filter(list_transform(string_split_regex(regexp_replace(text, '(^|\n)[ \t]*([0-9]+[.)]|[-*])[ \t]+', '\1', 'g'), '[.!?\n]+'), lambda s: trim(s)), lambda s: s <> '')"


@query("str_10_repetition_flag", f"SELECT doc_id, len(list_distinct(s)) < len(s) AS repeats FROM (SELECT doc_id, {_SENT} AS s FROM documents)")
def _(t):
    return t.documents.select("doc_id", has_repetition("text").alias("repeats"))


@query("str_11_sentence_count", f"SELECT doc_id, len({_SENT})::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(sentences("text")).alias("n"))


@query("str_12_sentence_ends", r"SELECT doc_id, len(regexp_extract_all(text, '[.!?](\s|$)'))::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.regexp_count("text", F.lit(r"[.!?](\s|$)")).alias("n"))


@query("str_13_nonempty_lines", "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''))::INT AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", F.size(nonempty_lines("text")).alias("n"))


@query("str_18_mask_place", "SELECT doc_id, replace(text, source, 'place') AS masked FROM (SELECT doc_id, source, source || ': ' || text AS text FROM documents)")
def _(t):
    rows = t.documents.select("doc_id", "source", F.concat("source", F.lit(": "), "text").alias("text"))
    return rows.select("doc_id", F.replace("text", F.col("source"), F.lit("place")).alias("masked"))


@query("str_19_letter_share", r"SELECT doc_id, round(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / nullif(length(regexp_replace(text, '[\s]', '', 'g')), 0), 9) AS share FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(letter_share("text", "A-Za-z"), 9).alias("share"))


@query("str_20_foreign_sentence", "SELECT doc_id, regexp_matches(text, '[ぁ-ヿ]') OR regexp_matches(text, '[A-Z][a-z]+( [a-z]+){5,}[.]') AS is_foreign FROM documents")
def _(t):
    return t.documents.select("doc_id", (F.col("text").rlike("[ぁ-ヿ]") | F.col("text").rlike("[A-Z][a-z]++(?: [a-z]++){5,}+[.]")).alias("is_foreign"))


@query("str_22_iso_dates", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS dates FROM orders")
def _(t):
    return t.orders.select("o_orderkey", F.array_join(iso_dates(F.date_format("o_orderdate", "'on 'yyyy/MM/dd' or 2023.02.31'")), ",").alias("dates"))


@query("str_24_required_terms", "SELECT doc_id, array_to_string(terms, ',') AS terms FROM (SELECT doc_id, list(t ORDER BY i)[1:8] AS terms FROM (SELECT doc_id, t, min(i) AS i FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS t, generate_subscripts(regexp_extract_all(text, '[A-Z][a-z]{3,}'), 1) AS i FROM documents) GROUP BY doc_id, t) GROUP BY doc_id)")
def _(t):
    return t.documents.select("doc_id", F.array_join(required_terms("text", "[A-Z][a-z]{3,}"), ",").alias("terms")).where("terms <> ''")


@query("str_25_contracts", f"""
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN len({_SENT}) = 5 WHEN 1 THEN len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) = 2 ELSE contains(text, 'the') END AS ok FROM documents""")
def _(t):
    kind = F.when(F.col("doc_id") % 3 == 0, "sentences").when(F.col("doc_id") % 3 == 1, "lines").otherwise("includes")
    value = F.when(F.col("doc_id") % 3 == 0, "5").when(F.col("doc_id") % 3 == 1, "2").otherwise("the")
    return t.documents.select("doc_id", "text", kind.alias("k"), value.alias("v")).select("doc_id", contract_ok("text", "k", "v").alias("ok"))
