"""Places of matches in texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.columns import let

#: Matches that one fold adds up; longer lists are folded by blocks, so that copies stay short.
_FOLDED = 64


def cut_at(text: Column, pattern: str | Column) -> Column:
    """A text cut at its matches: ``spans`` of (start, end, value, lead) and the ``rest`` behind the last.

    Starts and ends are code points from 0, and ``lead`` is what stands between a match
    and the one before. ``pattern`` must not match the empty text. A null text gives null.
    """
    form = pattern if isinstance(pattern, Column) else F.lit(pattern)
    none = F.array().cast("array<struct<start:int,end:int,value:string,lead:string>>")
    fresh = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["lead"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["lead"].alias("lead")))).alias("out"))

    def shifted(state: Column, block: Column) -> Column:
        at = state["at"]
        moved = F.transform(block["out"], lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at))
        return F.struct((at + block["at"]).alias("at"), F.concat(state["out"], moved).alias("out"))

    def walk(b: Column) -> Column:
        pairs = F.zip_with(F.slice(b["p"], F.lit(1), F.size(b["m"])), b["m"], lambda p, m: F.struct(p.alias("lead"), m.alias("value")))

        def spans(x: Column) -> Column:
            numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / _FOLDED).cast("int") - 1, F.lit(0)))
            blocks = F.transform(numbers, lambda k: F.aggregate(F.slice(x, k * _FOLDED + 1, F.lit(_FOLDED)), fresh, add))
            return F.aggregate(blocks, fresh, shifted, lambda s: s["out"])

        return F.struct(let(pairs, spans).alias("spans"), F.element_at(b["p"], -1).alias("rest"))

    return F.when(text.isNotNull(), let(F.struct(F.split(text, form, -1).alias("p"), F.regexp_extract_all(text, form, F.lit(0)).alias("m")), walk))


def spans_of(text: Column, pattern: str | Column) -> Column:
    """(start, end, value) of all matches, counted in code points from 0."""
    return F.transform(cut_at(text, pattern)["spans"], lambda s: F.struct(s["start"], s["end"], s["value"]))


def pieces_of(text: Column, breaks: str) -> Column:
    """(start, end, value) of what stands between matches of ``breaks``, empty pieces too."""

    def pieces(c: Column) -> Column:
        inner = F.transform(c["spans"], lambda s: F.struct((s["start"] - F.length(s["lead"])).alias("start"), s["start"].alias("end"), s["lead"].alias("value")))
        at = F.coalesce(F.try_element_at(c["spans"], F.lit(-1))["end"], F.lit(0))
        return F.concat(inner, F.array(F.struct(at.alias("start"), (at + F.length(c["rest"])).alias("end"), c["rest"].alias("value"))))

    return let(cut_at(text, breaks), pieces)
