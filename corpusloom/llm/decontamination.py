"""Benchmark decontamination by winnowed fingerprints, in DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._columns import ascii_lower, let
from corpusloom.llm._store import materialise

#: Words of a window, and of the k-grams whose hashes are winnowed.
WINDOW, GRAM = 13, 8
#: Bytes of a table of numbers that may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_NO_ID = -(1 << 63)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BETWEEN), "")


def _hashed(words: Column, seed: int | None = None) -> Column:
    return F.transform(words, lambda x: F.xxhash64(x) if seed is None else F.xxhash64(F.lit(seed), x))


def _pair(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _less(x: Column, y: Column) -> Column:
    return F.least(x, y)


def _beside(left: Column, right: Column, k: int, f: Callable[[Column, Column], Column]) -> Column:
    """``f`` of each element of ``left`` and the one ``k`` places on in ``right``; the last elements meet nulls."""
    return F.zip_with(left, F.slice(right, F.lit(k + 1), F.greatest(F.size(right) - k, F.lit(0))), f)


def _with_powers(words: Column, longest: int, body: Callable[[list[Column]], Column], f: Callable[[Column, Column], Column] = _pair, powers: tuple = ()) -> Column:
    """``body`` of arrays that combine 1, 2, 4, ... neighbours up to ``longest``, each made from the one before."""

    def more(own: Column) -> Column:
        found = (*powers, own)
        if 1 << len(found) > longest:
            return body(list(found))
        return _with_powers(_beside(own, own, 1 << len(found) - 1, f), longest, body, f, found)

    return let(words, more)


def _first(values: Column, n: Column, length: int) -> Column:
    """The elements that stand for ``length`` whole words among ``n``."""
    return F.slice(values, F.lit(1), F.greatest(n - (length - 1), F.lit(0)))


def _grams(powers: list[Column], n: Column, length: int) -> Column:
    """The hash of every ``length`` consecutive words."""
    done, out = 0, None
    for k in reversed(range(len(powers))):
        if length >> k & 1:
            out = powers[k] if out is None else _beside(out, powers[k], done, _pair)
            done += 1 << k
    return _first(out, n, length)


def _minima(grams: Column, width: int) -> Column:
    """The smallest of every ``width`` neighbours."""
    top = 1 << width.bit_length() - 1
    widest = lambda p: p[-1] if width == top else _beside(p[-1], p[-1], width - top, _less)
    return let(grams, lambda g: _first(_with_powers(g, width, widest, _less), F.size(g), width))


def _winnowed(powers: list[Column], n: Column, window: int, gram: int) -> Column:
    """The smallest hash of every window's k-grams.

    Two texts that share ``window`` words share all k-grams of that window, and so its smallest hash.
    """
    return _minima(_grams(powers, n, gram), window - gram + 1)


def _prints(text: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """n, and the distinct fingerprints: window minima, and whole k-grams for each of ``lengths``."""

    def body(w: Column) -> Column:
        n = F.size(w)
        some = lambda p: F.array_distinct(F.concat(_winnowed(p, n, window, gram), *(_grams(p, n, k) for k in lengths)))
        return F.struct(n.alias("n"), _with_powers(_hashed(w), window, some).alias("prints"))

    return let(_words(text), body)


def _windows(text: Column, window: int, gram: int, lengths: list[int]) -> Column:
    """Every window: its place, length, fingerprint, and two hashes of all its words."""

    def body(w: Column) -> Column:
        n = F.size(w)

        def both(p: list[Column], q: list[Column]) -> Column:
            whole = [(window, _winnowed(p, n, window, gram)), *((k, _grams(p, n, k)) for k in lengths)]
            zipped = (F.arrays_zip(m.alias("print"), _grams(p, n, k).alias("h"), _grams(q, n, k).alias("g")) for k, m in whole)
            named = lambda k: lambda x, i: F.struct((i + 1).alias("at"), F.lit(k).alias("len"), x["print"].alias("print"), x["h"].alias("h"), x["g"].alias("g"))
            return F.concat(*(F.transform(z, named(k)) for z, (k, _) in zip(zipped, whole)))

        return _with_powers(_hashed(w), window, lambda p: _with_powers(_hashed(w, 1), window, lambda q: both(p, q)))

    return let(_words(text), body)


def _small(df: DataFrame, limit: int) -> DataFrame:
    """Broadcast a table of numbers if its rows take ``limit`` bytes at most."""
    return F.broadcast(df) if df.count() * 8 * len(df.columns) <= limit else df


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, content, n_words, n_hit, item_ids) for each row of ``docs`` (doc_id, text).

    Items of ``benchmark`` (item_id, text) give windows of ``window`` consecutive words;
    shorter ones, if not empty, are one window. A document's word is hit if it lies in
    an occurrence of a window. ``content`` is a hash of the text.

    Fingerprints are the smallest k-gram hash of each window, so a document without one
    of the benchmark's fingerprints shares no window with it; short items are looked for
    by their own length. In the documents that are left, a fingerprint's hit is extended
    to the windows of which it is the smallest hash, these are compared by 128 bits of
    their words' hashes, and runs of them extend to the whole shared span. Items are
    kept as rows: windows held by the same items share a number of their set.
    Tables of numbers are broadcast when they take at most ``broadcast_bytes``; else
    the joins shuffle.

    A null or empty text has no word. A null doc_id is kept; repeated rows are each
    returned. Items with a null id are ignored; repeated items count once by id.
    Other columns are ignored. The list of a document's items is as long as there are
    items that it holds a window of.
    """
    own = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = materialise(own.withColumn("n", F.size(_words(F.col("text")))).where("n > 0"), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < window).select("n").distinct().collect())  # fewer than ``window`` numbers
    every = F.filter(_windows(F.col("text"), window, gram, short), lambda x: x["len"] == F.least(F.col("n"), F.lit(window)))
    holders = materialise(items.select("item_id", F.explode(every).alias("x")).select("item_id", "x.len", "x.h", "x.g", "x.print").distinct(), "item-windows")
    sums = (F.sum(F.xxhash64(F.lit(k), "item_id").cast("decimal(38,0)")) for k in (1, 2))
    windows = holders.groupBy("len", "h", "g").agg(F.xxhash64(F.count("*"), *sums).alias("set_id"))
    windows = materialise(windows, "item-sets")
    shown = windows.groupBy("set_id").agg(F.min(F.struct("len", "h", "g")).alias("w")).select("set_id", "w.*")
    members = materialise(holders.join(shown, ["len", "h", "g"]).select("set_id", "item_id"), "item-members")
    prints = materialise(holders.select("print").distinct(), "item-prints")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("content", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID)))
    looked = rows.select("id", "doc_id", "content", _prints(F.col("text"), window, gram, short).alias("s"))
    looked = looked.select("id", "doc_id", "content", F.col("s.n").alias("n_words"), F.posexplode_outer("s.prints").alias("i", "print"))
    known = _small(prints, broadcast_bytes).withColumn("known", F.lit(1))
    first = F.when(F.coalesce("i", F.lit(0)) == 0, 1).otherwise(0)
    looked = looked.join(known, "print", "left").groupBy("id", "doc_id", "content").agg(F.max("n_words").alias("n_words"), F.max("known").alias("known"), F.sum(first).alias("copies"))
    looked = materialise(looked, "fingerprinted")

    suspects = looked.where("known = 1").select("id", "content")
    suspects = rows.join(_small(suspects, broadcast_bytes), ["id", "content"], "left_semi").dropDuplicates(["id", "content"])
    found = suspects.select("id", "content", F.explode(_windows(F.col("text"), window, gram, short)).alias("x")).select("id", "content", "x.*")
    found = found.join(_small(prints, broadcast_bytes), "print", "left_semi")
    found = materialise(found.join(_small(windows, broadcast_bytes), ["len", "h", "g"]).select("id", "content", "at", "len", "set_id"), "hits")
    spans = found.groupBy("id", "content").agg(F.sort_array(F.collect_set(F.struct("at", "len"))).alias("spans"))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["at"] + x["len"]).alias("end"), (s["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(s["end"], x["at"]))).alias("n")),
        lambda s: s["n"],
    )
    owners = found.select("id", "content", "set_id").distinct().join(members, "set_id").select("id", "content", "item_id").distinct()
    owners = owners.groupBy("id", "content").agg(F.array_sort(F.collect_list("item_id")).alias("item_ids"))
    out = looked.join(spans.select("id", "content", covered.cast("long").alias("n_hit")), ["id", "content"], "left").join(owners, ["id", "content"], "left")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    none = F.array().cast("array<string>")
    return out.select("doc_id", "content", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"))


def contaminated() -> Column:
    """At least one hit word, and a twentieth of all words."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), contaminated().alias("contaminated"))


#: The same rows, comparing every window.
SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), lens AS (
    SELECT DISTINCT least(13, len(w)) AS k FROM b WHERE len(w) > 0
), bw AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT item_id, w, least(13, len(w)) AS k, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
    SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
    FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, lens WHERE len(w) >= k)
), hits AS (
    SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, g)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM (SELECT DISTINCT doc_id, k, i FROM hits)) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN found ON d.doc_id = found.doc_id
"""
