"""Deterministic ranks, samples, quotas, diversity and splits.

Ranks come from SHA-256 of a seed and an id, so a sample depends on neither the order
nor the partitioning of rows. ``row_number() <= k`` within strata lets Spark keep the
first k of each stratum in every task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.registry import query


def stable_rank(seed: str, *parts: Column | str) -> Column:
    """SHA-256 of the seed and the parts, joined by a bar; null is the empty text."""
    texts = [F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws("|", F.lit(seed), *texts), 256)


def ordinal(df: DataFrame, *order: Column | str, bucket: Column | None = None, name: str = "place") -> DataFrame:
    """Number all rows from 1 in an order.

    ``bucket`` is a non-decreasing function of the order: rows are numbered within
    buckets, and a small table of the buckets' sizes gives the offsets. Without it all
    rows meet in one task, so their number must be bounded, as after a limit.
    """
    if bucket is None:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
    rows = df.withColumn("_bucket", bucket)
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # one row for each bucket
    offsets = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    own = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    return rows.withColumn("_own", own).join(offsets, "_bucket").withColumn(name, (F.col("_own") + F.col("_offset")).cast("int")).drop("_bucket", "_own", "_offset")


def first_of_each(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int = 1, name: str | None = None) -> DataFrame:
    """The first k rows of each group, with their places if ``name`` is given."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = df.withColumn(name or "_rank", rank).where(F.col(name or "_rank") <= k)
    return rows if name else rows.drop("_rank")


def quota_sample(df: DataFrame, stratum: str, quotas: Mapping[str, int], order: Sequence[Column | str]) -> DataFrame:
    """The first rows of each stratum, as many as its quota; strata without one give none."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    quota = F.create_map(*(x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))))
    return df.where(F.col(stratum).isin(*quotas)).withColumn("_rank", rank).where(F.col("_rank") <= quota[F.col(stratum)]).drop("_rank")


def ordered_variants(df: DataFrame, variant: str, quotas: Mapping[str, int], key: str, rank: str, looks: int | None = None) -> DataFrame:
    """Variants in their order take their quotas of the lowest ranks, no key twice.

    Of rows with equal keys the first counts; keys that earlier variants took are passed
    over. With ``looks`` only so many times the quota of rows, those of the lowest
    ranks, are looked at, so a variant of many repeated keys may get fewer than its
    quota; None looks at all.
    """
    taken, out = None, None
    for name, quota in quotas.items():
        rows = df.where(F.col(variant) == name)
        rows = rows.orderBy(rank).limit(looks * quota) if looks else rows
        rows = rows.join(taken, key, "left_anti") if taken is not None else rows
        own = first_of_each(rows, [key], [rank]).orderBy(rank).limit(quota)
        out = own if out is None else out.unionByName(own)
        taken = out.select(key)
    return out


def diverse(df: DataFrame, field: str, order: Sequence[Column | str], k: int) -> DataFrame:
    """k rows: the first of each value come before any second."""
    again = F.row_number().over(Window.partitionBy(field).orderBy(*order)) > 1
    return df.withColumn("_again", again).orderBy("_again", *order).limit(k).drop("_again")


def disjoint_queues(df: DataFrame, queues: Mapping[str, tuple[Column, int]], key: str, order: Sequence[Column | str]) -> DataFrame:
    """Queues in their order take their first rows that no earlier queue took."""
    taken, out = None, None
    for name, (predicate, count) in queues.items():
        rows = df.where(predicate)
        rows = rows.join(taken, key, "left_anti") if taken is not None else rows
        own = rows.orderBy(*order).limit(count).withColumn("queue", F.lit(name))
        out = own if out is None else out.unionByName(own)
        taken = out.select(key)
    return out


def revision_chains(log: DataFrame, key: str, revision: str, decision: str, supersedes: str) -> DataFrame:
    """The latest decision of each key, and whether revisions are 1, 2, 3 … and each names the one before."""
    order = Window.partitionBy(key).orderBy(revision)
    before = F.lag(decision).over(order)
    good = (F.col(revision) == F.row_number().over(order)) & F.col(supersedes).eqNullSafe(before)
    rows = log.withColumn("_good", good)
    return rows.groupBy(key).agg(F.max_by(decision, revision).alias(decision), F.count("*").alias("n_revisions"), F.bool_and("_good").alias("chain_ok"))


def spread(df: DataFrame, count: int, order: Sequence[Column | str], bucket: Column | None = None) -> DataFrame:
    """Rows at the indices floor(i n / count) of the sorted rows."""
    rows = ordinal(df, *order, bucket=bucket, name="_place")
    n = df.count()
    wanted = df.sparkSession.range(count).select(F.floor(F.col("id") * n / count).cast("int").alias("_index")).distinct()
    return rows.withColumn("_index", F.col("_place") - 1).join(F.broadcast(wanted), "_index").drop("_index", "_place")


def nested_mixes(df: DataFrame, sizes: Mapping[str, int], stratum: str, order: Sequence[Column | str]) -> DataFrame:
    """(row, mix) for every mix that a row is in; smaller mixes are in larger ones."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*order))
    mixes = F.array(*(F.struct(F.lit(k).alias("mix"), F.lit(v).alias("size")) for k, v in sizes.items()))
    rows = df.withColumn("_rank", rank).where(F.col("_rank") <= max(sizes.values())).withColumn("_m", F.explode(mixes))
    return rows.where(F.col("_rank") <= F.col("_m.size")).withColumn("mix", F.col("_m.mix")).drop("_rank", "_m")


def within_budget(turns: DataFrame, key: str, pair: str, tokens: str, budget: int) -> DataFrame:
    """The latest pairs of each conversation whose tokens fit together."""
    back = Window.partitionBy(key).orderBy(F.desc(pair)).rangeBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_sum", F.sum(tokens).over(back)).where(F.col("_sum") <= budget).drop("_sum")


def islands(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers of each group, from first to last."""
    rows = df.select(*keys, number).distinct()
    run = F.col(number) - F.row_number().over(Window.partitionBy(*keys).orderBy(number))
    return rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_run")


def sliding_windows(daily: DataFrame, day: str, value: str, longest: int) -> DataFrame:
    """For each length the complete windows of consecutive days, their largest sum, and those with a gap."""
    ordered = Window.partitionBy("_part").orderBy(day)
    rows = daily.withColumn("_part", F.lit(0))  # one row for each day
    out = None
    for length in range(1, longest + 1):
        own = ordered.rowsBetween(0, length - 1)
        w = rows.select(F.count("*").over(own).alias("n"), F.sum(value).over(own).alias("s"), F.datediff(F.max(day).over(own), F.min(day).over(own)).alias("d"))
        one = w.where(F.col("n") == length).agg(F.lit(length).alias("length"), F.count("*").alias("n_windows"), F.max("s").alias("most"), F.count_if(F.col("d") != length - 1).alias("n_gaps"))
        out = one if out is None else out.union(one)
    return out


def _ranked(t):
    return t.documents.select("doc_id", "source", "lang", "n_chars").withColumn("h", stable_rank("42", "source", "doc_id"))


_H = "sha256('42|' || source || '|' || doc_id)"


@query("win_01_stable_rank", f"SELECT doc_id, {_H} AS h FROM documents")
def _(t):
    return _ranked(t).select("doc_id", "h")


@query("win_02_lowest_k", f"SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= 5")
def _(t):
    return first_of_each(_ranked(t), ["lang"], ["h"], 5).select("doc_id", "lang")


@query("win_03_variants", f"""
WITH r AS (SELECT doc_id, source, lang, {_H} AS h FROM documents), a2 AS (SELECT * FROM r WHERE lang = 'en' ORDER BY h LIMIT 20), a1 AS (SELECT * FROM a2 QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1), a AS (SELECT * FROM a1 ORDER BY h LIMIT 10),
b2 AS (SELECT * FROM r WHERE lang = 'de' ORDER BY h LIMIT 16), b1 AS (SELECT * FROM b2 WHERE source NOT IN (SELECT source FROM a) QUALIFY row_number() OVER (PARTITION BY source ORDER BY h) = 1), b AS (SELECT * FROM b1 ORDER BY h LIMIT 8)
SELECT doc_id, lang FROM a UNION ALL SELECT doc_id, lang FROM b""")
def _(t):
    return ordered_variants(_ranked(t), "lang", {"en": 10, "de": 8}, "source", "h", looks=2).select("doc_id", "lang")


@query("win_04_first_per_axis", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 2")
def _(t):
    return first_of_each(t.documents, ["source", "lang"], ["doc_id"], 2).select("doc_id")


@query("win_05_quotas", f"SELECT doc_id, lang FROM documents WHERE lang IN ('en', 'de', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= CASE lang WHEN 'en' THEN 12 WHEN 'de' THEN 5 ELSE 3 END")
def _(t):
    return quota_sample(_ranked(t), "lang", {"en": 12, "de": 5, "fr": 3}, ["h"]).select("doc_id", "lang")


@query("win_06_revisions", "SELECT user_id, arg_max(event_id, r) AS decision, count(*) AS n_revisions, TRUE AS chain_ok FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY user_id")
def _(t):
    order = Window.partitionBy("user_id").orderBy("event_id")
    log = t.events.select("user_id", F.col("event_id").alias("decision"), F.row_number().over(order).alias("revision"), F.lag("event_id").over(order).alias("supersedes"))
    return revision_chains(log, "user_id", "revision", "decision", "supersedes")


@query("win_07_diverse", f"SELECT doc_id FROM (SELECT doc_id, {_H} AS h, row_number() OVER (PARTITION BY source ORDER BY {_H}) > 1 AS again FROM documents) ORDER BY again, h LIMIT 30")
def _(t):
    return diverse(_ranked(t), "source", ["h"], 30).select("doc_id")


@query("win_08_diverse_components", f"""
WITH c AS (SELECT doc_id, source, {_H} AS h, sha256(text) AS k FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY {_H}) = 1)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) > 1 AS again FROM c) ORDER BY again, h LIMIT 30""")
def _(t):
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("k")).withColumn("h", stable_rank("42", "source", "doc_id"))
    return diverse(first_of_each(rows, ["k"], ["h"]), "source", ["h"], 30).select("doc_id")


@query("win_09_spread", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER () AS n FROM documents) WHERE i IN (SELECT floor(x * n / 25) FROM generate_series(0, 24) g(x))")
def _(t):
    rows = t.documents.select("doc_id", "n_chars")
    bucket = F.floor(F.log2(F.col("n_chars") + 1) * 8)
    return spread(rows, 25, ["n_chars", "doc_id"], bucket).select("doc_id")


@query("win_10_deciles", f"SELECT doc_id, d::INT AS decile FROM (SELECT *, ntile(10) OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS d, {_H} AS h FROM documents) QUALIFY row_number() OVER (PARTITION BY lang, d ORDER BY h) <= 2")
def _(t):
    tiles = _ranked(t).withColumn("decile", F.ntile(10).over(Window.partitionBy("lang").orderBy("n_chars", "doc_id")))
    return first_of_each(tiles, ["lang", "decile"], ["h"], 2).select("doc_id", "decile")


@query("win_11_stratified_unique", f"""
WITH c AS (SELECT doc_id, lang, source, {_H} AS h, sha256(text) AS k FROM documents), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY k ORDER BY h) = 1)
SELECT doc_id, lang FROM f QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 4""")
def _(t):
    rows = t.documents.select("doc_id", "lang", "source", F.sha2("text", 256).alias("k")).withColumn("h", stable_rank("42", "source", "doc_id"))
    return first_of_each(first_of_each(rows, ["k"], ["h"]), ["lang"], ["h"], 4).select("doc_id", "lang")


@query("win_12_hash_order", f"SELECT doc_id, row_number() OVER (ORDER BY {_H})::INT AS place FROM documents")
def _(t):
    return ordinal(_ranked(t), "h", bucket=F.substring("h", 1, 2)).select("doc_id", "place")


@query("win_13_disjoint_queues", f"""
WITH r AS (SELECT doc_id, n_chars, lang, {_H} AS h FROM documents), a AS (SELECT * FROM r WHERE n_chars > 4000 ORDER BY h LIMIT 10), b AS (SELECT * FROM r WHERE lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY h LIMIT 10)
SELECT doc_id, 'long' AS queue FROM a UNION ALL SELECT doc_id, 'french' FROM b""")
def _(t):
    return disjoint_queues(_ranked(t), {"long": (F.col("n_chars") > 4000, 10), "french": (F.col("lang") == "fr", 10)}, "doc_id", ["h"]).select("doc_id", "queue")


@query("win_14_review_queue", """
WITH a AS (SELECT doc_id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 15), b AS (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM a) ORDER BY n_chars DESC, doc_id LIMIT 15) SELECT doc_id, 'first' AS queue FROM a UNION ALL SELECT doc_id, 'second' FROM b""")
def _(t):
    rows = t.documents.select("doc_id", "n_chars")
    return disjoint_queues(rows, {"first": (F.lit(True), 15), "second": (F.lit(True), 15)}, "doc_id", [F.desc("n_chars"), "doc_id"]).select("doc_id", "queue")


@query("win_15_group_pairs", f"""
WITH s AS (SELECT source, doc_id, (lang = 'en')::INT AS side, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY {_H}) AS r FROM documents)
SELECT source, max(doc_id) FILTER (side = 0) AS a, max(doc_id) FILTER (side = 1) AS b FROM s WHERE r = 1 GROUP BY source HAVING count(*) = 2""")
def _(t):
    rows = _ranked(t).withColumn("side", (F.col("lang") == "en").cast("int"))
    first = first_of_each(rows, ["source", "side"], ["h"])
    pairs = first.groupBy("source").agg(F.max(F.when(F.col("side") == 0, F.col("doc_id"))).alias("a"), F.max(F.when(F.col("side") == 1, F.col("doc_id"))).alias("b"))
    return pairs.where("a IS NOT NULL AND b IS NOT NULL")


@query("win_16_nested_mixes", f"WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS k FROM documents) SELECT doc_id, mix FROM r JOIN (VALUES ('small', 3), ('middle', 10), ('large', 30)) m(mix, n) ON k <= n")
def _(t):
    return nested_mixes(_ranked(t), {"small": 3, "middle": 10, "large": 30}, "lang", ["h"]).select("doc_id", "mix")


@query("win_18_blind_components", f"""
WITH r AS (SELECT doc_id, lang, source, {_H} AS h FROM documents) SELECT doc_id, 'quota' AS how FROM (SELECT * FROM r WHERE lang IN ('es', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 5)
UNION ALL SELECT doc_id, 'diverse' FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) > 1 AS again FROM r WHERE lang = 'en' ORDER BY again, h LIMIT 12)""")
def _(t):
    rows = _ranked(t)
    quota = quota_sample(rows, "lang", {"es": 5, "fr": 5}, ["h"]).select("doc_id", F.lit("quota").alias("how"))
    return quota.union(diverse(rows.where("lang = 'en'"), "source", ["h"], 12).select("doc_id", F.lit("diverse")))


@query("win_19_monitor_sample", f"WITH s AS (SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY {_H}) <= 3) SELECT doc_id, row_number() OVER (ORDER BY sha256('order|' || doc_id))::INT AS place FROM s")
def _(t):
    chosen = first_of_each(_ranked(t), ["source"], ["h"], 3).select("doc_id").withColumn("o", stable_rank("order", "doc_id"))
    return ordinal(chosen, "o", bucket=F.substring("o", 1, 1)).select("doc_id", "place")


@query("win_20_stress_subset", f"WITH a AS (SELECT doc_id, 'stress' AS part FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10), b AS (SELECT doc_id, 'typical' AS part FROM documents WHERE lang IN ('en', 'de') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= 6) SELECT * FROM a UNION ALL SELECT * FROM b")
def _(t):
    rows = _ranked(t)
    stress = rows.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", F.lit("stress").alias("part"))
    return stress.union(quota_sample(rows, "lang", {"en": 6, "de": 6}, ["h"]).select("doc_id", F.lit("typical")))


@query("win_21_longest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(t):
    return t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(20).select("doc_id", "n_chars")


@query("win_22_conflict_sample", f"""
WITH r AS (SELECT doc_id, lang, n_chars, {_H} AS h FROM documents), a AS (SELECT * FROM r WHERE n_chars > 2000 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 5), b AS (SELECT * FROM r WHERE n_chars < 3000 AND doc_id NOT IN (SELECT doc_id FROM a) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY h) <= 5)
SELECT doc_id, 'long' AS anchor FROM a UNION ALL SELECT doc_id, 'short' FROM b""")
def _(t):
    rows, taken, out = _ranked(t), None, None
    for name, rule in (("long", F.col("n_chars") > 2000), ("short", F.col("n_chars") < 3000)):
        left = rows.where(rule) if taken is None else rows.where(rule).join(taken, "doc_id", "left_anti")
        own = first_of_each(left, ["lang"], ["h"], 5).select("doc_id", F.lit(name).alias("anchor"))
        out = own if out is None else out.union(own)
        taken = out.select("doc_id")
    return out


@query("win_23_windows", """
WITH d AS (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1), l AS (SELECT unnest(generate_series(1, 7)) AS k), w AS (SELECT k, a.day, sum(b.n) AS s, count(*) AS c, max(b.day) - min(b.day) AS gap FROM l JOIN (SELECT *, row_number() OVER (ORDER BY day) AS r FROM d) a ON TRUE JOIN (SELECT *, row_number() OVER (ORDER BY day) AS r FROM d) b ON b.r BETWEEN a.r AND a.r + k - 1 GROUP BY k, a.day)
SELECT k::INT AS length, count(*) AS n_windows, max(s)::BIGINT AS most, count(*) FILTER (gap <> k - 1) AS n_gaps FROM w WHERE c = k GROUP BY k""")
def _(t):
    daily = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return sliding_windows(daily, "day", "n", 7)


@query("win_24_monotonic", "SELECT user_id, count(*) FILTER (event_id < p) AS n_breaks, count(*) AS n FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) GROUP BY user_id")
def _(t):
    before = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", before.alias("p")).groupBy("user_id").agg(F.count_if(F.col("event_id") < F.col("p")).alias("n_breaks"), F.count("*").alias("n"))


@query("win_25_alternate", f"SELECT doc_id, ((row_number() OVER (PARTITION BY source ORDER BY {_H}) - 1) % 2)::INT AS side FROM documents")
def _(t):
    return _ranked(t).select("doc_id", ((F.row_number().over(Window.partitionBy("source").orderBy("h")) - 1) % 2).alias("side"))


@query("win_26_repeated_reply", "SELECT conv_id, turn FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations WHERE role = 'assistant') WHERE left(text, 2) = left(p, 2)")
def _(t):
    rows = t.conversations.where("role = 'assistant'").withColumn("p", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    return rows.where(F.left("text", F.lit(2)) == F.left("p", F.lit(2))).select("conv_id", "turn")


@query("win_27_priority", "SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 40")
def _(t):
    level = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return t.lineitem.orderBy(level, F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(40).select("l_orderkey", "l_linenumber")


@query("win_28_tolerant_best", "WITH s AS (SELECT o_orderpriority AS k, avg(o_totalprice) AS speed, count(*) AS memory FROM orders GROUP BY 1) SELECT k FROM s WHERE speed >= (SELECT max(speed) FROM s) * 0.98 ORDER BY memory, k LIMIT 1")
def _(t):
    s = t.orders.groupBy(F.col("o_orderpriority").alias("k")).agg(F.avg("o_totalprice").alias("speed"), F.count("*").alias("memory"))
    return s.join(F.broadcast(s.agg(F.max("speed").alias("best")))).where(F.col("speed") >= F.col("best") * 0.98).orderBy("memory", "k").limit(1).select("k")


@query("win_29_blind_labels", "SELECT user_id, event_type, chr(64 + row_number() OVER (PARTITION BY user_id ORDER BY sha256('blind|' || user_id || '|' || event_type))::INT) AS label FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(t):
    arms = t.events.select("user_id", "event_type").distinct().withColumn("h", stable_rank("blind", "user_id", "event_type"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("h"))
    return arms.select("user_id", "event_type", F.char(F.lit(64) + place).alias("label"))


@query("win_30_truncate", "SELECT conv_id, turn FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS s FROM conversations) WHERE s <= 1500")
def _(t):
    return within_budget(t.conversations.withColumn("n", F.length("text")), "conv_id", "turn", "n", 1500).select("conv_id", "turn")


def fill_band(pairs: DataFrame, case: str, tokens: str, minimum: int, choices: int = 16) -> DataFrame:
    """Greedy filling of each case: of its next ``choices`` pairs, again and again the longest that stays within the minimum.

    Sequential within a case, so each case's pairs, of bounded number, are one group.
    """
    import pandas as pd

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["ordinal"]).reset_index(drop=True)
        left, total, chosen = list(range(len(rows))), 0, []
        while left:
            fitting = [i for i in left[:choices] if total + rows[tokens][i] <= minimum]
            if not fitting:
                break
            best = max(fitting, key=lambda i: (rows[tokens][i], -i))
            total += int(rows[tokens][best])
            chosen.append((key[0], int(rows.ordinal[best]), len(chosen), total))
            left.remove(best)
        return pd.DataFrame(chosen, columns=[case, "ordinal", "step", "total"])

    schema = f"{case} {pairs.schema[case].dataType.simpleString()}, ordinal long, step int, total long"
    return pairs.select(case, F.col("ordinal").cast("long").alias("ordinal"), F.col(tokens).cast("long").alias(tokens)).groupBy(case).applyInPandas(fill, schema)


@query("win_31_fill_band")
def _(t):
    return fill_band(t.conversations.select("conv_id", F.col("turn").alias("ordinal"), F.length("text").alias("n")), "conv_id", "n", 2000)


@query("win_32_islands", "WITH y AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS d FROM events), r AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS g FROM y) SELECT user_id, min(d)::INT AS first, max(d)::INT AS last FROM r GROUP BY user_id, g")
def _(t):
    return islands(t.events.select("user_id", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("d")), ["user_id"], "d")


@query("win_33_duplicate_repairs", "SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1")
def _(t):
    return t.documents.withColumn("r", F.row_number().over(Window.partitionBy(F.sha2("text", 256)).orderBy("doc_id"))).where("r > 1").select("doc_id")


@query("win_34_preferred", "SELECT doc_id FROM documents ORDER BY (source = 'src5') DESC, doc_id LIMIT 60")
def _(t):
    return t.documents.orderBy((F.col("source") == "src5").desc(), "doc_id").limit(60).select("doc_id")


@query("win_35_pending", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def _(t):
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id")


@query("win_36_continuous_days", "WITH d AS (SELECT DISTINCT ts::DATE AS day FROM events) SELECT count(*) AS n_days, count(*) FILTER (day - p <> 1) AS n_gaps FROM (SELECT day, lag(day) OVER (ORDER BY day) AS p FROM d)")
def _(t):
    days = t.events.select(F.col("ts").cast("date").alias("day")).distinct().withColumn("p", F.lag("day").over(Window.orderBy("day")))  # one row for each day
    return days.agg(F.count("*").alias("n_days"), F.count_if(F.datediff("day", "p") != 1).alias("n_gaps"))


@query("win_37_diagnostic", f"WITH s AS (SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_H}) <= 9) SELECT doc_id, row_number() OVER (ORDER BY sha256('diag|' || doc_id))::INT AS place FROM s")
def _(t):
    chosen = quota_sample(_ranked(t), "lang", {"en": 9, "fr": 9}, ["h"]).select("doc_id").withColumn("o", stable_rank("diag", "doc_id"))
    return ordinal(chosen, "o").select("doc_id", "place")  # 18 rows


@query("win_38_browse", f"SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY {_H} LIMIT 12")
def _(t):
    return _ranked(t).where("lang = 'de'").orderBy("h").limit(12).select("doc_id")


@query("win_39_guard_sample", f"SELECT doc_id, 'guard:' || sha256('guard|' || doc_id) AS id FROM documents WHERE source IN ('src1', 'src2') AND lang = 'en' ORDER BY {_H} LIMIT 8")
def _(t):
    rows = _ranked(t).where("source IN ('src1', 'src2') AND lang = 'en'").orderBy("h").limit(8)
    return rows.select("doc_id", F.concat(F.lit("guard:"), stable_rank("guard", "doc_id")).alias("id"))


@query("win_40_provider_choice", "SELECT s_suppkey FROM supplier ORDER BY (s_acctbal > 0) DESC, s_nationkey, s_suppkey LIMIT 1")
def _(t):
    return t.supplier.orderBy((F.col("s_acctbal") > 0).desc(), "s_nationkey", "s_suppkey").limit(1).select("s_suppkey")


@query("win_41_schedule", """
WITH x AS (SELECT n_nationkey, n_name, r_regionkey FROM nation CROSS JOIN region), r AS (SELECT *, row_number() OVER (PARTITION BY r_regionkey ORDER BY length(n_name) DESC, n_nationkey) AS k FROM x)
SELECT n_nationkey, r_regionkey, row_number() OVER (ORDER BY r_regionkey, (k > 1), n_nationkey)::INT AS place FROM r""")
def _(t):
    every = t.nation.select("n_nationkey", "n_name").crossJoin(F.broadcast(t.region.select("r_regionkey")))  # fixed tables
    first = F.row_number().over(Window.partitionBy("r_regionkey").orderBy(F.length("n_name").desc(), "n_nationkey")) > 1
    return ordinal(every.withColumn("later", first), "r_regionkey", "later", "n_nationkey").select("n_nationkey", "r_regionkey", "place")


@query("win_42_fixed_partition", f"SELECT doc_id, r <= 20 AS chosen FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_H}) AS r FROM documents WHERE lang = 'fr')")
def _(t):
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return _ranked(t).where("lang = 'fr'").select("doc_id", (place <= 20).alias("chosen"))


@query("win_43_spaced_dates", "SELECT i::INT AS i, DATE '1950-01-01' + CAST(floor(i * (DATE '2049-12-31' - DATE '1950-01-01') / 99) AS INT) AS day FROM generate_series(0, 99) g(i)")
def _(t):
    span = F.datediff(F.lit("2049-12-31").cast("date"), F.lit("1950-01-01").cast("date"))
    return t.spark.range(100).select(F.col("id").cast("int").alias("i"), F.date_add(F.lit("1950-01-01").cast("date"), F.floor(F.col("id") * span / 99).cast("int")).alias("day"))


@query("udf_04_order_key", "SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY abs(o_totalprice - 150000), o_orderkey) <= 4")
def _(t):
    """The caller's sort key is a column expression."""
    nearest = F.abs(F.col("o_totalprice") - 150000)
    return first_of_each(t.orders, ["o_orderpriority"], [nearest, "o_orderkey"], 4).select("o_orderkey", "o_orderpriority")


@query("udf_05_group_selector", "SELECT conv_id, min(turn) FILTER (role = 'assistant' AND contains(text, chr(10))) AS first, max(turn) FILTER (role = 'assistant' AND contains(text, chr(10))) AS last FROM conversations GROUP BY conv_id HAVING last > first")
def _(t):
    """From each group the pair of rows that the caller's selector names."""
    chosen = lambda f, test: f(F.when(test, F.col("turn")))
    test = (F.col("role") == "assistant") & F.col("text").contains("\n")
    return group_pairs(t.conversations, ["conv_id"], {"first": chosen(F.min, test), "last": chosen(F.max, test)}, F.col("last") > F.col("first"))


def group_pairs(df: DataFrame, keys: Sequence[str], selector: Mapping[str, Column], valid: Column) -> DataFrame:
    """What the caller's aggregate expressions select in each group, where that is valid."""
    return df.groupBy(*keys).agg(*(c.alias(name) for name, c in selector.items())).where(valid)


@query("udf_06_predicates", f"""
WITH r AS (SELECT doc_id, lang, n_chars, {_H} AS h FROM documents), a AS (SELECT doc_id, h FROM r WHERE lang = 'en' AND n_chars > 500 ORDER BY h LIMIT 9), b AS (SELECT doc_id, h FROM r WHERE n_chars > 200 AND doc_id NOT IN (SELECT doc_id FROM a) ORDER BY h LIMIT 7)
SELECT doc_id, 'long' AS queue FROM a UNION ALL SELECT doc_id, 'any' FROM b""")
def _(t):
    """Disjoint queues by the caller's predicates."""
    queues = {"long": ((F.col("lang") == "en") & (F.col("n_chars") > 500), 9), "any": (F.col("n_chars") > 200, 7)}
    return disjoint_queues(_ranked(t), queues, "doc_id", ["h"]).select("doc_id", "queue")
