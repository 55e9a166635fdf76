"""Metric aggregates: macro averages, intervals, verdict counts, duplicates and comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.registry import query


def macro_average(df: DataFrame, levels: Sequence[str], metric: str) -> DataFrame:
    """Average level by level, the first grouped by all of ``levels``, down to one row.

    Null metrics are left out where records are averaged; a group without any doesn't count.
    """
    rows = df
    for depth in range(len(levels), -1, -1):
        rows = rows.groupBy(*levels[:depth]).agg(F.avg(metric).alias(metric))
    return rows


def rate(numerator: Column, denominator: Column, digits: int = 6) -> Column:
    """A rounded share, null for no denominator."""
    return F.round(F.try_divide(numerator.cast("double"), denominator), digits)


def wilson(passed: Column, total: Column, z: float = 1.959963984540054) -> Column:
    """The bounds of Wilson's interval for a share; null for no trial."""
    p = passed.cast("double") / F.when(total > 0, total)
    centre = p + z * z / (2 * total)
    spread = z * F.sqrt(p * (1 - p) / total + z * z / (4.0 * total * total))
    scale = 1 + z * z / total
    return F.struct(((centre - spread) / scale).alias("low"), ((centre + spread) / scale).alias("high"))


def verdict_counts(verdict: str) -> list[Column]:
    """Counts of applicable, scorable, PASS, FAIL and UNSCORABLE; a null verdict isn't applicable."""
    v = F.col(verdict)
    return [F.count(v).alias("applicable"), F.count_if(v.isin("PASS", "FAIL")).alias("scorable"), *(F.count_if(v == x).alias(x.lower()) for x in ("PASS", "FAIL", "UNSCORABLE"))]


def with_totals(df: DataFrame, keys: Sequence[str], stratum: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates by keys and stratum, and by keys with the stratum ``all``, in one pass."""
    sets = [[F.col(k) for k in keys], [F.col(k) for k in (*keys, stratum)]]
    rows = df.groupingSets(sets, *keys, stratum).agg(F.grouping(stratum).alias("_total"), *aggregates)
    return rows.withColumn(stratum, F.when(F.col("_total") == 1, "all").otherwise(F.col(stratum))).drop("_total")


def confusion(df: DataFrame, truth: str, guess: str, values: Sequence) -> DataFrame:
    """A row for each true value and a column for each guess, zero where none."""
    names = [str(v) for v in values]
    return df.groupBy(truth).pivot(guess, list(values)).agg(F.count(F.lit(1))).na.fill(0, names)


def duplicate_summary(df: DataFrame, text: Column, axis: str) -> DataFrame:
    """One row: rows, distinct texts, rows that have a twin, the most copies, groups over several axes."""
    groups = df.groupBy(F.xxhash64(text).alias("h"), F.sha2(text, 256).alias("key")).agg(F.count("*").alias("n"), F.count_distinct(axis).alias("axes"))
    return groups.agg(
        F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_participating"),
        F.max("n").alias("most"), F.count_if((F.col("n") > 1) & (F.col("axes") > 1)).alias("n_cross_axis"),
    )


def multiplicity(df: DataFrame, axis: str, signature: Column) -> DataFrame:
    """For each axis its distinct signatures, the rows of repeated ones, and the most repeats."""
    groups = df.groupBy(axis, signature.alias("s")).agg(F.count("*").alias("c"))
    return groups.groupBy(axis).agg(F.count("*").alias("n_unique"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("n_repeated"), F.max("c").alias("most"))


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many groups there are of each size."""
    return df.groupBy(*keys).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n_groups"))


def shares(df: DataFrame, key: str, amount: str, digits: int = 4) -> DataFrame:
    """Each group's part of the total in percent."""
    sums = df.groupBy(key).agg(F.sum(amount).alias("amount"))
    return sums.crossJoin(F.broadcast(sums.agg(F.sum("amount").alias("total")))).select(key, "amount", F.round(F.col("amount") * 100 / F.col("total"), digits).alias("percent"))  # one row is broadcast


def cross_case_repeats(df: DataFrame, text: Column, case: str, most: int) -> DataFrame:
    """Rows whose text more than ``most`` distinct cases share."""
    rows = df.withColumn("_key", F.sha2(text, 256))
    many = rows.groupBy("_key").agg(F.count_distinct(case).alias("n_cases")).where(F.col("n_cases") > most)
    return rows.join(many, "_key").drop("_key")


def detail_list(df: DataFrame, key: Sequence[str], value: str, most: int) -> DataFrame:
    """The first values of each group as a list, the number of all, and whether some are left out."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(value))
    first = df.select(*key, value).withColumn("_r", rank).where(F.col("_r") <= most)
    lists = first.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias("details"))
    return df.groupBy(*key).agg(F.count("*").alias("n")).join(lists, list(key)).withColumn("truncated", F.col("n") > most)


def _records(t):
    """Order lines as scored records: axis is the segment, component the order."""
    orders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("c_mktsegment").alias("axis"))
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))


_RECORDS = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@query("agg_19_macro_average", f"SELECT avg(m) AS passed FROM (SELECT axis, avg(m) AS m FROM (SELECT c_mktsegment AS axis, o_orderkey, avg(CASE WHEN l_tax > 0.07 THEN NULL ELSE (l_quantity > 25)::INT END) AS m FROM {_RECORDS} GROUP BY ALL) GROUP BY axis)")
def _(t):
    rows = _records(t).withColumn("passed", F.when(F.col("l_tax") <= 0.07, (F.col("l_quantity") > 25).cast("int")))
    return macro_average(rows, ["axis", "o_orderkey"], "passed")


@query("agg_20_macro_micro", f"""
WITH c AS (SELECT c_mktsegment AS axis, o_orderkey, sum(l_extendedprice) AS nll, sum(l_quantity) AS tokens FROM {_RECORDS} GROUP BY ALL)
SELECT (SELECT avg(m) FROM (SELECT avg(nll / tokens) AS m FROM c GROUP BY axis)) AS macro, (SELECT sum(nll) / sum(tokens) FROM c) AS micro""")
def _(t):
    parts = _records(t).groupBy("axis", "o_orderkey").agg(F.sum("l_extendedprice").alias("nll"), F.sum("l_quantity").alias("tokens"))
    axes = parts.groupBy("axis").agg(F.avg(F.col("nll") / F.col("tokens")).alias("m"), F.sum("nll").alias("nll"), F.sum("tokens").alias("tokens"))
    return axes.agg(F.avg("m").alias("macro"), (F.sum("nll") / F.sum("tokens")).alias("micro"))


@query("agg_21_grouping_sets", "SELECT o_orderstatus, o_orderpriority, CASE WHEN grouping(y) = 1 THEN 'all' ELSE y::VARCHAR END AS y, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT *, year(o_orderdate) AS y FROM orders) GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus, o_orderpriority, y))")
def _(t):
    rows = t.orders.withColumn("y", F.year("o_orderdate").cast("string"))
    return with_totals(rows, ["o_orderstatus", "o_orderpriority"], "y", [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")])


_VERDICT = "CASE WHEN l_tax = 0 THEN NULL WHEN l_tax > 0.07 THEN 'UNSCORABLE' WHEN l_quantity > 25 THEN 'PASS' ELSE 'FAIL' END"
_VERDICTS = "count(v) AS applicable, count(*) FILTER (v IN ('PASS', 'FAIL')) AS scorable, count(*) FILTER (v = 'PASS') AS pass, count(*) FILTER (v = 'FAIL') AS fail, count(*) FILTER (v = 'UNSCORABLE') AS unscorable"


@query("agg_22_verdicts", f"SELECT l_returnflag, {_VERDICTS} FROM (SELECT l_returnflag, {_VERDICT} AS v FROM lineitem) GROUP BY 1")
def _(t):
    return t.lineitem.select("l_returnflag", F.expr(_VERDICT).alias("v")).groupBy("l_returnflag").agg(*verdict_counts("v"))


@query("agg_23_wilson", """
WITH c AS (SELECT l_returnflag, count(*) FILTER (l_quantity > 45)::DOUBLE AS k, count(*)::DOUBLE AS n, 1.959963984540054 AS z FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM c""")
def _(t):
    rows = t.lineitem.groupBy("l_returnflag").agg(F.count_if(F.col("l_quantity") > 45).alias("k"), F.count("*").alias("n")).select("l_returnflag", wilson(F.col("k"), F.col("n")).alias("w"))
    return rows.select("l_returnflag", F.round("w.low", 9).alias("low"), F.round("w.high", 9).alias("high"))


@query("agg_24_rate", "SELECT source, count(*) FILTER (toxic = 1) AS numerator, count(toxic) AS denominator, round(count(*) FILTER (toxic = 1) / nullif(count(toxic), 0), 6) AS rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left").groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("numerator"), F.count("toxic").alias("denominator"))
    return rows.withColumn("rate", rate(F.col("numerator"), F.col("denominator")))


@query("agg_25_confusion", 'SELECT quality, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1", count(*) FILTER (toxic = 2) AS "2" FROM labels GROUP BY quality')
def _(t):
    return confusion(t.labels, "quality", "toxic", [0, 1, 2])


_NORM = "lower(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')))"


def collapsed(text: str) -> Column:
    """Lower case with runs of white space as one space."""
    return F.lower(F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")))


@query("agg_26_duplicates", f"""
WITH g AS (SELECT {_NORM} AS k, count(*) AS n, count(DISTINCT source) AS a FROM documents GROUP BY 1)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS n_participating, max(n) AS most, count(*) FILTER (n > 1 AND a > 1) AS n_cross_axis FROM g""")
def _(t):
    return duplicate_summary(t.documents, collapsed("text"), "source")


@query("agg_27_multiplicity", "SELECT lang, count(*) AS n_unique, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS n_repeated, max(c) AS most FROM (SELECT lang, sha256(text) AS s, count(*) AS c FROM documents GROUP BY ALL) GROUP BY lang")
def _(t):
    return multiplicity(t.documents, "lang", F.sha2("text", 256))


@query("agg_28_crossing_groups", "SELECT count(*) AS n FROM (SELECT sha256(text) FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id % 3) > 1)")
def _(t):
    groups = t.documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.count_distinct(F.col("doc_id") % 3).alias("n"))
    return groups.where("n > 1").agg(F.count("*").alias("n"))


@query("agg_29_group_sizes", "SELECT size, count(*) AS n_groups FROM (SELECT count(*) AS size FROM lineitem GROUP BY l_orderkey) GROUP BY size")
def _(t):
    return group_sizes(t.lineitem, ["l_orderkey"])


@query("agg_30_shares", "SELECT source, sum(n_chars)::BIGINT AS amount, round(sum(n_chars) * 100 / (SELECT sum(n_chars) FROM documents), 4) AS percent FROM documents GROUP BY source")
def _(t):
    return shares(t.documents, "source", "n_chars")


@query("agg_31_json_keys", "SELECT 'k' AS path, count(*) AS n, 1 AS depth FROM events WHERE json_extract(props, '$.k') IS NOT NULL HAVING count(*) > 0")
def _(t):
    from corpusloom.functions.hashing import json_keys

    keys = t.events.select(F.explode(json_keys(F.col("props"))).alias("x"))
    return keys.groupBy(F.col("x.key").alias("path")).agg(F.count("*").alias("n"), F.max("x.depth").alias("depth"))


@query("agg_32_turn_pairs", "SELECT pairs, count(*) AS n FROM (SELECT least(count(*) FILTER (role = 'user'), count(*) FILTER (role = 'assistant')) AS pairs FROM conversations GROUP BY conv_id) GROUP BY pairs")
def _(t):
    pairs = t.conversations.groupBy("conv_id").agg(F.least(F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant")).alias("pairs"))
    return pairs.groupBy("pairs").agg(F.count("*").alias("n"))


@query("agg_33_role_patterns", "SELECT roles, count(*) AS n FROM (SELECT string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id) GROUP BY roles")
def _(t):
    roles = t.conversations.groupBy("conv_id").agg(F.expr("listagg(role, ',') WITHIN GROUP (ORDER BY turn)").alias("roles"))
    return roles.groupBy("roles").agg(F.count("*").alias("n"))


@query("agg_37_lowest_hash", "SELECT source, arg_min(doc_id, sha256('7|' || doc_id)) AS doc_id FROM documents GROUP BY source")
def _(t):
    return t.documents.groupBy("source").agg(F.min_by("doc_id", F.sha2(F.concat(F.lit("7|"), F.col("doc_id").cast("string")), 256)).alias("doc_id"))


@query("agg_38_details", "SELECT lang, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (r <= 20) AS details, count(*) > 20 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) GROUP BY lang")
def _(t):
    return detail_list(t.documents, ["lang"], "doc_id", 20).withColumn("details", F.array_join(F.transform("details", lambda x: x.cast("string")), ","))


@query("agg_39_review_means", "SELECT event_type, avg(value) FILTER (value > 50) AS mean_scored, avg((value > 90)::INT) AS first_rate, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.avg(F.when(F.col("value") > 50, F.col("value"))).alias("mean_scored"), F.avg((F.col("value") > 90).cast("int")).alias("first_rate"), F.count("*").alias("n"))


@query("agg_40_cross_case", "WITH m AS (SELECT sha256(text) AS h FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1) SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT h FROM m)")
def _(t):
    return cross_case_repeats(t.documents, F.col("text"), "source", 1).select("doc_id")


@query("agg_41_response_shape", "SELECT count(DISTINCT text) * 100.0::DOUBLE / count(*) AS unique_percent, (SELECT max(n) FROM (SELECT count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY text)) AS largest FROM conversations WHERE role = 'assistant'")
def _(t):
    groups = t.conversations.where("role = 'assistant'").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n"))
    return groups.agg((F.count("*") * 100.0 / F.sum("n")).alias("unique_percent"), F.max("n").alias("largest"))


@query("agg_42_zero_tolerance", f"SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_components, count(*) FILTER (l_discount > 0.1) AS n_violations, count(DISTINCT c_mktsegment) AS n_axes FROM {_RECORDS}")
def _(t):
    return _records(t).agg(F.count("*").alias("n_rows"), F.count_distinct("o_orderkey").alias("n_components"), F.count_if(F.col("l_discount") > 0.1).alias("n_violations"), F.count_distinct("axis").alias("n_axes"))


@query("agg_43_by_stratum", "SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS n_done, avg(o_totalprice) AS mean FROM orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("n_done"), F.avg("o_totalprice").alias("mean"))


@query("agg_44_bands", "SELECT CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 2000 THEN 'middle' ELSE 'long' END AS band, count(*) AS n, avg(n_chars) AS mean FROM documents GROUP BY 1")
def _(t):
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 2000, "middle").otherwise("long")
    return t.documents.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean"))


@query("agg_45_exploded_conflicts", "SELECT part, count(*) FILTER (a <> b) AS n_conflicts FROM (SELECT 'y' AS part, year(o_orderdate) AS a, 1995 AS b FROM orders UNION ALL SELECT 'm', month(o_orderdate), 6 FROM orders UNION ALL SELECT 'd', day(o_orderdate), 15 FROM orders) GROUP BY part")
def _(t):
    parts = F.array(*(F.struct(F.lit(k).alias("part"), f("o_orderdate").alias("a"), F.lit(b).alias("b")) for k, f, b in (("y", F.year, 1995), ("m", F.month, 6), ("d", F.dayofmonth, 15))))
    return t.orders.select(F.explode(parts).alias("x")).groupBy("x.part").agg(F.count_if(F.col("x.a") != F.col("x.b")).alias("n_conflicts"))


_WORDS = "len(string_split_regex(trim(text, chr(32) || chr(10)), '[ \\n]+'))"


def word_count(text: str) -> Column:
    return F.size(F.split(F.btrim(text, F.lit(" \n")), "[ \\n]+"))


@query("agg_46_token_totals", f"SELECT lang, sum({_WORDS})::BIGINT AS n_words, count(*) FILTER ({_WORDS} > 512) AS over_512, count(*) FILTER ({_WORDS} > 1024) AS over_1024 FROM documents GROUP BY lang")
def _(t):
    rows = t.documents.select("lang", word_count("text").alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("n_words"), *(F.count_if(F.col("n") > k).alias(f"over_{k}") for k in (512, 1024)))


@query("agg_47_length_ladder", f"SELECT max({_WORDS})::INT AS longest, (SELECT min(x) FROM (VALUES (512), (1024), (2048), (4096), (8192), (16384), (32768)) v(x) WHERE x >= (SELECT max({_WORDS}) FROM documents)) AS ladder FROM documents")
def _(t):
    ladder = F.array(*(F.lit(2**k) for k in range(9, 16)))
    row = t.documents.agg(F.max(word_count("text")).alias("longest"))
    return row.select("longest", F.array_min(F.filter(ladder, lambda x: x >= F.col("longest"))).alias("ladder"))


@query("agg_48_axis_quantiles", "SELECT o_orderpriority, round(avg(o_totalprice), 2) AS mean, round(quantile_cont(o_totalprice, 0.5), 2) AS p50, round(quantile_cont(o_totalprice, 0.99), 2) AS p99, max(o_totalprice) AS most FROM orders GROUP BY 1")
def _(t):
    points = F.percentile("o_totalprice", F.array(F.lit(0.5), F.lit(0.99)))
    return t.orders.groupBy("o_orderpriority").agg(F.round(F.avg("o_totalprice"), 2).alias("mean"), F.round(points[0], 2).alias("p50"), F.round(points[1], 2).alias("p99"), F.max("o_totalprice").alias("most"))


@query("agg_49_metric_kinds", "SELECT CASE WHEN NOT isfinite(x) THEN 'non_finite' WHEN event_type = 'purchase' THEN 'eval' ELSE 'train' END AS kind, count(*) AS n FROM (SELECT event_type, CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE WHEN event_id % 89 = 0 THEN 'inf'::DOUBLE ELSE value END AS x FROM events) GROUP BY 1")
def _(t):
    x = F.when(F.col("event_id") % 97 == 0, float("nan")).when(F.col("event_id") % 89 == 0, float("inf")).otherwise(F.col("value"))
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    rows = t.events.select("event_type", x.alias("x"))
    return rows.groupBy(F.when(bad, "non_finite").when(F.col("event_type") == "purchase", "eval").otherwise("train").alias("kind")).agg(F.count("*").alias("n"))


@query("agg_50_call_profile", "SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, bool_or(value > 99) AS any_high, min(year(ts))::INT AS first_year, max(year(ts))::INT AS last_year FROM events GROUP BY event_type")
def _(t):
    calls = t.events.select("user_id", F.explode(F.array(F.struct("event_type", "value", "ts"))).alias("c")).select("user_id", "c.*")
    return calls.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("n_users"), F.bool_or(F.col("value") > 99).alias("any_high"), F.min(F.year("ts")).alias("first_year"), F.max(F.year("ts")).alias("last_year"))


@query("agg_51_failure_codes", "SELECT code, count(*) AS n FROM (SELECT 'late' AS code FROM lineitem WHERE month(l_shipdate) = 12 UNION ALL SELECT 'cheap' FROM lineitem WHERE l_discount >= 0.09 UNION ALL SELECT 'small' FROM lineitem WHERE l_quantity < 3) GROUP BY code")
def _(t):
    from corpusloom.operators.quality import reasons

    codes = reasons({"late": F.month("l_shipdate") == 12, "cheap": F.col("l_discount") >= 0.09, "small": F.col("l_quantity") < 3})
    return t.lineitem.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


@query("agg_53_category_counters", "SELECT event_type, count(*) FILTER (value > 20) AS n_pass, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 20).alias("n_pass"), F.count("*").alias("n"))


@query("agg_54_quality_percents", "SELECT round(count(*) FILTER (quality = 1) * 100 / count(*), 6) AS quality_percent, round(count(*) FILTER (toxic = 0 AND quality = 1) * 100 / nullif(count(*) FILTER (quality = 1), 0), 6) AS clean_percent FROM labels")
def _(t):
    good = F.col("quality") == 1
    return t.labels.agg(F.round(F.count_if(good) * 100 / F.count("*"), 6).alias("quality_percent"), F.round(F.try_divide(F.count_if(good & (F.col("toxic") == 0)) * 100.0, F.count_if(good)), 6).alias("clean_percent"))


@query("agg_55_overlap_counts", f"""
WITH r AS (SELECT text, {_NORM} AS k FROM documents WHERE source = 'src3') SELECT source, count(*) FILTER (text IN (SELECT text FROM r)) AS n_exact, count(*) FILTER ({_NORM} IN (SELECT k FROM r)) AS n_normalised FROM documents WHERE source <> 'src3' GROUP BY source""")
def _(t):
    rows = t.documents.select("source", F.sha2("text", 256).alias("e"), F.sha2(collapsed("text"), 256).alias("k"))
    held = rows.where("source = 'src3'")
    both = rows.where("source <> 'src3'").join(held.select("e", F.lit(1).alias("x")).distinct(), "e", "left").join(held.select("k", F.lit(1).alias("y")).distinct(), "k", "left")
    return both.groupBy("source").agg(F.count("x").alias("n_exact"), F.count("y").alias("n_normalised"))


@query("agg_56_inventory", "SELECT lang, count(*) AS n, count(*) FILTER (len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) >= 3) AS n_lined FROM documents GROUP BY lang")
def _(t):
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    return t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(lines >= 3).alias("n_lined"))


@query("agg_57_package_metrics", "SELECT round(sum(n_chars) FILTER (lang = 'en') / sum(n_chars), 9) AS english_share, round(count(*) FILTER (contains(text, 'License')) / count(*), 9) AS license_share, count(*) FILTER (contains(text, 'src')) AS n_leaks FROM documents")
def _(t):
    english = F.sum(F.when(F.col("lang") == "en", F.col("n_chars")))
    licensed = F.count_if(F.col("text").contains("License"))
    return t.documents.agg(F.round(english / F.sum("n_chars"), 9).alias("english_share"), F.round(licensed / F.count("*"), 9).alias("license_share"), F.count_if(F.col("text").contains("src")).alias("n_leaks"))


@query("agg_58_factorial", """
WITH c AS (SELECT l_orderkey, max((l_quantity > 25)::INT) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS a1, max((l_quantity > 25)::INT) FILTER (l_returnflag = 'N' AND l_linestatus = 'F') AS b1,
    max((l_quantity > 25)::INT) FILTER (l_returnflag <> 'N' AND l_linestatus = 'O') AS a0, max((l_quantity > 25)::INT) FILTER (l_returnflag <> 'N' AND l_linestatus = 'F') AS b0 FROM lineitem GROUP BY 1)
SELECT count(*) AS n_cases, count(*) FILTER (a1 + b1 + a0 + b0 IS NOT NULL) AS n_complete, sum((b1 - a1) - (b0 - a0))::BIGINT AS interaction FROM c""")
def _(t):
    cell = lambda e, c: F.max(F.when(e & (F.col("l_linestatus") == c), (F.col("l_quantity") > 25).cast("int")))
    new = F.col("l_returnflag") == "N"
    cells = t.lineitem.groupBy("l_orderkey").agg(cell(new, "O").alias("a1"), cell(new, "F").alias("b1"), cell(~new, "O").alias("a0"), cell(~new, "F").alias("b0"))
    whole = F.expr("a1 + b1 + a0 + b0").isNotNull()
    return cells.agg(F.count("*").alias("n_cases"), F.count_if(whole).alias("n_complete"), F.sum(F.expr("(b1 - a1) - (b0 - a0)")).alias("interaction"))


@query("agg_59_stop_reasons", "SELECT o_orderpriority AS stop_reason, o_orderstatus AS verdict, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    return t.orders.groupBy(F.col("o_orderpriority").alias("stop_reason"), F.col("o_orderstatus").alias("verdict")).agg(F.count("*").alias("n"))
