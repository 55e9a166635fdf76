"""Joins: keyed, completeness checks, paired arms, as-of, range, band and similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.spread import join_spread
from corpusloom.registry import query


def hashed_lookup(raw: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``raw`` whose SHA-256 of a column is in ``wanted`` (h, ...)."""
    return raw.withColumn("h", F.sha2(F.col(column).cast("string"), 256)).join(wanted, "h")


def completeness(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: keys on both sides, on the left only, and on the right only."""
    sides = left.select(*keys, F.lit(1).alias("l")).join(right.select(*keys, F.lit(1).alias("r")), list(keys), "full_outer")
    return sides.agg(
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("n_both"), F.count_if(F.col("r").isNull()).alias("n_left"), F.count_if(F.col("l").isNull()).alias("n_right")
    )


def field_conflicts(left: DataFrame, right: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row: matched keys, missing ones, and for each field the keys whose values differ."""
    both = left.alias("l").join(right.alias("r"), list(keys), "left")
    found = F.col(f"r.{fields[0]}").isNotNull()
    return both.agg(
        F.count_if(found).alias("n_matched"), F.count_if(~found).alias("n_missing"),
        *(F.count_if(found & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))).alias(f"n_{f}") for f in fields),
    )


def outcome(before: Column, after: Column) -> Column:
    """What a verdict became; a null verdict can't be scored."""
    return (
        F.when(before.isNull() | after.isNull(), "unscorable_pair").when(before & after, "both_pass").when(~before & ~after, "both_fail").when(after, "improved").otherwise("regressed")
    )


def paired_outcomes(left: DataFrame, right: DataFrame, key: Sequence[str], verdict: str, group: Sequence[str] = ()) -> DataFrame:
    """Outcomes of two arms' verdicts by case, counted by group; cases of one arm only don't pair."""
    both = left.alias("l").join(right.alias("r"), list(key))
    rows = both.select(*(F.col(f"l.{g}").alias(g) if g not in key else F.col(g) for g in group), outcome(F.col(f"l.{verdict}"), F.col(f"r.{verdict}")).alias("outcome"))
    return rows.groupBy(*group, "outcome").agg(F.count("*").alias("n"))


def transitions(left: DataFrame, right: DataFrame, key: Sequence[str], state: str, states: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """One row for each group: how often each state became each other, zero where never."""
    both = left.alias("l").join(right.alias("r"), list(key))
    rows = both.select(*(F.col(f"l.{g}").alias(g) if g not in key else F.col(g) for g in group), F.concat_ws("_to_", f"l.{state}", f"r.{state}").alias("change"))
    names = [f"{a}_to_{b}" for a in states for b in states]
    return rows.groupBy(*group).pivot("change", names).agg(F.count(F.lit(1))).na.fill(0, names)


def as_of(events: DataFrame, boundaries: DataFrame, time: str, at: str, by: Sequence[str] = (), values: Sequence[str] = ()) -> DataFrame:
    """Each event with the latest boundary at or before it, and that boundary's values.

    Both sides are put in one order by key and time, boundaries first on ties, and the
    last boundary is carried along. Without a key there is one order over all rows;
    :func:`as_of_bucketed` deals it by days.
    """
    found = F.struct(F.col(at).alias(at), *(F.col(v).alias(v) for v in values))
    left = events.withColumns({"_at": F.col(time), "_side": F.lit(1), "_b": F.lit(None).cast(boundaries.select(found.alias("b")).schema[0].dataType)})
    right = boundaries.select(*by, F.col(at).alias("_at"), F.lit(0).alias("_side"), found.alias("_b"))
    both = left.unionByName(right, allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    carried = both.withColumn("_b", F.last("_b", ignorenulls=True).over(order)).where("_side = 1")
    return carried.select(*events.columns, *(F.col(f"_b.{c}").alias(c) for c in (at, *values)))


def as_of_bucketed(events: DataFrame, boundaries: DataFrame, time: str, at: str, values: Sequence[str] = ()) -> DataFrame:
    """As-of join without a key, by days: no task sees more than a day's rows.

    A day's events look at the day's boundaries and at the last one before the day,
    which a small table of days with boundaries gives.
    """
    day = lambda c: F.date_trunc("day", F.col(c)).cast("date")
    b = boundaries.select(day(at).alias("_day"), F.col(at).alias(at), *(F.col(v).alias(v) for v in values))
    last = b.groupBy("_day").agg(F.max(F.struct(at, *values)).alias("_last"))
    days = events.select(day(time).alias("_day")).union(b.select("_day")).distinct().join(last, "_day", "left")
    before = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row for each day
    days = days.select("_day", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    start = days.where("_before IS NOT NULL").select("_day", *(F.col(f"_before.{c}").alias(c) for c in (at, *values)))
    every = b.unionByName(start)
    return as_of(events.withColumn("_day", day(time)), every, time, at, ["_day"], values).drop("_day")


def range_join(spans: DataFrame, points: DataFrame, start: str, end: str, at: str, bucket: str = "1 day") -> DataFrame:
    """Pairs of a span and each point within it, both ends included.

    A span is put in all buckets that it touches, so the join is by equal buckets.
    """
    seconds = F.expr(f"unix_seconds(timestamp '1970-01-01 00:00:00 UTC' + interval {bucket})")
    number = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / seconds)
    left = spans.withColumn("_bucket", F.explode(F.sequence(number(start), number(end))))
    right = points.withColumn("_bucket", number(at))
    return left.join(right, "_bucket").where(F.col(at).between(F.col(start), F.col(end))).drop("_bucket")


def band_join(left: DataFrame, right: DataFrame, a: str, b: str, seconds: int) -> DataFrame:
    """Pairs of times at most so many seconds apart, by equal or neighbouring buckets."""
    number = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (seconds * 1_000_000))
    near = left.withColumn("_bucket", F.explode(F.array(number(a) - 1, number(a), number(a) + 1)))
    gap = F.abs(F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp")))
    return near.join(right.withColumn("_bucket", number(b)), "_bucket").where(gap <= seconds * 1_000_000).drop("_bucket")


def pair_lookup(pairs: DataFrame, table: DataFrame, x: str, y: str) -> DataFrame:
    """Join on an unordered pair: ``table`` has (low, high, ...)."""
    return pairs.withColumns({"low": F.least(x, y), "high": F.greatest(x, y)}).join(table, ["low", "high"], "left").drop("low", "high")


@query("jon_01_hashed_lookup", "SELECT c_custkey, sha256(c_name) AS h FROM customer JOIN (SELECT DISTINCT sha256('Customer#' || lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0')) AS h FROM nation) w ON sha256(c_name) = w.h")
def _(t):
    wanted = t.nation.select(F.sha2(F.concat(F.lit("Customer#"), F.lpad((F.col("n_nationkey") * 3).cast("string"), 9, "0")), 256).alias("h")).distinct()
    return hashed_lookup(t.customer, "c_name", wanted).select("c_custkey", "h")


@query("jon_02_three_way", "SELECT count(*) AS n, count(*) FILTER (c_nationkey = n_nationkey) AS n_equal FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("c_nationkey") == F.col("n_nationkey")).alias("n_equal"))


@query("jon_03_manifest_check", """
SELECT count(*) FILTER (length(text) >= 300) AS n_matched, count(*) FILTER (length(text) < 300) AS n_missing, count(*) FILTER (length(text) >= 300 AND contains(text, chr(10))) AS n_h FROM documents""")
def _(t):
    """A manifest of all texts against the records of those that aren't short, whose line ends have changed."""
    manifest = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    records = t.documents.where(F.length("text") >= 300).select("doc_id", F.sha2(F.replace("text", F.lit("\n"), F.lit("\r\n")), 256).alias("h"))
    return field_conflicts(manifest, records, ["doc_id"], ["h"])


@query("jon_04_completeness", "SELECT count(d.doc_id) FILTER (l.doc_id IS NOT NULL) AS n_both, count(d.doc_id) FILTER (l.doc_id IS NULL) AS n_left, count(l.doc_id) FILTER (d.doc_id IS NULL) AS n_right FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def _(t):
    return completeness(t.documents, t.labels, ["doc_id"])


@query("jon_05_by_ordinal", """
WITH a AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS o, source FROM documents), b AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS o, source FROM documents)
SELECT a.source, count(*) AS n, count(*) FILTER (a.doc_id = b.doc_id) AS n_same FROM a JOIN b USING (source, o) GROUP BY a.source""")
def _(t):
    own = Window.partitionBy("source")
    a = t.documents.select("source", F.col("doc_id").alias("x"), F.row_number().over(own.orderBy("doc_id")).alias("o"))
    b = t.documents.select("source", F.col("doc_id").alias("y"), F.row_number().over(own.orderBy(F.desc("doc_id"))).alias("o"))
    return a.join(b, ["source", "o"]).groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("x") == F.col("y")).alias("n_same"))


@query("jon_06_exclusion", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t.documents.join(t.labels.where("toxic = 1"), "doc_id", "left_anti").select("doc_id")


@query("jon_07_single_axis", """
WITH g AS (SELECT sha256(text) AS h, count(DISTINCT source) AS n FROM documents GROUP BY 1), blocked AS (SELECT DISTINCT sha256(text) AS h FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)
SELECT doc_id FROM documents JOIN g ON sha256(text) = g.h WHERE n = 1 AND h NOT IN (SELECT h FROM blocked)""")
def _(t):
    rows = t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h"))
    single = rows.groupBy("h").agg(F.count_distinct("source").alias("n")).where("n = 1")
    blocked = rows.join(t.labels.where("toxic = 1"), "doc_id").select("h")
    return rows.join(single, "h", "left_semi").join(blocked, "h", "left_anti").select("doc_id")


@query("jon_08_hash_overlap", "SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src0') AND source <> 'src0'")
def _(t):
    sealed = t.documents.where("source = 'src0'").select(F.sha2("text", 256).alias("h"))
    return t.documents.where("source <> 'src0'").withColumn("h", F.sha2("text", 256)).join(sealed, "h", "left_semi").select("doc_id")


def _arms(t):
    """Two arms of verdicts by order: its price against one threshold, and a lowered price against another."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    left = rows.withColumn("ok", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None).cast("boolean")).otherwise(F.col("o_totalprice") > 150000))
    right = rows.withColumn("ok", F.col("o_totalprice") - F.col("o_custkey") % 50 * 2000 > 120000)
    return left, right


_ARMS_SQL = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_totalprice > 150000 END AS a, o_totalprice - o_custkey % 50 * 2000 > 120000 AS b FROM orders"


@query("jon_09_paired", f"""
SELECT CASE WHEN a AND b THEN 'both_pass' WHEN NOT a AND NOT b THEN 'both_fail' WHEN b THEN 'improved' ELSE 'regressed' END AS outcome, count(*) AS n FROM ({_ARMS_SQL}) WHERE a IS NOT NULL GROUP BY 1""")
def _(t):
    left, right = _arms(t)
    return paired_outcomes(left.where("ok IS NOT NULL"), right, ["o_orderkey"], "ok")


@query("jon_10_tri_state", f"""
SELECT o_orderstatus, CASE WHEN a IS NULL OR b IS NULL THEN 'unscorable_pair' WHEN a AND b THEN 'both_pass' WHEN NOT a AND NOT b THEN 'both_fail' WHEN b THEN 'improved' ELSE 'regressed' END AS outcome, count(*) AS n FROM ({_ARMS_SQL}) GROUP BY ALL""")
def _(t):
    left, right = _arms(t)
    return paired_outcomes(left, right, ["o_orderkey"], "ok", ["o_orderstatus"])


def _states(df):
    return df.withColumn("state", F.when(F.col("ok").isNull(), "none").when(F.col("ok"), "pass").otherwise("fail"))


@query("jon_11_transitions", f"""
WITH s AS (SELECT o_orderstatus, CASE WHEN a IS NULL THEN 'none' WHEN a THEN 'pass' ELSE 'fail' END AS a, CASE WHEN b THEN 'pass' ELSE 'fail' END AS b FROM ({_ARMS_SQL}))
SELECT o_orderstatus, {", ".join(f"count(*) FILTER (a = '{a}' AND b = '{b}') AS {a}_to_{b}" for a in ("pass", "fail", "none") for b in ("pass", "fail", "none"))} FROM s GROUP BY o_orderstatus""")
def _(t):
    left, right = map(_states, _arms(t))
    return transitions(left, right, ["o_orderkey"], "state", ["pass", "fail", "none"], ["o_orderstatus"])


@query("jon_12_residuals", """
WITH f AS (SELECT o_orderkey, o_orderdate FROM orders), s AS (SELECT l_orderkey, min(l_shipdate) AS shipped FROM lineitem GROUP BY 1)
SELECT count(*) AS n, count(shipped) AS n_matched, max(epoch(shipped - o_orderdate))::DOUBLE AS most, avg(epoch(shipped - o_orderdate)) AS mean FROM f LEFT JOIN s ON o_orderkey = l_orderkey""")
def _(t):
    shipped = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped"))
    rows = t.orders.join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    gap = (F.unix_seconds(F.col("shipped").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))).cast("double")
    return rows.agg(F.count("*").alias("n"), F.count("shipped").alias("n_matched"), F.max(gap).alias("most"), F.avg(gap).alias("mean"))


@query("jon_13_crosscheck", """
WITH x AS (SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' WHEN (d.n_chars > 2000)::INT <> l.quality THEN 'mismatch' ELSE 'match' END AS class FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
SELECT class, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FILTER (r <= 10) AS details FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY doc_id) AS r FROM x) GROUP BY class""")
def _(t):
    kind = F.when(F.col("quality").isNull(), "missing").when((F.col("n_chars") > 2000).cast("int") != F.col("quality"), "mismatch").otherwise("match")
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", kind.alias("class"))
    some = rows.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("doc_id"))).where("r <= 10")
    details = some.groupBy("class").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), ",").alias("details"))
    return rows.groupBy("class").agg(F.count("*").alias("n")).join(details, "class")


@query("jon_14_as_of", """
SELECT e.event_id, b.ts AS at FROM (SELECT * FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts FROM events WHERE event_type = 'purchase') b ON e.user_id = b.user_id AND e.ts >= b.ts""")
def _(t):
    bought = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("at"))
    return as_of(t.events.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), bought, "ts", "at", ["user_id"]).select("event_id", "at")


@query("jon_15_as_of_days", """
SELECT e.event_id, b.ts AS at FROM (SELECT * FROM events WHERE event_type <> 'signup') e ASOF LEFT JOIN (SELECT DISTINCT ts FROM events WHERE event_type = 'signup') b ON e.ts >= b.ts""")
def _(t):
    marks = t.events.where("event_type = 'signup'").select(F.col("ts").alias("at")).distinct()
    return as_of_bucketed(t.events.where("event_type <> 'signup'").select("event_id", "ts"), marks, "ts", "at").select("event_id", "at")


@query("jon_16_range_join", """
SELECT o_orderkey, count(*) AS n FROM (SELECT o_orderkey, date_trunc('day', o_orderdate) AS s, date_trunc('day', o_orderdate) + INTERVAL 3 DAY AS e FROM orders) JOIN (SELECT l_shipdate FROM lineitem) ON l_shipdate BETWEEN s AND e GROUP BY 1""")
def _(t):
    day = F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz")
    spans = t.orders.select("o_orderkey", day.alias("s"), (day + F.expr("INTERVAL 3 DAY")).alias("e"))
    points = t.lineitem.groupBy("l_shipdate").agg(F.count("*").alias("c"))
    found = range_join(spans.select("s", "e").distinct(), points, "s", "e", "l_shipdate").groupBy("s").agg(F.sum("c").alias("c"))  # equal spans and equal times once each
    return spans.join(found, "s").groupBy("o_orderkey").agg(F.sum("c").alias("n"))


@query("jon_17_band_join", """
SELECT a.event_id, count(*) AS n FROM (SELECT event_id, ts FROM events WHERE event_type = 'purchase') a JOIN (SELECT ts FROM events WHERE event_type = 'error') b ON abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000 GROUP BY 1""")
def _(t):
    a = t.events.where("event_type = 'purchase'").select("event_id", "ts")
    b = t.events.where("event_type = 'error'").select(F.col("ts").alias("other"))
    return band_join(a, b, "ts", "other", 600).groupBy("event_id").agg(F.count("*").alias("n"))


@query("jon_19_small_product", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE length(r_name) % 5 = n_nationkey % 5")
def _(t):
    return t.region.crossJoin(F.broadcast(t.nation)).where(F.length("r_name") % 5 == F.col("n_nationkey") % 5).select("r_name", "n_name")  # fixed tables of 5 and 25 rows


@query("jon_20_unordered_pair", "WITH p AS (SELECT l_orderkey, l_returnflag AS x, l_linestatus AS y FROM lineitem) SELECT kind, count(*) AS n FROM (SELECT CASE WHEN least(x, y) = 'A' AND greatest(x, y) = 'F' THEN 'harm' WHEN least(x, y) = 'N' AND greatest(x, y) = 'O' THEN 'union' ELSE NULL END AS kind FROM p) GROUP BY kind")
def _(t):
    table = t.spark.createDataFrame([("A", "F", "harm"), ("N", "O", "union")], "low string, high string, kind string")
    pairs = t.lineitem.select(F.col("l_returnflag").alias("x"), F.col("l_linestatus").alias("y"))
    return pair_lookup(pairs, table, "x", "y").groupBy("kind").agg(F.count("*").alias("n"))


@query("jon_21_split_overlap", """
WITH k AS (SELECT DISTINCT sha256(text) AS h, (doc_id % 3)::INT AS s FROM documents) SELECT a.s AS left_split, b.s AS right_split, count(*) AS n FROM k a JOIN k b ON a.h = b.h AND a.s < b.s GROUP BY ALL""")
def _(t):
    keys = t.documents.select(F.sha2("text", 256).alias("h"), (F.col("doc_id") % 3).cast("int").alias("s")).distinct()
    splits = keys.groupBy("h").agg(F.array_sort(F.collect_set("s")).alias("s")).where("size(s) > 1")  # three splits at most
    pair = splits.select(F.explode("s").alias("left_split"), "s").select("left_split", F.explode("s").alias("right_split")).where("left_split < right_split")
    return pair.groupBy("left_split", "right_split").agg(F.count("*").alias("n"))


@query("jon_22_overlap_flags", """
SELECT doc_id, sha256(text) IN (SELECT sha256(text) FROM documents WHERE source = 'src1') AS same_text, substring(text, 1, 40) IN (SELECT substring(text, 1, 40) FROM documents WHERE source = 'src1') AS same_start FROM documents WHERE source <> 'src1'""")
def _(t):
    train = t.documents.where("source = 'src1'")
    texts = train.select(F.sha2("text", 256).alias("h")).distinct().withColumn("x", F.lit(True))
    starts = train.select(F.substring("text", 1, 40).alias("p")).distinct().withColumn("y", F.lit(True))
    dev = t.documents.where("source <> 'src1'").select("doc_id", F.sha2("text", 256).alias("h"), F.substring("text", 1, 40).alias("p"))
    return dev.join(texts, "h", "left").join(starts, "p", "left").select("doc_id", F.coalesce("x", F.lit(False)).alias("same_text"), F.coalesce("y", F.lit(False)).alias("same_start"))


@query("jon_23_field_conflicts", """
SELECT count(l.doc_id) AS n_matched, count(*) FILTER (l.doc_id IS NULL) AS n_missing, count(*) FILTER (length(text) > 3000 AND l.doc_id IS NOT NULL) AS n_text,
    count(*) FILTER (l.quality = 0 AND lang IS DISTINCT FROM 'en') AS n_lang FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def _(t):
    """Documents against a copy of the labelled ones, with long texts cut and those of low quality called English."""
    cut = t.documents.join(t.labels, "doc_id").withColumns({"text": F.substring("text", 1, 3000), "lang": F.when(F.col("quality") == 0, "en").otherwise(F.col("lang"))})
    return field_conflicts(t.documents, cut, ["doc_id"], ["text", "lang"])


@query("jon_24_as_of_quarantine", """
WITH b AS (SELECT DISTINCT ts FROM events WHERE event_type = 'signup'), e AS (SELECT event_id, ts FROM events WHERE event_type = 'error')
SELECT e.event_id, m.ts AS at, EXISTS (SELECT 1 FROM b x WHERE abs(epoch_us(x.ts) - epoch_us(e.ts)) <= 300000000) AS quarantined FROM e ASOF LEFT JOIN b m ON e.ts >= m.ts""")
def _(t):
    marks = t.events.where("event_type = 'signup'").select(F.col("ts").alias("at")).distinct()
    errors = t.events.where("event_type = 'error'").select("event_id", "ts")
    bucket = F.floor(F.unix_micros(F.col("at").cast("timestamp")) / 300_000_000)
    ends = marks.groupBy(bucket.alias("k")).agg(F.min("at").alias("a"), F.max("at").alias("z")).select(F.explode(F.array("a", "z")).alias("mark"))  # if any mark is near, one of these is
    near = band_join(errors, ends, "ts", "mark", 300).select("event_id").distinct().withColumn("q", F.lit(True))
    return as_of_bucketed(errors, marks, "ts", "at").join(near, "event_id", "left").select("event_id", "at", F.coalesce("q", F.lit(False)).alias("quarantined"))


@query("jon_25_interval_excess", "SELECT l_orderkey, l_linenumber, greatest(-30 - (l_quantity - 25) * 2, (l_quantity - 25) * 2 - 30, 0) AS excess FROM lineitem")
def _(t):
    x = (F.col("l_quantity") - 25) * 2
    return t.lineitem.select("l_orderkey", "l_linenumber", F.greatest(-30 - x, x - 30, F.lit(0.0)).alias("excess"))


@query("jon_26_date_check", "SELECT count(*) AS n, count(*) FILTER (s.d IS NULL) AS n_missing, count(*) FILTER (s.d < o.o_orderdate) AS n_early FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS d FROM lineitem GROUP BY 1) s ON o.o_orderkey = s.l_orderkey")
def _(t):
    first = t.lineitem.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("d"))
    rows = t.orders.join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("d").isNull()).alias("n_missing"), F.count_if(F.col("d") < F.col("o_orderdate")).alias("n_early"))


def merge_evidence(rows: DataFrame, keys: Sequence[str], value: str, roles: str, grade: str, order: Sequence[str]) -> DataFrame:
    """One row for each key: all roles, whether values conflict, and the class of highest precedence."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(grade))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_set(roles)).alias("roles"), (F.count_distinct(value) > 1).alias("conflict"), F.min(rank).alias("_rank"))
    return out.withColumn(grade, F.element_at(F.array(*map(F.lit, order)), F.col("_rank").cast("int"))).drop("_rank")


@query("jon_27_merge_evidence", """
SELECT o_custkey, string_agg(DISTINCT o_orderstatus, '+' ORDER BY o_orderstatus) AS roles, count(DISTINCT year(o_orderdate)) > 1 AS conflict, min(o_orderpriority) AS o_orderpriority FROM orders GROUP BY o_custkey""")
def _(t):
    order = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = t.orders.withColumn("y", F.year("o_orderdate"))
    out = merge_evidence(rows, ["o_custkey"], "y", "o_orderstatus", "o_orderpriority", order)
    return out.withColumn("roles", F.array_join("roles", "+"))


@query("jon_28_provider_order", """
WITH a AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events) SELECT count(*) FILTER (nxt < ts) AS n_unordered, count(*) FILTER (nxt::DATE = ts::DATE) AS n_same_day, max(abs(epoch(nxt - ts)))::DOUBLE AS most FROM a""")
def _(t):
    nxt = F.lead("ts").over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = t.events.select("ts", nxt.alias("nxt"))
    gap = F.abs(F.unix_micros(F.col("nxt").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1_000_000
    return rows.agg(F.count_if(F.col("nxt") < F.col("ts")).alias("n_unordered"), F.count_if(F.col("nxt").cast("date") == F.col("ts").cast("date")).alias("n_same_day"), F.max(gap).alias("most"))


@query("jon_29_calendar_check", "SELECT count(*) AS n, count(*) FILTER (dayname(o_orderdate) = 'Sunday') AS n_sunday FROM orders")
def _(t):
    first, last = t.orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    days = t.spark.range(1).select(F.explode(F.sequence(F.lit(first.date()), F.lit(last.date()), F.expr("INTERVAL 1 DAY"))).alias("day"))
    table = days.select("day", (F.dayofweek("day") == 1).alias("sunday"))
    rows = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).join(table, "day", "left")
    return rows.agg(F.count("*").alias("n"), F.count_if("sunday").alias("n_sunday"))


@query("jon_30_equal_inputs", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 <> 0) AS n_equal FROM orders")
def _(t):
    a = t.orders.select("o_orderkey", F.col("o_totalprice").alias("p"))
    b = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")).alias("p"))
    return a.alias("a").join(b.alias("b"), "o_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("a.p").eqNullSafe(F.col("b.p"))).alias("n_equal"))


@query("jon_31_holdout_leakage", """
WITH k AS (SELECT doc_id, source, sha256(substring(text, 1, 60)) AS p, sha256(text) AS c FROM documents)
SELECT count(*) FILTER (p IN (SELECT p FROM k WHERE source = 'src2')) AS n_prompt, count(*) FILTER (c IN (SELECT c FROM k WHERE source = 'src2')) AS n_content FROM k WHERE source <> 'src2'""")
def _(t):
    keys = t.documents.select("source", F.sha2(F.substring("text", 1, 60), 256).alias("p"), F.sha2("text", 256).alias("c"))
    held, train = keys.where("source = 'src2'"), keys.where("source <> 'src2'")
    prompts = held.select("p").distinct().withColumn("x", F.lit(1))
    contents = held.select("c").distinct().withColumn("y", F.lit(1))
    return train.join(prompts, "p", "left").join(contents, "c", "left").agg(F.count("x").alias("n_prompt"), F.count("y").alias("n_content"))
