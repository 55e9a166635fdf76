"""Set algebra over keys of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.registry import query


def overlap_size(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: distinct rows that both sides have."""
    return left.intersect(right).agg(F.count("*").alias("n_both"))


def subset_report(small: DataFrame, large: DataFrame) -> DataFrame:
    """One row: rows of the small side that the large one lacks, and whether it is a strict subset."""
    missing = small.distinct().exceptAll(large.distinct()).agg(F.count("*").alias("n_missing"))
    sizes = small.distinct().agg(F.count("*").alias("n_small")).crossJoin(large.distinct().agg(F.count("*").alias("n_large")))
    return missing.crossJoin(sizes).select("n_missing", ((F.col("n_missing") == 0) & (F.col("n_small") < F.col("n_large"))).alias("strict"))


def difference_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows, with their multiplicity, that one side has more often than the other."""
    a = left.exceptAll(right).agg(F.count("*").alias("n_left_only"))
    return a.crossJoin(right.exceptAll(left).agg(F.count("*").alias("n_right_only")))


def stable_facts(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """For each key the fields on which all of its alternatives agree; others are null."""
    agree = [F.when((F.count_distinct(f) == 1) & (F.count(f) == F.count("*")), F.min(f)).alias(f) for f in fields]
    return df.groupBy(key).agg(*agree)


@query("set_01_overlap", "SELECT count(*) AS n_both FROM (SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE source = 'src0')")
def _(t):
    return overlap_size(t.documents.where("lang = 'en'").select("text"), t.documents.where("source = 'src0'").select("text"))


@query("set_02_split_overlap", "SELECT count(*) AS n_both FROM (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT sha256(text) FROM documents WHERE doc_id % 2 = 1)")
def _(t):
    h = t.documents.select("doc_id", F.sha2("text", 256).alias("h"))
    return overlap_size(h.where("doc_id % 2 = 0").select("h"), h.where("doc_id % 2 = 1").select("h"))


@query("set_03_strict_subset", "SELECT (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) AS n_missing, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) = 0 AND (SELECT count(DISTINCT doc_id) FROM labels) < (SELECT count(DISTINCT doc_id) FROM documents) AS strict")
def _(t):
    return subset_report(t.labels.select("doc_id"), t.documents.select("doc_id"))


@query("set_04_equality", "SELECT (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT ALL SELECT o_orderkey FROM orders)) AS n_left_only, (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT ALL SELECT l_orderkey FROM lineitem)) AS n_right_only")
def _(t):
    return difference_counts(t.lineitem.select(F.col("l_orderkey").alias("k")), t.orders.select(F.col("o_orderkey").alias("k")))


@query("set_05_undecided", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic IS NOT NULL)")
def _(t):
    return t.documents.join(t.labels.where("toxic IS NOT NULL"), "doc_id", "left_anti").select("doc_id")


@query("set_06_union", "SELECT axis, count(*) AS n FROM (SELECT 'customer' AS axis FROM customer UNION ALL SELECT 'supplier' FROM supplier) GROUP BY axis")
def _(t):
    both = t.customer.select(F.lit("customer").alias("axis"), F.col("c_acctbal").alias("v")).unionByName(t.supplier.select(F.col("s_acctbal").alias("v"), F.lit("supplier").alias("axis")))
    return both.groupBy("axis").agg(F.count("*").alias("n"))


@query("set_07_array_difference", "SELECT user_id, array_to_string(list_sort(list_filter(['click', 'purchase', 'error', 'signup', 'view', 'refund'], lambda x: NOT list_contains(have, x))), ',') AS missing FROM (SELECT user_id, list(DISTINCT event_type) AS have FROM events GROUP BY user_id)")
def _(t):
    wanted = F.array(*map(F.lit, ("click", "purchase", "error", "signup", "view", "refund")))
    have = t.events.groupBy("user_id").agg(F.collect_set("event_type").alias("have"))
    return have.select("user_id", F.array_join(F.array_sort(F.array_except(wanted, "have")), ",").alias("missing"))


@query("set_08_stable_facts", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) END AS l_returnflag, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS l_linestatus FROM lineitem GROUP BY 1")
def _(t):
    return stable_facts(t.lineitem, "l_orderkey", ["l_returnflag", "l_linestatus"])
