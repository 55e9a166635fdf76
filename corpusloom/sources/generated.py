"""Rows that are made by rules and hashes instead of being read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.registry import query


def hash_number(text: Column, first: int, modulus: int) -> Column:
    """A number below ``modulus`` from seven hex digits of SHA-256, beginning at ``first``."""
    return F.conv(F.substring(F.sha2(text, 256), first, 7), 16, 10).cast("long") % modulus


def synthetic_days(spark: SparkSession, namespace: str, n: int, start: str = "1950-01-01", span: int = 36524) -> DataFrame:
    """(sequence, day, hour): rows that depend on nothing but the namespace and their number."""
    key = F.concat_ws("|", F.lit(namespace), F.col("id").cast("string"))
    return spark.range(n).select(F.col("id").alias("sequence"), F.date_add(F.lit(start).cast("date"), hash_number(key, 1, span).cast("int")).alias("day"), hash_number(key, 9, 24).alias("hour"))


def constrained_days(spark: SparkSession, namespace: str, n: int, attempts: int, wanted: Column) -> DataFrame:
    """For each sequence number the first attempt, of a fixed number, for which ``wanted`` holds."""
    tries = spark.range(n).select(F.col("id").alias("sequence"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    key = F.concat_ws("|", F.lit(namespace), F.col("sequence").cast("string"), F.col("attempt").cast("string"))
    days = tries.select("sequence", "attempt", F.date_add(F.lit("1950-01-01").cast("date"), hash_number(key, 1, 36524).cast("int")).alias("day"))
    return days.where(wanted).groupBy("sequence").agg(F.min(F.struct("attempt", "day")).alias("x")).select("sequence", "x.*")


def unique_days(spark: SparkSession, namespace: str, n: int, attempts: int, wanted: Column) -> DataFrame:
    """As :func:`constrained_days`, no day given twice: in rounds the lowest sequence number keeps a day, others go on.

    A loser's next attempt is the first one after those that it tried; rounds end when
    no day is shared. All rounds look at the same rows, so the result is determined.
    """
    from corpusloom.operators.leakage import _checkpoint

    tries = spark.range(n).select(F.col("id").alias("sequence"), F.explode(F.sequence(F.lit(0), F.lit(attempts - 1))).alias("attempt"))
    key = F.concat_ws("|", F.lit(namespace), F.col("sequence").cast("string"), F.col("attempt").cast("string"))
    days = tries.select("sequence", "attempt", F.date_add(F.lit("1950-01-01").cast("date"), hash_number(key, 1, 36524).cast("int")).alias("day")).where(wanted)
    left, kept = _checkpoint(days), None
    while True:
        first = left.groupBy("sequence").agg(F.min(F.struct("attempt", "day")).alias("x")).select("sequence", "x.*")
        own = first.groupBy("day").agg(F.min(F.struct("sequence", "attempt")).alias("x")).select("x.sequence", "x.attempt", "day")
        kept = _checkpoint(own if kept is None else kept.unionByName(own))
        left = _checkpoint(left.join(kept, "sequence", "left_anti").join(kept.select("day"), "day", "left_anti"))
        if left.isEmpty():
            return kept


_KEY = "'demo|' || i"
_NUM = "('0x' || substring(sha256({k}), {a}, 7))::BIGINT"


@query("src_29_synthetic_days", f"SELECT i AS sequence, DATE '1950-01-01' + ({_NUM.format(k=_KEY, a=1)} % 36524)::INT AS day, {_NUM.format(k=_KEY, a=9)} % 24 AS hour FROM generate_series(0, 499) g(i)")
def _(t):
    return synthetic_days(t.spark, "demo", 500)


_TRY = "'rule|' || i || '|' || a"


@query("src_30_constrained_days", f"""
WITH d AS (SELECT i, a, DATE '1950-01-01' + ({_NUM.format(k=_TRY, a=1)} % 36524)::INT AS day FROM generate_series(0, 99) g(i), generate_series(0, 39) h(a))
SELECT i AS sequence, a::INT AS attempt, day FROM d WHERE dayofweek(day) = 0 QUALIFY row_number() OVER (PARTITION BY i ORDER BY a) = 1""")
def _(t):
    return constrained_days(t.spark, "rule", 100, 40, F.dayofweek("day") == 1)


@query("src_30_unique_days")
def _(t):
    return unique_days(t.spark, "rule", 100, 40, F.dayofweek("day") == 1)
