"""Joins that deal the rows of a common key to many tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that more than one row in SHARE has is dealt to several tasks; fewer than SHARE keys can be.
SHARE = 10_000


def join_spread(rows: DataFrame, other: DataFrame, key: str, held: str, total: int, by: str) -> DataFrame:
    """Inner join of ``rows`` with ``other``, whose column ``held`` says how many of ``rows`` have its key.

    ``total``: the number of ``rows``, or more. Rows of a key that has more than
    total / SHARE of them are dealt by a hash of ``by`` to as many parts as it has such
    shares, and the key's rows in ``other``, which should be few, are repeated for each
    part: that adds fewer than SHARE repetitions in all. The list of these keys, fewer
    than SHARE, is broadcast. A null key joins nothing.
    """
    parts = F.ceil(F.col(held) * SHARE / F.lit(float(max(total, 1)))).cast("long")
    dealt = other.withColumn("_parts", F.greatest(parts, F.lit(1).cast("long")))
    common = dealt.where("_parts > 1").groupBy(key).agg(F.max("_parts").alias("_parts"))
    repeated = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts")
    part = F.when(F.col("_parts").isNull(), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64(by), F.col("_parts")))
    own = rows.join(F.broadcast(common), key, "left").withColumn("_part", part).drop("_parts")
    return own.join(repeated, [key, "_part"]).drop("_part")
