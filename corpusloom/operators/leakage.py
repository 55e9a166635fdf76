"""Groups of rows that share keys, and splits that no group crosses."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ranking import first_of_each, stable_rank
from corpusloom.operators.spread import join_spread
from corpusloom.plans.scratch import Scratch
from corpusloom.registry import query


def _checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder that the cluster shares; only a local session that names none gets one of its own."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def _with_least(near: DataFrame, total: int) -> DataFrame:
    """Neighbours (a, b) with ``m``, the smallest of a and its neighbours; those of a hub are dealt to many tasks."""
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("held"))
    return join_spread(near, least, "a", "held", total, "b").drop("held")


def _contract(links: DataFrame) -> DataFrame:
    """(node, root) of links (a, b): the smallest node that they lead to.

    Two steps take turns. Each node's larger neighbours are tied to the smallest one
    around it; then each node's smaller ones are. Neither adds links, both keep what is
    connected, and in the end every node hangs on its root alone. A round is written,
    the one before it deleted, and only two numbers of each come to the driver.
    """
    held = Scratch(links.sparkSession)
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = held.keep(edges, "links"), None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if now == before:
            break
        before, total = now, 2 * now["n"]
        near = _with_least(edges.union(edges.select("b", "a")), total)
        large = near.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large, total)
        tied = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b")))
        last, held = held, Scratch(links.sparkSession)
        edges = held.keep(tied.where("a <> b").distinct(), "links")
        last.discard()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def key_components(rows: DataFrame, record: str, key: str) -> DataFrame:
    """(record, root): records that share keys, directly or through others, have one root, the smallest of them.

    Each key ties its records to its smallest one, so a key of m records makes m links,
    not pairs; a key that many records have is dealt to many tasks. The links are then
    contracted to stars. Records without a key are their own root, and null records are
    left out. The last round's table stays in the shared folder.
    """
    total = rows.count()
    edges = rows.select(F.col(record).alias("r"), F.col(key).alias("k")).where("r IS NOT NULL").distinct()
    keyed = edges.where("k IS NOT NULL")
    least = keyed.groupBy("k").agg(F.min("r").alias("m"), F.count("*").alias("held"))
    links = join_spread(keyed, least, "k", "held", total, "r").where("r <> m").select(F.col("r").alias("a"), F.col("m").alias("b"))
    found = _contract(links)
    return edges.select("r").distinct().join(found, F.col("r") == F.col("node"), "left").select(F.col("r").alias(record), F.coalesce("root", "r").alias("root"))


def component_ids(components: DataFrame, record: str) -> DataFrame:
    """(root, component_id, size): SHA-256 of the sorted members, one to a line.

    This digest needs a component's members together, so it is for components that a
    task holds; component_digests names any component without that.
    """
    members = F.array_sort(F.collect_list(F.col(record).cast("string")))
    return components.groupBy("root").agg(F.sha2(F.array_join(members, "\n"), 256).alias("component_id"), F.count("*").alias("size"))


#: Hexadecimal digits of a member's digest that one sum takes; sums of 10**20 members fit a decimal.
_DIGITS = 15


def component_digests(components: DataFrame, record: str) -> DataFrame:
    """(root, component_id, size): a digest of a component's members in no order.

    Four numbers of 60 bits of each member's SHA-256 are summed, and the sums and the
    number of members hashed. Sums are added up where the rows are, so members never
    meet, whatever the component's size. Components of the same members, and (but for
    chance) only those, have one id.
    """
    own = F.sha2(F.col(record).cast("string"), 256)
    part = lambda i: F.conv(F.substring(own, i * _DIGITS + 1, _DIGITS), 16, 10).cast("decimal(20,0)")
    sums = components.groupBy("root").agg(*(F.sum(part(i)).alias(f"_{i}") for i in range(4)), F.count("*").alias("size"))
    told = F.concat_ws(",", *(F.col(f"_{i}").cast("string") for i in range(4)), F.col("size").cast("string"))
    return sums.select("root", F.sha2(told, 256).alias("component_id"), "size")


def _keys(t):
    """Documents with the keys that tie them: their text, and the customer of a hashed order."""
    docs = t.documents.select("doc_id", "source", "lang", "text")
    text = docs.select("doc_id", F.sha2("text", 256).alias("k"))
    start = docs.select("doc_id", F.sha2(F.concat(F.lit("start:"), F.substring("text", 1, 80)), 256).alias("k"))
    return text.union(start)


_COMPONENTS = """
WITH RECURSIVE keys AS (SELECT doc_id, sha256(text) AS k FROM documents UNION SELECT doc_id, sha256('start:' || substring(text, 1, 80)) FROM documents),
links AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM keys a JOIN keys b USING (k)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a)
"""


@query("agg_34_components", _COMPONENTS + """, parts AS (SELECT root, sha256(doc_id::VARCHAR) AS h FROM comp),
sums AS (SELECT root, count(*) AS size, """ + ", ".join(f"sum(('0x' || substring(h, {15 * i + 1}, 15))::HUGEINT)::VARCHAR AS s{i}" for i in range(4)) + """ FROM parts GROUP BY root)
SELECT sha256(concat_ws(',', s0, s1, s2, s3, size)) AS component_id, size FROM sums""")
def _(t):
    return component_digests(key_components(_keys(t), "doc_id", "k"), "doc_id").select("component_id", "size")


@query("agg_34_sorted_ids", _COMPONENTS + "SELECT sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS component_id, count(*) AS size FROM comp GROUP BY root")
def _(t):
    return component_ids(key_components(_keys(t), "doc_id", "k"), "doc_id").select("component_id", "size")


@query("agg_35_axis_patterns", _COMPONENTS + ", p AS (SELECT root, string_agg(DISTINCT lang, '+' ORDER BY lang) AS axes FROM comp JOIN documents USING (doc_id) GROUP BY root) SELECT axes, count(*) AS n FROM p GROUP BY axes")
def _(t):
    own = key_components(_keys(t), "doc_id", "k").join(t.documents.select("doc_id", "lang"), "doc_id")
    return own.groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("lang")), "+").alias("axes")).groupBy("axes").agg(F.count("*").alias("n"))


@query("win_17_safe_split", _COMPONENTS + """, c AS (SELECT doc_id, root, source FROM comp JOIN documents USING (doc_id)), held AS (SELECT DISTINCT root FROM c WHERE source = 'src4')
SELECT doc_id, CASE WHEN source = 'src4' THEN 'holdout' WHEN root IN (SELECT root FROM held) THEN 'blocked' ELSE 'train' END AS split FROM c""")
def _(t):
    return leakage_safe_split(t.documents, key_components(_keys(t), "doc_id", "k"), "source", ["src4"]).select("doc_id", "split")


def leakage_safe_split(docs: DataFrame, components: DataFrame, field: str, held: Sequence[str], record: str = "doc_id") -> DataFrame:
    """Rows of the held values are the holdout; other rows of their components are blocked; the rest trains.

    A component is judged by one number, which goes back to its rows; those of a large
    one are dealt to many tasks.
    """
    rows = docs.join(components, record)
    own = F.coalesce(F.col(field).isin(*held), F.lit(False))
    judged = rows.groupBy("root").agg(F.max(own.cast("int")).alias("_held"), F.count("*").alias("_size"))
    split = F.when(own, "holdout").when(F.col("_held") == 1, "blocked").otherwise("train")
    return join_spread(rows, judged, "root", "_size", docs.count(), record).withColumn("split", split).drop("_held", "_size")


@query("win_17_split_overlap", _COMPONENTS + """, c AS (SELECT root, bool_or(source = 'src4') AND bool_or(source <> 'src4') AS crosses, bool_and(source = 'src4') AS held FROM comp JOIN documents USING (doc_id) GROUP BY root)
SELECT 0::BIGINT AS n_crossing, count(*) FILTER (crosses) AS n_crossing_by_source, count(*) FILTER (crosses OR held) AS n_held, count(*) FILTER (NOT crosses AND NOT held) AS n_train FROM c""")
def _(t):
    """Components whose documents two splits share: none of the safe split, and those of a split by source alone."""
    split = leakage_safe_split(t.documents, key_components(_keys(t), "doc_id", "k"), "source", ["src4"])
    some = lambda name: F.max(F.when(F.col("split") == name, 1).otherwise(0)).cast("long")
    kinds = split.groupBy("root").agg(some("holdout").alias("h"), some("train").alias("t"), some("blocked").alias("b"))
    return kinds.agg(F.sum(F.col("h") * F.col("t")).alias("n_crossing"), F.sum(F.col("h") * F.greatest("t", "b")).alias("n_crossing_by_source"), F.sum("h").alias("n_held"), F.sum("t").alias("n_train"))


@query("win_17_eval_components", _COMPONENTS + "SELECT doc_id FROM (SELECT doc_id, root FROM comp QUALIFY row_number() OVER (PARTITION BY root ORDER BY sha256('eval|' || doc_id)) = 1) ORDER BY sha256('pick|' || doc_id) LIMIT 40")
def _(t):
    rows = key_components(_keys(t), "doc_id", "k").withColumn("h", stable_rank("eval", "doc_id"))
    return first_of_each(rows, ["root"], ["h"]).orderBy(stable_rank("pick", "doc_id")).limit(40).select("doc_id")


def join_pairs(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of undirected pairs: the smallest node that they lead to. Each pair is a key of its two ends."""
    ends = pairs.select(F.xxhash64(a, b).alias("k"), F.explode(F.array(a, b)).alias("node"))
    return key_components(ends, "node", "k")


@query("agg_36_union_find", """
WITH RECURSIVE p AS (SELECT DISTINCT s_nationkey AS a, c_nationkey AS b FROM supplier JOIN customer ON s_suppkey = c_custkey WHERE s_acctbal > c_acctbal), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p UNION SELECT a, a FROM p UNION SELECT b, b FROM p),
reach(x, y) AS (SELECT a, b FROM e UNION SELECT r.x, e.b FROM reach r JOIN e ON r.y = e.a) SELECT x AS node, min(y) AS root FROM reach GROUP BY x""")
def _(t):
    """Nations tied by a supplier and the customer of its number, where the supplier has more on its account."""
    own = t.supplier.join(t.customer, F.col("s_suppkey") == F.col("c_custkey")).where("s_acctbal > c_acctbal")
    return join_pairs(own.select("s_nationkey", "c_nationkey").distinct(), "s_nationkey", "c_nationkey")
