"""Merkle manifests of folders: leaves are files' bytes, nodes are folders, and only what differs is looked into."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.scratch import new_path
from corpusloom.registry import query

ROOT = ""


def file_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """(path, n_bytes, modified, digest) of all files under a folder, relative to it; bytes are read and hashed in tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    inside = F.substring_index("path", f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    return files.select(inside.alias("path"), F.octet_length("content").cast("long").alias("n_bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("digest"))


def renewed_leaves(spark: SparkSession, folder: str, known: DataFrame) -> DataFrame:
    """file_leaves of the folder as it is now, reading only files whose length or time differs from ``known``; file_leaves reads all, where times can't be trusted."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("n_bytes"), F.col("modificationTime").alias("modified"))
    inside = F.substring_index("path", f"{folder.rstrip('/').rsplit('/', 1)[-1]}/", -1)
    same = listed.withColumn("path", inside).join(known, ["path", "n_bytes", "modified"])
    fresh = file_leaves(spark, folder).join(same.select("path"), "path", "left_anti")
    return same.select("path", "n_bytes", "modified", "digest").unionByName(fresh)


def tree(leaves: DataFrame) -> DataFrame:
    """(path, above, depth, n_files, n_bytes, digest): every file and every folder up to the root, whose path is empty.

    A folder's digest is of its entries' names and digests in the order of their names,
    so it is known from them alone. Levels go up from the deepest; a folder's entries,
    which a listing holds too, meet in one task as short lines.
    """
    name = F.element_at(F.split("path", "/"), -1)
    above = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    level = leaves.select("path", above.alias("above"), F.size(F.split("path", "/")).alias("depth"), F.lit(1).cast("long").alias("n_files"), "n_bytes", "digest")
    every, deepest = level, leaves.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
    for depth in range(deepest, 0, -1):
        here = every.where(F.col("depth") == depth).withColumn("line", F.concat_ws(" ", name, "digest"))
        folders = here.groupBy("above").agg(F.sum("n_files").alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("digest"))
        parent = F.regexp_replace(F.col("above"), "/?[^/]*$", "")
        every = every.union(folders.select(F.col("above").alias("path"), F.when(F.col("above") != ROOT, parent), F.lit(depth - 1), "n_files", "n_bytes", "digest"))
    return every


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) of files that two trees hold differently: changed, added or removed.

    Both are walked from the root; of each level only entries of folders whose digests
    differ are compared.
    """
    spark = old.sparkSession
    deepest = max((t.agg(F.max("depth")).first()[0] or 0) for t in (old, new))
    open_ = spark.createDataFrame([(ROOT,)], "above string")
    found = None
    for depth in range(1, deepest + 1):
        sides = [t.where(F.col("depth") == depth).join(open_, "above", "left_semi").select("path", "above", F.col("digest").alias(d), F.lit(True).alias(h)) for t, d, h in ((old, "a", "in_old"), (new, "b", "in_new"))]
        here = sides[0].join(sides[1].drop("above"), "path", "full").where(~F.col("a").eqNullSafe(F.col("b")))
        change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").otherwise("changed")
        rows = here.select("path", change.alias("change"))
        found = rows if found is None else found.union(rows)
        open_ = here.select(F.col("path").alias("above"))
    if found is None:
        return spark.createDataFrame([], "path string, change string")
    folders = old.select("above").union(new.select("above")).where("above IS NOT NULL").distinct().withColumnRenamed("above", "path")
    return found.join(folders, "path", "left_anti")


def _written(rows: DataFrame, path: str) -> None:
    rows.repartition("lang", "part").sortWithinPartitions("lang", "part", "doc_id").select("lang", "part", "value").write.partitionBy("lang", "part").text(path)


@query("snk_05_merkle", """
WITH lines AS (SELECT lang, doc_id // 5000 AS part, doc_id, doc_id || ' ' || sha256(text) AS line FROM documents),
spoilt AS (SELECT min(doc_id) AS doc_id FROM documents WHERE lang = 'fr')
SELECT 'lang=' || lang || '/part=' || part AS folder, sum(strlen(line) + 1)::BIGINT AS n_bytes, sha256(string_agg(line || chr(10), '' ORDER BY doc_id)) AS digest,
    coalesce(bool_or(doc_id = (SELECT doc_id FROM spoilt)), FALSE) AS found FROM lines GROUP BY lang, part""")
def _(t):
    """Documents' digests written as text by language and block, then one letter of one line spoilt: the manifest names the file."""
    base = new_path(t.spark, "merkle")
    rows = t.documents.select("lang", F.floor(F.col("doc_id") / 5000).alias("part"), "doc_id", F.concat_ws(" ", "doc_id", F.sha2("text", 256)).alias("value"))
    first = t.documents.where("lang = 'fr'").agg(F.min("doc_id")).first()[0]
    _written(rows, f"{base}/one")
    _written(rows.withColumn("value", F.when(F.col("doc_id") == first, F.concat(F.expr("left(value, length(value) - 1)"), F.lit("x"))).otherwise(F.col("value"))), f"{base}/two")
    leaves = [file_leaves(t.spark, f"{base}/{n}").withColumn("path", F.regexp_replace("path", "/part-[^/]*$", "/file")) for n in ("one", "two")]
    gone = differences(*map(tree, leaves)).where("change = 'changed'").select("path", F.lit(True).alias("found"))
    folder = F.regexp_replace("path", "/file$", "").alias("folder")
    return leaves[0].join(gone, "path", "left").select(folder, "n_bytes", "digest", F.coalesce("found", F.lit(False)).alias("found"))
