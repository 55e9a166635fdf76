"""Write-once tables, their fingerprints, identities of builds, and checks of what was written."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.ranking import revision_chains
from corpusloom.plans.scratch import new_path
from corpusloom.registry import query


class ContentConflict(ValueError):
    """A path that must be written once holds other rows."""


def fingerprint(df: DataFrame) -> tuple[int, str]:
    """The number of rows and a digest that doesn't depend on their order: repeated rows count.

    Each row gives four 64-bit hashes; their sums, which partial aggregates make in every
    task, are the digest.
    """
    columns = [F.to_json(c) if df.schema[c].dataType.typeName() == "map" else df[c] for c in sorted(df.columns)]
    sums = [F.sum(F.xxhash64(F.lit(k), *columns).cast("decimal(38,0)")).alias(f"s{k}") for k in range(4)]
    row = df.agg(F.count("*").alias("n"), *sums).first()
    return row["n"], hashlib.sha256("|".join(f"{row[f's{k}'] or 0}" for k in range(4)).encode()).hexdigest()


def write_once(df: DataFrame, path: str, form: str = "parquet") -> bool:
    """Write a table to a new path; True if written, False if the path already holds the same rows.

    Spark's commit makes the files appear at once. Other rows raise ContentConflict.
    """
    try:
        there = df.sparkSession.read.format(form).schema(df.schema).load(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        df.write.format(form).mode("errorifexists").save(path)
        return True
    if fingerprint(there) != fingerprint(df):
        raise ContentConflict(path)
    return False


def json_lines(df: DataFrame) -> DataFrame:
    """One canonical JSON text for each row: fields in the order of their names, nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl_once(df: DataFrame, path: str) -> bool:
    return write_once(json_lines(df), path, "text")


def build_identity(config: Mapping, inputs: Mapping[str, str], code: Mapping[str, str]) -> str:
    """``build-`` and twelve hex digits that depend on the configuration, the inputs' and the code's digests."""
    whole = json.dumps({"config": config, "inputs": inputs, "code": code}, sort_keys=True, separators=(",", ":"))
    return "build-" + hashlib.sha256(whole.encode()).hexdigest()[:12]


def artifact_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, n_bytes, sha256) of all files under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.octet_length("content").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def _move(spark: SparkSession, source: str, target: str) -> None:
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    files = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(b):
        raise FileExistsError(target)
    files.mkdirs(b.getParent())
    if not files.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")


def staged_promote(spark: SparkSession, writers: Mapping[str, Callable[[str], None]], staging: str, check: Callable[[str], bool]) -> None:
    """Write all targets to a staging folder, check it, then move each; if one can't be moved, those moved go back."""
    places = {target: f"{staging}/{i}" for i, target in enumerate(writers)}
    for target, write in writers.items():
        write(places[target])
    if not all(map(check, places.values())):
        raise ValueError("a staged table failed its check")
    moved: list[str] = []
    try:
        for target, place in places.items():
            _move(spark, place, target)
            moved.append(target)
    except Exception:
        for target in reversed(moved):
            _move(spark, target, places[target])
        raise


def verify_build(written: DataFrame, recomputed: DataFrame) -> DataFrame:
    """One row: rows only written, and rows only recomputed."""
    a = written.exceptAll(recomputed).agg(F.count("*").alias("n_only_written"))
    return a.crossJoin(recomputed.exceptAll(written).agg(F.count("*").alias("n_only_recomputed")))


def append_decision(df: DataFrame, path: str) -> None:
    """Append decisions (review_id, revision, ...) to a log, partitioned by a hash of the id."""
    df.withColumn("part", F.pmod(F.xxhash64("review_id"), F.lit(16))).write.mode("append").partitionBy("part").parquet(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Append rows as canonical JSON lines; the commit makes all of them appear at once."""
    json_lines(df).write.mode("append").text(path)


def seal(c: Column, key: Column, context: str) -> Column:
    """AES-GCM with a context that opening must repeat."""
    return F.base64(F.aes_encrypt(c, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(context)))


def open_sealed(c: Column, keys: list[Column], context: str) -> Column:
    """The plain text by the first of the keys that fits, newest first; null if none does."""
    tries = [F.try_aes_decrypt(F.unbase64(c), k, F.lit("GCM"), F.lit("DEFAULT"), F.lit(context)).cast("string") for k in keys]
    return F.coalesce(*tries)


@query("snk_01_atomic_json", "SELECT doc_id, lang, n_chars FROM documents")
def _(t):
    """Written as one table of JSON lines, which a second write can't replace, and read back."""
    path = new_path(t.spark, "atomic")
    rows = json_lines(t.documents.select("doc_id", "lang", "n_chars"))
    rows.write.mode("errorifexists").text(path)
    try:
        rows.limit(1).write.mode("errorifexists").text(path)
    except AnalysisException as e:
        if "PATH_ALREADY_EXISTS" not in str(e):
            raise
    return t.spark.read.schema(t.documents.select("doc_id", "lang", "n_chars").schema).json(path)


@query("snk_02_write_once", """
SELECT 'first' AS step, TRUE AS written, FALSE AS conflict, count(*) AS n FROM documents UNION ALL SELECT 'again', FALSE, FALSE, count(*) FROM documents UNION ALL SELECT 'other', FALSE, TRUE, count(*) FROM documents""")
def _(t):
    path, rows = new_path(t.spark, "once"), t.documents.select("doc_id", "lang")
    out = []
    for step, own in (("first", rows), ("again", rows.orderBy("lang")), ("other", rows.where("lang <> 'en'").unionByName(rows.where("lang = 'en'").withColumn("lang", F.lit("xx"))))):
        try:
            out.append((step, write_once(own, path), False))
        except ContentConflict:
            out.append((step, False, True))
    steps = t.spark.createDataFrame(out, "step string, written boolean, conflict boolean")
    return steps.crossJoin(t.spark.read.parquet(path).agg(F.count("*").alias("n")))


@query("snk_07_staged_promote", "SELECT 'public' AS side, lang, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'private', source, count(*) FROM documents GROUP BY source UNION ALL SELECT 'rolled back', 'yes', 1")
def _(t):
    """Two tables are moved together; a second promotion whose last target is taken takes its first one back."""
    base = new_path(t.spark, "promote")
    by = lambda c: t.documents.groupBy(F.col(c).alias("lang")).agg(F.count("*").alias("n"))
    full = lambda place: not t.spark.read.parquet(place).isEmpty()
    public, private, third = f"{base}/public", f"{base}/private", f"{base}/third"
    staged_promote(t.spark, {public: by("lang").write.parquet, private: by("source").write.parquet}, f"{base}/stage", full)
    rolled = "no"
    try:
        staged_promote(t.spark, {third: by("lang").write.parquet, public: by("lang").write.parquet}, f"{base}/stage2", full)
    except FileExistsError:
        try:
            t.spark.read.parquet(third)
        except AnalysisException as e:
            rolled = "yes" if "PATH_NOT_FOUND" in str(e) else str(e)
    sides = [t.spark.read.parquet(path).select(F.lit(name).alias("side"), "lang", "n") for name, path in (("public", public), ("private", private))]
    return sides[0].union(sides[1]).union(t.spark.createDataFrame([("rolled back", rolled, 1)], "side string, lang string, n long"))


@query("snk_10_decision_log", """
SELECT doc_id AS review_id, CASE WHEN length(text) > 3000 THEN 'reject' ELSE 'accept' END AS decision, CASE WHEN length(text) > 3000 THEN 2 ELSE 1 END::BIGINT AS n_revisions, TRUE AS chain_ok FROM documents""")
def _(t):
    """A decision for each document, then another for long ones, appended; the latest counts."""
    path = new_path(t.spark, "decisions")
    first = t.documents.select(F.col("doc_id").alias("review_id"), F.lit(1).alias("revision"), F.lit("accept").alias("decision"), F.lit(None).cast("string").alias("supersedes"))
    again = t.documents.where(F.length("text") > 3000).select(F.col("doc_id").alias("review_id"), F.lit(2).alias("revision"), F.lit("reject").alias("decision"), F.lit("accept").alias("supersedes"))
    for rows in (first, again):
        append_decision(rows, path)
    return revision_chains(t.spark.read.parquet(path), "review_id", "revision", "decision", "supersedes")


@query("snk_11_append_lines", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS part FROM conversations")
def _(t):
    path = new_path(t.spark, "lines")
    for part, test in enumerate((F.col("role") == "user", F.col("role") != "user")):
        append_json_lines(t.conversations.where(test).select("conv_id", "turn", F.lit(part).alias("part")), path)
    return t.spark.read.schema("conv_id long, turn int, part int").json(path)


@query("snk_03_json_lines", "SELECT doc_id, lang FROM documents")
def _(t):
    lines = json_lines(t.documents.select("lang", "doc_id"))
    return lines.select(F.from_json("value", "doc_id long, lang string").alias("r")).select("r.*")


@query("snk_05_artifact_hashes", "SELECT 'documents' AS name, 64 AS n_hex")
def _(t):
    found = artifact_hashes(t.spark, t.path("documents")).agg(F.max(F.length("sha256")).alias("n_hex"))
    return found.select(F.lit("documents").alias("name"), "n_hex")


@query("snk_06_build_identity", "SELECT 18 AS n, TRUE AS stable, TRUE AS sensitive")
def _(t):
    a, b, c = (build_identity({"seed": s}, {"docs": "x"}, {}) for s in (1, 1, 2))
    return t.spark.createDataFrame([(len(a), a == b, a != c)], "n int, stable boolean, sensitive boolean")


@query("snk_08_verify_build", "SELECT 0::BIGINT AS n_only_written, count(*) AS n_only_recomputed FROM documents WHERE lang = 'es'")
def _(t):
    counts = t.documents.select("doc_id", "lang")
    return verify_build(counts.where("lang <> 'es'"), counts)


@query("snk_12_sealed", "SELECT doc_id, lang AS plain, lang <> 'en' AS new_key_fails, TRUE AS wrong_context_fails FROM documents")
def _(t):
    new, old = (F.unhex(F.substring(F.sha2(F.lit(f"key {k} for tests"), 256), 1, 32)) for k in (1, 2))
    rows = t.documents.select("doc_id", seal(F.col("lang"), F.when(F.col("lang") == "en", new).otherwise(old), "row").alias("sealed"))
    tries = {"plain": open_sealed(F.col("sealed"), [new, old], "row"), "new_key_fails": open_sealed(F.col("sealed"), [new], "row").isNull(), "wrong_context_fails": open_sealed(F.col("sealed"), [new, old], "table").isNull()}
    return rows.select("doc_id", *(c.alias(name) for name, c in tries.items()))
