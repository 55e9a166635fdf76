"""A corpus pipeline: five stages from documents to packed training sequences.

Rejecting toxic documents comes first, since its decision depends on the document
alone; then lines repeated across documents go, then all but one document of each
group of near copies, then documents that hold benchmark passages; what is left is
packed. Every stage reads what its predecessor wrote.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import Scratch, materialise
from corpusloom.llm.decontamination import contaminated, find_contamination
from corpusloom.llm.jaccard_join import jaccard_components
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.packing import pack
from corpusloom.llm.toxicity import THRESHOLD, fit_toxicity, score_toxicity

#: Rows of a list of documents to drop that may be broadcast: two numbers each, 8 MB.
BROADCAST_ROWS = 500_000

#: Near copies: words of a shingle, and the least Jaccard similarity in percent.
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80

_NO_ID = -(1 << 63)


def _bundled(docs: DataFrame) -> DataFrame:
    """doc_id, text, and all columns but the text in ``row``: no name can clash."""
    rest = F.struct(*(docs[c] for c in docs.columns if c != "text"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("row"))


def _restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` in their order."""
    return rows.select(*(F.col("text").cast(docs.schema[c].dataType).alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text aren't in ``gone`` (id, content)."""
    gone = materialise(gone, "dropped")
    small = gone.count() <= BROADCAST_ROWS
    rows = _bundled(docs).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("content"), "text", "row")
    return _restored(rows.join(F.broadcast(gone) if small else gone, ["id", "content"], "left_anti"), docs)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose toxicity reaches the threshold; columns stay.

    The model is fitted on the labelled ones of ``docs``. A null or empty text has the
    bias alone as its score. Repeated rows share a decision; a null doc_id is kept.
    """
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _restored(score_toxicity(_bundled(docs).select("text", "row"), model).where(F.col("toxicity") < THRESHOLD), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop repeated lines; every document stays, with its new text and number of characters.

    Documents that lose no line are returned as they are, null texts too.
    """
    bundled = _bundled(docs)
    out = dedup_lines(bundled.withColumn("row", F.struct(F.col("text").isNull().alias("none"), F.col("row").alias("row"))), carry=("row",))
    changed = F.col("n_dropped") > 0
    out = out.select(F.when(changed | ~F.col("row.none"), F.col("text")).alias("text"), F.col("row.row").alias("row"), changed.alias("changed"))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
        out = out.withColumn("row", F.col("row").withField("n_chars", n_chars))
    return _restored(out, docs)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: that of the smallest doc_id.

    Texts without a word belong to no group and stay. Rows equal in doc_id and text are
    copies too. A document without an id goes if its group has one with an id.
    """
    found = materialise(jaccard_components(_bundled(docs), SHINGLE_WORDS, SIMILAR_PERCENT).where("n_shingles > 0"), "groups")
    place = F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("order"), F.col("content"))
    first = found.groupBy("root").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    gone = found.join(first, "root").where(place != F.col("first"))
    out = _without(docs, gone.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "content").distinct())
    twice = found.groupBy("doc_id", "content").count().where("count > 1")
    if twice.isEmpty():
        return out
    rows = _bundled(out).withColumn("content", F.xxhash64("text"))
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return _restored(rows.where(~worded).unionAll(rows.where(worded).dropDuplicates(["doc_id", "content"])), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which a twentieth or more lies in benchmark windows; columns stay.

    A null or empty text has no word and stays, a null doc_id is no reason to go, and
    repeated rows share a decision. An empty table, or an empty benchmark, drops nothing.
    """
    found = find_contamination(_bundled(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(contaminated()).select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("id"), "content"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece of a document: where it stands in which sequence.

    A null or empty text is one token, a null doc_id stays null, repeated rows are packed
    each, an empty table gives no rows, and no column but doc_id and text is read.
    """
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_lines),
    ("jaccard_join", keep_one_of_each),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can't express the classifier; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents; each one's rows are written and read again, and those of the one before deleted."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        held = Scratch(spark)
        docs = held.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        before.discard()
        before = held
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
