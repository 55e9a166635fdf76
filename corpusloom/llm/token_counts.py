"""Token counts through a digest cache."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import materialise, new_path
from corpusloom.llm._text import chunks, split_words, texts
from corpusloom.operators.spread import join_spread

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"
#: Distinct words that a Python worker remembers.
MEMO_WORDS = 1 << 18


@functools.cache
def _counter(path: str):
    """Counts the tokens of each of a list of texts, as the file's library gives them."""
    if path.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda values: [len(x) for x in own.encode(values, num_threads=1)]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    own.no_truncation()
    own.no_padding()
    return lambda values: [len(x) for x in own.encode_batch_fast(values, add_special_tokens=False)]


@functools.cache
def _memo(path: str) -> dict[str, int]:
    return {}


def splits_at_white_space(path: str) -> bool:
    """Whether no token of the tokenizer spans white space, so that words count apart."""
    if not path.endswith(".json"):
        return False
    import json

    with open(path) as file:
        about = json.load(file)
    pre = about.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    return (
        first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
        and r"[^\s" in str(first.get("pattern")) and r"\s+" not in str(first.get("pattern"))
        and not any(x["lstrip"] or x["rstrip"] or x["single_word"] or not x["special"] for x in about["added_tokens"])
    )


def _count(path: str, by_word: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, memo = _counter(path), _memo(path)
        for batch in chunks(batches, "text"):
            values = texts(batch, "text")
            if by_word:
                offsets, codes, words = split_words(values)
                strings = words.to_pylist()
                fresh = [w for w in strings if w not in memo]
                if len(memo) + len(fresh) > MEMO_WORDS:
                    memo.clear()
                    fresh = strings
                for at in range(0, len(fresh), 4096):
                    part = fresh[at : at + 4096]
                    memo.update(zip(part, count(part)))
                sizes = np.fromiter((memo[w] for w in strings), np.int64, len(strings))
                ends = np.concatenate([[0], np.cumsum(sizes[codes])])
                n = ends[offsets[1:]] - ends[offsets[:-1]]
            else:
                n = np.array(count(values.to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def version(tokenizer: str) -> str:
    """The digest of the tokenizer's file: a changed file has counts of its own."""
    return hashlib.sha256(Path(tokenizer).read_bytes()).hexdigest()


def count_tokens(docs: DataFrame, tokenizer: str, cache: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs`` (doc_id, text).

    ``cache`` is a Parquet table of counts by content digest and tokenizer version,
    made if it's missing. Contents with no count there are encoded once each,
    copies being merged before the shuffle, and appended; the counts are then joined
    by digest, so texts of known content aren't encoded. The rows of a content with many
    copies are dealt to several tasks. Where the tokenizer drops
    white space, runs of it are made one space before the digest, and words are
    counted apart. A null text is empty and has no token. Every row is returned,
    repeated ones and those of null doc_id too; other columns are ignored.
    """
    spark = docs.sparkSession
    by_word = splits_at_white_space(tokenizer)
    tag = version(tokenizer)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    content = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ") if by_word else text
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], CACHE_SCHEMA)
    known = known.where(F.col("tokenizer") == tag).select("digest")
    about = materialise(rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest"), "token-digests")
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    counted = misses.mapInArrow(_count(tokenizer, by_word), "digest binary, n_tokens long")
    counted.select(F.lit(tag).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    counts = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == tag)
    counts = counts.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two writers may have met
    held = about.groupBy("digest").agg(F.count("*").alias("held"))
    return join_spread(about, counts.join(held, "digest"), "digest", "held", about.count(), "doc_id").select("doc_id", "n_bytes", "n_tokens")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty cache of its own, so that every content is encoded."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counted = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
