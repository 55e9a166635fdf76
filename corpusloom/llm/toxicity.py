"""Toxicity by FTRL-proximal logistic regression over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._text import chunks, crc_mod, hash_strings, mix, texts

#: Weights are indexed by so many bits; at most 2**BITS of them are broadcast.
BITS = 20
#: Labelled rows that the classifier is fitted on at most, chosen by a hash of the id.
MAX_ROWS = 12_000
THRESHOLD = 0.3
#: Bytes of text whose features a task holds at once.
CHUNK = 4 << 20
#: Code points of a long word's stem, which is a word n-gram feature of its own.
STEM = 5


@dataclass(frozen=True)
class Ftrl:
    """alpha, beta: rates of each coordinate; l1, l2: regularisation; epochs over the rows; rows that a feature needs."""

    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 5.0
    l2: float = 0.0
    epochs: int = 5
    least_rows: int = 3


@dataclass
class Model:
    """Sparse weights: indices of non-zero ones, their values, and the bias."""

    bias: float
    index: np.ndarray = field(repr=False)
    weight: np.ndarray = field(repr=False)


def _features(values: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text, and hashed features with repeats.

    Words are runs of letters, marks and digits, lower-cased. Features: words, stems of
    longer words, pairs of neighbours, and pairs with one word skipped.
    """
    plain = pc.replace_substring_regex(pc.utf8_lower(values), r"[^\pL\pM\pN]+", " ")
    lists = pc.split_pattern(plain, " ")
    owner = np.repeat(np.arange(len(values)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    words = lists.flatten().dictionary_encode()
    full = pc.greater(pc.binary_length(words.dictionary), 0).to_numpy(zero_copy_only=False)
    codes = words.indices.to_numpy()
    keep = full[codes]
    owner, codes = owner[keep], codes[keep]
    long = pc.greater(pc.utf8_length(words.dictionary), STEM).to_numpy(zero_copy_only=False)
    stems = hash_strings(pc.utf8_slice_codeunits(words.dictionary, 0, STEM))
    word = hash_strings(words.dictionary)[codes]
    n = len(word)
    kinds = [(word, owner), (mix(stems, np.full(len(stems), 7, np.uint64))[codes][long[codes]], owner[long[codes]])]
    for skip in (1, 2):
        same = owner[:-skip] == owner[skip:] if n > skip else np.zeros(0, bool)
        pairs = mix(mix(word[:-skip][same], np.full(int(same.sum()), skip, np.uint64)), word[skip:][same]) if n > skip else np.zeros(0, np.uint64)
        kinds.append((pairs, owner[:-skip][same] if n > skip else np.zeros(0, np.int64)))
    rows = np.concatenate([r for _, r in kinds])
    found = (np.concatenate([h for h, _ in kinds]) >> np.uint64(64 - bits)).astype(np.int32)
    return rows, found


def _distinct(rows: np.ndarray, found: np.ndarray, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct features, as offsets and indices."""
    both = np.unique(rows.astype(np.int64) << bits | found)
    offsets = np.searchsorted(both, np.arange(n + 1, dtype=np.int64) << bits)
    return offsets, (both & (1 << bits) - 1).astype(np.int32)


def _featurise(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", CHUNK):
            rows, found = _features(texts(batch, "text"), bits)
            offsets, index = _distinct(rows, found, bits, batch.num_rows)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(index, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("one"), batch.column("rank"), batch.column("label"), lists], names=["one", "rank", "label", "features"])

    return run


def ftrl(features: Iterable[pa.Array], labels: np.ndarray, bits: int, how: Ftrl) -> Model:
    """Fit on binary features, row by row; features of too few rows have no weight."""
    count = np.zeros(1 << bits, np.int32)
    rows = [f.to_numpy() for f in features]  # views, without copies
    for f in rows:
        count[f] += 1
    rows = [f[count[f] >= how.least_rows] for f in rows]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias = np.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5)) if len(labels) else 0.0
    bias_n = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) <= how.l1, 0.0, (np.sign(own) * how.l1 - own) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2))

    for _ in range(how.epochs):
        for f, y in zip(rows, labels.tolist()):
            w = weights(f)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
            g = p - y
            bias_n += g * g
            bias -= 0.05 * g / (1 + np.sqrt(bias_n))
            sigma = (np.sqrt(n[f] + g * g) - np.sqrt(n[f])) / how.alpha
            z[f] += g - sigma * w
            n[f] += g * g
    used = np.flatnonzero(n)
    w = weights(used)
    return Model(float(bias), used[w != 0].astype(np.int32), w[w != 0].astype(np.float32))


def _fit(bits: int, how: Ftrl):
    def run(table: pa.Table) -> pa.Table:
        table = table.select(["rank", "label", "features"]).sort_by([("rank", "ascending"), ("label", "ascending")])
        lists = (x.values for chunk in table.column("features").chunks for x in chunk)
        model = ftrl(lists, table.column("label").to_numpy(), bits, how)
        return pa.table({"index": np.append(model.index, -1).astype(np.int32), "weight": np.append(model.weight, model.bias).astype(np.float32)})

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column | None = None, max_rows: int = MAX_ROWS, bits: int = BITS, how: Ftrl = Ftrl()) -> Model:
    """Fit on documents (doc_id, text) that ``labels`` (doc_id, toxic) marks.

    ``usable``: which labels may be used. Rows with a null id or label are left out.
    At most about ``max_rows`` labels are used, those of the lowest hashed ids, so the
    labels' side of the join is broadcast and one task holds all features; of rows that
    share a doc_id the smallest text is taken, so there is one for each label. The model
    has 2**bits weights at most. With no usable label the score is 1/2 everywhere.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    known = known.where(usable) if usable is not None else known
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("double").alias("label"))
    total = known.count()
    share = min(1.0, max_rows / max(1, total))
    rank = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    known = known.withColumn("rank", rank).where(F.col("rank") < int(share * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(known), "doc_id")
    rows = rows.groupBy("doc_id", "rank", "label").agg(F.min("text").alias("text"))  # one row for each label
    rows = rows.select(F.lit(1).alias("one"), "rank", "label", "text").mapInArrow(_featurise(bits), "one int, rank long, label double, features array<int>")
    found = rows.groupBy("one").applyInArrow(_fit(bits, how), "index int, weight float").toPandas()
    bias = found.weight[found["index"] < 0]
    found = found[found["index"] >= 0]
    return Model(float(bias.iloc[0]) if len(bias) else 0.0, found["index"].to_numpy(np.int32), found.weight.to_numpy(np.float32))


def _score(shared, bits: int, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        dense = np.zeros(1 << bits, np.float32)
        dense[model.index] = model.weight
        for batch in chunks(batches, "text", CHUNK):
            rows, found = _features(texts(batch, "text"), bits)
            used = dense[found] != 0
            offsets, index = _distinct(rows[used], found[used], bits, batch.num_rows)
            sums = np.concatenate([[0.0], np.cumsum(dense[index], dtype=np.float64)])
            total = sums[offsets[1:]] - sums[offsets[:-1]] + model.bias
            score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(score)], names=[*carry, "toxicity"])

    return run


def score_toxicity(docs: DataFrame, model: Model, bits: int = BITS) -> DataFrame:
    """All columns of ``docs`` and ``toxicity``, from 0 to 1, of each row's whole text.

    A null or empty text has no feature and gets the bias alone. A column of that name
    in ``docs`` is replaced; repeated rows are scored alike.
    """
    rows = docs.drop("toxicity").withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*rows.schema, T.StructField("toxicity", T.DoubleType())])
    return rows.mapInArrow(_score(shared, bits, rows.columns), schema)


def held_out() -> Column:
    """The rows whose labels aren't learned from."""
    return crc_mod("doc_id", 4) == 2


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_toxicity(docs, labels, ~held_out())
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
