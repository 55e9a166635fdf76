"""Language identification with hyperdimensional n-gram profiles."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import materialise
from corpusloom.llm._text import crc_mod, texts

#: Components of a vector, and letter classes (0 stands for all that isn't a letter).
DIMENSIONS, CLASSES = 1024, 128
#: Languages that may be learned: their vectors, 4 KB each, are sent to every task.
MOST_LANGUAGES = 10_000
#: Code points worked on at once; longer texts are taken in such parts.
PART = 1 << 20
UNKNOWN = "und"


@functools.cache
def letter_classes() -> np.ndarray:
    """The class of each code point: a-z have their own, other letters share the rest by hash."""
    point = np.arange(0x110000)
    letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    other = 27 + (point.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(CLASSES - 27)
    own = np.where((point >= 97) & (point <= 122), point - 96, other.astype(np.int64))
    return np.where(letter, own, 0).astype(np.int32)


@functools.cache
def letter_vectors() -> np.ndarray:
    """A random vector of +1 and -1 for each class."""
    return np.random.default_rng(20240229).choice(np.array([-1, 1], np.int8), (CLASSES, DIMENSIONS))


def bind(codes: np.ndarray) -> np.ndarray:
    """The vectors of trigrams: each letter's vector is permuted by its place, then all are multiplied."""
    v = letter_vectors()
    a, b, c = codes // CLASSES**2, codes // CLASSES % CLASSES, codes % CLASSES
    return (np.roll(v, 2, axis=1)[a] * np.roll(v, 1, axis=1)[b] * v[c]).astype(np.float32)


def _parts(values: pa.Array) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Rows and their letter classes, up to about PART code points and 256 parts at a time, each with a space at both ends."""
    classes, rows, parts, size = letter_classes(), [], [], 0
    for i, text in enumerate(values):
        lower = text.as_py().lower()
        for at in range(0, len(lower), PART):
            points = np.frombuffer(lower[max(0, at - 2) : at + PART].encode("utf-32-le", "surrogatepass"), np.uint32)
            own = classes[points]
            own = np.concatenate([[0] * (at == 0), own, [0] * (at + PART >= len(lower))]).astype(np.int32)
            rows.append(i)
            parts.append(own)
            size += len(own)
            if size >= PART or len(rows) >= 256:
                yield rows, parts
                rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _bundles(rows: np.ndarray, parts: list[np.ndarray], n: int) -> np.ndarray:
    """For each of ``n`` rows the sum of its trigrams' vectors."""
    flat = np.concatenate(parts)
    owner = np.repeat(rows, [len(p) for p in parts])
    ends = np.cumsum([len(p) for p in parts])
    code = (flat[:-2] * CLASSES + flat[1:-1]) * CLASSES + flat[2:]
    own = np.ones(len(code), bool)
    for back in (1, 2):  # trigrams over the border of two parts
        own[ends[:-1] - back] = False
    own &= code > 0
    code, owner = code[own], owner[:-2][own]
    present = np.flatnonzero(np.bincount(code, minlength=1))
    place = np.zeros(CLASSES**3, np.int32)
    place[present] = np.arange(len(present))
    code = place[code]
    out = np.zeros((n, DIMENSIONS), np.float32)
    block = 8192
    for at in range(0, len(present), block):
        width = min(block, len(present) - at)
        here = (code >= at) & (code < at + width) if len(present) > block else slice(None)
        counts = np.bincount(owner[here] * width + (code[here] - at), minlength=n * width).reshape(n, width)
        out += counts.astype(np.float32) @ bind(present[at : at + width])
    return out


@dataclass
class Profiles:
    """The languages and the unit vectors of their prototypes."""

    languages: list[str]
    vectors: np.ndarray = field(repr=False)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column("lang").dictionary_encode()
        lang, known = names.indices.to_numpy(), names.dictionary.to_pylist()
        for rows, parts in _parts(texts(batch, "text")):
            local, own = np.unique(lang[rows], return_inverse=True)
            for k, v in zip(local.tolist(), _bundles(own, parts, len(local))):
                sums[known[k]] = sums.get(known[k], 0) + v.astype(np.float64)
        if len(sums) > 1000:
            yield _sums(sums)
            sums = {}
    yield _sums(sums)


def _sums(sums: dict[str, np.ndarray]) -> pa.RecordBatch:
    place = np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(sums))
    value = np.concatenate(list(sums.values())) if sums else np.zeros(0)
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(list(sums), object), DIMENSIONS), pa.string()), pa.array(place), pa.array(value)], names=["lang", "place", "value"])


def learn_profiles(docs: DataFrame) -> Profiles:
    """A prototype for each non-null ``lang`` of ``docs`` (text, lang): all its texts' bundles together.

    Every task sends one vector for each language it meets; these are summed by language
    and component. The result has as many vectors as there are languages; more than
    MOST_LANGUAGES distinct values are no languages, and raise.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = rows.mapInArrow(_learn, "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value"))
    sums = materialise(sums, "language-sums")
    if (n := sums.where("place = 0").count()) > MOST_LANGUAGES:
        raise ValueError(f"{n} languages: at most {MOST_LANGUAGES} can be learned")
    found = sums.toPandas().sort_values(["lang", "place"])
    languages = sorted(found.lang.unique())
    vectors = found.value.to_numpy().reshape(len(languages), DIMENSIONS)
    if len(languages) > 1:  # what all languages share tells nothing
        unit = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
        vectors = unit - 0.9 * unit.mean(axis=0)
    return Profiles(languages, (vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def _predict(shared, carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = shared.value
        for batch in batches:
            n, k = batch.num_rows, len(profiles.languages)
            dot, norm, seen = np.zeros((n, max(1, k))), np.zeros(n), np.zeros(n, bool)
            whole: dict[int, np.ndarray] = {}  # of texts that come in several parts
            values = texts(batch, "text")
            several = pc.utf8_length(values).to_numpy(zero_copy_only=False) > PART // 2
            for rows, parts in _parts(values):
                local, own = np.unique(rows, return_inverse=True)
                found = _bundles(own, parts, len(local))
                seen[local] |= np.array([any(p.any() for p, r in zip(parts, rows) if r == i) for i in local]) if len(local) < len(rows) else [p.any() for p in parts]
                for i, v in zip(local.tolist(), found):
                    if several[i]:
                        whole[i] = whole.get(i, 0) + v.astype(np.float64)
                norm[local] = np.linalg.norm(found, axis=1)
                if k:
                    dot[local] = found @ profiles.vectors.T
            for i, v in whole.items():
                norm[i] = np.linalg.norm(v)
                if k:
                    dot[i] = profiles.vectors @ v
            best = dot.argmax(axis=1)
            score = np.clip(dot[np.arange(n), best] / np.maximum(norm, 1e-9), 0.0, 1.0)
            known = seen & (k > 0)
            names = np.array([*profiles.languages, UNKNOWN], object)[np.where(known, best, -1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], names=[*carry, "lang_pred", "score"])

    return run


def predict_languages(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """(doc_id, lang_pred, score): the language of the largest cosine with each row's whole text.

    A text that is null or has no letter is ``und`` with score 0, and so is every text
    where no language was learned. Equal cosines take the first name. Each row is its
    own, so repeated rows get equal answers; a null doc_id stays; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(profiles)
    return rows.mapInArrow(_predict(shared, ["doc_id"]), "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return crc_mod("doc_id", 4) == 2


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predict_languages(docs, learn_profiles(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
