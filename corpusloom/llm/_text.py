"""Columnar text helpers for tasks that work on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of text that are worked on at once inside a task.
CHUNK_BYTES = 8 << 20


def crc_mod(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod


def chunks(batches: Iterable[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of each hold ``limit`` bytes at most (a longer text stands alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = total[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end
            pa.default_memory_pool().release_unused()  # else the pool keeps what the last part took


def texts(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The texts as large strings, null as empty, in buffers of their own.

    The cast of a slice keeps the values' offsets of the whole, which pc.ascii_lower
    doesn't heed; ``take`` makes them begin at 0.
    """
    values = pc.fill_null(batch.column(column).cast(pa.large_string()), "")
    return values.take(pa.array(np.arange(len(values))))


def split_words(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between runs of ASCII white space.

    Returns the offsets of each text's words, the words as codes, and the distinct
    words that the codes index.
    """
    trimmed = pc.ascii_trim_whitespace(values)
    lists = pc.ascii_split_whitespace(trimmed)
    filled = pc.greater(pc.binary_length(trimmed), 0).to_numpy(zero_copy_only=False)
    counts = np.where(filled, pc.list_value_length(lists).to_numpy(zero_copy_only=False), 0)
    flat = lists.flatten()
    if not filled.all():  # an empty text is split into one empty word
        flat = flat.filter(pc.greater(pc.binary_length(flat), 0))
    encoded = flat.dictionary_encode()
    offsets = np.zeros(len(values) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return offsets, encoded.indices.to_numpy(), encoded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hashes of the UTF-8 bytes of each value."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, values.cast(pa.large_binary()).to_pylist()), np.uint64, len(values))


def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of an ordered pair of hashes, element by element."""
    with np.errstate(over="ignore"):
        x = (left * np.uint64(0x9E3779B97F4A7C15)) ^ (left >> np.uint64(31))
        x = (x + right) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices start .. start + length - 1 of every run, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return shift + np.arange(total, dtype=np.int64)
