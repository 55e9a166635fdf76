"""Byte-level BPE by the tokenizers library over Arrow batches, and decoding by the byte table."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm._text import chunks, spread, texts

#: Stands for an id that the vocabulary doesn't have.
UNKNOWN = "\N{REPLACEMENT CHARACTER}".encode()


@functools.cache
def byte_characters() -> dict[int, str]:
    """A printable character for every byte: printable Latin-1 stands for itself, the rest for the next ones from U+0100."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + others.index(b)) if b in others else chr(b) for b in range(256)}


def _ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a rank file: base64 of the bytes and the rank on every line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


def build_tokenizer(ranks: dict[bytes, int], pattern: str):
    """A tokenizer of the tokenizers library that encodes as the ranks do.

    Every cut of a token into two other tokens is a merge, in the order of the token's
    rank, and a piece that is a token itself isn't merged: so each step joins the pair
    whose joint token has the lowest rank. Pieces are the matches of ``pattern``.
    """
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    chars = byte_characters()
    spell = lambda token: "".join(map(chars.__getitem__, token))
    merges = [
        (spell(token[:i]), spell(token[i:])) for token in sorted(ranks, key=ranks.__getitem__)
        for i in range(1, len(token)) if token[:i] in ranks and token[i:] in ranks
    ]
    own = Tokenizer(models.BPE(vocab={spell(t): r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), "isolated")
    own.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return own


@functools.cache
def _tokenizer(path: str, pattern: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return build_tokenizer(_ranks(path), pattern)


def _tokens(own, pieces: list[str], offsets: bool) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens each piece has, and a row for each token: its id, or (id, start, end) by character."""
    sizes, rows = [], []
    for at in range(0, len(pieces), 4096):
        part = pieces[at : at + 4096]
        if offsets:
            found = [[(i, *o) for i, o in zip(e.ids, e.offsets)] for e in own.encode_batch(part, add_special_tokens=False)]
        else:
            found = [e.ids for e in own.encode_batch_fast(part, add_special_tokens=False)]
        sizes += map(len, found)
        rows.append(np.array(list(chain.from_iterable(found)), np.int64).reshape((-1, 3) if offsets else -1))
    return np.array(sizes, np.int64), np.concatenate(rows) if rows else np.zeros((0, 3) if offsets else 0, np.int64)


def cut_at_spaces(values: pa.Array, cut: bool) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's parts, and all parts (large strings).

    A space behind a visible ASCII character begins a new match of PATTERN, which holds
    a space at its start or among white space alone, and looks back at nothing; so the
    parts can be encoded apart. Without ``cut`` a text is one part.
    """
    ends = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[: ends[-1]]
    starts = ends[:-1][np.diff(ends) > 0]
    if cut:
        begins = np.zeros(len(data), bool)
        begins[starts] = True
        begins[1:] |= (data[1:] == 0x20) & (data[:-1] > 0x20) & (data[:-1] < 0x7F)
        starts = np.flatnonzero(begins)
    bounds = np.append(starts, ends[-1]).astype(np.int64)
    parts = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(bounds), values.buffers()[2]])
    return np.searchsorted(starts, ends), parts


def _encode(path: str, pattern: str, offsets: bool):
    import pyarrow.compute as pc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(path, pattern)
        for batch in chunks(batches, "text"):
            ends, parts = cut_at_spaces(texts(batch, "text"), pattern == public_tokenizers.PATTERN)
            coded = parts.dictionary_encode()
            codes = coded.indices.to_numpy()
            sizes, flat = _tokens(own, coded.dictionary.to_pylist(), offsets)
            n = sizes[codes]
            rows = flat[spread((np.cumsum(sizes) - sizes)[codes], n)]
            bounds = np.concatenate([[0], np.cumsum(n)])[ends]  # of each text's tokens
            ids = np.ascontiguousarray(rows[:, 0] if offsets else rows, "<u4")
            packed = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(4 * bounds), pa.py_buffer(ids)])
            columns = [batch.column("doc_id"), pa.array(np.diff(bounds)), packed.cast(pa.binary())]
            if offsets:
                chars = np.concatenate([[0], np.cumsum(pc.utf8_length(parts).to_numpy())]).astype(np.int64)
                shift = np.repeat(chars[:-1], n) - np.repeat(chars[ends[:-1]], np.diff(bounds))  # a part's place in its text
                columns += [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(rows[:, i] + shift, pa.int32())) for i in (1, 2)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "starts", "ends"][: len(columns)])

    return run


def encode_texts(docs: DataFrame, ranks: str, pattern: str = public_tokenizers.PATTERN, offsets: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids, starts, ends) for each row of ``docs`` (doc_id, text).

    ``ranks`` is a file of byte tokens by rank. Bytes are spelled as characters for the
    tokenizers library; matches of ``pattern`` are encoded separately, and strings of
    special tokens are ordinary text. ``ids`` are little-endian unsigned 32-bit
    numbers, one after another. With ``offsets``, token i covers the characters from
    ``starts[i]`` to before ``ends[i]``; one that holds a part of a character's bytes
    covers that character.

    A null text is empty, and an empty one has no tokens. Every row is returned,
    repeated ones and those of null doc_id too; other columns are ignored. Equal
    parts between spaces are encoded once in a block of texts; nothing is shuffled, and a
    task holds one block.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids binary" + ", starts array<int>, ends array<int>" * offsets
    return rows.mapInArrow(_encode(ranks, pattern, offsets), schema)


@functools.cache
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes, where each id's begin, and how many they are; the last entry is for unknown ids.

    The bytes are read back from the spelled tokens.
    """
    back = {c: b for b, c in byte_characters().items()}
    vocabulary = build_tokenizer(_ranks(path), public_tokenizers.PATTERN).get_vocab()
    tokens = [UNKNOWN] * (max(vocabulary.values()) + 2)
    for spelled, i in vocabulary.items():
        tokens[i] = bytes(map(back.__getitem__, spelled))
    sizes = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes, sizes


def _decode(path: str, kept: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, sizes = _byte_table(path)
        inside = (data[starts] & 0xC0) == 0x80
        for batch in chunks(batches, "ids", 8 << 20):
            packed = [(x.as_py() or b"") for x in batch.column("ids")]
            packed = [x[: len(x) // 4 * 4] for x in packed]
            ids = np.minimum(np.frombuffer(b"".join(packed), "<u4").astype(np.int64), len(sizes) - 1)
            bounds = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int64)
            out = data[spread(starts[ids], sizes[ids])]
            ends = np.concatenate([[0], np.cumsum(sizes[ids])])[bounds]
            decoded = pa.Array.from_buffers(pa.large_binary(), len(packed), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out))])
            split = np.diff(np.concatenate([[0], np.cumsum(inside[ids])])[bounds])
            yield pa.RecordBatch.from_arrays([decoded.cast(pa.binary()), pa.array(split, pa.int64()), *(batch.column(c) for c in kept)], names=["decoded", "n_split", *kept])

    return run


def decode_ids(rows: DataFrame, ranks: str, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, decoded, text, n_split) for each row of ``rows``, whose ``ids`` are packed as by encode_texts.

    ``decoded`` are the bytes of all tokens of a row together, so that a character that
    tokens share is whole again; ``text`` is what they spell, with U+FFFD for bytes that
    make no character, as where ids begin or end inside one. ``n_split`` counts tokens
    that begin inside a character. Null ids decode to nothing, and an id that the
    vocabulary lacks to U+FFFD. Columns named decoded, text, n_split or ids aren't carried.
    """
    kept = [c for c in carry if c not in ("decoded", "text", "n_split", "ids")]
    own = rows.select("ids", *kept)
    schema = T.StructType([T.StructField("decoded", T.BinaryType()), T.StructField("n_split", T.LongType()), *own.select(*kept).schema])
    return own.mapInArrow(_decode(ranks, kept), schema).select(*kept, "decoded", F.make_valid_utf8(F.col("decoded").cast("string")).alias("text"), "n_split")


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), ranks, offsets=False)
    encoded = encoded.withColumn("ids_sha256", F.sha2("ids", 256))
    decoded = decode_ids(encoded, ranks, ("doc_id", "n_tokens", "ids_sha256"))
    return decoded.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
