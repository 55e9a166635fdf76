"""Whitening, byte-level BPE and the prefix trie against plain versions and the libraries."""

from __future__ import annotations

import base64
import hashlib
import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import byte_bpe, prefix_trie, whitening
from tests.llm import brute
from tests.llm.test_operators import DOCS, awkward

# 11


def plain_whitening(rows, k=16):
    """op11 over (vec_id, vector) by an eigendecomposition in one array."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in kept}))
    n, sums = len(fit), fit.sum(0)
    covariance = ((n * fit - sums) / n).T @ ((n * fit - sums) / n) / n
    e, v = np.linalg.eigh(covariance)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    out = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums.tolist())), (n * np.array(x) - sums) / n @ v / np.sqrt(e)) for i, x in kept]
    return n, out, e / np.trace(covariance)


def check_whitening(got, rows, k=16):
    n, want, explained = plain_whitening(rows, k)
    by = defaultdict(list)
    for r in got:
        by[r.vec_id].append(r)
    assert len(got) == len(want) * len(explained) and {r.n for r in got} == {n} and max(r.identity_error for r in got) < 1e-6
    sign = {}
    for i, deviation, whitened in want:
        for j, w in enumerate(whitened.tolist()):
            mine = [r for r in by[i] if r.component == j + 1 and r.deviation == deviation]
            assert mine and mine[0].explained == pytest.approx(explained[j], rel=1e-9)
            if abs(w) > 1e-3:
                sign.setdefault(j, math.copysign(1, w * mine[0].whitened))
            assert any(abs(r.whitened * sign.get(j, 1) - w) < 1e-8 or abs(w) <= 1e-3 for r in mine)


def test_whitening(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    check_whitening(whitening.op11_embedding_whitening(spark, sf_dir).collect(), rows)


def whitened(spark, tmp_path, rows, name):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("x", F.lit("clash")).withColumn("whitened", F.lit(2))
    df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    return whitening.op11_embedding_whitening(spark, f"{tmp_path}/{name}").collect()


def test_awkward_vectors(spark, tmp_path):
    rng = random.Random(3)
    vector = lambda: [float(np.float32(rng.gauss(0, 1 + i))) for i in range(5)]
    rows = [(i, vector()) for i in range(40)]
    rows += [(7, rows[3][1]), (None, rows[4][1]), (50, rows[3][1]), (51, None), (52, [1.0, None, 0.0, 0.0, 0.0]), (53, [math.nan, 0.0, 0.0, 0.0, 0.0]), (54, [math.inf] + [0.0] * 4), (55, [-math.inf] + [0.0] * 4)]
    good = [r for r in rows if r[0] is None or r[0] <= 50]
    got = whitened(spark, tmp_path, rows + [(56, []), (57, [1.0, 2.0]), (58, [3e38] * 5)], "some")
    check_whitening(got, good, 5)
    assert Counter(r.vec_id for r in got)[7] == 10 and Counter(r.vec_id for r in got)[None] == 5
    assert whitened(spark, tmp_path, [], "none") == [] and whitened(spark, tmp_path, [(1, [0.5, 0.5]), (2, [0.5, 0.5])], "one") == []
    flat = whitened(spark, tmp_path, [(i, [float(i), 1.0, 2.0 * i]) for i in range(6)], "line")  # one direction has all variance
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1) for r in flat)


def test_wide_deviations_are_exact():
    x = np.array([[1 << 60, -5], [3, 4]])
    away, exact = whitening._spread_of(x, 10**6, np.array([7, 8]))
    want = [sum((10**6 * int(c) - s) ** 2 for c, s in zip(row, (7, 8))) for row in x]
    assert [None if v is None else int(v) for v in exact.to_pylist()] == [v if v < 10**38 else None for v in want] and away[1, 0] == 10**6 * 3 - 7


# 12

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe._ranks(RANKS)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def own(ranks):
    return byte_bpe.build_tokenizer(ranks, public_tokenizers.PATTERN)


def test_every_token_and_character(own, ranks, library):
    def spelled(token):
        try:
            return token.decode()
        except UnicodeDecodeError:
            return None

    tokens = [t for t in map(spelled, ranks) if t is not None]
    tokens += [f"a{chr(c)}a {chr(c)}1{chr(c)}{chr(c)} {chr(c)}." for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3400 or c % 7 == 0 or 0xFA00 <= c < 0x1FFFF)]
    assert [e.ids for e in own.encode_batch_fast(tokens)] == [library.encode_ordinary(t) for t in tokens]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="ab -=\n\t'steé1\U0001f600一\x85 ", max_size=60)), max_size=8))
def test_parts_give_the_library_s_ids(library, own, values):
    """Cut at spaces and put together, over several texts; places by character too."""
    big = pa.array(values, pa.large_string())
    for offsets in (False, True):
        (out,) = byte_bpe._encode(RANKS, public_tokenizers.PATTERN, offsets)([pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), big], names=["doc_id", "text"])]) if values else (None,)
        for i, value in enumerate(values):
            want = library.encode_ordinary(value)
            assert np.frombuffer(out.column("ids")[i].as_py(), "<u4").tolist() == want and out.column("n_tokens")[i].as_py() == len(want)
            if offsets:
                whole = own.encode(value).offsets
                assert list(zip(out.column("starts")[i].as_py(), out.column("ends")[i].as_py())) == whole
    if values:
        (back,) = byte_bpe._decode(RANKS, ["doc_id"])([out])
        assert back.column("decoded").to_pylist() == [v.encode() for v in values]


def plain_bpe(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(text or "")


def test_bpe_query(spark, sf_dir, library):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, byte_bpe.op12_byte_bpe(spark, sf_dir).collect())) == Counter((i, *plain_bpe(library, t)) for i, t in docs)


def test_bpe_awkward(spark, library):
    odd = spark.createDataFrame(awkward(), DOCS).withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1))
    encoded = byte_bpe.encode_texts(odd, RANKS)
    assert Counter((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest()) for r in encoded.collect()) == Counter((r[0], *plain_bpe(library, r[1])[:2]) for r in awkward())
    back = byte_bpe.decode_ids(encoded, RANKS, ("doc_id", "decoded")).collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter((r[0], r[1] or "") for r in awkward())
    assert byte_bpe.encode_texts(odd.limit(0), RANKS).count() == 0 and byte_bpe.decode_ids(encoded.limit(0), RANKS).count() == 0


def test_split_characters(spark, library):
    text = "a \U0001f600 b"
    ids = library.encode_ordinary(text)
    cut = next(i for i in range(1, len(ids)) if library.decode_single_token_bytes(ids[i])[0] & 0xC0 == 0x80)
    packed = lambda x: np.array(x, "<u4").tobytes()
    rows = [(1, packed(ids)), (2, packed(ids[:cut])), (3, packed(ids[cut:])), (4, None), (5, packed([ids[0], 4_000_000_000]))]
    out = {r.doc_id: r for r in byte_bpe.decode_ids(spark.createDataFrame(rows, "doc_id long, ids binary"), RANKS).collect()}
    assert out[1].text == text and out[1].n_split >= 1
    assert bytes(out[2].decoded) + bytes(out[3].decoded) == text.encode() and out[2].text.endswith("�") and out[3].text.startswith("�")
    assert out[4].text == "" and out[5].text == "a�"


# 13


def test_trie_query_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = Counter(brute.trie(rows))
    got = prefix_trie.op13_prefix_trie(spark, sf_dir)
    assert Counter(map(tuple, got.collect())) == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    assert Counter(duck.sql(prefix_trie.SQL).fetchall()) == want and duck.sql(prefix_trie.SQL).columns == got.columns


SCHEMA = "conv_id long, turn long, role string, text string"


def borrow():
    return {"base": F.col("conv_id") - F.col("conv_id") % 100, "borrowed": F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6, "most": 5}


@pytest.mark.parametrize("graft", [True, False])
def test_trie_of_blocks_and_pieces(spark, graft):
    """Chains in chains, copies, turnless conversations, nulls and repeated turns; blocks and pieces of a few rows."""
    rng = random.Random(6)
    rows = [(c, t, rng.choice(["user", "a", None]), rng.choice(["x", "yy", None])) for c in range(-60, 130) for t in range(rng.choice([1, 2, 4, 9, 30]))]
    rows += [(500, i, "user", "y" * (i % 3)) for i in range(60)] + [(501, i, "user", "y" * (i % 3)) for i in range(70)] + [(600 + i, 0, "user", "same") for i in range(150)]
    rows += [(700, None, "user", "first"), (700, 0, "user", "then"), (701, 1, "b", "x"), (701, 1, "a", "x"), (702, 3, "a", "x"), (702, 3, "a", "x"), (None, 0, "user", "x"), (None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("depth", F.lit(1)).withColumn("owner", F.lit(None))
    got = prefix_trie.conversation_trie(df, block=8, piece=16, **(borrow() if graft else {}))
    assert Counter(map(tuple, got.collect())) == Counter(brute.trie(rows, graft))


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert prefix_trie.conversation_trie(empty).count() == 0 and prefix_trie.conversation_trie(empty, **borrow()).count() == 0
    none = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert prefix_trie.conversation_trie(none).count() == 0
    alone = prefix_trie.conversation_trie(spark.createDataFrame([(105, 1, "user", "x")], SCHEMA), **borrow())
    assert Counter(map(tuple, alone.collect())) == Counter(brute.trie([(105, 1, "user", "x")]))
