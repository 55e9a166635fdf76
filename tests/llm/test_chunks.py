"""Every Arrow function gives the same rows wherever its batches are cut."""

from __future__ import annotations

import types

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from corpusloom.llm import _text, jaccard_join, line_dedup, media, packing, token_counts, toxicity
from tests.llm.test_operators import awkward

MODEL = toxicity.Model(0.25, np.arange(0, 1 << toxicity.BITS, 3, np.int32), np.linspace(-1, 1, len(range(0, 1 << toxicity.BITS, 3)), dtype=np.float32))
CARD = public_tokenizers.path("word_bpe_49k.json")

FUNCTIONS = {
    "packing": (packing, lambda: packing._encode_documents(public_tokenizers.path("byte_bpe_50k.json"), 64, 2)),
    "line_dedup": (line_dedup, lambda: line_dedup._line_rows(20)),
    "token_counts": (token_counts, lambda: token_counts._count(CARD, True)),
    "token_counts_whole": (token_counts, lambda: token_counts._count(CARD, False)),
    "media": (media, lambda: media._store),
    "features": (toxicity, lambda: toxicity._featurise(toxicity.BITS)),
    "scores": (toxicity, lambda: toxicity._score(types.SimpleNamespace(value=MODEL), toxicity.BITS, ["doc_id"])),
    "sets": (jaccard_join, lambda: jaccard_join._summaries(3, 90)),
}


def batch():
    rows = [r[:2] for r in awkward()] * 2
    n = len(rows)
    ids = pa.array([i for i, _ in rows], pa.int64())
    number = pa.array(range(n), pa.int64())
    return pa.RecordBatch.from_arrays(
        [ids, pa.array([t for _, t in rows], pa.string()), number, pa.array([str(i).encode() for i in range(n)]), pa.array([1] * n, pa.int32()), number, pa.array([1.0] * n)],
        names=["doc_id", "text", "content", "digest", "one", "rank", "label"],
    )


@pytest.mark.parametrize("name", FUNCTIONS)
@pytest.mark.parametrize("limit", [1, 300, 30_000])
def test_cuts_change_nothing(monkeypatch, name, limit):
    module, make = FUNCTIONS[name]
    found = []
    for size in (1 << 30, limit):
        monkeypatch.setattr(module, "chunks", lambda batches, column, _=None, size=size: _text.chunks(batches, column, size))
        out = pa.Table.from_batches(list(make()(iter([batch().slice(3), batch().slice(0, 3)]))))
        found.append(out.to_pylist())
    if name == "line_dedup":  # a set's order isn't fixed
        found = [sorted(map(repr, x)) for x in found]
    assert found[0] == found[1]


@pytest.mark.parametrize("kernel", [pc.ascii_lower, pc.utf8_lower, pc.ascii_trim_whitespace, pc.ascii_split_whitespace, pc.binary_length, pc.utf8_length])
def test_slices_are_texts_of_their_own(kernel):
    whole = batch()
    for start in (0, 1, 5, 19):
        part = whole.slice(start)
        fresh = pa.array([x or "" for x in part.column("text").to_pylist()], pa.large_string())
        assert kernel(_text.texts(part, "text")).equals(kernel(fresh))
