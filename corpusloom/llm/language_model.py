"""Language-model scores by a weighted backoff automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm._store import materialise
from corpusloom.llm._text import crc_mod, hash_strings, mix, split_words, texts

#: Bytes of text in a block, whose documents are scored together by one automaton, and for each shard of n-grams.
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 16 << 20
#: Partitions of the exchanges at most; below that there is one for each shard's bytes.
MOST_PARTS = 20_000
#: Bits of an n-gram's key inside its shard, for n of 2 or more; words have all 64.
KEY_BITS = 40
#: For histories of one token, two, and so on: the weight of the shorter history, in tokens.
MU = (400.0, 40.0)
#: Tokens of a stretch of text that is walked beside others.
STRETCH = 256

_END, _BEGIN = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" end", b" begin"))  # no word has a space


@dataclass
class Tokens:
    """The tokens of a block's texts: hashes of words, then one end for each text.

    ``owner``: each token's row; ``place``: its place in the text, from 0.
    """

    token: np.ndarray
    owner: np.ndarray
    place: np.ndarray


def tokens_of(offsets: np.ndarray, codes: np.ndarray, words: np.ndarray) -> Tokens:
    """``offsets``: of each text's words; ``codes``: all words in order, as indices of the hashes ``words``."""
    counts = np.diff(offsets)
    n = counts + 1
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    first = np.cumsum(n) - n
    place = np.arange(len(owner)) - first[owner]
    token = np.full(len(owner), _END, np.uint64)
    token[place < counts[owner]] = words[codes]
    return Tokens(token, owner, place)


def _tokens(values: pa.Array) -> Tokens:
    offsets, codes, words = split_words(pc.ascii_lower(values.take(pa.array(np.arange(len(values))))))
    return tokens_of(offsets, codes, hash_strings(words))


def grams(own: Tokens, order: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: sorted distinct keys, the token where each is first seen, and each token's index of a key.

    A text's first tokens follow one begin, so order k takes the tokens from place k - 2
    on; the others have index -1. Keys of order 2 or more lose ``shift`` bits.
    """
    gram = own.token
    for k in range(1, order + 1):
        if k > 1:  # the n-gram one shorter that ends before, then the token
            last = np.concatenate([[_BEGIN], gram[:-1]]).astype(np.uint64)[: len(gram)]
            gram = mix(np.where(own.place == 0, _BEGIN, last) if k == 2 else last, own.token)
        held = np.flatnonzero(own.place >= k - 2) if k > 2 else np.arange(len(gram))
        keys, first, inverse = np.unique(gram[held] >> np.uint64(shift if k > 1 else 0), return_index=True, return_inverse=True)
        at = np.full(len(gram), -1, np.int32)
        at[held] = inverse
        yield keys, held[first], at


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them, in as few bytes each as the largest needs; the first byte is the width."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8, offset=1).reshape(-1, data[0])
    steps = np.zeros((len(own), 8), np.uint8)
    steps[:, : data[0]] = own
    return np.cumsum(steps.view("<u8").ravel(), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs; the first byte is the width."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or not len(counts) or counts.max() < 1 << 8 * w)
    return bytes([width]) + counts.astype(f"<u{width}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


#: What goes to shards: a block's keys and its own counts of them, by order.
_REQUEST = "shard long, block long, keys array<binary>, counts array<binary>"
#: What comes back: the whole counts of those keys, and with one row of a shard its tokens and types.
_ANSWER = "shard long, block long, counts array<binary>, tokens long, types long"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.schema([(n, pa.list_(kinds[k[6:-1]]) if k.startswith("array") else kinds[k]) for n, k in fields])


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a task, up to ``limit`` bytes of text together; a longer text stands alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            end = int(np.searchsorted(ends, before + limit - size, side="right"))
            if end <= start and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
                continue
            end = max(end, start + 1)
            held.append(batch.slice(start, end - start))
            size += int(ends[end - 1] - before)
            start = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _named(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The blocks of a task's rows with their names, which tell other texts apart from those of this place."""
    part = TaskContext.get().partitionId() if TaskContext.get() else 0
    for number, batch in enumerate(_gathered(batches, limit)):
        own = xxhash.xxh3_64(f"{part} {number} {batch.num_rows}")
        for buffer in texts(batch, "text").buffers()[1:]:
            own.update(buffer or b"")
        yield own.intdigest() >> 1, batch


def _blocked(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, batch in _named(batches, limit):
            yield pa.RecordBatch.from_arrays([pa.array([block] * batch.num_rows, pa.int64()), *batch.columns], names=["block", *batch.schema.names])

    return run


def _ask(order: int, bits: int, limit: int):
    """Of each block: its distinct n-grams and their counts in training texts, cut into 2**bits shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift, schema = max(0, 64 - bits - KEY_BITS), _arrow(_REQUEST)
        for block, batch in _named(batches, limit):
            own = _tokens(texts(batch, "text"))
            train = batch.column("train").to_numpy(zero_copy_only=False)[own.owner]
            rows: dict[int, tuple[list, list]] = {}
            for k, (keys, _, at) in enumerate(grams(own, order, shift)):
                counts = np.bincount(at[train & (at >= 0)], minlength=len(keys))
                size = 64 if k == 0 else 64 - shift
                shard = keys >> np.uint64(size - bits)
                low = keys & np.uint64((1 << size - bits) - 1)
                cuts = np.flatnonzero(np.diff(shard)) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                    if b > a:
                        row = rows.setdefault(int(shard[a]), ([b""] * order, [b""] * order))
                        row[0][k], row[1][k] = _pack(low[a:b]), _narrow(counts[a:b])
            columns = ([*rows], [block] * len(rows), [r[0] for r in rows.values()], [r[1] for r in rows.values()])
            yield pa.RecordBatch.from_pydict(dict(zip(schema.names, columns)), schema=schema)

    return run


def _answer(order: int):
    """Of one shard: sums the blocks' counts and gives each block those of its n-grams."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        n = len(keys)
        sent: list[list[bytes]] = [[b""] * order for _ in keys]
        tokens = types = 0
        for k in range(order):
            some = [i for i in range(n) if keys[i][k]]
            if not some:
                continue
            parts = [_unpack(keys[i][k]) for i in some]
            found, inverse = np.unique(np.concatenate(parts), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate([_wide(counts[i][k]) for i in some]), minlength=len(found)).astype(np.int64)
            ends = np.cumsum([len(p) for p in parts])
            for i, p, b in zip(some, parts, ends):
                sent[i][k] = _narrow(total[inverse[b - len(p) : b]])
            if k == 0:
                tokens, types = int(total.sum()), int((total > 0).sum())
        columns = (table.column("shard").to_pylist(), table.column("block").to_pylist(), sent, [tokens] + [0] * (n - 1), [types] + [0] * (n - 1))
        schema = _arrow(_ANSWER)
        return pa.Table.from_pydict(dict(zip(schema.names, columns)), schema=schema)

    return run


@dataclass
class Automaton:
    """States are the kept histories; 0 is the empty one.

    ``fail``: the state of the history without its first token; ``back``: the failure
    arc's log10 weight. ``arcs``: sorted keys state * n_tokens + token, each with its
    ``weight`` and the state it leads to, ``to``. The root has an arc for each token,
    the first ``n_tokens`` ones.
    """

    n_tokens: int
    begin: int
    fail: np.ndarray
    back: np.ndarray
    arcs: np.ndarray
    weight: np.ndarray
    to: np.ndarray

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the log10 weights, failure arcs included, of one token for each of many walks."""
        state, after, total = state.copy(), np.zeros(len(state), np.int64), np.zeros(len(state))
        left = np.arange(len(state))
        while len(left):
            key = state[left] * self.n_tokens + token[left]
            at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
            has = self.arcs[at] == key
            done, at = left[has], at[has]
            total[done] += self.weight[at]
            after[done] = self.to[at]
            left = left[~has]
            total[left] += self.back[state[left]]
            state[left] = self.fail[state[left]]
        return after, total


def build(own: Tokens, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], counts: list[np.ndarray], begun: int, tokens: int, types: int, mu: tuple[float, ...]) -> Automaton:
    """The automaton of the n-grams that a block's texts hold, with counts of all training texts.

    The arc of an n-gram h w that training texts hold weighs
    log10 p(w | h) = log10((c(h w) + mu p(w | h')) / (c(h) + mu)), h' being h without
    its first token, and leads to the longest kept history that h w ends with. For
    other tokens the failure arc of h weighs log10(mu / (c(h) + mu)) and leads to h'.
    The root gives (c + 1) / (N + V + 1), to unknown words too: each state's
    probabilities sum to one.
    """
    order = len(found)
    n_tokens = len(found[0][0])
    p = [(counts[0] + 1.0) / (tokens + types + 1.0)]
    # the state of each kept n-gram shorter than ``order``, 0 for others; the last state is that of a text's begin
    states, n_states = [], 1
    for k in range(order - 1):
        kept = counts[k] > 0
        states.append(np.where(kept, n_states + np.cumsum(kept) - 1, 0))
        n_states += int(kept.sum())
    begin = n_states if begun and order > 1 else 0
    fail, back = np.zeros(n_states + 1, np.int64), np.zeros(n_states + 1)
    keys, weights, to = [np.arange(n_tokens, dtype=np.int64)], [np.log10(p[0])], [states[0] if order > 1 else np.zeros(n_tokens, np.int64)]
    if begin:
        back[begin] = np.log10(mu[0] / (begun + mu[0]))
    for k in range(order - 1):
        kept = np.flatnonzero(states[k])
        back[states[k][kept]] = np.log10(mu[k] / (counts[k][kept] + mu[k]))
        if k:
            fail[states[k][kept]] = states[k - 1][found[k - 1][2][found[k][1][kept]]]
    for k in range(1, order):
        first, count, last = found[k][1], counts[k], found[k - 1][2]
        token = found[0][2][first]
        before = last[first - 1]
        starts = own.place[first] == 0 if k == 1 else np.zeros(len(first), bool)
        held = np.where(starts, begun, counts[k - 1][before])
        source = np.where(starts, begin, states[k - 1][before])
        lower = p[k - 1][last[first]]
        p.append(np.where(held > 0, (count + mu[k - 1] * lower) / (held + mu[k - 1]), lower))
        arc = np.flatnonzero((count > 0) & (source > 0))
        keys.append(source[arc] * n_tokens + token[arc])
        weights.append(np.log10(p[k][arc]))
        to.append(states[k][arc] if k < order - 1 else states[k - 1][last[first[arc]]])
    arcs = np.concatenate(keys)
    by = np.argsort(arcs, kind="stable")
    return Automaton(n_tokens, begin, fail, back, arcs[by], np.concatenate(weights)[by], np.concatenate(to)[by])


def traverse(machine: Automaton, token: np.ndarray, owner: np.ndarray, place: np.ndarray, n: int, order: int, stretch: int = STRETCH) -> np.ndarray:
    """The log10 probability of each of ``n`` texts, each token read once from left to right.

    Texts are walked beside each other, long ones in stretches of ``stretch`` tokens. The
    state depends on the last order - 1 tokens alone, so a stretch begins that many
    tokens before its own at the root, without adding their weights.
    """
    starts = np.flatnonzero(place % stretch == 0)
    size = np.diff(np.append(starts, len(token)))
    lead = np.minimum(place[starts], order - 1)
    by = np.argsort(-(size + lead), kind="stable")
    starts, size, lead = starts[by], size[by], lead[by]
    state = np.where(place[starts] == lead, machine.begin, 0).astype(np.int64)
    total = np.zeros(len(starts))
    active = np.searchsorted(-(size + lead), -np.arange(int((size + lead).max(initial=0))), side="left")
    for t, k in enumerate(active.tolist()):
        state[:k], weight = machine.step(state[:k], token[starts[:k] - lead[:k] + t])
        total[:k] += np.where(lead[:k] <= t, weight, 0.0)
    return np.bincount(owner[starts], total, n)


_SCORED = "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double"


def _score(order: int, bits: int, tokens: int, types: int, begun: int, mu: tuple[float, ...]):
    """Of one block: its automaton from the shards' answers, and its texts' scores."""

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        n = table.num_rows
        own = _tokens(pc.fill_null(table.column("text").combine_chunks().cast(pa.large_string()), "")) if n else None
        found = list(grams(own, order, max(0, 64 - bits - KEY_BITS))) if n else []
        answers = answers.select(["shard", "counts"]).sort_by("shard").column("counts").to_pylist()
        counts = [np.concatenate([np.zeros(0, np.int64), *(_wide(a[k]) for a in answers if a[k])]) for k in range(order)]
        if not n or any(len(c) != len(keys) for c, (keys, _, _) in zip(counts, found)):
            raise ValueError("the texts changed between two reads: write them to a table first")
        n_tokens = np.bincount(own.owner, minlength=n)
        known = counts[0][found[0][2]]
        base = np.log10((known + 1.0) / (tokens + types + 1.0))
        machine = build(own, found, counts, begun, tokens, types, mu)
        token = found[0][2].astype(np.int64)
        del found, counts
        score = traverse(machine, token, own.owner, own.place, n, order)
        pa.default_memory_pool().release_unused()
        return pa.table({
            "doc_id": table.column("doc_id"), "train": table.column("train"), "n_tokens": pa.array(n_tokens),
            "n_known": pa.array(np.bincount(own.owner[known > 0], minlength=n)), "base_score": pa.array(np.bincount(own.owner, base, n)), "score": pa.array(score),
        })

    return run


def score_texts(docs: DataFrame, train: Column, mu: tuple[float, ...] = MU, block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, train, n_tokens, n_known, train_tokens, base_score, score) for each row.

    The rows where ``train`` holds teach the model, of n-grams up to ``len(mu) + 1``
    tokens; every row is scored. Consecutive rows of a task are a block of at most
    ``block_bytes`` of text. A block sends its distinct n-grams, with their counts, to
    the shards of their keys, one row for each shard; shards sum the counts of all
    blocks and answer. The block then builds the automaton of its own n-grams, with the
    counts of the whole corpus, and walks each text once. So no task holds the whole
    model and nothing is pruned. There is a shard for each ``shard_bytes`` of
    text, so a row holds fewer n-grams the larger the input is; there are never more rows
    than n-grams.
    Keys of words have 64 bits and those of longer n-grams 40 and the shard's, so two
    words share a count with negligible odds. Texts are read twice and must come in
    the same order, as from files; if they don't, that raises.

    A null or empty text is the end token alone. Rows of one doc_id are scored apart;
    a null id stays null. With no training row N and V are 0 and every token has
    probability 1. Other columns are ignored.
    """
    order = len(mu) + 1
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    about = rows.agg(F.sum(F.octet_length("text").cast("long") + 64).alias("size"), F.sum(F.col("train").cast("long")).alias("begun")).first()
    shards = max(2, -(-(about["size"] or 0) // shard_bytes))
    bits = (shards - 1).bit_length()
    parts = min(shards, MOST_PARTS)  # so that a task's share doesn't grow with the input
    asked = rows.mapInArrow(_ask(order, bits, block_bytes), _REQUEST).repartition(parts, "shard")
    answers = materialise(asked.groupBy("shard").applyInArrow(_answer(order), _ANSWER), "lm-answers")
    known = answers.agg(F.sum("tokens"), F.sum("types")).first()
    tokens, types = int(known[0] or 0), int(known[1] or 0)
    blocked = rows.mapInArrow(_blocked(block_bytes), "block long, doc_id long, text string, train boolean").repartition(parts, "block")
    told = answers.select("shard", "block", "counts").repartition(parts, "block").groupBy("block")
    scored = blocked.groupBy("block").cogroup(told).applyInArrow(_score(order, bits, tokens, types, int(about["begun"] or 0), tuple(mu)), _SCORED)
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))


def held_out() -> Column:
    return crc_mod("doc_id", 7) == 2


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = score_texts(docs, ~held_out())
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
