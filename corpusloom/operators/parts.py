"""Parts of sets of hashes, one of which similar sets have in common."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np

#: Buckets of hashes whose sizes tell how rare a hash is: two megabytes for each task.
BUCKETS = 1 << 18
#: Parts for each difference that similar sets may have; those beyond one let sets leave out their commonest parts.
SPARE_PARTS = 1.1
#: Parts of a block.
BLOCK = 8

#: Sizes of sets at which classes begin, each half as large again as the one before.
STARTS = [1]
while STARTS[-1] < 1 << 40:
    STARTS.append(max(STARTS[-1] + 1, STARTS[-1] * 3 // 2))

_FACTOR, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bucket(hashes: np.ndarray) -> np.ndarray:
    """Each hash's bucket of BUCKETS."""
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarity(sizes: np.ndarray) -> np.ndarray:
    """What a hash of each bucket adds to the weight of its part, from the buckets' sizes; whole numbers, so that sums don't depend on their order."""
    return 1 + np.rint(16 * np.log2(max(int(sizes.max()), 1) / np.maximum(sizes, 1))).astype(np.int64)


def first_of_runs(values: np.ndarray) -> np.ndarray:
    """Places at which runs of equal values begin."""
    starts = np.ones(len(values), bool)
    np.not_equal(values[1:], values[:-1], out=starts[1:])
    return np.flatnonzero(starts)


def differences(total: int, least: float) -> int:
    """The most hashes that similar sets of ``total`` hashes together don't share, or one more by rounding."""
    return math.floor(total * (1 - least) / (1 + least) + 1e-6)


def shown_parts(hashes: np.ndarray, rare: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests, places and blocks' bits of the parts that a set (sorted, distinct, 64 bits) shows; sets of Jaccard similarity ``least`` show one in common.

    Such sets of n and m hashes differ in at most d = (n + m)(1 - least) / (1 + least) of
    them. Both are cut at the same places into p > d parts; each difference spoils one, so
    p - d parts or more are equal, and in any one order of parts the first equal one is
    among the first d + 1 of both. The order is by weight, rarest first, so several
    hashes have to agree where one rare hash would have to be shared: in a small vocabulary
    even rare ones are.

    p is that of a class of sizes. A set shows parts for its own class, in which its
    partner may be larger than it, and for smaller classes that its partner may be of. A
    place is the number of parts before it; sets whose first equal part has a place
    beyond the d of their sizes aren't similar.

    BLOCK neighbouring parts are a block. p - d equal parts or more lie in blocks of fewer
    than BLOCK differences (the others have as many differences as parts, or more), so
    only those count. A block's bits are turned by one hash each; where two sets' differ
    in BLOCK bits or more, so do the blocks.
    """
    found, places, bits = [], [], []
    for _, first, digests, blocks in class_parts(hashes, rare, least):
        found.append(digests)
        places.append(np.arange(len(first)))
        bits.append(blocks[first // BLOCK])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).view(np.int64), np.concatenate(places), np.concatenate(bits).view(np.int64)


def most_parts(j: int, least: float) -> int:
    """The most parts that a set shows in a class of sizes."""
    last = STARTS[j + 1] - 1
    return differences(last + math.floor(last / least + 1e-9), least) + 1


def blocks_of(j: int, least: float) -> int:
    """The blocks of a class of sizes."""
    last = STARTS[j + 1] - 1
    return -(-(math.ceil(SPARE_PARTS * differences(last + math.floor(last / least + 1e-9), least)) + 1) // BLOCK)


def class_parts(hashes: np.ndarray, rare: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each class in which a set shows parts (see shown_parts): its number, the parts shown by their numbers and their digests, rarest first, and the bits of all blocks."""
    n = len(hashes)
    turned = np.uint64(1) << (hashes & np.uint64(63))
    for j in range(bisect_right(STARTS, n) - 1, -1, -1):
        last = STARTS[j + 1] - 1
        if last < math.ceil(least * n - 1e-9):
            break
        shown = differences(n + (math.floor(n / least + 1e-9) if n <= last else last), least) + 1
        p = math.ceil(SPARE_PARTS * differences(last + math.floor(last / least + 1e-9), least)) + 1
        piece = ((hashes >> np.uint64(32)) * np.uint64(p) >> np.uint64(32)).astype(np.int64)
        starts = first_of_runs(piece)
        weight, digest = np.zeros(p, np.int64), np.arange(p, dtype=np.uint64) + np.uint64(j << 40)
        with np.errstate(over="ignore"):
            digest *= _FACTOR
            digest[piece[starts]] += np.add.reduceat((hashes ^ (hashes >> np.uint64(29))) * _MIX, starts)
            digest = (digest ^ (digest >> np.uint64(31))) * _MIX
        digest ^= digest >> np.uint64(32)
        weight[piece[starts]] = np.add.reduceat(rare, starts)
        blocks = np.zeros(-(-p // BLOCK), np.uint64)
        block = piece[starts] // BLOCK
        opens = first_of_runs(block)
        blocks[block[opens]] = np.bitwise_xor.reduceat(turned, starts[opens])
        first = np.lexsort((digest, -weight))[:shown]
        yield j, first, digest[first], blocks
