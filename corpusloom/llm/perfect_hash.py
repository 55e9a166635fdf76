"""Minimal perfect hashing of 64-bit keys, with fingerprint and value arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corpusloom.llm._text import mix

#: Bits of a level for each key that reaches it.
GAMMA = 2.0


@dataclass
class PerfectHash:
    """Levels of bit arrays: a key's place is the rank of the first set bit that it alone hits.

    ``fingerprints`` tell members from other keys; ``counts`` and ``values`` are in
    the order of places. Keys themselves aren't stored.
    """

    levels: list[np.ndarray]
    fingerprints: np.ndarray
    counts: np.ndarray
    values: np.ndarray

    @staticmethod
    def slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys, np.full(len(keys), level + 1, np.uint64)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, values: np.ndarray) -> PerfectHash:
        """``keys`` are distinct."""
        levels, places, base = [], np.zeros(len(keys), np.int64), 0
        left = np.arange(len(keys))
        while len(left):
            size = max(64, int(len(left) * GAMMA) + 63 & ~63)
            slot = cls.slots(keys[left], len(levels), size)
            alone = np.bincount(slot, minlength=size) == 1
            won = alone[slot]
            places[left[won]] = base + np.cumsum(alone)[slot[won]] - 1
            base += int(alone.sum())
            levels.append(np.packbits(alone, bitorder="little"))
            left = left[~won]
        order = np.argsort(places)
        return cls(levels, fingerprints[order], counts[order], values[order])

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Each key's place; any place, or -1, for a key that isn't a member."""
        found = np.full(len(keys), -1, np.int64)
        left, base = np.arange(len(keys)), 0
        for level, packed in enumerate(self.levels):
            if not len(left):
                break
            bits = np.unpackbits(packed, bitorder="little")
            slot = self.slots(keys[left], level, len(bits))
            won = bits[slot] == 1
            found[left[won]] = base + np.cumsum(bits, dtype=np.int64)[slot[won]] - 1
            base += int(bits.sum())
            left = left[~won]
        return found

    def look_up(self, keys: np.ndarray, fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each key is a member, and its place (0 for others)."""
        places = self.places(keys)
        if not len(self.fingerprints):
            return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        member = (places >= 0) & (self.fingerprints[np.maximum(places, 0)] == fingerprints)
        return member, np.where(member, places, 0)

    def to_row(self) -> dict:
        return {
            "levels": [x.tobytes() for x in self.levels], "fingerprints": self.fingerprints.astype("<u8").tobytes(),
            "counts": self.counts.astype("<i8").tobytes(), "values": self.values.astype("<i8").tobytes(),
        }

    @classmethod
    def from_row(cls, row) -> PerfectHash:
        levels = [np.frombuffer(x, np.uint8) for x in row["levels"]]
        return cls(levels, *(np.frombuffer(row[k], form) for k, form in (("fingerprints", "<u8"), ("counts", "<i8"), ("values", "<i8"))))
