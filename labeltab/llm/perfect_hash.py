"""Minimal perfect hash of distinct 64-bit keys as a cascade of bit arrays.

A level has about two bits a key. A key that no other key of its level meets sets its bit; the others go
on to the next level. A key's number is the rank of its bit over all levels, so n keys have the numbers
0 to n - 1.
"""

from __future__ import annotations

import numpy as np

from . import textvec as tv

U64 = np.uint64
STEP = 0x9E3779B97F4A7C15


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tv.mix64(keys ^ U64((level + 1) * STEP & 0xFFFFFFFFFFFFFFFF)) % U64(size)).astype(np.int64)


class PerfectHash:
    """Numbers of the keys it was built from; other keys give any number or -1."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        self.rank = np.cumsum(bits) - 1

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], keys
        while len(rest):
            size = max(64, 2 * len(rest))
            at = _place(rest, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            rest = rest[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, bool))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = self.start[level] + _place(keys[rest], level, size)
            hit = self.bits[at]
            out[rest[hit]] = self.rank[at[hit]]
            rest = rest[~hit]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        return self.sizes.tobytes(), np.packbits(self.bits).tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> PerfectHash:
        s = np.frombuffer(sizes, np.int64)
        return cls(s, np.unpackbits(np.frombuffer(bits, np.uint8), count=int(s.sum())).astype(bool))
