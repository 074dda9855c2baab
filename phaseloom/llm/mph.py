"""Minimal perfect hashing by levels of bit arrays (the scheme of Limasset et al., 2017).

Keys are 64-bit hashes.  A level keeps one bit for every slot that exactly one
remaining key falls on; keys that collide go on to the next level.  The rank of
a key's bit over all levels is its index, so n keys get 0..n-1.
"""

from __future__ import annotations

import io

import numpy as np

_U = np.uint64
MAX_LEVELS = 48


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A finaliser for 64-bit words (fixed multipliers of splitmix64)."""
    with np.errstate(over="ignore"):
        x = h.astype(_U) + _U((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def fingerprint(h: np.ndarray) -> np.ndarray:
    """What is stored for a key, so that unknown keys are told apart."""
    return (mix(h, 977) >> _U(32)).astype(np.uint32)


class PerfectHash:
    """index(keys) is a bijection from the built keys to 0..n-1; for other keys
    the value is -1 or arbitrary, so callers compare a stored fingerprint."""

    def __init__(self, words: list[np.ndarray], n: int):
        self.words, self.n = words, n
        self.sizes = [len(w) * 64 for w in words]
        counts = [np.bitwise_count(w).astype(np.int64) for w in words]
        before = 0
        self.ranks = []
        for c in counts:
            ranks = np.concatenate(([0], np.cumsum(c)[:-1])) + before if len(c) else c
            self.ranks.append(ranks)
            before += int(c.sum())

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 2.0) -> PerfectHash:
        left = np.asarray(keys, _U)
        if len(np.unique(left)) != len(left):
            raise ValueError("keys of a perfect hash must be distinct")
        words = []
        for level in range(MAX_LEVELS):
            if not len(left):
                break
            size = max(64, int(-(-len(left) * gamma // 64)) * 64)
            at = (mix(left, level) % _U(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        if len(left):
            raise ValueError("too many levels")
        return cls(words, len(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        keys = np.asarray(keys, _U)
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks, strict=True)):
            at = (mix(keys[todo], level) % _U(self.sizes[level])).astype(np.int64)
            word, bit = words[at >> 6], (at & 63).astype(_U)
            hit = ((word >> bit) & _U(1)).astype(bool)
            below = np.bitwise_count(word & ((_U(1) << bit) - _U(1)))
            out[todo[hit]] = (ranks[at >> 6] + below)[hit]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, n=np.int64(self.n), **{f"w{i}": w for i, w in enumerate(self.words)})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        z = np.load(io.BytesIO(data))
        return cls([z[f"w{i}"] for i in range(len(z.files) - 1)], int(z["n"]))
