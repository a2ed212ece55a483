"""A minimal perfect hash over distinct 64-bit keys, in numpy.

Level by level, every key that has a bit of its own in a bit array is placed;
the others go on to the next, smaller array. A key's slot is the number of bits
set before its own, so n keys fill the slots 0 to n - 1. A key that was not in
the set gets some slot or none (-1); callers compare a stored fingerprint.
"""

from __future__ import annotations

import io

import numpy as np

GAMMA = 2.0
MAX_LEVELS = 64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33 = np.uint64(33)


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser of the keys, another for each seed."""
    x = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


class PerfectHash:
    def __init__(self, sizes: np.ndarray, bits: np.ndarray, ranks: np.ndarray, n: int):
        self.sizes, self.bits, self.ranks, self.n = sizes, bits, ranks, n
        self.offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64 values."""
        left, sizes, arrays = keys.astype(np.uint64), [], []
        while len(left):
            if len(sizes) == MAX_LEVELS:
                raise ValueError("keys are not distinct")
            size = (int(len(left) * GAMMA) + 64) // 64 * 64
            at = (mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            arrays.append(alone)
            sizes.append(size)
            left = left[~alone[at]]
        flat = np.concatenate(arrays) if arrays else np.zeros(64, bool)
        bits = np.packbits(flat, bitorder="little").view(np.uint64)
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)
        return cls(np.array(sizes, np.int64), bits, ranks, len(keys))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of every key; -1 where no level has a bit for it."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(todo):
                break
            at = (mix(keys[todo], level) % np.uint64(size)).astype(np.int64) + self.offsets[level]
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (self.bits[word] >> bit) & np.uint64(1) == 1
            below = self.bits[word[found]] & ((np.uint64(1) << bit[found]) - np.uint64(1))
            out[todo[found]] = self.ranks[word[found]] + np.bitwise_count(below)
            todo = todo[~found]
        return out


def pack(index: PerfectHash, **arrays: np.ndarray) -> bytes:
    """The hash and arrays by slot as one blob."""
    out = io.BytesIO()
    np.savez(out, sizes=index.sizes, bits=index.bits, ranks=index.ranks, n=np.array([index.n]), **{f"by_slot.{k}": x for k, x in arrays.items()})
    return out.getvalue()


def unpack(blob: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    with np.load(io.BytesIO(blob)) as z:
        index = PerfectHash(z["sizes"], z["bits"], z["ranks"], int(z["n"][0]))
        return index, {k.removeprefix("by_slot."): z[k] for k in z.files if k.startswith("by_slot.")}
