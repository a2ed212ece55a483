"""Hashed n-gram indicators of a text.

A text's indicators are the buckets of its words, of its pairs of neighbouring words
(A-Z lower-cased; a word that repeats the one before it stands as a mark of its own)
and of its byte trigrams as they stand. Words are runs without `[\\x20\\x09-\\x0D]`,
cut every ``PIECE`` bytes. Texts are read in windows, so that a very long one, or one
without white space, needs no more memory than the window and one flag a bucket.
"""

from __future__ import annotations

import numpy as np

BITS = 18
BUCKETS = 1 << BITS
PIECE = 64
WINDOW = 1 << 20
MANY = 1 << 15

_U = np.uint64
_TOP = _U(64 - BITS)
_ONE, _FIRST, _SECOND, _REPEAT = (_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """White-space flags, a random number for each byte (capital A-Z as small ones), and an odd one for each place in a word."""
    rng = np.random.default_rng(12)
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    letters = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    letters[0x41:0x5B] = letters[0x61:0x7B]
    return space, letters, rng.integers(1, 1 << 62, PIECE, dtype=np.uint64) * _U(2) + _U(1)


_SPACE, _LETTER, _PLACE = _tables()


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(29))) * _ONE
    return (h >> _TOP).astype(np.int32)


def _words(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the words of a window begin, their hashes, and where the last one ends."""
    at = np.flatnonzero(~_SPACE[a])
    if not len(at):
        return at, at.astype(np.uint64), 0
    new = np.append(True, np.diff(at) > 1)
    first = np.flatnonzero(new)
    place = (np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))) % PIECE
    heads = np.flatnonzero(place == 0)
    return at[heads], np.add.reduceat(_LETTER[a[at]] * _PLACE[place], heads), int(at[-1]) + 1


class _Seen:
    """Buckets of one text; few are sorted, many are flagged."""

    def __init__(self):
        self.parts, self.size, self.flags = [], 0, None

    def add(self, part: np.ndarray) -> None:
        self.parts.append(part)
        self.size += len(part)
        if self.size > MANY:
            self.flags = np.zeros(BUCKETS, bool) if self.flags is None else self.flags
            for p in self.parts:
                self.flags[p] = True
            self.parts, self.size = [], 0

    def result(self) -> np.ndarray:
        if self.flags is None:
            return np.unique(np.concatenate(self.parts)) if self.parts else np.zeros(0, np.int32)
        for p in self.parts:
            self.flags[p] = True
        return np.flatnonzero(self.flags).astype(np.int32)


def indicators(text: bytes, window: int = WINDOW) -> np.ndarray:
    """Sorted distinct buckets of a UTF-8 text; ``window`` is over ``PIECE`` and does not change them."""
    a, seen = np.frombuffer(text, np.uint8), _Seen()
    for at in range(0, max(len(a) - 2, 0), window):
        w = a[at : at + window + 2].astype(np.uint32)
        code = w[:-2] | w[1:-1] << np.uint32(8) | w[2:] << np.uint32(16)
        seen.add(((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
    at, before = 0, np.zeros(0, np.uint64)  # hash and token of the word before the window
    while at < len(a):
        end = min(len(a), at + window)
        heads, h, last = _words(a[at:end])
        cut = end < len(a) and last == end - at  # the last word may go on behind the window
        at = at + int(heads[-1]) if cut else end
        h = h[:-1] if cut else h
        if not len(h):
            continue
        raw = np.append(before[:1], h)
        token = np.append(raw[0], np.where(raw[1:] == raw[:-1], _REPEAT, raw[1:]))
        if len(before):
            token[0] = before[1]
        seen.add(_bucket(token[len(before[:1]) :] * _ONE))
        seen.add(_bucket(token[:-1] * _FIRST + token[1:] * _SECOND))
        before = np.array([raw[-1], token[-1]])
    return seen.result()
