"""Token ids of whole texts with a byte-level BPE file of the tokenizers library.

Texts are cut into units at places where the library's pre-tokenizer cuts whatever
stands around them: before a single space beside a word or sign, around a lone line
end between such, and between ASCII letters (and Latin-1 ones), digits and signs. So a
text's ids are the ids of its units in a row. Cuts, unit hashes (two of 64 bits) and the
final gathering are array operations over about ``BLOCK`` bytes of texts at a time; a
unit goes to the library when a Python worker first meets it and its ids are remembered.
Beyond ``REMEMBER`` units those not met for longest are forgotten, half of them at once.
Units of plain letters, signs or a line end go straight to the library's BPE model, all
others to its whole encoder; units over ``LONG`` bytes are not remembered.

A text is first cut at the file's added tokens (such as `<|endoftext|>`), which get
their own ids as in the library's plain call; what stands between them is encoded
as texts of their own. An ``Encoder`` made without ``added`` takes the strings of
special tokens as ordinary text; no operator uses it so.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

from tidecast.llm.common import quiet_threads

END_ID = 0
REMEMBER = 1_000_000
LONG = 64
BLOCK = 1 << 20

_RUNS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[!-&(-/:-@\[-`{-~]+|\n")
_SPACE_TWICE = re.compile(r"\s\s|\s\Z")
_PART = re.compile(r"[A-Za-z0-9](?= [A-Za-z0-9])")
_U = np.uint64
if sys.byteorder != "little":
    raise ImportError("ids are written as little-endian 32-bit integers of this machine")


def _byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, the others for 256 and up in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


# Byte classes: letters, digits, ASCII signs, the apostrophe (it may begin a contraction), the space, the line end; 0 for all others.
_LETTER, _DIGIT, _SIGN, _QUOTE, _SPACE, _LINE = range(1, 7)


def _classes() -> np.ndarray:
    out = np.zeros(256, np.uint8)
    for c in range(0x21, 0x7F):
        out[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _SIGN
    out[[0x27, 0x20, 0x0A]] = _QUOTE, _SPACE, _LINE
    return out


def _pairs() -> np.ndarray:
    """Whether the pre-tokenizer always cuts between a byte of one class and one of the other."""
    out = np.zeros((7, 7), bool)
    words = (_LETTER, _DIGIT, _SIGN)
    for a in words:
        out[a, [b for b in words if b != a]] = True
    out[[_LETTER, _DIGIT], _QUOTE] = True
    return out


_CLASS, _CUTS = _classes(), _pairs()
_rng = np.random.default_rng(9)
_BYTE, _PLACE = (_rng.integers(1, 1 << 63, (2, n), dtype=np.uint64) * _U(2) + _U(1) for n in (256, LONG))


def unit_starts(raw: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the units of texts in a row begin; ``starts`` are the texts' own starts and the end of the last."""
    kind = _CLASS[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF are letters but for two signs
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    before, after = np.append(np.uint8(0), kind[:-1]), np.append(kind[1:], np.uint8(0))
    edge = starts[(starts > 0) & (starts < len(raw))]
    before[edge] = after[edge - 1] = 0
    sure_before, sure_after = ((x > 0) & (x < _SPACE) for x in (before, after))
    cut = _CUTS[before, kind]
    cut |= (kind == _SPACE) & (sure_before | sure_after)
    line = (kind == _LINE) & sure_before & sure_after
    cut |= line
    cut[1:] |= line[:-1]
    cut[starts[:-1][starts[:-1] < len(raw)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Encodes texts; remembers the ids of units."""

    def __init__(self, path: str, added: bool = False, remember: int = REMEMBER):
        quiet_threads()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        tokens = self.tokenizer.get_added_tokens_decoder() if added else {}
        self.added = {t.content: np.array([i], np.uint32) for i, t in tokens.items()}
        self.cut = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        # Tokens that look at or take in what stands beside them are left to the library.
        self.wide = any(t.single_word or t.lstrip or t.rstrip for t in tokens.values())
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.space = self.letters[0x20]
        self.remember, self.turn = remember, 0
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.met = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.pool = np.zeros(0, np.uint32)

    def ids(self, unit: str) -> list[int]:
        """Ids of a unit by the library."""
        if unit.isascii():
            word = unit[1:] if unit[0] == " " else unit
            if word.isalpha():
                return [t.id for t in self.model.tokenize(self.space + word if word is not unit else word)]
        runs = _RUNS.findall(unit)
        if sum(map(len, runs)) == len(unit) and not ("\n" in unit and _SPACE_TWICE.search(unit)):
            spelled = (r.encode().decode("latin-1").translate(self.letters) for r in runs)
            return [t.id for s in spelled for t in self.model.tokenize(s)]
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def _met(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of each unit's ids in the pool; new units are encoded and remembered."""
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        place = np.searchsorted(self.hash, h[first])
        known = place < len(self.hash)
        known[known] = (self.hash[place[known]] == h[first[known]]) & (self.check[place[known]] == check[first[known]])
        new = first[~known]
        if len(new):
            data = raw.tobytes()
            made = [self.ids(data[a:z].decode()) for a, z in zip(starts[new].tolist(), ends[new].tolist())]
            size = np.fromiter(map(len, made), np.int64, len(made))
            at = len(self.pool) + np.cumsum(size) - size
            self.pool = np.concatenate([self.pool, np.fromiter((i for x in made for i in x), np.uint32, int(size.sum()))])
            self._add(h[new], check[new], at, size)
            place = np.searchsorted(self.hash, h[first])
        self.met[place] = self.turn
        return self.at[place][which], self.size[place][which]

    def _add(self, *columns: np.ndarray) -> None:
        """Merge units into the table sorted by hash; a hash that is there already under another check is replaced."""
        both = [np.concatenate([new, old]) for new, old in zip((*columns, np.full(len(columns[0]), self.turn, np.int32)), (self.hash, self.check, self.at, self.size, self.met))]
        _, keep = np.unique(both[0], return_index=True)  # the first of equals, which is the new one
        self.hash, self.check, self.at, self.size, self.met = (x[keep] for x in both)

    def _forget(self) -> None:
        """Once over ``remember`` units, keep the later half of them by the time they were last met."""
        if len(self.hash) <= self.remember:
            return
        keep = np.sort(np.argsort(-self.met.astype(np.int64), kind="stable")[: self.remember // 2])
        size = self.size[keep]
        self.pool = self.pool[_spans(self.at[keep], size)]
        self.hash, self.check, self.met, self.size, self.at = self.hash[keep], self.check[keep], self.met[keep], size, np.cumsum(size) - size

    def _block(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of texts without added tokens."""
        starts = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        raw = np.frombuffer(b"".join(texts), np.uint8)
        if not len(raw):
            return [np.zeros(0, np.uint32)] * len(texts)
        self.turn += 1
        head = unit_starts(raw, starts)
        ends = np.append(head[1:], len(raw))
        length = ends - head
        place = np.arange(len(raw)) - np.repeat(head, length)
        long = length > LONG
        if long.any():
            place %= LONG
        h, check = (np.add.reduceat(b[raw] * p[place], head) ^ length.astype(np.uint64) for b, p in zip(_BYTE, _PLACE))
        at, size = np.zeros(len(head), np.int64), np.zeros(len(head), np.int64)
        short = np.flatnonzero(~long)
        at[short], size[short] = self._met(raw, head[short], ends[short], h[short], check[short]) if len(short) else (0, 0)
        pool = self.pool
        if long.any():
            own = [np.array(self.ids(raw[a:z].tobytes().decode()), np.uint32) for a, z in zip(head[long], ends[long])]
            size[long] = [len(x) for x in own]
            at[long] = len(pool) + np.cumsum(size[long]) - size[long]
            pool = np.concatenate([pool, *own])
        ids = pool[_spans(at, size)]
        until = np.append(0, np.cumsum(size))[np.searchsorted(head, starts)]
        self._forget()
        return [ids[a:z] for a, z in zip(until, until[1:])]

    def _pieces(self, text: str) -> Iterator[bytes]:
        """A long text in blocks that end where the pre-tokenizer cuts."""
        at = 0
        while at < len(text):
            found = _PART.search(text, at + BLOCK // 2) if len(text) - at > BLOCK else None
            end = found.end() if found else len(text)
            yield text[at:end].encode()
            at = end

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Little-endian 32-bit ids of every text, its end id included; null is an empty text."""
        waiting: list[list] = []  # a text's parts: ids, or the place of bytes in ``held``
        held: list[bytes] = []
        size = 0

        def out() -> Iterator[bytes]:
            made = self._block(held)
            for parts in waiting:
                yield b"".join([(made[p] if isinstance(p, int) else p).tobytes() for p in parts]) + _END
            waiting.clear()
            held.clear()

        for text in texts:
            parts: list = []
            if text and self.wide and any(t in text for t in self.added):
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
            elif text:
                for x in self.cut.split(text) if any(t in text for t in self.added) else (text,):
                    if x in self.added:
                        parts.append(self.added[x])
                        continue
                    for piece in self._pieces(x) if len(x) > BLOCK else (x.encode(),):
                        if len(piece) > BLOCK // 2:  # large pieces are encoded by themselves, so that one text's blocks are not held together
                            parts.append(self._block([piece])[0])
                            continue
                        parts.append(len(held))
                        held.append(piece)
                        size += len(piece)
            waiting.append(parts)
            if size >= BLOCK:
                yield from out()
                size = 0
        yield from out()


_END = np.array([END_ID], "<u4").tobytes()


def _spans(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """at[0], at[0] + 1, ... of ``size[0]`` numbers, then those of the next."""
    before = np.cumsum(size) - size
    return np.repeat(at - before, size) + np.arange(int(size.sum()))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    return Encoder(path, added=True)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
