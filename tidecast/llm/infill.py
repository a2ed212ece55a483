"""Fill-in-middle transformation by displacement scatter, and its inverse.

A text is cut into units (lines with their line end) and two cuts, drawn from a
SHA-256 of seed and row id, part it into prefix, middle and suffix. The output
holds the three parts behind marks of their own, as prefix, suffix, middle (psm) or
suffix, prefix, middle (spm).

A batch is one array of bytes. Line ends are scanned in windows: the first scan
counts them per text, the second finds where the drawn units end. Every part moves
as a whole, so a byte's displacement changes only where a part begins: these changes
go into a difference array, its cumulative sum is each byte's displacement, and one
numpy scatter a window writes the output. The inverse finds the marks in the output,
builds the same differences and gathers. Windows bound the arrays, so a very long
text costs its own bytes in and out and no multiple of them.

Defined cases: null or empty text, a text that holds a mark, and texts left out by
``rate`` stay plain (output is the text, counts null); a null id is drawn as the
empty id; repeated rows are drawn alike; an empty table gives no rows; columns other
than id and text are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 7
RATE = 100
SPM_RATE = 50
WINDOW = 1 << 20
BLOCK = 4 << 20
PLAIN, PSM, SPM = 0, 1, 2
FORMS = pa.array(["plain", "psm", "spm"])
_LF = 10


@dataclass(frozen=True)
class Marks:
    """Strings that stand before prefix, suffix and middle. None may begin where another (or itself) ends, so that they are found again without doubt."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        own = [m.encode() for m in (self.prefix, self.suffix, self.middle)]
        for i, a in enumerate(own):
            for j, b in enumerate(own):
                overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) or (i != j and a in b)
                if not a or overlap:
                    raise ValueError(f"marks must be distinct, not empty and must not overlap: {self}")

    def encoded(self) -> tuple[bytes, bytes, bytes]:
        return self.prefix.encode(), self.suffix.encode(), self.middle.encode()


# ---------------------------------------------------------------- arrays of a block of texts


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column in a row, and the places where its texts begin (and the last ends); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, starts, data = column.buffers()
    at = np.frombuffer(starts, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if starts else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def string_array(raw: np.ndarray, starts: np.ndarray) -> pa.Array:
    return pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)).cast(pa.string())


def blocks(starts: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes; a longer text is a run of its own."""
    out, a = [], 0
    while a < len(starts) - 1:
        b = max(a + 1, int(np.searchsorted(starts, starts[a] + most, side="right")) - 1)
        out.append((a, b))
        a = b
    return out


def windows(n: int, size: int):
    return ((a, min(n, a + size)) for a in range(0, n, size))


def units(raw: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Number of units of every text, and the number of line ends before each text's start."""
    before = np.zeros(len(starts), np.int64)
    seen = 0
    for a, b in windows(len(raw), size):
        ends = np.flatnonzero(raw[a:b] == _LF) + a
        own = slice(*np.searchsorted(starts, (a, b)))
        before[own] = seen + np.searchsorted(ends, starts[own])
        seen += len(ends)
    before[starts >= len(raw)] = seen
    filled = starts[1:] > starts[:-1]
    tail = np.zeros(len(starts) - 1, bool)
    tail[filled] = raw[starts[1:][filled] - 1] != _LF
    return np.diff(before) + tail, before


def cuts(raw: np.ndarray, starts: np.ndarray, n: np.ndarray, before: np.ndarray, k: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Where the first ``k`` units of every text end."""
    out = np.where(k <= 0, starts[:-1], starts[1:])
    inner = np.flatnonzero((k > 0) & (k < n))
    wanted = before[inner] + k[inner] - 1
    order = np.argsort(wanted, kind="stable")
    inner, wanted = inner[order], wanted[order]
    seen = 0
    for a, b in windows(len(raw), size):
        ends = np.flatnonzero(raw[a:b] == _LF) + a
        own = slice(*np.searchsorted(wanted, (seen, seen + len(ends))))
        out[inner[own]] = ends[wanted[own] - seen] + 1
        seen += len(ends)
    return out


def holds(raw: np.ndarray, starts: np.ndarray, marks: Marks) -> np.ndarray:
    """Which texts hold a mark."""
    found = np.zeros(len(starts) - 1, bool)
    for m in marks.encoded():
        at = np.fromiter((x.start() for x in re.finditer(b"(?=" + re.escape(m) + b")", memoryview(raw))), np.int64)
        text = np.searchsorted(starts, at, side="right") - 1
        found[text[at + len(m) <= starts[text + 1]]] = True
    return found


def displaced(raw: np.ndarray, places: np.ndarray, moves: np.ndarray, out: np.ndarray, size: int = WINDOW, inverse: bool = False) -> None:
    """Scatter ``raw`` into ``out`` (or gather ``raw`` from it): a byte from ``places[i]`` on moves by ``moves[i]`` until the next place."""
    jumps = np.diff(moves, prepend=0)
    shift = 0
    for a, b in windows(len(raw), size):
        own = slice(*np.searchsorted(places, (a, b)))
        step = np.zeros(b - a, np.int64)
        np.add.at(step, places[own] - a, jumps[own])
        step[0] += shift
        step = np.cumsum(step)
        shift = step[-1]
        step += np.arange(a, b)
        if inverse:
            raw[a:b] = out[step]
        else:
            out[step] = raw[a:b]


def _put(out: np.ndarray, at: np.ndarray, mark: bytes) -> None:
    for k, byte in enumerate(mark):
        out[at + k] = byte


def _layout(starts: np.ndarray, c1: np.ndarray, c2: np.ndarray, form: np.ndarray, marks: Marks) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Output starts, and for prefix, middle and suffix of every text where they begin in text and output (3 a text)."""
    p, s, m = (len(x) for x in marks.encoded())
    sizes = np.diff(starts) + np.where(form == PLAIN, 0, p + s + m)
    outs = np.append(0, np.cumsum(sizes))
    a, z, o = starts[:-1], starts[1:], outs[:-1]
    pre, mid, suf = c1 - a, c2 - c1, z - c2
    to_p = np.select([form == PSM, form == SPM], [o + p, o + s + suf + p], o)
    to_s = np.select([form == PSM, form == SPM], [o + p + pre + s, o + s], o + pre + mid)
    to_m = np.select([form == PSM, form == SPM], [o + p + pre + s + suf + m, o + s + suf + p + pre + m], o + pre)
    return outs, np.column_stack([a, c1, c2]), np.column_stack([to_p, to_m, to_s]), form != PLAIN


def scatter(raw: np.ndarray, starts: np.ndarray, c1: np.ndarray, c2: np.ndarray, form: np.ndarray, marks: Marks, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of all outputs."""
    outs, places, to, cut = _layout(starts, c1, c2, form, marks)
    out = np.empty(outs[-1], np.uint8)
    displaced(raw, places.ravel(), (to - places).ravel(), out, size)
    for part, mark in zip(range(3), (marks.encoded()[0], marks.encoded()[2], marks.encoded()[1])):
        _put(out, to[cut, part] - len(mark), mark)
    return out, outs


def gather(out: np.ndarray, outs: np.ndarray, form: np.ndarray, marks: Marks, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and starts of the texts that the outputs were made of."""
    cut = np.flatnonzero(form != PLAIN)
    at = {}
    view = memoryview(out)
    for name, mark in zip("PSM", marks.encoded()):
        found = np.fromiter((x.start() for x in re.finditer(re.escape(mark), view)), np.int64)
        text = np.searchsorted(outs, found, side="right") - 1
        found, text = found[form[text] != PLAIN], text[form[text] != PLAIN]
        if not np.array_equal(text, cut):
            raise ValueError(f"an output does not hold the mark {mark!r} exactly once")
        at[name] = found
    p, s, m = (len(x) for x in marks.encoded())
    end, psm = outs[1:][cut], form[cut] == PSM
    pre = np.where(psm, at["S"], at["M"]) - at["P"] - p
    mid = end - at["M"] - m
    sizes = np.diff(outs)
    sizes[cut] -= p + s + m
    starts = np.append(0, np.cumsum(sizes))
    places = np.repeat(starts[:-1, None], 3, axis=1)
    moved = np.repeat(outs[:-1, None], 3, axis=1)
    places[cut, 1] += pre
    places[cut, 2] += pre + mid
    moved[cut] = np.column_stack([at["P"] + p, at["M"] + m, at["S"] + s])
    raw = np.empty(starts[-1], np.uint8)
    displaced(raw, places.ravel(), (moved - places).ravel(), out, size, inverse=True)
    return raw, starts


def code_points(raw: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points of the bytes a[i] to b[i]."""
    return np.fromiter((np.count_nonzero((raw[x:y] & 0xC0) != 0x80) for x, y in zip(a, b)), np.int64, len(a))


# ---------------------------------------------------------------- tables


def draws(id_col: str, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a row: the first hex groups of a SHA-256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: Marks = Marks(), rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output) of every row; no shuffle."""
    dtype = docs.schema[id_col].dataType.simpleString()

    def block(ids: pa.Array, raw: np.ndarray, starts: np.ndarray, h: list[np.ndarray]) -> pa.RecordBatch:
        n, before = units(raw, starts)
        k1, k2 = h[0] % (n + 1), h[1] % (n + 1)
        plain = (starts[1:] == starts[:-1]) | holds(raw, starts, marks) | (h[2] % 100 >= rate)
        form = np.where(plain, PLAIN, np.where(h[3] % 100 < spm_rate, SPM, PSM))
        c1, c2 = (cuts(raw, starts, n, before, k) for k in (np.minimum(k1, k2), np.maximum(k1, k2)))
        out, outs = scatter(raw, starts, c1, c2, form, marks)
        pre, mid = (pa.array(code_points(raw, a, b), pa.int64(), mask=plain) for a, b in ((starts[:-1], c1), (c1, c2)))
        cols = [ids, pa.array(n, pa.int64()), FORMS.take(pa.array(form)), pre, mid, string_array(out, outs)]
        return pa.RecordBatch.from_arrays(cols, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    def run(batches):
        for b in batches:
            raw, starts = text_arrays(b.column(1))
            h = [b.column(i).to_numpy() for i in range(2, 6)]
            for x, y in blocks(starts, BLOCK):
                yield block(b.column(0).slice(x, y - x), raw[starts[x] : starts[y]], starts[x : y + 1] - starts[x], [v[x:y] for v in h])

    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), *draws(f"`{id_col}`", seed))
    return rows.mapInArrow(run, f"id {dtype}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restore(outputs: DataFrame, marks: Marks = Marks(), output_col: str = "output", form_col: str = "form", restored_col: str = "restored") -> DataFrame:
    """``outputs`` with the exact texts rebuilt from output and form alone in ``restored_col`` (replaced if there)."""
    outputs = outputs.drop(restored_col)
    names = outputs.columns
    plain_names = [f"c{i}" for i in range(len(names) + 1)]  # Arrow functions take no column with a dot in its name
    at, kind = names.index(output_col), names.index(form_col)
    numbers = {"plain": PLAIN, "psm": PSM, "spm": SPM}

    def run(batches):
        for b in batches:
            raw, starts = text_arrays(b.column(at))
            form = np.array([numbers[x] for x in b.column(kind).to_pylist()], np.int64)
            for x, y in blocks(starts, BLOCK):
                back = string_array(*gather(raw[starts[x] : starts[y]], starts[x : y + 1] - starts[x], form[x:y], marks))
                yield pa.RecordBatch.from_arrays([*(c.slice(x, y - x) for c in b.columns), back], names=plain_names)

    types = [f.dataType for f in outputs.schema] + [T.StringType()]
    schema = T.StructType([T.StructField(c, t) for c, t in zip(plain_names, types)])
    return outputs.toDF(*plain_names[:-1]).mapInArrow(run, schema).toDF(*names, restored_col)
