"""Line-first quality rules.

Every line is judged by itself: punctuation (too many symbols or exclamation
marks), shouting, navigation (menus, breadcrumbs) and boilerplate phrases. Lines
that fail are taken out; a document that loses more than ``max_loss`` of its
word characters, or whose words fail the base rules, is rejected.

Defined cases: a null or empty text has no words and is rejected; a line without
a word is neutral; repeated rows are judged each by itself; other columns,
whatever their names, are passed through untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import SPACES, numbered, strings

# Fixed values of the line rules.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·"
MAX_SYMBOL_PCT = 10  # symbols and exclamation marks, of a line's word characters
MIN_SHOUT_LETTERS = 20
MAX_UPPER_PCT = 80
MIN_SEPARATORS = 3
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "click here",
    "cookie policy",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up for our newsletter",
    "skip to content",
    "subscribe to our newsletter",
    "terms of service",
    "terms of use",
)
NAVIGATION = ("about us", "back to top", "contact us", "home", "log in", "login", "menu", "next", "previous", "register", "search", "sign in", "sitemap")

MAX_LOSS = 0.5
MIN_WORDS = 10
MAX_REPEAT_PCT = 20
WINDOW = 5

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines_removed long, chars_removed long, cleaned string"

_SPACES = frozenset(SPACES)
_WORD = re.compile(r"[^\x20\x09-\x0D]")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTER = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]")


def _count(text: str, chars: str) -> int:
    return sum(text.count(c) for c in chars)


def line_fails(line: str) -> str | None:
    """The first rule that a line with a word fails, or None."""
    chars = len(line) - _count(line, SPACES)
    if 100 * (_count(line, SYMBOLS) + line.count("!")) > MAX_SYMBOL_PCT * chars:
        return "punctuation"
    upper = len(_UPPER.findall(line)) if not line.islower() else 0
    if upper >= MIN_SHOUT_LETTERS * MAX_UPPER_PCT // 100:
        letters = len(_LETTER.findall(line))
        if letters >= MIN_SHOUT_LETTERS and 100 * upper > MAX_UPPER_PCT * letters:
            return "punctuation"
    key = line.strip(SPACES).lower()
    if key in NAVIGATION or _count(line, SEPARATORS) >= MIN_SEPARATORS:
        return "navigation"
    if any(p in key for p in BOILERPLATE):
        return "boilerplate"
    return None


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of five words that occur at least twice; exact, by ranks of word pairs."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)[1]
    top = int(pairs.max()) + 1
    if top == len(pairs):
        return 0
    fours = np.unique(pairs[:-2] * top + pairs[2:], return_inverse=True)[1]
    _, where, counts = np.unique(fours[:n] * len(seen) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[where] > 1)
    if not len(starts):
        return 0
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    np.add.at(edge, starts + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def judge(text: str | None, max_loss: float = MAX_LOSS) -> tuple:
    """All figures of one text, in the order of FIELDS."""
    text = text or ""
    words = text.encode().split()
    word_chars = len(text) - _count(text, SPACES)
    earlier: set[str] = set()
    kept_lines, dup, removed, lost = [], 0, 0, 0
    for line in text.split("\n"):
        if not _WORD.search(line):
            kept_lines.append(line)
            continue
        dup += line in earlier
        earlier.add(line)
        if line_fails(line):
            removed += 1
            lost += len(line) - _count(line, SPACES)
        else:
            kept_lines.append(line)
    repeated = repeat_words(words)
    base = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PCT * len(words)
    kept = not base and lost <= max_loss * word_chars
    return len(words), word_chars, _count(text, SYMBOLS), dup, repeated, base, kept, removed, lost, "\n".join(kept_lines)


def quality(docs: DataFrame, text: str = "text", id_col: str = "doc_id", max_loss: float = MAX_LOSS, cleaned: bool = True) -> DataFrame:
    """``id_col`` and the columns of FIELDS, one row for each row of ``docs``; no shuffle."""
    dtype = dict(docs.dtypes)[id_col]
    fields = FIELDS if cleaned else FIELDS.rpartition(",")[0]
    # arrow batches carry every field the JVM declares, in its order
    def run(batches):
        for b in batches:
            rows = [judge(t, max_loss) for t in strings(b.column(1))]
            cols = list(zip(*rows)) if rows else [[] for _ in range(10)]
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            out = [b.column(0), *(pa.array(c, t) for c, t in zip(cols, types))]
            n = len(out) if cleaned else len(out) - 1
            yield pa.RecordBatch.from_arrays(out[:n], names=[id_col, *(f.split()[0] for f in FIELDS.split(", "))][:n])

    narrow = docs.select(F.col(id_col), F.col(text).cast("string"))
    return narrow.mapInArrow(run, f"`{id_col}` {dtype}, {fields}")


def clean_documents(docs: DataFrame, max_loss: float = MAX_LOSS) -> DataFrame:
    """Documents that pass, with the failing lines taken out of ``text`` and ``n_chars`` (if there) set anew; columns stay."""
    names, plain = docs.columns, numbered(docs)
    own_names = plain.columns

    def run(batches):
        for b in batches:
            rows = [judge(t, max_loss) for t in strings(b.column(names.index("text")))]
            keep = pa.array([r[6] for r in rows], pa.bool_())
            cols = []
            for name, col in zip(names, b.columns):
                if name == "text":
                    col = pa.array([r[9] for r in rows], pa.string())
                elif name == "n_chars":
                    col = pa.array([len(r[9]) for r in rows]).cast(col.type)
                cols.append(col)
            yield pa.RecordBatch.from_arrays(cols, names=own_names).filter(keep)

    return plain.mapInArrow(run, plain.schema).toDF(*names)
