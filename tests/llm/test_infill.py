import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import types as T

from tidecast.llm import infill
from tidecast.llm.infill import Marks, restore, transform

UNIT = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, marks=("<P>", "<S>", "<M>"), rate=100, spm=50, seed=7):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = UNIT.findall(text)
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), marks[1] + s + marks[0] + p + marks[2] + m
    return len(units), "psm", len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m


def random_texts(n, rng):
    letters = ["a", "é", "漢", "\U0001f600", "\n", "\n", " ", "<", ">", "P", "S", "M"]
    return [None, "", "\n", "\n\n", "x", "x\n", "<P>", "<", "<S", "a<M>b", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n))]


@pytest.mark.parametrize("window,block", [(7, 50), (1 << 20, 4 << 20)])
def test_outputs_and_round_trip_are_brute_force(spark, make_docs, monkeypatch, window, block):
    rng = random.Random(3)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(random_texts(400, rng))]
    docs = make_docs(rows + rows[:20])
    if window == 7:  # the arrays themselves in small windows; tasks use the defaults
        ids = np.array([i or 0 for i, _ in rows])
        raw = np.frombuffer("".join(t or "" for _, t in rows).encode(), np.uint8)
        starts = np.append(0, np.cumsum([len((t or "").encode()) for _, t in rows]))
        n, before = infill.units(raw, starts, window)
        assert n.tolist() == [len(UNIT.findall(t or "")) for _, t in rows]
        for k in (ids % (n + 1), n, n * 0):
            ends = infill.cuts(raw, starts, n, before, k, window)
            assert (ends - starts[:-1]).tolist() == [len("".join(UNIT.findall(t or "")[:x]).encode()) for x, (_, t) in zip(k, rows)]
        return
    got = restore(transform(docs)).collect()
    want = sorted(((i, *brute(i, t), t or "") for i, t in rows + rows[:20]), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_small_windows_scatter_and_gather_alike():
    rng = random.Random(5)
    texts = [(t or "").encode() for t in random_texts(200, rng)]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    marks = Marks()
    n, before = infill.units(raw, starts)
    form = np.where(infill.holds(raw, starts, marks) | (n == 0), 0, np.arange(len(texts)) % 2 + 1)
    c1, c2 = (infill.cuts(raw, starts, n, before, k) for k in (n // 3, n // 2))
    whole = infill.scatter(raw, starts, c1, c2, form, marks)
    small = infill.scatter(raw, starts, c1, c2, form, marks, size=5)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small))
    back = infill.gather(*small, form, marks, size=5)
    assert np.array_equal(back[0], raw) and np.array_equal(back[1], starts)


def test_a_mark_across_two_texts_is_none():
    texts = [b"a<", b"P>b", b"<P>", b"<", b"<S>"]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.append(0, np.cumsum([len(t) for t in texts]))
    assert infill.holds(raw, starts, Marks()).tolist() == [False, False, True, False, True]


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("", "x", "y"), ("aba", "x", "y"), ("ab", "bc", "z"), ("abc", "b", "z")])
def test_marks_that_could_be_mistaken_are_refused(marks):
    with pytest.raises(ValueError):
        Marks(*marks)


def test_own_marks_rates_and_clashing_columns(spark):
    schema = T.StructType([T.StructField(n, t) for n, t in (("key.id", T.StringType()), ("body", T.StringType()), ("n", T.LongType()), ("form", T.StringType()), ("restored", T.StringType()))])
    rows = [(f"k{i}", f"line {i}\n" * (i % 5), i, "x", "y") for i in range(60)]
    docs = spark.createDataFrame(rows, schema)
    marks = Marks("[pre]", "{suf}", "(mid)")
    got = restore(transform(docs, "key.id", "body", marks, rate=40, spm_rate=100, seed=9), marks).collect()
    want = {k: (*brute(k, t, ("[pre]", "{suf}", "(mid)"), 40, 100, 9), t) for k, t, *_ in rows}
    assert {r[0]: tuple(r)[1:] for r in got} == want
    assert {r["form"] for r in got} == {"plain", "spm"}


def test_long_text_and_empty_table(spark, make_docs):
    text = "é line of text\n" * 400_000 + "tail"
    (row,) = restore(transform(make_docs([(5, text)]))).collect()
    assert row["restored"] == text and row["output"] == brute(5, text)[-1]
    assert transform(make_docs([])).count() == 0
