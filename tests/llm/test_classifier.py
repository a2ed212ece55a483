import random
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm import nbsvm as N
from tidecast.llm.ngrams import BUCKETS, indicators
from tidecast.llm.op12 import held_out, query

SF = "/root/testdata/sf0.01"


def random_bytes(rng):
    return "".join(rng.choice(["a", "B", "é", " ", "  ", "\n", "abc", "abc abc ", "x" * 70, "漢"]) for _ in range(rng.randint(0, 90))).encode()


def test_indicators_do_not_depend_on_windows():
    rng = random.Random(1)
    for _ in range(200):
        text = random_bytes(rng)
        whole = indicators(text)
        assert all(np.array_equal(whole, indicators(text, w)) for w in (65, 71, 200))


def test_indicators_know_words_repeats_and_trigrams():
    def same(a, b):
        return set(indicators(a.encode())) == set(indicators(b.encode()))

    assert len(indicators(b"")) == 0 and len(indicators(b" \n\t")) <= 1
    assert len(indicators(b"ab")) == 1  # one word, no pair, no trigram
    assert set(indicators(b"ab")) == set(indicators(b"AB"))
    assert same("the cat the cat the cat the", "the cat the cat the")  # indicators, not counts
    assert same("no no no no", "no no no no no no")
    assert not same("no no", "no")
    long = b"ab" * (1 << 20)
    assert 3 <= len(indicators(long)) <= 10


def test_ratios_are_zero_for_unseen_buckets_and_signed():
    counts = np.zeros((2, 4))
    counts[:, 0] = 5, 0
    counts[:, 1] = 0, 50
    counts[:, 2] = 2, 20
    r = N.ratios(counts, np.array([10, 100]), 1.0)
    assert r[0] < 0 < r[1] and abs(r[2]) < 1e-9 and abs(r[3]) < 1e-12


def hinge_problem():
    rng = np.random.default_rng(4)
    own = [np.sort(rng.choice(30, rng.integers(0, 8), replace=False)) for _ in range(80)]
    label = np.array([int(x.sum() % 3 != 0) for x in own])
    return own, label, rng.normal(size=30)


def test_dual_coordinate_descent_reaches_the_optimum():
    """The primal value of the model equals the dual's to the tolerance, and no direction lowers it."""
    own, label, ratio = hinge_problem()
    w, b = N.descend(own, label, ratio, cost=2.0, sweeps=3000, tolerance=1e-9)
    x = np.zeros((len(own), 31))
    for i, o in enumerate(own):
        if len(o):
            x[i, o] = ratio[o] / np.sqrt((ratio[o] ** 2).sum())
        x[i, 30] = 1
    y = np.where(label == 1, 1, -1)
    cost = 2.0 * len(y) / (2 * np.bincount(label)[label])

    def primal(v):
        return v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()

    best = np.append(w, b)
    rng = np.random.default_rng(5)
    value = primal(best)
    assert all(primal(best + s * d) > value - 1e-6 for s in (1e-3, 1e-2, 0.1) for d in rng.normal(size=(200, 31)))


def test_curve_is_calibrated():
    rng = np.random.default_rng(6)
    margin = rng.normal(size=20_000)
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(2 * margin + 0.5)))).astype(int)
    slope, shift = N.fit_curve(margin, label, np.bincount(label).astype(float))
    assert slope == pytest.approx(2, abs=0.1) and shift == pytest.approx(0.5, abs=0.1)
    assert N.fit_curve(margin[:5], np.ones(5, int), np.array([3.0, 5.0])) == (1.0, 0.0)


def test_class_counts_are_brute_force(spark):
    rng = random.Random(7)
    rows = [(random_bytes(rng).decode(), rng.randint(0, 1)) for _ in range(60)] + [(None, 1), ("", 0)]
    counts, n = N.class_counts(spark.createDataFrame(rows, "text string, label int").repartition(5))
    want = np.zeros((2, BUCKETS), np.int64)
    for text, label in rows:
        want[label, indicators((text or "").encode())] += 1
    assert np.array_equal(counts, want)
    assert n.tolist() == [sum(1 - k for _, k in rows), sum(k for _, k in rows)]


SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("label", T.StringType()), ("own_id", T.StringType()), ("score", T.DoubleType()))])


def test_held_out_labels_nulls_repeats_and_clashing_columns(spark):
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows, marks = [], []
    for i in range(300):
        junk = i % 3 == 0
        rows.append((i, " ".join(rng.choice(words) + ("###" if junk else "") for _ in range(20)), "x", "y", 0.0))
        marks.append((i, 0 if junk else 1))
    rows += [(None, "alpha beta", None, None, None), (500, None, None, None, None), (501, "", None, None, None), rows[4], rows[4]]
    docs = spark.createDataFrame(rows, SCHEMA)
    odd = [(None, 0), (4, 1), (5, None), (7, 9), (9999, 0)]
    flipped = [(i, 1 - k) if zlib.crc32(str(i).encode()) % 4 == 2 else (i, k) for i, k in marks]
    out = []
    for told in (marks + odd, flipped + odd):
        model = N.learn(docs, spark.createDataFrame(told, "doc_id long, quality int"), ~held_out("own_id"))
        out.append(sorted(((r[0] is None, r[0] or 0), r[1]) for r in N.score(docs, model).collect()))
    assert out[0] == out[1]  # labels of held-out rows change nothing
    assert len(out[0]) == len(rows)
    by_id = {k[1]: s for k, s in out[0] if not k[0]}
    assert all((by_id[i] >= 0.7) == bool(k) for i, k in marks)
    assert by_id[500] == by_id[501] and 0 <= by_id[500] <= 1


def test_one_class_no_labels_and_no_documents(spark, make_docs):
    docs = make_docs([(1, "a b c"), (2, None)])
    labels = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert N.learn(docs, labels) == 0.75
    assert N.learn(docs, labels.limit(0)) == 0.5
    assert [r["score"] for r in N.score(docs, 0.75).collect()] == [0.75, 0.75]
    assert N.score(docs.limit(0), N.learn(docs.limit(0), labels)).count() == 0


def test_held_out_quality_of_the_given_table(spark):
    got = query(spark, SF).toPandas()
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    assert len(got) == len(pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id"]))
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    own = got[got["held_out"]].merge(labels, on="doc_id")
    assert (own["predicted"] == own["quality"]).mean() > 0.9


def test_held_out_marks_null_ids_false(spark):
    assert spark.range(1).select(F.lit(None).cast("long").alias("i")).select(held_out("i")).first()[0] is False
