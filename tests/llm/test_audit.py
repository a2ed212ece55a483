import random
from itertools import permutations

import pytest
from pyspark.sql import types as T

from tidecast.llm.audit import CopyFilter, Figures, TextFilter, audit
from tidecast.llm.op13 import FILTERS

SMALL = [
    TextFilter("A", lambda t: len(t.words) < 3),
    TextFilter("B", lambda t: 100 * len(set(t.words)) < 50 * len(t.words)),
    TextFilter("D", lambda t: t.count(b"#$") > 0),
    CopyFilter("E"),
]
LOSSES = {"good_lost": "quality = 1", "toxic_lost": "toxic = 1"}
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("part", T.StringType()), ("row", T.LongType()), ("counts", T.StringType()), ("fails_A", T.BooleanType()))])


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    fails, parts = [], []
    for i, t, lang in rows:
        known = Figures(t or "")
        own = {f.name for f in SMALL if isinstance(f, TextFilter) and f.fails(known)}
        if i is not None and first[t or ""] < i:
            own.add("E")
        fails.append(own)
        parts.append(lang or "")
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out, total = {}, {}
    for part in set(parts):
        own = [(r[0], f) for r, f, p in zip(rows, fails, parts) if p == part]
        for order in permutations("ABDE"):
            gone = set()
            for step, name in enumerate(order, 1):
                here = [i for i, f in own if name in f and not f & gone]
                redundant = sum(1 for _, f in own if name in f and f & gone)
                gone = gone | {name}
                kept = sum(1 for _, f in own if not f & gone)
                total[part, name] = total.get((part, name), 0) + len(here)
                out[part, "".join(order), step] = [kept, len(here), redundant, sum(1 for _, f in own if f == {name}), sum(i in good for i in here), sum(i in toxic for i in here)]
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_all_orders_are_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d", "a a a a a", "a $ b c", "x y", "one two three four #", "b b b b b $"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(None, "a b c d", "en"), (None, "x y", "de"), rows[3], rows[3], (7, "other text of an id seen", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 160, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, "zz", 1, "c", True) for i, t, p in rows], SCHEMA).repartition(4)
    got = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), SMALL, LOSSES, part_col="lang")
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == brute(rows, labels)


def test_zeros_are_rows_and_an_empty_table_has_none(spark, make_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    clean = make_docs([(1, "a b c d e"), (2, "f g h i j")])
    got = audit(clean, labels, SMALL, LOSSES, part_col="lang").collect()
    assert len(got) == 24 * 4 and {(r["kept"], r["removed"], r["shapley"]) for r in got} == {(2, 0, 0)}
    assert audit(make_docs([]), labels, SMALL, LOSSES, part_col="lang").count() == 0


def test_conditions_of_the_query():
    fails = {f.name: f.fails for f in FILTERS if isinstance(f, TextFilter)}
    words = " ".join(f"w{i}" for i in range(200))
    assert not any(f(Figures(words)) for f in fails.values())
    assert fails["A"](Figures(words[:-5])) and fails["A"](Figures(""))
    assert fails["B"](Figures("a a a")) and not fails["B"](Figures("a a")) and not fails["B"](Figures("A a é É"))
    assert fails["C"](Figures("ABCD" + "é" * 96)) and not fails["C"](Figures("ABC" + "é" * 97)) and not fails["C"](Figures(""))
    assert all(fails["D"](Figures(f"x{c}")) for c in "#$%&*|") and not fails["D"](Figures("<>!@^"))


@pytest.mark.parametrize("filters", [[], [CopyFilter("A"), CopyFilter("A")], [CopyFilter("AB")]])
def test_filters_need_letters_of_their_own(spark, make_docs, filters):
    with pytest.raises(ValueError):
        audit(make_docs([]), make_docs([]), filters, {}, part_col="lang")
