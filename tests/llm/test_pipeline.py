import re

import pytest

import corpus_pipeline
from simhash_brute import brute_components, brute_fingerprint
from tidecast.llm.common import SPACES, written
from tidecast.llm.quality import judge

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
NAMES = ["quality rules", "line dedup", "simhash near-dedup", "benchmark decontamination", "best-fit packing"]


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_lines(docs):
    owner = {}
    held = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            key = low(line.strip(SPACES))
            if len(key) >= 10:
                held.setdefault(key, set()).add(i)
    owner = {k: min(v) for k, v in held.items() if len(v) > 1}
    return {i: "\n".join(x for x in t.split("\n") if owner.get(low(x.strip(SPACES)), i) == i) for i, t in docs.items()}


def brute_near(docs):
    fps = {i: brute_fingerprint(t) for i, t in docs.items()}
    root = brute_components(set(fps.values()))
    first = {}
    for i in sorted(docs):
        first.setdefault(root[fps[i]], i)
    return {i: docs[i] for i in first.values()}


def brute_clean(docs, items):
    windows = set()
    for t in items:
        w = WORD.findall(low(t or ""))
        n = min(10, len(w))
        windows |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
    sizes = {len(x) for x in windows}
    out = {}
    for i, t in docs.items():
        w = WORD.findall(low(t))
        if not any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1)):
            out[i] = t
    return out


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_stages_against_brute_force(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs, want = documents, {r.doc_id: r.text for r in documents.collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    steps = [lambda d: {i: v[9] for i, t in d.items() if (v := judge(t))[6]}, brute_lines, brute_near, lambda d: brute_clean(d, items)]
    for (name, stage), brute in zip(corpus_pipeline.STAGES, steps):
        docs = written(stage(spark, docs, SF), "test")
        assert docs.columns == documents.columns and dict(docs.dtypes) == dict(documents.dtypes)
        before, want = len(want), brute(want)
        assert {r.doc_id: r.text for r in docs.collect()} == want, name
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert 0 < len(want) <= before
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(want)


def test_run_on_odd_rows(spark, tmp_path, make_docs):
    text = "A plain sentence of ten words or more that says a little number {}."
    rows = [(1, text.format(1)), (1, text.format(1)), (2, None), (None, text.format("none")), (3, text.format(1)), (4, "")]
    make_docs(rows).selectExpr("*", "lang AS slot", "n_chars AS fp", "lang AS n_lines").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "not in there at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString()
    assert {r.n_lines for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()} == {"en"}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {1, 3, None} and out


def test_run_on_an_empty_table(spark, tmp_path, make_docs):
    make_docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    """Names that operators use inside, names with a dot, and ids that repeat."""
    from pyspark.sql import types as T

    extra = ["__own", "__drops", "__id", "__tie", "__root", "__fp", "a.b", "own", "drops", "c0", "fp", "kept_id", "bad_id", "row", "lines"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), *(T.StructField(n, T.StringType()) for n in extra)])
    body = "A first long line of words here\nand a second line that stands in several documents\nmore words to have enough of them"
    texts = {1: body, 2: body + " two and three and four", 3: "something else entirely with its own ten words and a few more of them", 4: None}
    rows = [(i, t, *(f"{n}-{i}" for n in extra)) for i, t in texts.items()]
    items = spark.createDataFrame([("q", "something else entirely with its own ten words and a few")], "item_id string, text string")
    for frame in (rows, rows + [rows[0], (1, body, *("z" for _ in extra)), (None, "no id at all", *extra)]):
        docs = spark.createDataFrame(frame, schema)
        stages = [
            corpus_pipeline.clean_documents(docs),
            corpus_pipeline.drop_lines(docs, counts=("n1", "n2")).drop("n1", "n2"),
            corpus_pipeline.keep_one(docs),
            corpus_pipeline.clean(docs, items),
        ]
        for out in stages:
            assert out.columns == docs.columns
            for r in out.collect():
                assert r["doc_id"] is None or r["__own"] in (f"__own-{r['doc_id']}", "z")
        kept = [r for r in stages[2].collect() if r["doc_id"] == 1]
        assert len(kept) == 1
        assert not [r for r in stages[3].collect() if r["doc_id"] == 3]


def test_the_kept_one_of_equal_ids_is_the_same_every_time(spark, make_docs):
    rows = [(1, "b b b b"), (1, "a a a a"), (1, "b b b b"), (2, "other words")]
    for parts in (1, 2, 4):
        got = corpus_pipeline.keep_one(make_docs(rows).repartition(parts)).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, "a a a a"), (1, "b b b b"), (2, "other words")]
