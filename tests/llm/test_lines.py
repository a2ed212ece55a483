import pandas as pd

from tidecast.llm import op2
from tidecast.llm.lines import drop_lines

LONG = "this very line is shared by many"


def result(frame):
    return {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in frame.collect()}


def test_edge_rows(spark, make_docs):
    rows = [(4, f"{LONG}\nown line of four\n  {LONG.upper()}\t"), (2, f"x\n {LONG}\nshort"), (3, "short\nshort"), (None, LONG), (5, None), (6, ""), (7, f"{LONG}"), (8, "twice in one only\ntwice in one only"), (9, "repeated row here"), (9, "repeated row here"), (10, "ÄÖÜäöüßéèê"), (11, "ÄÖÜäöüßéèê"), (12, "äöüäöüßéèê")]
    docs = make_docs(rows).selectExpr("*", "lang AS h", "lang AS n_lines")
    got = result(drop_lines(docs))
    assert got[4, "own line of four"] == (3, 2)
    assert got[2, f"x\n {LONG}\nshort"] == (3, 0)
    assert got[3, "short\nshort"] == (2, 0)
    assert got[None, LONG] == (1, 0) and got[5, None] == (1, 0) and got[6, ""] == (1, 0) and got[7, ""] == (1, 1)
    assert got[8, "twice in one only\ntwice in one only"] == (2, 0) and got[9, "repeated row here"] == (1, 0)
    assert got[10, "ÄÖÜäöüßéèê"] == (1, 0) and got[11, ""] == (1, 1) and got[12, "äöüäöüßéèê"] == (1, 0)
    assert set(docs.columns) <= set(drop_lines(docs).columns)


def test_many_small_shards_against_sql(spark, make_docs, oracle):
    rows = [(i, "\n".join(f"a common line number {(i * j) % 37}" for j in range(1, 6))) for i in range(120)] + [(500, None)]
    docs = make_docs(rows)
    got = drop_lines(docs.select("doc_id", "text"), shard_keys=3).selectExpr("doc_id", "n_lines", "n_dropped", "sha2(coalesce(text, ''), 256) AS kept_sha256").toPandas()
    want = oracle(op2.SQL, documents=pd.DataFrame(rows, columns=["doc_id", "text"]))
    cols = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert got.sort_values("doc_id")[cols].values.tolist() == want.sort_values("doc_id")[cols].values.tolist()
    assert got.n_dropped.sum() > 300


def test_empty_table(make_docs):
    assert drop_lines(make_docs([])).count() == 0
