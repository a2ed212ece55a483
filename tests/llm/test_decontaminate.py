import pandas as pd
import pytest

from tidecast.llm import op3
from tidecast.llm.decontaminate import clean, contamination

LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (2, "Short item here"), (3, None), (4, "!!"), (10, LONG.upper() + " more"), (None, "nameless words stand here in one row as an item too"), (5, "É è"), (6, "ΟΔΟΣ one two")]
DOCS = [
    (1, f"before {LONG} after"), (2, "one two three four five six seven eight nine, TEN!"), (3, "a short ITEM-here and short item there"),
    (4, None), (5, ""), (6, "nothing of the kind " * 40), (7, f"{LONG} {LONG} " * 5), (8, "nameless words stand here in one row as an item too"),
    (9, "é è"), (9, "É è"), (9, "É è"), (None, LONG), (12, "one two three four five six seven eight nine x ten"), (13, "ΟΔΟΣ' ONE two."),
]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_against_sql(spark, make_docs, oracle, broadcast):
    docs = make_docs(DOCS).selectExpr("*", "lang AS words", "lang AS tie", "lang AS least")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = contamination(docs, items, broadcast=broadcast)
    got = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.n_items, ",".join(r["items"]), r.contaminated) for r in got.collect()))
    want = oracle(op3.SQL.replace("sha256(coalesce(items, ''))", "coalesce(items, '')"), documents=pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}), benchmark=pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    want = sorted((0 if pd.isna(r.doc_id) else int(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in want.itertuples())
    assert got == want
    assert [x[:4] for x in got if x[0] == 9] == [(9, 2, 0, 0), (9, 2, 2, 1), (9, 2, 2, 1)]


def test_clean_and_empty_tables(spark, make_docs):
    docs, items = make_docs(DOCS), spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = clean(docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [4, 5, 6, 9, 12]
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean(docs, none).count() == len(DOCS)
    assert contamination(make_docs([]), items).count() == 0
