import pandas as pd

from tidecast.llm import op8
from tidecast.llm.quality import clean_documents, judge, line_fails, quality, repeat_words

GOOD = "This is a plain sentence of words that anybody may read, and it ends well."
MORE = "Other words stand here so that nothing is said a second time."
ROWS = [
    (1, GOOD), (2, None), (3, ""), (4, f"{GOOD}\n\nHome\n{MORE}\n"), (5, "### $$$ %%% &&& *** <<< >>> ||| ### $$$ %%% &&&"),
    (6, "a b c d e " * 30), (7, f"{GOOD}\nACCEPT ALL COOKIES to go on\nHome | News | Sport | Login\n" + "THIS LINE SHOUTS AT EVERYONE WHO READS IT!"),
    (8, "Éäü ÀÖß " * 3 + GOOD), (9, "one two three four five six seven eight nine"), (10, GOOD), (10, GOOD), (None, GOOD), (11, " \n\t\n\x0b"), (12, "x" * 5000 + " " + GOOD),
]


def brute_repeats(words):
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
    return len(inside)


def test_repeats_against_brute_force():
    import random

    rng = random.Random(2)
    for _ in range(300):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 40))]
        assert repeat_words(words) == brute_repeats(words)


def test_rows_against_sql(spark, make_docs, oracle):
    docs = make_docs(ROWS).selectExpr("*", "lang AS kept", "n_chars AS n_words")
    got = quality(docs, cleaned=False).toPandas()
    want = oracle(op8.SQL, documents=pd.DataFrame(ROWS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    cells = lambda f: sorted(str([None if pd.isna(x) else int(x) for x in row]) for row in f[sorted(f.columns)].astype(object).values.tolist())
    assert cells(got) == cells(want)


def test_lines_and_documents():
    assert line_fails(GOOD) is None
    assert line_fails("Home › News › Sport › Login") == "navigation" and line_fails(" Log in ") == "navigation"
    assert line_fails("see our Cookie Policy for more") == "boilerplate"
    assert line_fails("THIS LINE SHOUTS AT EVERYONE") == line_fails("$$$ %%%") == "punctuation"
    assert judge(GOOD)[6] and not judge(None)[6] and not judge("\n".join(["Buy now!!!!!!"] * 8 + [GOOD]))[6]


def test_clean_documents_keeps_columns_and_clean_texts(spark, make_docs):
    docs = make_docs(ROWS).selectExpr("*", "lang AS kept")
    out = clean_documents(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert {r.doc_id for r in rows} >= {1, 4, 8, 10, 12, None} and not {2, 3, 5, 6, 9, 11} & {r.doc_id for r in rows}
    assert all(r.text == GOOD for r in rows if r.doc_id in (1, 10)) and all(r.n_chars == len(r.text) for r in rows)
    assert [r.text for r in rows if r.doc_id == 4] == [f"{GOOD}\n\n{MORE}\n"]
    assert clean_documents(make_docs([])).count() == 0
