import pandas as pd

from tidecast.llm import op5, op6
from tidecast.llm.chat import messages, rotate
from tidecast.llm.urls import judge_urls

TURNS = [
    (1, 0, "system", "Be kind."), (1, 1, "Ann", "Hi <|assistant|> é"), (1, 2, "Bob", None), (1, 3, " ", "who am I"), (1, 3, None, "who am I"), (1, 3, None, "who am I"),
    (2, 0, "system", "alone"), (None, 0, "Ann", "no conversation"), (3, None, "user", "no turn"), (3, 5, "assistant", ""), (3, 1500, "user", "later"), (4, 0, "a<|b", "x"), (4, 1, "system", ""),
]


def plain(frame):
    """Rows as texts, whole numbers alike in every type."""

    def cell(v):
        if pd.isna(v):
            return None
        return str(int(v)) if not isinstance(v, str) and float(v).is_integer() else str(v)

    return sorted(tuple(str(cell(v)) for v in row) for row in frame[sorted(frame.columns)].astype(object).values.tolist())


def test_rotation_against_sql(spark, oracle):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "role AS speaker", "turn AS place")
    got = rotate(turns).toPandas()
    pdf = pd.DataFrame(TURNS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    assert plain(got) == plain(oracle(op5.SQL, conversations=pdf))
    for r in got.itertuples():
        for span in filter(None, r.masks.split(",")):
            a, z = map(int, span.split("-"))
            assert r.text[:a].endswith("<|assistant|>\n") and r.text[a:z].endswith("<|end|>")
    assert set(got.speaker) == {"Ann", "Bob", "unknown", "user", "assistant", "a<|b"}


def test_rotation_goes_by_places_and_not_by_turn_numbers(spark, oracle):
    rows = [(1, 1000 * k, "ab"[k % 2], f"m{k}") for k in range(4)] + [(2, -5, "a", "first"), (2, None, "a", "last"), (2, 3, "b", "second")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    got = rotate(turns).toPandas()
    assert sorted(zip(got.conv_id, got.speaker, got.n_messages)) == [(1, "a", 4), (1, "b", 4), (2, "a", 3), (2, "b", 3)]
    assert got.text[got.conv_id == 2].map(lambda t: t.index("first") < t.index("second") < t.index("last")).all()
    pdf = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"turn": "Int64"})
    assert plain(got) == plain(oracle(op5.SQL, conversations=pdf))


def test_places_of_rows_that_repeat(spark):
    turns = spark.createDataFrame([(1, 0, "a", "same")] * 500 + [(1, 1, "b", "end"), (2, 0, "a", "x")], "conv_id long, turn long, role string, text string").repartition(7)
    rows = messages(turns).collect()
    assert sorted(r.place for r in rows if r.conv_id == 1) == list(range(501))
    assert [r.body for r in rows if r.conv_id == 1 and r.place == 500] == ["end"]


def test_rotation_splits_long_dialogues(spark):
    turns = spark.createDataFrame([(1, i, "ab"[i % 2], f"m{i}") for i in range(50)] + [(2, 0, "a", f"t{i}") for i in range(20)], "conv_id long, turn long, role string, text string")
    got = rotate(turns, block=8).collect()
    assert max(r.n_messages for r in got) == 8
    for who in "ab":
        text = "".join(r.text for r in sorted(got, key=lambda r: r.block) if r.conv_id == 1 and r.speaker == who)
        assert [int(x.split("<|end|>")[0]) for x in text.split("m")[1:] if x[0].isdigit()] == list(range(50))
    assert rotate(turns.limit(0)).count() == 0


def urls():
    out = [None, "", "no scheme", "http://", "https://Example.NET/en/1?x#y", "http://a.example.com/de/", "http://example.com/de", "http://x.org/fr/12.html", "ftp://y.net", "http://y.net/", "http://notexample.net/en/", "a://b://c/d"]
    out += [f"https://h{i % 3}.example.org/{lang}/{kind}" for i in range(90) for lang in ("en", "fr") for kind in (str(i), f"user{i}", "deadbeef12", "2024-01-02.html", "a-b-c-d-e", "about")]
    out += [f"http://www.example.com/{lang}/{i % 4}" for i in range(40) for lang in ("de", "en", "es")]
    return out


def test_urls_against_sql(spark, oracle):
    rows = list(enumerate(urls())) + [(5, "http://a.example.com/de/"), (None, "http://a.example.com/de/")]
    got = judge_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "url AS host", "url AS segs")).toPandas()
    pdf = pd.DataFrame(rows, columns=["page_id", "url"]).astype({"page_id": "Int64"})
    assert len(got) == len(rows)
    assert plain(got) == plain(oracle(op6.SQL, pages=pdf))
    by_url = {dict(rows).get(r.page_id): r for r in got.itertuples() if not pd.isna(r.page_id)}
    assert (by_url["https://Example.NET/en/1?x#y"].rule, by_url["https://Example.NET/en/1?x#y"].verdict) == ("example.net/en/", "allow")
    assert by_url["http://a.example.com/de/"].rule == "example.com/de/" and by_url["http://example.com/de"].rule is None
    assert by_url["http://y.net/"].rule == "net/" and by_url["http://notexample.net/en/"].rule == "net/"
    assert (by_url[None].host, by_url[None].path) == ("", "") and by_url["a://b://c/d"].host == "b:"
    assert by_url["https://h0.example.org/en/user0"].template == "/*/*"  # en has no labelled url of its own
    assert judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_template_tree_goes_on_until_nothing_changes(spark, oracle):
    rows = [(k * 8 + j, f"http://one.host/u/name{chr(97 + k % 26)}{chr(97 + k // 26)}/word{chr(97 + j)}{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(40) for j in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = judge_urls(pages).toPandas()
    assert set(got.template) == {"/u/*/*"}
    assert plain(got) == plain(oracle(op6.SQL, pages=pd.DataFrame(rows, columns=["page_id", "url"])))
