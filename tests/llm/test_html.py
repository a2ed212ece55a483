import random
import re
from collections import defaultdict

import pytest

from tidecast.llm import html_text, op7
from tidecast.llm.html_text import blocks, main_text, repeated


def test_blocks_of_one_page():
    page = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><p>no</p>";</script></head><body><header>site</header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad big">buy</div><article class="post"><h1>Ti&amp;tle</h1><p>a  b&nbsp;<b>c</b>d<br>e
    <p>unclosed <span class="share-links">tweet</span> tail<div id="comments"><p>I like it</p></div><form><input><p>mail</p></form><aside>x</aside><p title="a>b">last &copy &am</article>
    <section>after</section><footer>&copy; foot</footer></body></html><p clas"""
    article = [t for t, inside, out in blocks(page) if inside and not out]
    assert article == ["Ti&tle", "a b cd e", "unclosed", "tail", "last © &am"]
    assert [t for t, inside, out in blocks(page) if not inside and not out] == ["after"]
    assert blocks("") == [] and blocks("a < b") == [("a < b", False, False)] and blocks("<") == [("<", False, False)]


def test_article_inside_a_wrapper():
    for wrapper in ("class='site has-sidebar'", "class=with-sidebar", "id='page' class='no-sidebar sticky-header with-footer'", "class='no-comments'", "id=navbar-page"):
        page = f"<body><div {wrapper}>before<main>top<div class='with-sidebar'>skip<article><p>text</p><div class='share'>tweet</div></article></div></main><div>after</div></div></body>"
        assert blocks(page) == [("before", False, True), ("top", True, False), ("skip", True, True), ("text", True, False), ("tweet", True, True), ("after", False, True)]
    for other in ("nav", "aside", "form", "div id=comments", "div class='has-sidebar related-posts'", "div role=complementary"):
        assert blocks(f"<{other}><div class=with-sidebar><article>not of the page</article></div></{other.split()[0]}>") == [("not of the page", True, True)]


def test_repeated_runs_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        shared = [[rng.randrange(6) for _ in range(rng.randint(3, 9))] for _ in range(2)]
        streams = []
        for _ in range(rng.randint(0, 9)):
            s = [rng.randrange(30) for _ in range(rng.randint(0, 12))]
            for x in shared:
                if rng.random() < 0.5:
                    k = rng.randint(0, len(s))
                    s[k:k] = x
            streams.append(s)
            if rng.random() < 0.2:
                streams.append(list(s))
        owners = defaultdict(set)
        for s in streams:
            for i in range(len(s) - 3):
                owners[tuple(s[i : i + 4])].add(tuple(s))
        for s, got in zip(streams, repeated(streams, 4, 3)):
            want = [any(0 <= i and i + 4 <= len(s) and len(owners[tuple(s[i : i + 4])]) >= 3 for i in range(j - 3, j + 1)) for j in range(len(s))]
            assert list(got) == want


def test_pages_without_an_article(spark):
    menu = "<div>Home and more links here</div><div>All rights are ours alone always</div>"
    rows = [(i, f"http://h.org/{i}", f"<html><body>{menu}<div>own{i} words of w{i} page number {i} x{i} y{i}</div></body>") for i in range(6)]
    rows += [(100 + i, "http://copy.org/", "<div>the same article text on every one of these pages</div>") for i in range(5)]
    rows += [(7, None, None), (8, "http://h.org/e", ""), (9, "http://h.org/m", f"{menu}<main><p>Home and more links here</p></main>"), (None, "http://h.org/n", "<p>no id but words</p>"), (9, "http://h.org/m", f"{menu}<main><p>Home and more links here</p></main>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url AS text", "url AS host", "page_id AS part")
    for part in (2000, 5):
        got = main_text(pages, part=part).collect()
        assert len(got) == len(rows)
        texts = {r.page_id: r.text for r in got}
        assert all(texts[100 + i] == "the same article text on every one of these pages" for i in range(5))
        assert (texts[7], texts[8], texts[9], texts[None]) == ("", "", "Home and more links here", "no id but words")
        if part == 2000:
            assert all(texts[i] == f"own{i} words of w{i} page number {i} x{i} y{i}" for i in range(6))
    assert main_text(pages.limit(0)).count() == 0


def test_parts_of_a_host_are_counted_together(spark):
    rows = []
    for i in range(60):
        notice = "<div>this notice stands on twelve pages only</div>" if i % 5 == 0 else ""
        twice = "<div>these words stand on two pages alone</div>" if i in (3, 31) else ""
        copies = "<div>one text that copies alone hold here</div>" if i in (8, 9, 10, 11) else f"<div>own{i} text of w{i} page x{i} y{i}</div>"
        rows.append((i, "http://big.org/", f"<div>Home and more links here</div>{notice}{twice}{copies}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = {r.page_id: r.text for r in main_text(pages, part=2000).collect()}
    assert not any("notice" in t or "Home" in t for t in whole.values())
    assert "two pages" in whole[3] and whole[8] == "one text that copies alone hold here"
    for part in (1, 5, 20):
        assert {r.page_id: r.text for r in main_text(pages, part=part).collect()} == whole


def test_query_gives_the_documents_that_pages_were_made_of(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = op7.query(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/pages.parquet").count()
    seen = 0
    for r in got:
        own = docs.get(int(re.search(r"/(\d+)", r.url)[1]))
        lines = [" ".join(x.split()) for x in (own or "").split("\n")]
        lines = [x for x in lines if x]
        seen += bool(lines)
        title, *rest = r.text.split("\n")  # the heading stands before the paragraphs
        assert not lines or (rest == lines and title)
        assert r.n_chars == len(r.text)
    assert seen > 200


PROBES = {
    "<article><div class='body no-sidebar'><p>text of the page</p></div></article>": "text of the page",
    "<article><section class='social'><p>text of the page</p></section></article>": "text of the page",
    "<article><p class='notice'>text of the page</p></article>": "text of the page",
    "<article><div class='search-results'><p>text of the page</p></div></article>": "text of the page",
    "<article><ul class='menu-items'><li>text of</li><li>the page</li></ul></article>": "text of\nthe page",
    "<form id='aspnetForm'><nav>menu</nav><article><p>text of the page</p><div class='ad'>buy</div></article></form>": "text of the page",
    "<article><p>text of the page</p></article><article class='comment'><p>I like it</p></article>": "text of the page",
    "<form><input><article><p>subscribe here</p></article></form><article><p>text of the page</p></article>": "text of the page",
}


def test_no_text_of_an_article_is_lost(spark):
    rows = [(i, f"http://probe{i}.org/", page) for i, page in enumerate(PROBES)]
    got = {r.page_id: r.text for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(len(rows))] == list(PROBES.values())


@pytest.mark.parametrize("part", [2000, 3])
def test_the_host_decides_on_hinted_blocks_and_keeps_unique_runs(spark, monkeypatch, part):
    notice = "<p class='notice'>we use these words on each of our pages</p>"
    legal = " ".join(f"legal{k}" for k in range(25))
    rows = [(i, "http://h.org/", f"<article><h1>T{i}</h1>{notice}<p class='notice'>only page {i} says so in w{i} x{i}</p></article>") for i in range(8)]
    rows += [(100 + i, "http://n.org/", f"<div>Home and more links here</div><div>start{i} a{i} b{i} c{i} {legal} end{i}</div><div>as all of us do say here d{i} e{i} f{i} g{i} h{i}</div>") for i in range(8)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {r.page_id: r.text for r in main_text(pages, part=part).collect()}
    assert all(texts[i] == f"T{i}\nonly page {i} says so in w{i} x{i}" for i in range(8))
    # the long repeat goes, what is unique around it stays, and so does a short phrase that prose shares
    assert all(texts[100 + i] == f"start{i} a{i} b{i} c{i} end{i}\nas all of us do say here d{i} e{i} f{i} g{i} h{i}" for i in range(8))


def test_without_the_suffix_array_texts_differ():
    pages = [["Home and more links here", f"own{i} text w{i} x{i} y{i}"] for i in range(4)]
    assert html_text.unique_texts(pages) == [["", p[1]] for p in pages]
    assert html_text.unique_texts(pages[:2]) == pages[:2]  # on two pages nothing is repeated often enough
