import random
import re

from tidecast.llm import op4
from tidecast.llm.licenses import BASE, NOTICES, edits_allowed, license_scan, scanner, short_words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(words):
    places, labels = [], set()
    for phrase, label in BASE:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return places, labels


def in_order(words, short):
    at = 0
    for w in words:
        at += at < len(short) and w == short[at]
    return at == len(short)


def brute_labels(words):
    """Labels of notices within the allowed edits of some run of whole words (edit distance over all runs)."""
    out = set()
    for phrase, label in (*BASE, *NOTICES):
        k = edits_allowed(phrase)
        for i in range(len(words)):
            row = list(range(len(phrase) + 1))
            for j in range(i, len(words)):
                for c in (" " if j > i else "") + words[j]:
                    new = [row[0] + 1]
                    for x, p in enumerate(phrase):
                        new.append(min(new[-1] + 1, row[x + 1] + 1, row[x] + (p != c)))
                    row = new
                if row[-1] <= k and in_order(words[i : j + 1], short_words(phrase)):
                    out.add(label)
                if min(row) > k:
                    break
    return out


def texts():
    rng = random.Random(11)
    out = [None, "", "MIT License", "the MIT-License. MIT license mit license", "admit license", "mit licence and GNU General Public Licence", "mit mit license license", "x" * 3000, "general public license " * 40]
    for phrase, _ in (*BASE, *NOTICES):
        for n in range(0, edits_allowed(phrase) + 3, 2):
            p = list(phrase)
            for _ in range(n):
                at = rng.randrange(len(p))
                kind = rng.randrange(3)
                p[at : at + 1] = [[], [rng.choice("aeiou")], [p[at], rng.choice("xyz")]][kind]
            out.append(f"some words before {''.join(p)} and behind, mostly")
    return out


def test_against_brute_force(spark, make_docs):
    rows = list(enumerate(texts())) + [(None, "mit license"), (3, "repeated"), (3, "repeated")]
    got = license_scan(make_docs(rows).selectExpr("*", "lang AS labels")).collect()
    assert len(got) == len(rows)
    for r, (i, t) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id or 0)), sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))):
        if i == 3:
            continue
        words = brute_words(t)
        places, labels = brute_base(words)
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert set(filter(None, r.labels.split(","))) == brute_labels(words) | labels, t
        assert 0 <= r.score <= 1 and (r.score == 1 if places else True) and (r.score > 0) == bool(r.labels)


def test_spans_point_at_the_notice():
    text = "released under the mit licence today"
    base, found = scanner().scan(text)
    assert not base and [(text[m.start : m.end], m.label, m.edits) for m in found] == [("mit licence", "mit", 1)]


def test_query_over_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op4.query(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        places, labels = brute_base(brute_words(d.text))
        assert (got[d.doc_id].n_base, got[d.doc_id].base_labels) == (len(places), ",".join(sorted(labels)))


def test_empty_table(make_docs):
    assert license_scan(make_docs([])).count() == 0


def test_short_words_stand_unchanged():
    own = scanner()
    for text in ("it license", "kit license", "hit license", "licensed under a by", "mix license"):
        assert own.scan(text) == ([], [])
    assert [(m.label, m.edits) for m in own.scan("the mit licence here")[1]] == [("mit", 1)]


def test_every_place_is_listed():
    own = scanner()
    found = own.scan("the gnu leser general public license gnu lesser general public license")[1]
    assert sorted(m.edits for m in found if m.label == "lgpl") == [0, 1]
    many = own.scan("mit licence " * 300)[1]
    assert len(many) == 300 and {m.edits for m in many} == {1}


def test_time_grows_with_the_text():
    import time

    own, took = scanner(), []
    for n in (500, 4000):
        t0 = time.process_time()
        assert len([m for m in own.scan("mit licence " * n)[1] if m.label == "mit"]) == n
        took.append(time.process_time() - t0)
    assert took[1] < 8 * 4 * took[0] + 0.5  # eight times the text
