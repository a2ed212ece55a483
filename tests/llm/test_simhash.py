import random

from simhash_brute import brute_components, brute_fingerprint

from tidecast.llm.simhash import cluster, fingerprint, keep_one, near_duplicates


def same_groups(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_fingerprint_is_the_contracts():
    rng = random.Random(1)
    texts = [None, "", " \n\t", "One", "one Two", "Été ÀB ß ss", "a b c", "A b c d\x1fe"]
    texts += [" ".join(rng.choice("ab cd Éf gh ij kl".split()) for _ in range(rng.randint(1, 200))) for _ in range(50)]
    for t in texts:
        assert fingerprint(t) == brute_fingerprint(t), t


def test_links_against_brute_force(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(300)}
    for base in rng.sample(sorted(fps), 6):  # chains and dense groups around some of them
        x = base
        for _ in range(60):
            x ^= 1 << rng.randrange(64)
            x ^= 1 << rng.randrange(64)
            fps.add(x)
        fps |= {base ^ (1 << rng.randrange(10)) ^ (1 << rng.randrange(10)) ^ (1 << rng.randrange(10)) for _ in range(120)}
    fps |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) | 3}
    want = brute_components(fps)
    rows = [(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(sorted(fps, key=lambda _: rng.random()))]
    frame = spark.createDataFrame(rows, "doc_id long, fp long")
    for bucket in (4096, 8):  # 8: buckets are split on every level
        got = {r.fp % (1 << 64): r for r in cluster(frame, 2, bucket).collect()}
        assert set(got) == fps
        order = sorted(fps)
        assert same_groups([want[f] for f in order], [got[f].root for f in order])
        ids = {f % (1 << 64): i for i, f in rows}
        least = {}
        for f in order:
            least[want[f]] = min(least.get(want[f], 1 << 60), ids[f])
        assert all(got[f].component_id == least[want[f]] for f in order)


def test_documents_with_nulls_copies_and_repeated_rows(spark, make_docs):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    other = " ".join(f"v{rng.randrange(500)}" for _ in range(300))
    docs = make_docs([(5, text), (3, text), (9, other), (9, other), (None, other), (7, None), (8, ""), (None, "lone row without id"), (11, text + " more")])
    docs = docs.withColumn("fp", docs.lang)
    got = {(r.doc_id, r.fp): r.component_id for r in near_duplicates(docs).collect()}
    by_id = {}
    for (i, _), c in got.items():
        by_id.setdefault(i, set()).add(c)
    assert by_id[5] == by_id[3] == {3} and by_id[9] == {9} and by_id[7] == by_id[8] == {7} and by_id[None] == {9, None}
    kept = keep_one(docs).collect()
    assert kept[0].asDict().keys() == docs.first().asDict().keys()
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in kept)
    assert [i for n, i in ids if not n] in ([3, 7, 9], [3, 7, 9, 11]) and sum(n for n, _ in ids) == 1


def test_empty_table(spark, make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert keep_one(make_docs([])).count() == 0
