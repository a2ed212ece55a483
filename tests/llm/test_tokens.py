import random
import zlib

import numpy as np
import pytest
from tokenizers import AddedToken, Tokenizer

from tidecast.llm import op9, op10
from tidecast.llm.binary import look_up, read_back, write_files
from tidecast.llm.packing import best_fit, crossover, cuts, evolve, first_population, lower_bound, pack, pieces, sequences
from tidecast.llm.common import written
from tidecast.llm.tokens import Encoder, default_path, encoder


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_chunked_encoding_is_the_librarys(plain):
    rng = random.Random(5)
    bits = [" ", " ", "  ", "\n", "\t", "a", "The", "ab", ".", ",", "'s", "12", " ", "　", "é", "Straße", "\x1c", "\x85", "<|endoftext|>", "😀", "中文", "!!", "$$$"]
    texts = [None, "", " ", "  ", "   ", "a  ", "\n\n b", "x" * 500, *("".join(rng.choice(bits) for _ in range(rng.randint(1, 16))) for _ in range(4000))]
    got = [np.frombuffer(x, "<u4").tolist() for x in Encoder(default_path()).encode(texts)]
    assert got == [plain(t) for t in texts]


def test_operators_give_added_tokens_their_ids(spark, make_docs, tmp_path):
    unmodified = Tokenizer.from_file(default_path())
    rng = random.Random(6)
    bits = [" ", "  ", "\n", "a", "The", ".", "12", "é", "<|", "|>", "endoftext", "<|endoftext|>", "<|endoftext|>"]
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", *("".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(2000))]
    want = [[*unmodified.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert want[0] == [64, 220, 50256, 275, 0]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(default_path()).encode(texts)] == want
    docs = make_docs(list(enumerate(texts[:40])))
    made = write_files(docs, default_path(), shard_keys=2)
    rows = read_back(look_up(made.entries.select("doc_id", "copy"), made), made, with_ids=True).collect()
    assert {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in rows} == dict(enumerate(want[:40]))
    found = pieces(docs, default_path(), capacity=64).collect()
    assert sorted((r.doc_id, r.ids_crc32) for r in found) == [(i, crc(x)) for i, x in enumerate(want[:40])]
    wide = Tokenizer.from_file(default_path())
    wide.add_tokens([AddedToken("<pad>", lstrip=True, rstrip=True), AddedToken("word", single_word=True)])
    wide.save(str(tmp_path / "wide.json"))
    texts = ["a  <pad>  b", "word words  word", "no token", "x<|endoftext|> <pad>"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(str(tmp_path / "wide.json")).encode(texts)] == [[*wide.encode(t, add_special_tokens=False).ids, 0] for t in texts]


ROWS = [(7, "seven words are in this short text"), (3, None), (3, "again three"), (5, ""), (None, "no id"), (9, "repeated"), (9, "repeated"), (4, "long " * 5000)]


def test_files_round_trip(spark, make_docs, plain):
    docs = make_docs(ROWS).selectExpr("*", "lang AS file", "lang AS copy")
    made = write_files(docs, default_path(), shard_keys=2)
    rows = read_back(look_up(made.entries.select("doc_id", "copy"), made), made, with_ids=True).collect()
    assert len(rows) == len(ROWS)
    want = sorted((i is not None, i or 0, tuple(plain(t))) for i, t in ROWS)
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in rows) == want
    assert all(r.ids_crc32 == zlib.crc32(r.ids) for r in rows)
    assert sorted(r.copy for r in rows if r.doc_id == 9) == [0, 1]
    strangers = spark.createDataFrame([(i, 0) for i in range(1000, 1400)], "doc_id long, copy long")
    assert look_up(strangers, made).count() == 0


def test_query_against_brute_force(spark, plain):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op9.query(spark, sf).collect()}
    at, want = 0, {}
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()):
        ids = plain(r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    assert got == want


def check_packing(rows, capacity, want):
    by_seq, by_doc = {}, {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    for parts in by_seq.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    expected = {}
    for i, ids in want:
        own = expected.setdefault(i, [])
        own += [(k, a, n, crc(ids[a : a + n])) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
    assert {i: sorted(x) for i, x in by_doc.items()} == {i: sorted(x) for i, x in expected.items()}
    return len(by_seq)


def test_packing_edge_rows(spark, make_docs, plain):
    found = written(pieces(make_docs(ROWS), default_path(), capacity=64, with_ids=True), "t")
    out = written(pack(found, capacity=64, group=40), "t")
    n = check_packing(out.collect(), 64, [(i, plain(t)) for i, t in ROWS])
    assert n == len(sequences(out).collect())
    assert sum(len(r.ids) for r in sequences(out).collect()) == 4 * sum(len(plain(t)) for _, t in ROWS)


def test_packing_query(spark, plain):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    rows = op10.query(spark, sf).collect()
    n = check_packing(rows, 2048, [(r.doc_id, plain(r.text)) for r in docs])
    assert n <= lower_bound(np.array([r.length for r in rows]), 2048) * 1.01 + 1


def test_genetic_steps_keep_packings_whole():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 700, 800)
    population = first_population(lengths, 1000, rng)
    assert len(population) > 1 or population[0].max() + 1 == lower_bound(lengths, 1000)
    a = best_fit(lengths, rng.permutation(800), np.full(800, -1, np.int32), 1000)
    for donor in population:
        child = crossover(lengths, a, donor, 1000, rng)
        fill = np.bincount(child, weights=lengths)
        assert fill.max() <= 1000 and fill.min() > 0 and fill.sum() == lengths.sum()


def test_lower_bound_is_never_too_high():
    rng = np.random.default_rng(2)
    for _ in range(200):
        lengths = rng.integers(1, 33, rng.integers(1, 60))
        made = best_fit(lengths, np.argsort(-lengths), np.full(len(lengths), -1, np.int32), 32)
        assert lower_bound(lengths, 32) <= made.max() + 1


def test_empty_tables(spark, make_docs):
    made = write_files(make_docs([]), default_path())
    assert made.entries.count() == 0
    assert pack(written(pieces(make_docs([]), default_path()), "t")).count() == 0


def test_forgetting_long_texts_and_units_change_no_ids(plain):
    rng = random.Random(8)
    bits = ["a", "Ab", "é", "ß", "×", " ", " ", ".", ",", "'", "s", "7", "\n", "中", "-", "\x00"]
    words = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(60)] + ["x" * 300_000, "ab1 " * 700_000, " " * 1000]
    own = Encoder(default_path(), remember=300)
    for x in (texts, reversed(texts)):
        for t, got in zip(x := list(x), own.encode(x)):
            assert np.frombuffer(got, "<u4").tolist() == plain(t)
    assert len(own.hash) <= 300


def test_units_are_the_librarys_cuts(plain):
    """Every unit begins a pre-token wherever the text around it comes from."""
    rng = random.Random(9)
    bits = [" ", " ", "  ", "\n", "\t", "a", "The", ".", ",", "'s", "'", "12", "é", "ÿ", "÷", "Ā", " ", "_", "\x1c", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    from tidecast.llm.tokens import unit_starts

    for t in texts:
        raw = t.encode()
        cuts = unit_starts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).tolist() + [len(raw)]
        units = [raw[a:z].decode() for a, z in zip(cuts, cuts[1:])]
        assert "".join(units) == t
        assert [i for u in units for i in plain(u)[:-1]] == plain(t)[:-1]


@pytest.mark.parametrize("low,high", [(300, 900), (500, 800)])
def test_genetic_steps_beat_best_fit(low, high):
    """Where best fit misses the bound, crossover needs fewer bins than it and than every first individual."""
    lengths = np.random.default_rng(3).integers(low, high, 4000)
    population = first_population(lengths, 2048, np.random.default_rng(1))
    bins = [int(a.max()) + 1 for a in population]
    assert bins[0] > lower_bound(lengths, 2048)
    best = evolve(lengths, population, 2048, np.random.default_rng(2))[0]
    assert int(best.max()) + 1 < min(bins) and np.bincount(best, weights=lengths).max() <= 2048


def test_islands_beat_best_fit(spark):
    lengths = np.random.default_rng(4).integers(300, 900, 1200).tolist()
    rows = spark.createDataFrame([(i, 0, 0, n, 0, i * 7919 % 1200) for i, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long, slot long")
    out = pack(written(rows, "t")).collect()
    alone = best_fit(np.array(lengths), np.argsort(-np.array(lengths), kind="stable"), np.full(1200, -1, np.int32), 2048)
    assert len({r.sequence_id for r in out}) < int(alone.max()) + 1
    fill = {}
    for r in out:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 2048 and sum(fill.values()) == sum(lengths)
