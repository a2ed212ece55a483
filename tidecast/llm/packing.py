"""Best-fit packing of documents into sequences by a grouping genetic algorithm.

Pieces (a document's ids, cut only if longer than a sequence) are dealt by a
random slot into groups of about ``GROUP`` pieces. Each group is one packing
problem with ``ISLANDS`` populations. An individual is a set of filled bins. A
crossover injects whole well-filled bins of one parent into the other, removes
the bins that hold duplicates, and best-fits the displaced pieces, largest first.
After every epoch each island sends its elite to the next one (a shuffle); a
group that has reached its lower bound rests. The best island's elite is laid out.

Defined cases: null or empty text is its end id alone; rows with one id are
packed each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import strings, written
from tidecast.llm.tokens import encoder

CAPACITY = 2048
GROUP = 16_384
ISLANDS = 2
POPULATION = 8
EPOCHS = 4
CHILDREN = 200
INJECT = 0.3
SEED = 42

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(length: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces; only the first may be shorter than the capacity."""
    first = length % capacity or capacity
    yield 0, min(first, length)
    for at in range(first, length, capacity):
        yield at, capacity


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows with a random ``slot``, and their ids (little-endian 32-bit) if asked for; no shuffle."""

    def run(batches):
        task, seen = TaskContext.get().partitionId(), 0
        for b in batches:
            rows = []
            for i, raw in zip(b.column(0).to_pylist(), encoder(tokenizer).encode(strings(b.column(1)))):
                whole = memoryview(raw)
                for k, (at, n) in enumerate(cuts(len(raw) // 4, capacity)):
                    own = whole[4 * at : 4 * (at + n)]
                    slot = xxhash.xxh64_intdigest(f"{task} {seen}", SEED) >> 1
                    rows.append((i, k, at, n, zlib.crc32(own), slot, bytes(own) if with_ids else None))
                    seen += 1
            cols = list(zip(*rows)) if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            out = [pa.array(c, t) for c, t in zip(cols, types)][: 7 if with_ids else 6]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "slot", "ids"][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE + ", slot long" + ", ids binary" * with_ids)


# ---------------------------------------------------------------- one group, in numpy


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: pieces over half a bin stand alone, and the rest must find room beside or beyond them."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = -(-int(total[-1]) // capacity)
    for k in range(0, capacity // 2 + 1):
        huge = len(lengths) - number[capacity - k]
        large = number[capacity - k] - number[capacity // 2]
        room = large * capacity - (total[capacity - k] - total[capacity // 2])
        small = total[capacity // 2] - (total[k - 1] if k else 0)
        best = max(best, int(huge + large + max(0, -(-(small - room) // capacity))))
    return best


class Bins:
    """Open bins by free room; the tightest that fits is found by the bits of one integer."""

    def __init__(self, capacity: int):
        self.capacity, self.by_room, self.bits = capacity, [[] for _ in range(capacity + 1)], 0

    def add(self, number: int, room: int) -> None:
        self.by_room[room].append(number)
        self.bits |= 1 << room

    def place(self, length: int, fresh: int) -> int:
        """The bin of a piece: the tightest open one, or ``fresh``."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            own = self.by_room[room]
            number = own.pop()
            if not own:
                self.bits ^= 1 << room
        else:
            room, number = self.capacity, fresh
        if room > length:
            self.add(number, room - length)
        return number


def best_fit(lengths: np.ndarray, order: np.ndarray, assign: np.ndarray, capacity: int) -> np.ndarray:
    """Place the pieces of ``order`` one by one; the others keep their bins in ``assign``."""
    out = assign.copy()
    out[order] = -1
    have = out >= 0
    fresh = int(out.max(initial=-1)) + 1
    bins = Bins(capacity)
    if have.any():
        fill = np.bincount(out[have], weights=lengths[have], minlength=fresh).astype(np.int64)
        for b in np.flatnonzero((fill > 0) & (fill < capacity)).tolist():
            bins.add(b, capacity - int(fill[b]))
    places = []
    for n in lengths[order].tolist():
        b = bins.place(n, fresh)
        fresh += b == fresh
        places.append(b)
    out[order] = places
    return np.unique(out, return_inverse=True)[1].astype(np.int32)


def fitness(lengths: np.ndarray, assign: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    fill = np.bincount(assign, weights=lengths)
    return -len(fill), float(((fill / capacity) ** 2).mean())


def crossover(lengths: np.ndarray, into: np.ndarray, donor: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    fill = np.bincount(donor, weights=lengths)
    n = max(1, int(INJECT * len(fill)))
    well = np.argsort(-fill, kind="stable")[: 3 * n]
    chosen = np.zeros(len(fill), bool)
    chosen[rng.permutation(well)[:n]] = True
    given = chosen[donor]
    torn = np.zeros(int(into.max()) + 1, bool)
    torn[into[given]] = True
    least = np.argsort(np.bincount(into, weights=lengths), kind="stable")[: max(1, n // 8)]
    torn[least] = True  # and some of the emptiest bins
    displaced = np.flatnonzero(torn[into] & ~given)
    child = np.where(given, donor + len(torn), into)
    order = displaced[np.argsort(-lengths[displaced], kind="stable")]
    return best_fit(lengths, order, child, capacity)


def first_population(lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Best fit in falling order, and in orders with noise."""
    none = np.full(len(lengths), -1, np.int32)
    out = []
    for k in range(POPULATION):
        noise = 1 + 0.08 * k * rng.random(len(lengths))
        out.append(best_fit(lengths, np.argsort(-lengths * noise, kind="stable"), none, capacity))
        if k == 0 and int(out[0].max(initial=-1)) + 1 <= lower_bound(lengths, capacity):
            break
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], capacity: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Children replace the weakest; ends when the lower bound is reached. Best first."""
    bound = lower_bound(lengths, capacity)
    ranked = sorted(population, key=lambda a: fitness(lengths, a, capacity), reverse=True)
    for _ in range(CHILDREN):
        if -fitness(lengths, ranked[0], capacity)[0] <= bound or len(ranked) < 2:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        ranked.append(crossover(lengths, ranked[min(a, b)], ranked[max(a, b)], capacity, rng))
        ranked = sorted(ranked, key=lambda x: fitness(lengths, x, capacity), reverse=True)[:POPULATION]
    return ranked


# ---------------------------------------------------------------- islands on Spark

_STATE = "group long, island int, migrant boolean, lengths binary, population array<binary>, n_bins long, score double"


def _state(group: int, island: int, lengths: np.ndarray, ranked: list[np.ndarray], capacity: int) -> dict:
    bins, score = fitness(lengths, ranked[0], capacity) if len(lengths) else (0, 0.0)
    return {"group": group, "island": island, "migrant": False, "lengths": lengths.astype("<i4").tobytes(), "population": [a.astype("<i4").tobytes() for a in ranked], "n_bins": -bins, "score": score}


def _rng(group: int, island: int, epoch: int) -> np.random.Generator:
    return np.random.default_rng([SEED, group, island, epoch])


def islands(dealt: DataFrame, capacity: int, n_islands: int, epochs: int) -> DataFrame:
    """The elite of each group's best island; ``dealt`` has group, slot and length."""

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group, island = (int(x) for x in key)
        lengths = rows.sort_values("slot", kind="stable")["length"].to_numpy(np.int64)
        lengths = lengths[lengths < capacity]
        rng = _rng(group, island, 0)
        return pd.DataFrame([_state(group, island, lengths, evolve(lengths, first_population(lengths, capacity, rng), capacity, rng), capacity)])

    def go_on(epoch: int):
        def step(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            group, island = (int(x) for x in key)
            lengths = np.frombuffer(rows["lengths"].iloc[0], "<i4").astype(np.int64)
            rows = rows.sort_values("migrant", kind="stable")
            population = [np.frombuffer(a, "<i4") for p in rows["population"] for a in p]
            return pd.DataFrame([_state(group, island, lengths, evolve(lengths, population, capacity, _rng(group, island, epoch)), capacity)])

        return step

    each = dealt.select("group", "slot", "length", F.explode(F.array(*(F.lit(i) for i in range(n_islands)))).alias("island"))
    state = written(each.groupBy("group", "island").applyInPandas(begin, _STATE), "islands")
    for epoch in range(1, epochs):
        elite = state.select("group", F.pmod(F.col("island") + 1, F.lit(n_islands)).alias("island"), F.lit(True).alias("migrant"), "lengths", F.slice("population", 1, 1).alias("population"), "n_bins", "score")
        state = written(state.unionAll(elite).groupBy("group", "island").applyInPandas(go_on(epoch), _STATE), "islands")
    best = state.groupBy("group").agg(F.min_by(F.element_at("population", 1), F.struct("n_bins", -F.col("score"), "island")).alias("elite"))
    return best


def pack(found: DataFrame, capacity: int = CAPACITY, group: int = GROUP, n_islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``; ``found`` should be a written table of pieces()."""
    n = found.count()
    groups = max(1, -(-n // group))
    columns = [c for c in found.columns if c != "slot"]
    dealt = found.withColumn("group", F.expr(f"pmod(slot, {groups}L)"))
    best = written(islands(dealt, capacity, n_islands, epochs), "packing-elite")

    def lay_out(rows: pd.DataFrame, elite: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("slot", kind="stable").reset_index(drop=True)
        lengths = rows["length"].to_numpy(np.int64)
        assign = np.zeros(len(rows), np.int64)
        part = lengths < capacity
        own = np.frombuffer(elite["elite"].iloc[0], "<i4") if len(elite) and part.any() else np.zeros(0, np.int32)
        assign[part] = own
        more = int(own.max(initial=-1)) + 1
        assign[~part] = more + np.arange((~part).sum())
        order = np.argsort(assign, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.append(True, assign[order][1:] != assign[order][:-1])
        base = np.maximum.accumulate(np.where(first, ends - lengths[order], 0))
        offset = np.zeros(len(rows), np.int64)
        offset[order] = ends - lengths[order] - base
        rows["sequence_id"] = (int(rows["group"].iloc[0]) << 24) + assign if len(rows) else assign
        rows["offset"] = offset
        return rows[[*columns, "sequence_id", "offset"]]

    if group > 1 << 23:
        raise ValueError("groups of more than 2^23 pieces have no room in a sequence number")
    schema = found.drop("slot").schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("group").cogroup(best.groupBy("group")).applyInPandas(lay_out, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, ids): the ids of each sequence, from packed pieces that carry ``ids``."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), parts.alias("parts")).select("sequence_id", "n_pieces", F.concat_ws("", F.transform("parts", lambda p: F.hex(p["ids"]))).alias("hex")).select("sequence_id", "n_pieces", F.unhex("hex").alias("ids"))
