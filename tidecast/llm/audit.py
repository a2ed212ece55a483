"""Filter interaction audit: what every filter of every order removes, and what others remove before it.

One pass over the texts writes a narrow row for each document (a row number, the part,
a failure flag for each filter that looks at one text). Then every filter has a stored
table of the row numbers that fail it; a filter that compares documents (copies of a
smaller id) makes its table by a left-semi join with the least id of every text that
several ids have. Labels are stored the same way, as row numbers.

What a filter f removes behind a set S of earlier filters are the rows of f's table
left-anti the table of every filter in S; a chain of left-anti joins, one a filter,
finds this for all f and S at once: a row stands in the chain once for each S it may
survive, and the join with filter s drops it from every S that holds s. Label
losses are the same chain over the rows that a left-semi join with the label's table
leaves. All joins are on the unique row number, so no key is hot and the first shuffle
serves every join. Orders only differ in which (f, S) they name, so survivors,
redundancies and Shapley sums of all orders are sums of these counts.

Defined cases: null text is empty; a null part is the empty string; a row without an
id never copies another and has no labels; rows with one id are no copies of each
other; a label row with any 1 counts for all rows of its id; filters see repeated rows
each by itself; an empty table gives no rows; columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from hashlib import sha256
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import strings, written
from tidecast.operators.joins import sized_broadcast

#: filters are named by one letter each; every order of them is audited, so they are few
MOST_FILTERS = 6


@dataclass(frozen=True)
class TextFilter:
    """A filter of one text: ``fails`` tells of a document's figures whether it fails."""

    name: str
    fails: Callable[[Figures], bool]


@dataclass(frozen=True)
class CopyFilter:
    """A filter of the table: fails rows whose text stands under a smaller id too."""

    name: str


class Figures:
    """What filters may ask of a text; each is worked out when first asked for."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode()
        self._words: list[bytes] | None = None

    @property
    def words(self) -> list[bytes]:
        """Words `[^\\x20\\x09-\\x0D]+`."""
        if self._words is None:
            self._words = self.raw.split()
        return self._words

    def count(self, among: bytes) -> int:
        """Bytes of the ASCII characters ``among``."""
        return len(self.raw) - len(self.raw.translate(None, among))


def figures_table(docs: DataFrame, filters: Sequence[TextFilter | CopyFilter], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(row, doc_id, part, fails_0, ..., digest), written once: row numbers hold only for this table."""
    own = [f for f in filters if isinstance(f, TextFilter)]

    def run(batches):
        for b in batches:
            flags: list[list[bool]] = [[] for _ in own]
            digests = []
            for text in strings(b.column(3)):
                known = Figures(text or "")
                for told, f in zip(flags, own):
                    told.append(f.fails(known))
                digests.append(sha256(known.raw).digest())
            cols = [*b.columns[:3], *(pa.array(x, pa.bool_()) for x in flags), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["row", "doc_id", "part", *(f"fails_{f.name}" for f in own), "digest"])

    part = F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), part, F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = "row long, doc_id long, part string" + "".join(f", fails_{f.name} boolean" for f in own) + ", digest binary"
    return written(rows.mapInArrow(run, schema), "audit-figures")


def copies(figures: DataFrame) -> DataFrame:
    """Rows whose text also stands under a smaller id."""
    first = figures.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    first = sized_broadcast(first.select(F.col("digest").alias("same"), "first"))
    return figures.join(first, (F.col("digest") == F.col("same")) & (F.col("doc_id") > F.col("first")), "left_semi")


def failing_tables(figures: DataFrame, filters: Sequence[TextFilter | CopyFilter]) -> dict[str, DataFrame]:
    """For each filter the stored table (row, part) of what fails it."""
    out = {}
    for f in filters:
        rows = copies(figures) if isinstance(f, CopyFilter) else figures.where(f"fails_{f.name}")
        out[f.name] = written(rows.select("row", "part"), f"audit-fails-{f.name}")
    return out


def labelled_rows(figures: DataFrame, labels: DataFrame, condition: str, id_col: str = "doc_id") -> DataFrame:
    """Stored table (row) of the documents that a label row with ``condition`` names."""
    ids = labels.where(condition).select(F.col(f"`{id_col}`").cast("long").alias("own_id")).where("own_id IS NOT NULL").distinct()
    found = figures.select("row", "doc_id").join(sized_broadcast(ids), F.col("doc_id") == F.col("own_id"), "left_semi")
    return written(found.select("row"), "audit-labelled")


def removals(failing: dict[str, DataFrame], labelled: dict[str, DataFrame]) -> DataFrame:
    """(part, filter, before, kind, n): rows that ``filter`` (its bit) removes behind the set ``before`` of filters (a sum of bits).

    ``kind`` is 0 for all rows and k for those of the k-th table of ``labelled``.
    """
    bits = {name: 1 << i for i, name in enumerate(failing)}
    chain = None
    for name, bit in bits.items():
        own = failing[name]
        kinds = [own.withColumn("kind", F.lit(0))]
        kinds += [own.join(known, "row", "left_semi").withColumn("kind", F.lit(k)) for k, known in enumerate(labelled.values(), 1)]
        for rows in kinds:
            rows = rows.select("row", "part", F.lit(bit).alias("filter"), "kind")
            chain = rows if chain is None else chain.unionAll(rows)
    sets = F.sequence(F.lit(0), F.lit(sum(bits.values())))
    # dealt out by row first, so that the shuffle moves a row once and not once a set
    chain = chain.repartition("row").withColumn("before", F.explode(F.filter(sets, lambda s: s.bitwiseAND(F.col("filter")) == 0)))
    for name, bit in bits.items():
        gone = failing[name].select(F.col("row").alias("gone"))
        chain = chain.join(gone, (F.col("row") == F.col("gone")) & (F.col("before").bitwiseAND(F.lit(bit)) != 0), "left_anti")
    return written(chain.groupBy("part", "filter", "before", "kind").agg(F.count("*").alias("n")), "audit-removals")


def audit(docs: DataFrame, labels: DataFrame, filters: Sequence[TextFilter | CopyFilter], losses: dict[str, str], id_col: str = "doc_id", text_col: str = "text", part_col: str = "part") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, one column for each of ``losses``, shapley) of all orders and steps.

    ``losses`` names a condition on the columns of ``labels`` for each such column.
    """
    names = [f.name for f in filters]
    if len(set(names)) != len(names) or not 1 <= len(names) <= MOST_FILTERS or any(len(n) != 1 for n in names):
        raise ValueError(f"one to {MOST_FILTERS} filters with a letter of their own are audited: {names}")
    figures = figures_table(docs, filters, id_col, text_col, part_col)
    failing = failing_tables(figures, filters)
    counts = removals(failing, {c: labelled_rows(figures, labels, told, id_col) for c, told in losses.items()})
    # one row a part: a map from (kind, filter, set before it) to a count, as many entries as filters, their sets and kinds allow
    sets = 1 << len(names)
    place = (F.col("kind") * (sets * sets) + F.col("filter") * sets + F.col("before")).cast("int")
    maps = counts.groupBy(F.col("part").alias("own")).agg(F.map_from_entries(F.collect_list(F.struct(place, "n"))).alias("counts"))
    parts = figures.groupBy("part").agg(F.count("*").alias("rows"))
    whole = parts.join(maps, F.col("part") == F.col("own"), "left")
    return whole.select("part", "rows", "counts", F.explode(_orders(names)).alias("o")).select(*_result(len(names), list(losses)))


def _orders(names: list[str]) -> Column:
    """Every order and step: the order's letters, the step, the bits of its filters up to there, and their sets."""
    steps = []
    for order in permutations(range(len(names))):
        letters = "".join(names[i] for i in order)
        befores = [sum(1 << i for i in order[:k]) for k in range(len(order))]
        for k, i in enumerate(order):
            so_far = F.array(*(F.struct(F.lit(1 << j).alias("filter"), F.lit(b).alias("before")) for j, b in zip(order[: k + 1], befores)))
            steps.append(F.struct(F.lit(letters).alias("letters"), F.lit(k + 1).alias("step"), F.lit(1 << i).alias("filter"), F.lit(befores[k]).alias("before"), so_far.alias("so_far")))
    return F.array(*steps)


def _result(wide: int, losses: list[str]) -> list[Column]:
    sets = 1 << wide

    def count(f: Column, before: Column, kind: int = 0) -> Column:
        return F.coalesce(F.try_element_at("counts", (F.lit(kind * sets * sets) + f * sets + before).cast("int")), F.lit(0).cast("long"))

    f, before = F.col("o.filter"), F.col("o.before")
    # survivors: all rows less what each step so far removes
    lost = F.aggregate("o.so_far", F.lit(0).cast("long"), lambda n, x: n + count(x["filter"], x["before"]))
    # orders in which exactly the set s stands before a filter
    share = {s: factorial(s.bit_count()) * factorial(wide - 1 - s.bit_count()) for s in range(sets) if s.bit_count() < wide}
    weights = F.array(*(F.struct(F.lit(s).alias("before"), F.lit(w).cast("long").alias("orders")) for s, w in share.items()))
    shapley = F.aggregate(weights, F.lit(0).cast("long"), lambda n, x: n + count(f, x["before"]) * x["orders"])
    return [
        F.col("part"),
        F.col("o.letters").alias("filter_order"),
        F.col("o.step").alias("step"),
        (F.col("rows") - lost).alias("kept"),
        count(f, before).alias("removed"),
        (count(f, F.lit(0)) - count(f, before)).alias("redundant"),
        count(f, F.lit(sets - 1) - f).alias("unique_fails"),
        *(count(f, before, k).alias(c) for k, c in enumerate(losses, 1)),
        shapley.alias("shapley"),
    ]
