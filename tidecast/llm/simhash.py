"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: the majority bit of the XXH64 values of a text's word shingles.
Distinct fingerprints that differ in at most ``d`` bits are linked, and linked
documents form components.

Routing: two fingerprints within ``d`` bits agree on one of d + 1 blocks of the
64 bits, so each goes to d + 1 buckets (a bit mask and the bits under it). A
bucket of more than ``BUCKET`` fingerprints is split before any shuffle: its
remaining bits are cut into d + 1 blocks again, which repeats until so few bits
remain that distinct values bound the bucket. No pair is lost and no bucket is
capped.

Index: inside a bucket the fingerprints are sorted by Gray rank and grouped by
eights into nodes, level by level. A node keeps the bits that all below it share
(mask and pattern); what a parent holds is factored out of its children. A search
walks down with the differences counted so far and drops a whole group as soon
as they exceed ``d``. Every bucket returns a spanning forest of its links, not
the pairs.

Defined cases: a null, empty or blank text has fingerprint zero and is linked
like any other; fewer words than a shingle make one shingle of all words; rows
without an id are linked but never name a component (its id is null only if no
row in it has an id); repeated rows share a component.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import numbered, strings, written
from tidecast.llm.graph import components

SHINGLE, MAX_BITS, SEED = 3, 2, 42
BUCKET = 4096
FANOUT = 8
FEW_BITS = 14
PAIRS_AT_ONCE = 1 << 20
HASHES_AT_ONCE = 1 << 16
BROADCAST_KEYS = 100_000
ALL = (1 << 64) - 1


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of the words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words))
    n = len(words) - k + 1
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, HASHES_AT_ONCE):
        to = min(n, at + HASHES_AT_ONCE)
        cuts = zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())
        h = np.fromiter((digest(joined[a:b], SEED) for a, b in cuts), np.uint64, to - at)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): one row for each row of ``docs``; fp holds the 64 bits."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _signed([fingerprint(t, shingle) for t in strings(b.column(1))])], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


# ---------------------------------------------------------------- routing


def _long(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def finer(mask: int, d: int) -> list[int]:
    """The mask joined with each of d + 1 blocks of the bits outside it."""
    free = [i for i in range(63, -1, -1) if not mask >> i & 1]
    cuts = [len(free) * i // (d + 1) for i in range(d + 2)]
    return [mask | sum(1 << b for b in free[a:z]) for a, z in zip(cuts, cuts[1:])]


def mask_levels(d: int) -> list[list[int]]:
    levels = [finer(0, d)]
    while max(64 - m.bit_count() for m in levels[-1]) > FEW_BITS:
        levels.append(list(dict.fromkeys(x for m in levels[-1] for x in finer(m, d))))
    return levels


def gray_links(distinct: DataFrame, d: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that join all fingerprints of column ``fp`` within ``d`` bits of each other, maybe by way of others."""
    levels = mask_levels(d)
    masks = F.array(*(F.lit(_long(m)).cast("long") for m in levels[0]))
    keyed = distinct.select("fp", F.explode(masks).alias("mask"))
    found = []
    for level, own in enumerate(levels):
        keyed = keyed.select("mask", F.expr("fp & mask").alias("key"), "fp")
        last = level == len(levels) - 1
        hot, n_hot = None, 0
        if not last:
            hot = written(keyed.groupBy("mask", "key").count().where(F.col("count") > bucket).drop("count"), "simhash-hot")
            n_hot = hot.count()
        if n_hot:
            hot = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
            cold = keyed.join(hot, ["mask", "key"], "left_anti")
            children = F.create_map(*(x for m in own for x in (F.lit(_long(m)).cast("long"), F.array(*(F.lit(_long(c)).cast("long") for c in finer(m, d))))))
            keyed, more = keyed.join(hot, ["mask", "key"], "left_semi").select("fp", F.explode(children[F.col("mask")]).alias("mask")).distinct(), True  # ways to one mask can differ
        else:
            cold, more = keyed, False
        dealt = cold.repartition("mask", "key").sortWithinPartitions("mask", "key")
        found.append(dealt.mapInArrow(_bucket_links(d), "a long, b long"))
        if not more:
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return out


# ---------------------------------------------------------------- the index of one task's buckets


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the reflected Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class GrayIndex:
    """Nodes over buckets of fingerprints; ``group`` numbers the buckets of the sorted ``fp`` from 0."""

    def __init__(self, fp: np.ndarray, group: np.ndarray):
        self.fp, self.group = fp, group
        full = np.full(len(fp), ALL, np.uint64)
        #: from the leaves up: pattern, mask, bucket, first child, children, last leaf below
        self.levels = [(fp, full, group, np.arange(len(fp)), np.ones(len(fp), np.int64), np.arange(len(fp)))]
        while True:
            pattern, mask, grp, _, _, last = self.levels[-1]
            starts = np.searchsorted(grp, np.arange(group[-1] + 1))
            sizes = np.diff(np.append(starts, len(grp)))
            if sizes.max() == 1:
                break
            place = np.arange(len(grp)) - starts[grp]
            first = np.flatnonzero(place % FANOUT == 0)
            count = np.diff(np.append(first, len(grp)))
            both, any_ = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ any_)
            self.levels.append((both & shared, shared, grp[first], first, count, last[first + count - 1]))
        #: what a node's mask has beyond its parent's
        self.rest = [None] * len(self.levels)
        for k in range(len(self.levels) - 1):
            up = self.levels[k + 1]
            self.rest[k] = self.levels[k][1] & ~np.repeat(up[1], up[4])

    def search(self, queries: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, leaf) with query < leaf, in one bucket, within ``d`` bits."""
        node = self.group[queries]  # one top node for each bucket
        own, diff = queries, np.zeros(len(queries), np.int64)
        for k in range(len(self.levels) - 1, 0, -1):
            _, _, _, first, count, _ = self.levels[k]
            n = count[node]
            own, diff = np.repeat(own, n), np.repeat(diff, n)
            child = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            pattern, last = self.levels[k - 1][0], self.levels[k - 1][5]
            diff = diff + np.bitwise_count((self.fp[own] ^ pattern[child]) & self.rest[k - 1][child])
            keep = (diff <= d) & (last[child] > own)
            own, node, diff = own[keep], child[keep], diff[keep]
        return own, node


def forest(fp: np.ndarray, group: np.ndarray, d: int) -> np.ndarray:
    """For each fingerprint the place of the first one that its bucket's links reach."""
    index = GrayIndex(fp, group)
    root = np.arange(len(fp))
    sizes = np.bincount(group)
    work = np.cumsum(sizes[group])
    cuts = np.searchsorted(work, np.arange(0, work[-1], PAIRS_AT_ONCE), side="right")
    for at, to in zip(cuts, [*cuts[1:], len(fp)]):
        if at == to:
            continue
        a, b = index.search(np.arange(at, to), d)
        while True:
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
            while (root != root[root]).any():
                root = root[root]
    return root


def _bucket_links(d: int):
    def links(mask, key, fp):
        new = np.append(True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1]))
        group = np.cumsum(new) - 1
        many = np.bincount(group)[group] > 1
        fp, group = fp[many].view(np.uint64), group[many]
        if not len(fp):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        group = np.cumsum(np.append(0, group[1:] != group[:-1]))
        order = np.lexsort((gray_rank(fp), group))
        fp = fp[order]
        root = forest(fp, group, d)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return fp[linked].view(np.int64), fp[root[linked]].view(np.int64)

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for b in batches:
            held = [np.concatenate([x, c.to_numpy()]) for x, c in zip(held, b.columns)]
            mask, key, fp = held
            # the last bucket may go on in the next batch
            last = np.flatnonzero((mask != mask[-1]) | (key != key[-1])) if len(mask) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                a, z = links(mask[:cut], key[:cut], fp[:cut])
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])
            held = [x[cut:] for x in held]
        if len(held[0]):
            a, z = links(*held)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(z)], names=["a", "b"])

    return run


# ---------------------------------------------------------------- documents


def cluster(fps: DataFrame, d: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(fp, root, component_id) for every distinct fp of (doc_id, fp); ``fps`` should be a written table."""
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-distinct")
    links = written(gray_links(distinct, d, bucket), "simhash-links")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    labelled = distinct.join(roots.select(F.col("u").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = labelled.groupBy("root").agg(F.min("first").alias("component_id"))
    return written(labelled.join(names, "root").select("fp", "root", "component_id"), "simhash-labels")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, d: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fp, root, component_id): one row for each row of ``docs``; root numbers the component."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fps")
    return fps.join(cluster(fps, d, bucket), "fp").select("doc_id", "fp", "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, d: int = MAX_BITS) -> DataFrame:
    """One row of each component with all its columns: that with the smallest id.

    Of rows that share this id and component, and of a component without any id, the one
    with the smallest text stays; of equal texts that with the least hash of the whole row.
    """
    names = docs.columns
    plain = numbered(docs)
    own_id, text = (f"c{names.index(c)}" for c in (id_col, text_col))
    found = written(near_duplicates(plain, own_id, text, shingle, d), "simhash-rows")
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    odd = found.groupBy("doc_id").count().where("doc_id IS NULL OR count > 1").limit(1).count()
    if not odd:
        ids = kept.select(F.col("doc_id").alias("kept_id"))
        return plain.join(ids, F.col(own_id).cast("long") == F.col("kept_id"), "left_semi").toDF(*names)

    @F.pandas_udf("long")
    def again(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))

    ids = kept.select(F.col("doc_id").alias("kept_id"), F.col("fp").alias("kept_fp"), F.col("root").alias("kept_root")).distinct()
    rows = plain.withColumn("fp", again(F.col(text).cast("string")))
    joined = rows.join(ids, F.col(own_id).cast("long").eqNullSafe(F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")))
    first = F.struct(F.col(text).cast("string"), F.xxhash64(*plain.columns))
    best = joined.groupBy("kept_root").agg(F.min_by(F.struct(*plain.columns), first).alias("row"))
    return best.select("row.*").toDF(*names)
