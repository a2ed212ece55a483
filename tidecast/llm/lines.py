"""Line dedup with a sharded minimal perfect hash over distinct line hashes.

A line's key is the line stripped of white space with A-Z lower-cased. Keys of
at least ``min_chars`` code points that stand in two documents or more keep
their lines only in the document with the smallest id. The hashes of such keys
go, by shard, into a minimal perfect hash whose slots index compact arrays: a
fingerprint, the owner's id and the count of documents. Documents probe these
arrays with the hashes of their lines; the lines themselves are never joined.

Probes are dealt out by ranges of (shard, a hash of the document), so that a line
that a third of all documents share is probed by as many tasks as its rows need;
each task holds one shard of at most about ``SHARD_KEYS`` keys at a time.

Defined cases: null or empty text is one empty line; rows with one id are one
document (a line repeated among them alone stays); a row without an id is not
counted and keeps all lines; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.llm import sharded
from tidecast.llm.common import SPACES, numbered, shared_folder, strings, written

MIN_CHARS = 10
SHARD_KEYS = sharded.SHARD_KEYS
KEY_TYPE = "h long, f long"
_BLANK = SPACES.encode()


def line_hash(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the line's key, None if the key is too short to count."""
    key = line.strip(_BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(docs: DataFrame, id_col: str, text_col: str, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, h, f): the distinct line hashes of every row that has an id."""

    def run(batches):
        for b in batches:
            ids, keys = [], []
            for i, text in zip(b.column(0).to_pylist(), strings(b.column(1))):
                own = {line_hash(x, min_chars) for x in text.encode().split(b"\n")}
                own.discard(None)
                ids.append(np.full(len(own), i, np.int64))
                keys.append(b"".join(own))
            both = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["doc_id", "h", "f"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, f"doc_id long, {KEY_TYPE}")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(h, f, owner, n_docs) of the keys in two documents or more, n_docs counting their rows; counted before the shuffle by partial aggregates."""
    found = keys.groupBy("h", "f").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count("*").alias("n_docs"))
    return found.where("owner < last").drop("last")


def probe(keys: DataFrame, shards: int, folder: str) -> DataFrame:
    """(doc_id, h, f) of the lines that their document does not own."""

    def run(batches):
        reader = sharded.Reader(folder)
        for b in batches:
            ids, h, f, shard = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            member, values = reader.find(shard, h, f)
            drop = member & (values["owner"] != ids) if len(ids) else member
            yield pa.RecordBatch.from_arrays([pa.array(x[drop]) for x in (ids, h, f)], names=["doc_id", "h", "f"])

    dealt = keys.withColumn("shard", sharded.shard_of(shards)).withColumn("part", F.xxhash64("doc_id"))
    return dealt.repartitionByRange("shard", "part").sortWithinPartitions("shard").mapInArrow(run, f"doc_id long, {KEY_TYPE}")


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines taken out of ``text_col`` and two more columns named ``counts``: lines before, and dropped.

    Columns of ``docs`` with these two names are replaced; name others to keep them.
    """
    spark = docs.sparkSession
    docs = docs.drop(*counts)
    names = docs.columns
    at, plain = names.index(text_col), numbered(docs)
    own_names, own_id = plain.columns, f"c{names.index(id_col)}"
    keys = written(line_keys(plain, own_id, f"c{at}", min_chars), "line-keys")
    shared = written(shared_keys(keys), "line-counts")
    n = shared.count()
    if n:
        shards, folder = -(-n // shard_keys), shared_folder(spark, "line-shards")
        sharded.build(shared, shards, folder)
        lost = probe(keys, shards, folder)
        drops = lost.groupBy(F.col("doc_id").alias("own")).agg(F.collect_set(F.struct("h", "f")).alias("drops"))
        joined = plain.join(drops, F.col(own_id).cast("long") == F.col("own"), "left").drop("own")
    else:
        joined = plain.withColumn("drops", F.lit(None).cast("array<struct<h:long,f:long>>"))

    def run(batches):
        for b in batches:
            texts, lines, dropped = [], [], []
            for text, drops in zip(strings(b.column(at)), b.column(len(names))):
                if not drops.is_valid:
                    texts.append(text)
                    lines.append((text or "").count("\n") + 1)
                    dropped.append(0)
                    continue
                gone = {np.array([x["h"], x["f"]], np.int64).tobytes() for x in drops.as_py()}
                all_lines = text.encode().split(b"\n")
                left = [x for x in all_lines if line_hash(x, min_chars) not in gone]
                texts.append(b"\n".join(left).decode())
                lines.append(len(all_lines))
                dropped.append(len(all_lines) - len(left))
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*own_names, "lines", "dropped"])

    schema = T.StructType([*plain.schema, T.StructField("lines", T.LongType()), T.StructField("dropped", T.LongType())])
    return joined.mapInArrow(run, schema).toDF(*names, *counts)
