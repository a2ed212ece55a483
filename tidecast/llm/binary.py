"""Token-id files with a minimal perfect hash index.

Payload: ``ids-NNNNN.bin`` holds the ids of a run of documents in ascending order
of their id (nulls first; rows with one id in order of a hash of their text), raw,
little-endian, 2 bytes each (4 if the vocabulary needs them). Index: a sharded
minimal perfect hash maps a document key (id and copy number) to slots with a
stored fingerprint, payload file, offset and length, so any document is read by
one look-up and one ranged read. All files are written by tasks into the shared
folder and moved into place whole, so repeated tasks are harmless.

Defined cases: null or empty text is its end id alone; rows with one id are
copies 0, 1, ... of it; an empty table has no files; other columns are ignored.
"""

from __future__ import annotations

import posixpath
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.llm import sharded
from tidecast.llm.common import open_fs, put_file, shared_folder, strings, written
from tidecast.llm.tokens import encoder

WIDTHS = {2: "<u2", 4: "<u4"}


@dataclass(frozen=True)
class TokenFiles:
    """A written set: folders, id width, number of index shards, and the table of files (file, n_ids, base)."""

    payload: str
    index: str
    width: int
    shards: int
    files: DataFrame
    entries: DataFrame


def payload_name(number: int) -> str:
    return f"ids-{number:06d}.bin"


def _key(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("copy"))


def write_files(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", width: int = 2, shard_keys: int = sharded.SHARD_KEYS) -> TokenFiles:
    spark = docs.sparkSession
    payload, index = shared_folder(spark, "token-payload"), shared_folder(spark, "token-index")
    most = 1 << 8 * width

    def run(batches):
        number, rows, at = TaskContext.get().partitionId(), [], 0

        def parts():
            nonlocal at
            for b in batches:
                ids = b.column(0).to_pylist()
                for i, raw in zip(ids, encoder(tokenizer).encode(strings(b.column(1)))):
                    own = np.frombuffer(raw, "<u4")
                    if width < 4 and own.max() >= most:
                        raise ValueError(f"an id does not fit {width} bytes")
                    rows.append((i, at, len(own)))
                    at += len(own)
                    yield own.astype(WIDTHS[width]).tobytes()

        first = next(source := parts(), None)
        if first is None:
            return

        def again():
            yield first
            yield from source

        put_file(payload, payload_name(number), again())
        for k in range(0, len(rows), 1 << 16):
            i, start, n = zip(*rows[k : k + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array([number] * len(i), pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "file", "offset", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    entries = written(dealt.select("doc_id", "text").mapInArrow(run, "doc_id long, file long, offset long, n_tokens long"), "token-entries")
    files = entries.groupBy("file").agg(F.sum("n_tokens").alias("n_ids"), F.count("*").alias("n_docs"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    files = written(files.select("file", "n_ids", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base")), "token-files")
    entries = _copies(entries, files)
    n = entries.count()
    shards = max(1, -(-n // shard_keys))
    if n:
        sharded.build(entries.select(_key(1).alias("h"), _key(2).alias("f"), "file", "offset", "n_tokens"), shards, index)
    return TokenFiles(payload, index, width, shards, files, entries)


def _copies(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries with ``copy``: a row's number among those of its id. Positions, not windows, so that a frequent id has no task of its own."""
    placed = entries.join(files.select("file", "base"), "file").withColumn("start", F.col("base") + F.col("offset"))
    same = placed.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("start").alias("first")).where("n > 1").drop("n")
    # few ids repeat; for them the number is that of the rows of the id in earlier files plus the place in the own file
    again = placed.join(same, placed.doc_id.eqNullSafe(same.doc_id), "left_semi")
    in_file = again.groupBy("doc_id", "file").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("doc_id").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    in_file = in_file.select(F.col("doc_id").alias("own"), F.col("file").alias("own_file"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    place = F.row_number().over(Window.partitionBy("doc_id", "file").orderBy("offset")) - 1
    numbered = again.withColumn("place", place).join(in_file, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("file") == F.col("own_file")))
    numbered = numbered.select("doc_id", (F.col("earlier") + F.col("place")).alias("copy"), "file", "offset", "n_tokens")
    once = placed.join(same, placed.doc_id.eqNullSafe(same.doc_id), "left_anti").select("doc_id", F.lit(0).cast("long").alias("copy"), "file", "offset", "n_tokens")
    return written(once.unionAll(numbered), "token-keys")


def look_up(keys: DataFrame, written_files: TokenFiles) -> DataFrame:
    """(doc_id, copy, file, offset, n_tokens) of the keys (doc_id, copy) that the index holds."""
    folder = written_files.index

    def run(batches):
        reader = sharded.Reader(folder)
        for b in batches:
            shard, h, f = (b.column(i).to_numpy() for i in (2, 3, 4))
            member, found = reader.find(shard, h, f)
            names = ["file", "offset", "n_tokens"]
            out = [b.column(0), b.column(1), *(pa.array(found.get(c, np.zeros(len(h), np.int64))) for c in names)]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "copy", *names]).filter(pa.array(member))

    hashed = keys.select("doc_id", "copy", _key(1).alias("h"), _key(2).alias("f")).withColumn("shard", sharded.shard_of(written_files.shards))
    dealt = hashed.repartitionByRange("shard", "h").sortWithinPartitions("shard", "h").select("doc_id", "copy", "shard", "h", "f")
    return dealt.mapInArrow(run, "doc_id long, copy long, file long, offset long, n_tokens long")


def read_back(places: DataFrame, written_files: TokenFiles, with_ids: bool = False) -> DataFrame:
    """(doc_id, copy, file, offset, n_tokens, ids_crc32) and, if asked for, the ids, from the payload files by ranged reads."""
    folder, width = written_files.payload, written_files.width

    def run(batches):
        fs, root = open_fs(folder)
        held, source = None, None
        for b in batches:
            crcs, ids = [], []
            for number, start, n in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if number != held:
                    if source is not None:
                        source.close()
                    source, held = fs.open_input_file(posixpath.join(root, payload_name(number))), number
                raw = source.read_at(n * width, start * width)
                own = np.frombuffer(raw, WIDTHS[width]).astype("<u4")
                crcs.append(zlib.crc32(own))
                if with_ids:
                    ids.append(own.tobytes())
            more = [pa.array(ids, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crcs, pa.int64()), *more], names=["doc_id", "copy", "file", "offset", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])])

    dealt = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "doc_id long, copy long, file long, offset long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
