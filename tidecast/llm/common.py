"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.session import scratch_path

# The white space of the contracts, and the two word patterns.
SPACES = " \t\n\x0b\x0c\r"
WORD_BYTES = rb"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: bytes.translate table: A-Z lower-cased, every other ASCII byte that is no letter or digit becomes a space.
TERM_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def terms(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text after lower-casing A-Z, as UTF-8; none for null."""
    return text.encode().translate(TERM_TABLE).split() if text else []


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with columns named c0, c1, ...: no name clashes with an operator's own, and Arrow functions take no dots."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for files that tasks write themselves, with the scheme of the file system Spark resolves it on."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, name))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by shared_folder()."""
    return pafs.FileSystem.from_uri(uri)


def put_file(folder: str, name: str, parts: Iterator[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a repeated task replaces it whole."""
    fs, root = open_fs(folder)
    fs.create_dir(root, recursive=True)
    temp, size = posixpath.join(root, f".{name}.{uuid.uuid4().hex}"), 0
    with fs.open_output_stream(temp) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    fs.move(temp, posixpath.join(root, name))
    return size


def read_file(folder: str, name: str) -> bytes:
    fs, root = open_fs(folder)
    with fs.open_input_stream(posixpath.join(root, name)) as f:
        return f.read()


def strings(column: pa.Array) -> Iterator[str | None]:
    """One Python value at a time, so that a batch of long texts is not held twice."""
    for v in column:
        yield v.as_py()


def quiet_threads() -> None:
    """One thread for each Python worker; Spark has the cores."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
