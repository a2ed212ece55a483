"""Scans of the base parquet tables and of text files with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One base table; later ``select``/``filter`` calls are pushed into the parquet scan."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType, columns: list[str] | None = None) -> DataFrame:
    """Header CSV scan with a declared schema (never inferred), optionally projected.

    Works for plain and gzip files alike (gzip is detected by extension; a
    ``.gz`` file is one split, so callers repartition after it when it is large).
    """
    df = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(path)
    return df.select(*columns) if columns else df


def path_exists(spark: SparkSession, path: str) -> bool:
    # Spark resolves a path without a scheme on its default file system, so ask the same one
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)


def optional_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Optional source: a missing file gives an empty table with the declared schema."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema)


class MissingSourceError(FileNotFoundError):
    pass


def required_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Required source: a missing file raises with the path in the message."""
    if not path_exists(spark, path):
        raise MissingSourceError(f"required source is not there: {path}")
    return read_csv(spark, path, schema)
