"""Query op4: license scan of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import table
from tidecast.llm.licenses import license_scan

NAME = "op4_license_scan"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents")).drop("spans")
