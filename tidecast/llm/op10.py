"""Query op10: all documents packed into sequences of 2048 tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidecast.llm.common import table, written
from tidecast.llm.packing import pack, pieces
from tidecast.llm.tokens import default_path

NAME = "op10_best_fit_packing"


def packed(docs: DataFrame) -> DataFrame:
    return pack(written(pieces(docs, default_path()), "pieces"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
