"""Query op9: token-id files of all documents, written, looked up and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.binary import look_up, read_back, write_files
from tidecast.llm.common import table
from tidecast.llm.tokens import default_path

NAME = "op9_token_files"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = write_files(table(spark, sf_dir, "documents"), default_path())
    read = read_back(look_up(made.entries.select("doc_id", "copy"), made), made)
    placed = read.join(made.files.select("file", "base"), "file")
    return placed.select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
