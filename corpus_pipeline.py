"""From raw documents to packed token sequences: five stages, each written as Parquet and read again by the next.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and returns the columns of ``documents``; only the last returns packed pieces.
Null ids, empty tables, repeated rows and further columns are handled as the
operators' modules define.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import table, written
from tidecast.llm.decontaminate import clean
from tidecast.llm.lines import drop_lines
from tidecast.llm.op10 import packed
from tidecast.llm.quality import clean_documents
from tidecast.llm.simhash import keep_one

ORACLE_SQL = None  # fingerprints, tokens and packing are beyond SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; failing lines of the others are taken out."""
    return clean_documents(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A line that several documents share stays only in the first of them."""
    kept = drop_lines(docs, counts=("__lines", "__dropped")).select(*docs.columns)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return keep_one(docs, shingle=3, d=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with the benchmark go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All tokens of the documents left, packed into sequences."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
