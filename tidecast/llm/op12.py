"""Query op12: quality of all documents, learnt from the labels of three quarters of the ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import table
from tidecast.llm.nbsvm import learn, score

NAME = "op12_quality_classifier"
HELD_OUT = 2  # fixed value: the remainder of crc32(doc_id as text) modulo 4 whose labels are never learnt from
THRESHOLD = 0.7


def held_out(doc_id: str) -> Column:
    """A row without an id is not held out (and has no label to learn from)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == HELD_OUT, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"), ~held_out("own_id"))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
