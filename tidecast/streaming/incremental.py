"""Incremental station-day counts with Structured Streaming.

The reference reads its trip file in chunks and keeps a running aggregate.
Here new event files are the chunks, and a file stream feeds the same cleaning and
the same fused conditional-count aggregate. Two ways to keep the result:

* ``run_to_partials``: every micro-batch writes its own partial counts under its
  batch id, and readers merge them. A batch costs what it holds, not what the table
  holds; a replayed batch replaces its own partial, and a partial that was never
  finished is not read, so failures neither lose nor double a count.
* ``run_to_table``: Spark keeps the running state (bounded by days x entities) and
  every micro-batch writes the complete table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidecast.operators import daily as D


def event_stream(spark: SparkSession, directory: str, schema: T.StructType, glob: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files of one table as a stream (declared schema, ``files_per_trigger`` per micro-batch)."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(directory)
    )


def running_daily_counts(events: DataFrame, type_values: Sequence[str], user_values: Sequence[str]) -> DataFrame:
    """Streaming form of the station-day table (all entities)."""
    return D.daily_entity_table(D.prepare_events(events, None), type_values, user_values)


def run_to_table(agg: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run the stream over everything available now, writing the complete table each micro-batch."""

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out_path)

    q = (
        agg.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def partial_path(out_path: str, batch_id: int) -> str:
    return f"{out_path}/batch={batch_id}"


def write_partial(events: DataFrame, batch_id: int, out_path: str, type_values: Sequence[str], user_values: Sequence[str]) -> None:
    """Partial counts of one micro-batch, in place of what an earlier try of this batch left."""
    counts = D.daily_entity_table(D.prepare_events(events, None), type_values, user_values)
    counts.write.mode("overwrite").parquet(partial_path(out_path, batch_id))


def run_to_partials(events: DataFrame, out_path: str, checkpoint: str, type_values: Sequence[str], user_values: Sequence[str]) -> None:
    """Run a stream of raw events over everything available now, one partial table for each micro-batch."""
    q = (
        events.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: write_partial(batch, number, out_path, type_values, user_values))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def finished_partials(spark: SparkSession, out_path: str) -> list[str]:
    """Folders of the batches that were written to the end (Spark marks them so)."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out_path)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = []
    for status in fs.listStatus(path):
        own = status.getPath()
        if own.getName().startswith("batch=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own, "_SUCCESS")):
            done.append(own.toString())
    return sorted(done)


def merged_partials(spark: SparkSession, out_path: str, schema: T.StructType, keys: Sequence[str]) -> DataFrame:
    """Counts of all finished batches added up by ``keys``; all other columns of ``schema`` are counts."""
    paths = finished_partials(spark, out_path)
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    counts = [c for c in schema.names if c not in keys]
    return rows.groupBy(*keys).agg(*[F.sum(c).cast(schema[c].dataType).alias(c) for c in counts])
