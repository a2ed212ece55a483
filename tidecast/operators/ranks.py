"""Exact global positions in a sort order without a single-partition window.

``Window.orderBy`` with no partition moves every row into one task. Here the
rows are range-partitioned on the sort key instead, numbered inside each
partition, and shifted by the row count of all earlier partitions (a table of
one row per partition). Every step is distributed; only P counts are shared.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidecast.session import shared_dir


def global_positions(df: DataFrame, order: Sequence[Column | str], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """Add a 0-based position column following ``order`` (which must be a total order).

    The position is exact: range partitions are disjoint and ordered, rows are
    sorted inside each partition, and ``monotonically_increasing_id`` counts
    rows within a partition in that sorted order.
    """
    spark = df.sparkSession
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n_part, *cols).sortWithinPartitions(*cols)
    tagged = ranged.withColumn("_mid", F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id())
    # Local index = id minus the partition's base (partition id << 33).
    tagged = tagged.withColumn("_local", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    # The range bounds come from a sample whose rows depend on shuffle fetch order,
    # so two executions may cut differently. Both consumers below (partition counts
    # and the numbered rows) must read ONE materialisation: a reliable checkpoint
    # in the shared folder, which also survives executor loss.
    shared_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off")
    # One row per partition: a proven bound, so the broadcast is safe.
    out = tagged.join(F.broadcast(offsets), "_pid")
    return out.withColumn(name, F.col("_off") + F.col("_local")).drop("_mid", "_pid", "_local", "_off")


def kth_values(df: DataFrame, col: str, ks: Sequence[int]) -> dict[int, object]:
    """Values at 0-based positions ``ks`` of the sorted distinct non-null values of ``col``."""
    distinct = df.select(col).where(F.col(col).isNotNull()).distinct()
    pos = global_positions(distinct, [col])
    rows = pos.where(F.col("pos").isin(list(ks))).select("pos", col).collect()
    return {int(r["pos"]): r[col] for r in rows}
