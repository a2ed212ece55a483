"""Join helper: a broadcast whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import table_bytes, written_table

#: bytes of a written side, at most, that are sent to every executor
MAX_BROADCAST_BYTES = 64 << 20


def sized_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``df`` written once to the shared folder, with a broadcast hint only if its files are small.

    Larger ones come back unhinted and the planner (with AQE) joins by shuffle.
    Nothing stays cached, and the written side survives lost executors.
    """
    kept, path = written_table(df, "dimension")
    return F.broadcast(kept) if table_bytes(df.sparkSession, path) <= max_bytes else kept
