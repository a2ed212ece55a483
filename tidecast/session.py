"""Session helpers: building a session for tests/bench and finding the shared work folder."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

# Used only when the session names no shared folder (local tests); on a cluster
# spark.checkpoint.dir points at shared storage and is always preferred.
_LOCAL_FALLBACK = "/tmp/tidecast-work"


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Return the active session, or build one tuned for this library.

    AQE is on so that small stages are coalesced at runtime and skewed join
    partitions are split; broadcast joins are only ever requested explicitly
    for sides whose size is bounded (see ``sized_broadcast``).
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName("tidecast")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session. Only a local master may
    leave it unset and gets a local fallback; any other master must name it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _LOCAL_FALLBACK
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique location below the shared folder."""
    return f"{shared_dir(spark)}/tidecast/{name}-{uuid.uuid4().hex[:12]}"


def written_table(df: DataFrame, name: str, file_rows: int = 0) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder, ``file_rows`` a file at most, and read back, and its path: computed once, no cache to release."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", file_rows).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of ``path`` and the place on it, for tasks that read or write files themselves."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(where).getLength()
