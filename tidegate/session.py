"""Session defaults, reliable checkpoints and size-checked small tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

# Upper bounds for a table that may pass through the driver and be broadcast.
SMALL_ROWS = 50_000
SMALL_CELLS = 2_000_000


def build_session(app: str = "tidegate", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are tuned for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.checkpoint.compress": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        # streaming state beyond the heap
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        # merge a hot source's rows into partial sessions before the shuffle
        "spark.sql.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    for name, value in {**defaults, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only for a local, unconfigured session."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if root:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(root)
        return root
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    root = tempfile.mkdtemp(prefix="tidegate-")
    sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stable(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder, so that lost executors cost no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str = "table", **options: str) -> DataFrame:
    """Write to the shared folder as Parquet and read back: later passes read only the columns they use."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_small(df: DataFrame, label: str = "table") -> DataFrame:
    """``written``, packed more densely: for large tables of codes that take much of the disk."""
    return written(df, label, compression="zstd")


def pinned(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Compute a small table once and keep it as a local relation.

    A local relation carries its exact size, so Catalyst broadcasts it only when
    it fits ``spark.sql.autoBroadcastJoinThreshold``. A table with more than
    ``max_rows`` rows, or with fewer of very many columns, is written to the
    shared folder and joined by shuffle. A caller whose rows hold arrays passes
    a ``max_rows`` that allows for their length.
    """
    max_rows = min(max_rows, max(1, SMALL_CELLS // max(1, len(df.columns))))
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return stable(df)
    local = df.sparkSession.createDataFrame(table, schema=df.schema)
    local._pinned_rows = table
    return local


def largest(df: DataFrame, column: str) -> int:
    """Maximum of a counter column, 0 for an empty table; no job for a pinned table."""
    rows = getattr(df, "_pinned_rows", None)
    value = pc.max(rows.column(column)).as_py() if rows is not None else df.agg(F.max(column)).first()[0]
    return value or 0
