"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One row of a broadcast lookup is at most a few hundred bytes, so this many rows
# stay far below the memory of an executor.
BROADCAST_ROWS = 200_000
# so that a core that is done early finds more to do
TASKS_A_CORE = 4


def build_session(app: str = "callgauge", **settings: str) -> SparkSession:
    """A session with the settings the operators were tuned with.

    The operators do not need them to be right; adaptive execution (coalescing,
    skew splitting) and zone-free timestamps are what they were planned for.
    """
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder;
    on a cluster a missing setting is an error, never a machine-local path.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    root = tempfile.mkdtemp(prefix="callgauge-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete what was written to a ``scratch_path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out over several tasks a core, however few files they come from.

    For small rows much is computed from. By a hash of all columns: no key can be hot, and a
    task that runs again deals as before.
    """
    parts = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(parts, *df.columns)


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Materialise ``df``, count it, and mark it for broadcast only if it is small.

    Above ``max_rows`` the frame comes back unmarked, so the join that uses it is
    planned as an ordinary shuffled join (which adaptive execution can split when
    a key is hot).
    """
    kept = materialize(df)
    return F.broadcast(kept) if kept.limit(max_rows + 1).count() <= max_rows else kept
