"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a hot key even where the split costs one more exchange later on.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}

# Largest side that is broadcast after its bytes were counted.
BROADCAST_BYTES = 32 * 1024 * 1024


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every operator relies on."""
    import loopwright

    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    # Functions of this package travel with the task: workers need not have it installed.
    cloudpickle.register_pickle_by_value(loopwright)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only for local sessions."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="loopwright-"))
    return context.getCheckpointDir().rstrip("/")


def new_shared_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other call has used."""
    return f"{shared_dir(spark)}/loopwright/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows and their partitions survive lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = shared_dir(df.sparkSession)
        if not context.getCheckpointDir():
            context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the counted bytes are so few; ``df`` is scanned once."""
    size = df.agg(
        F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("bytes")
    ).first()["bytes"]
    return size <= limit


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark for broadcast when the counted bytes allow it, else leave the plan to AQE.

    ``df`` is scanned once for the count, so pass a written or checkpointed table.
    """
    return F.broadcast(df) if is_small(df, limit) else df


def lookup_side(df: DataFrame) -> DataFrame:
    """The small side of a lookup join, computed once and broadcast if its size allows.

    Without this the large side is shuffled before AQE can see that the result of an
    aggregation is small.  Beyond the limit it stays an equi join with AQE's skew split.
    """
    return broadcast_if_small(checkpoint(df))
