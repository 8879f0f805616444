"""Where updating streams land: batches, snapshots of the last values, and whole results.

A landing folder holds ``batches/batch=N`` (what each micro-batch changed), ``snapshots/through=N``
(the last value per key of all batches up to N), ``results/version=N`` (whole results) and
``manifests/through=N`` (one row each).  A manifest is written after what it names, by one task into
one file; readers take the highest, so they never see a snapshot or a result that is half written.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Start streams with state on disk, in ``partitions`` parts; batches upload its changes only.

    A stream keeps the number it is first started with, so it is chosen for the state it will
    hold and not left to the batch setting of the session.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": STATE_STORE,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        # One store a partition for both sides of a join, in place of four.
        "spark.sql.streaming.join.stateFormatVersion": "3",
    }
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    usual = {name: spark.conf.get(name, None) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in usual.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def _started(stream: DataFrame, mode: str, land, checkpoint_path: str, partitions: int | None) -> StreamingQuery:
    writer = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(land)
        .option("checkpointLocation", checkpoint_path)
        .trigger(availableNow=True)
    )
    with state_settings(stream.sparkSession, partitions):
        return writer.start()


def _write_manifest(spark: SparkSession, path: str, through: int) -> None:
    row = spark.range(1, numPartitions=1).select(F.lit(through).cast("long").alias("written"))
    row.write.mode("overwrite").parquet(f"{path}/manifests/through={through}")


def _found(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, None before anything was written there."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def latest_manifest(spark: SparkSession, path: str) -> int | None:
    """The number of the newest whole snapshot or result, None before the first."""
    written = _found(spark, f"{path}/manifests")
    return None if written is None else written.agg(F.max("written")).first()[0]


def land_updates(
    stream: DataFrame, path: str, checkpoint_path: str, partitions: int | None = None
) -> StreamingQuery:
    """Write every batch of an update-mode stream to its own folder and stop at the end.

    A batch that is run again replaces its own folder, so the landing is idempotent.
    """

    def land(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id).cast("long")).write.mode("overwrite").parquet(
            f"{path}/batches/batch={batch_id}"
        )

    return _started(stream, "update", land, checkpoint_path, partitions)


def _newest(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the highest batch per key, with its ``_batch``."""
    rest = [c for c in rows.columns if c not in keys]
    newest: Column = F.max_by(F.struct(*rest), F.col("_batch")).alias("_newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def _since(spark: SparkSession, path: str, through: int | None) -> DataFrame:
    """The snapshot of ``through`` and the batches after it; older batches are not read."""
    batches = spark.read.parquet(f"{path}/batches")
    if through is None:
        return batches.drop("batch")
    later = batches.filter(F.col("batch") > through).drop("batch")
    return spark.read.parquet(f"{path}/snapshots/through={through}").unionByName(later)


def compact(spark: SparkSession, path: str, keys: Sequence[str]) -> int | None:
    """Fold all landed batches into a snapshot of the last value per key; returns its number.

    Reads the last snapshot and the batches after it.  Nothing is done when there are none, so a
    second run changes nothing; a run that was cut off is done again in full.  None before the
    first batch.  Run it between stream runs, or name one compacting job: two at once do the same work
    twice.
    """
    batches = _found(spark, f"{path}/batches")
    if batches is None:
        return None
    last = batches.agg(F.max("batch")).first()[0]
    through = latest_manifest(spark, path)
    if last is None or through is not None and through >= last:
        return through
    rows = _since(spark, path, through).filter(F.col("_batch") <= last)
    _newest(rows, keys).write.mode("overwrite").parquet(f"{path}/snapshots/through={last}")
    _write_manifest(spark, path, last)
    return last


def latest_values(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The current row per key: from the last snapshot and the batches after it."""
    return _newest(_since(spark, path, latest_manifest(spark, path)), keys).drop("_batch")


def replace_result(
    stream: DataFrame, path: str, checkpoint_path: str, partitions: int | None = None
) -> StreamingQuery:
    """Write the whole result of a complete-mode stream after each batch and stop at the end.

    Readers see the old result until the new one is whole.
    """

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/results/version={batch_id}")
        _write_manifest(batch.sparkSession, path, batch_id)

    return _started(stream, "complete", replace, checkpoint_path, partitions)


def current_result(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole result that ``replace_result`` wrote."""
    version = latest_manifest(spark, path)
    if version is None:
        raise ValueError(f"no result at {path}")
    return spark.read.parquet(f"{path}/results/version={version}")


def expire(spark: SparkSession, path: str, keep: int = 2) -> list[int]:
    """Delete what newer manifests stand for: all but the last ``keep`` snapshots or results.

    Batches go with the snapshot that holds them, one generation later, so that readers of
    the one before still find theirs.  Returns the manifests that went.
    """
    if keep < 1:
        raise ValueError("at least one manifest has to stay")
    written = _found(spark, f"{path}/manifests")
    numbers = [] if written is None else sorted(r[0] for r in written.select("written").collect())
    gone, kept = numbers[:-keep], numbers[-keep:]
    if not gone:
        return []
    files = spark.sparkContext._jvm.org.apache.hadoop.fs

    def delete(name: str) -> None:
        target = files.Path(f"{path}/{name}")
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

    for number in gone:
        # The manifest first: a reader never finds one whose rows are gone.
        for folder in ("manifests/through", "snapshots/through", "results/version"):
            delete(f"{folder}={number}")
    batches = _found(spark, f"{path}/batches")
    if batches is not None:
        old = batches.select("batch").distinct().filter(F.col("batch") <= kept[0])
        for row in old.collect():  # one row a folder
            delete(f"batches/batch={row['batch']}")
    return gone
