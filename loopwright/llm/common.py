"""What the operators of this subpackage share: settings, stored tables, worker state."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.session import configure, new_shared_path

# Rows and bytes of one Arrow batch: a task holds one batch of texts at a time.
BATCH_ROWS = 1000
BATCH_BYTES = 4 * 1024 * 1024


def session(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once to the shared folder and read back; survives lost executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str
) -> DataFrame:
    """Map each Arrow batch with a function that ``make`` prepares once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            yield each(batch)
        give_back()

    return df.mapInArrow(run, schema)


def of_text(text: str, make: Callable[[], Callable[[pa.Array], pa.Array]], kind: str) -> Column:
    """A column made of a text column; nothing else of the row goes to Python and back."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        each = make()
        for batch in batches:
            yield each(batch)
        give_back()

    return run(F.col(text))


def give_back() -> None:
    """Return a worker's unused memory to the system, so that idle workers hold little."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def worker_state(name: str, make: Callable[[], object]) -> object:
    """One object a Python worker, kept from task to task (caches only: never results).

    A worker keeps the last one only: what an earlier step has cached gives way to the next step's.
    """
    holder = sys.modules.setdefault("_loopwright_worker", types.ModuleType("_loopwright_worker"))
    held = vars(holder).setdefault("held", {})
    if name not in held:
        held.clear()
        give_back()
        held[name] = make()
    return held[name]


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
