"""Sinks: CSV and JSON exports, trace tables, run and evaluation logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loopwright.session import new_shared_path
from loopwright.sources.readers import folder_of_model


# A table of more columns is refused, never cut.
MAX_COLUMNS = 10_000


def write_csv(df: DataFrame, path: str, max_records: int = 0) -> None:
    """Any flat table as CSV with a header; quotes and line breaks survive."""
    (
        df.write.mode("errorifexists")
        .option("header", True)
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .option("maxRecordsPerFile", max_records)
        .csv(path)
    )


def record_fields(records: DataFrame, column: str = "record") -> list[str]:
    """The distinct field names over all records: content sorted first, then bookkeeping.

    Only the distinct names, found by partial aggregation, come to the driver; there are
    as many as the export has columns, and more than ``MAX_COLUMNS`` are refused.  Pass the
    declared names to ``records_wide`` where they are known, and this pass is not needed.
    """
    return _sorted_names(records.select(F.explode(F.map_keys(column)).alias("name")))


def _sorted_names(names: DataFrame) -> list[str]:
    names = [row["name"] for row in names.distinct().limit(MAX_COLUMNS + 1).collect()]
    if len(names) > MAX_COLUMNS:
        raise ValueError(f"the records have over {MAX_COLUMNS} field names; name those to export")
    return sorted(n for n in names if not n.startswith("_")) + sorted(
        n for n in names if n.startswith("_")
    )


def records_wide(
    records: DataFrame, fields: Sequence[str] | None = None, column: str = "record"
) -> DataFrame:
    """Record maps as columns.  Without any record the header is still there."""
    names = list(fields) if fields is not None else record_fields(records, column)
    if not names:
        names = ["inputs", "outputs"]
    return records.select(*[F.col(column)[n].alias(n) for n in names])


def _columnar(records: DataFrame) -> tuple[DataFrame, list[str]]:
    """The records read from a written table of their names and texts, and all names in order."""
    spark, path = records.sparkSession, new_shared_path(records.sparkSession, "records")
    parts = records.select(
        F.map_keys("record").alias("names"), F.map_values("record").alias("texts")
    )
    parts.write.parquet(path)
    stored = spark.read.schema(parts.schema).parquet(path)
    fields = _sorted_names(stored.select(F.explode("names").alias("name")))
    return stored.select(F.map_from_arrays("names", "texts").alias("record")), fields


def export_records(
    records: DataFrame,
    path: str,
    form: str = "csv",
    fields: Sequence[str] | None = None,
    chunk_rows: int = 0,
) -> Observation:
    """Write training records as CSV or JSON lines, in files of at most ``chunk_rows``.

    The returned observation holds ``total_records``, counted by the write itself.  Without
    ``fields`` a CSV export first writes the records' names and texts as two columns: the plan
    behind them runs once, the header is found in the column of names alone, and the
    export is a projection of that file.  JSON lines need no common columns: each record is
    written as it is, its fields sorted, in one pass.
    """
    if form not in ("csv", "json"):
        raise ValueError(f"unknown export format: {form}")
    counted = Observation()
    total = F.count(F.lit(1)).alias("total_records")
    if form == "json":
        given = F.map_filter("record", lambda _, v: v.isNotNull())
        if fields is not None:
            given = F.map_filter(given, lambda k, _: k.isin(*fields))
        line = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(given))))
        lines = records.select(F.coalesce(line, F.lit("{}")).alias("value"))
        lines.observe(counted, total).write.mode("errorifexists").option(
            "maxRecordsPerFile", chunk_rows
        ).text(path)
        return counted
    if fields is None:
        records, fields = _columnar(records)
    write_csv(records_wide(records, fields).observe(counted, total), path, chunk_rows)
    return counted


def write_traces(traces: DataFrame, path: str) -> None:
    """Append to the trace table, foldered by model and day.

    The rebalance gathers each folder's rows into few files; AQE splits a busy folder over
    several tasks and puts small ones together.
    """
    dated = traces.withColumn("date", F.to_date(F.timestamp_millis("timestamp_ms"))).withColumn(
        "model_name", folder_of_model(F.col("model_name"))
    )
    (
        dated.hint("rebalance", "model_name", "date")
        .write.mode("append")
        .partitionBy("model_name", "date")
        .parquet(path)
    )


def append_log(rows: DataFrame, path: str, run_date: str) -> None:
    """Append run parameters, metrics or evaluation rows to their log table."""
    rows.withColumn("run_date", F.lit(run_date).cast("date")).write.mode("append").partitionBy(
        "run_date"
    ).parquet(path)
