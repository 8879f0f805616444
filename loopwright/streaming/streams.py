"""Streaming twins of feedback ingest, running statistics and chunked export.

On the same finite input each stream gives the rows of its batch twin, as long as input
comes in time order (or the watermark delay covers its span).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loopwright.operators.feedback import (
    DEGRADED_PREFIX,
    RATING_NAME,
    feedback_counts,
    first_value_columns,
    training_records,
    up_rate,
    valid_feedback,
    with_feedback_id,
)
from loopwright.operators.serving import serving_counts
from loopwright.sources.writers import records_wide
from loopwright.streaming.landing import state_settings


def _feedback_events(feedback: DataFrame, lateness: str) -> DataFrame:
    return (
        valid_feedback(feedback)
        .withColumn("event_time", F.timestamp_millis("ts_ms"))
        .withWatermark("event_time", lateness)
    )


def _known_traces(traces: DataFrame, lateness: str, *columns: str) -> DataFrame:
    return traces.select(
        F.col("trace_id").alias("known_id"),
        F.timestamp_millis("timestamp_ms").alias("trace_time"),
        *columns,
    ).withWatermark("trace_time", lateness)


def _on_trace(earliest: str, latest: str) -> Column:
    """Feedback from ``earliest`` before its trace to ``latest`` after it: bounds the join state."""
    return (
        (F.col("trace_id") == F.col("known_id"))
        & (F.col("event_time") >= F.col("trace_time") - F.expr(f"INTERVAL {earliest}"))
        & (F.col("event_time") <= F.col("trace_time") + F.expr(f"INTERVAL {latest}"))
    )


def _once(events: DataFrame) -> DataFrame:
    # After the filter of its branch: an event is in the state of one branch only.
    return events.dropDuplicatesWithinWatermark(["feedback_id"])


def _event_columns(feedback: DataFrame) -> list[str]:
    columns = [*feedback.columns]
    return columns if "feedback_id" in columns else [*columns, "feedback_id"]


def accepted_feedback_stream(
    feedback: DataFrame,
    traces: DataFrame,
    lateness: str = "1 hour",
    earliest: str = "0 seconds",
    latest: str = "7 days",
) -> DataFrame:
    """Feedback events on a known trace, each once.

    Feedback counts for a trace from ``earliest`` before it to ``latest`` after it, which
    bounds the join state together with the watermarks.  Degraded ids pass unjoined.
    """
    events, known = _feedback_events(feedback, lateness), _known_traces(traces, lateness)
    degraded = F.startswith(F.col("trace_id"), F.lit(DEGRADED_PREFIX))
    matched = _once(events.filter(~degraded)).join(known, _on_trace(earliest, latest))
    columns = _event_columns(feedback)
    return matched.select(*columns).unionByName(_once(events.filter(degraded)).select(*columns))


def rejected_feedback_stream(
    feedback: DataFrame,
    traces: DataFrame,
    lateness: str = "1 hour",
    earliest: str = "0 seconds",
    latest: str = "7 days",
) -> DataFrame:
    """Feedback events for which no trace came, each once: the rest of ``accepted_feedback_stream``.

    An event is rejected when the watermark shows that its trace can no longer come; until then it
    stays in the state.  So do events without a trace id.
    """
    events, known = _feedback_events(feedback, lateness), _known_traces(traces, lateness)
    degraded = F.coalesce(F.startswith(F.col("trace_id"), F.lit(DEGRADED_PREFIX)), F.lit(False))
    joined = _once(events.filter(~degraded)).join(known, _on_trace(earliest, latest), "left_outer")
    return joined.filter(F.col("known_id").isNull()).select(*_event_columns(feedback))


def rated_traces_stream(
    traces: DataFrame,
    feedback: DataFrame,
    rating: str = "thumbs_up",
    lateness: str = "1 hour",
    earliest: str = "0 seconds",
    latest: str = "7 days",
    window: str = "1 hour",
) -> DataFrame:
    """Traces of one rating, once no feedback of theirs can come any more, in append mode.

    Feedback meets its trace in a join that times bound; then each trace keeps its first rating,
    correction and comment, which may come from three events.  Traces leave the state by windows
    of their own time, so that the state holds no more than the time range and one window.
    """
    columns = [c for c in traces.columns if c != "trace_id"]
    known = _known_traces(traces, lateness, *columns)
    named = feedback.withColumn("event_time", F.timestamp_millis("ts_ms"))
    events = with_feedback_id(named).withWatermark("event_time", lateness)
    given = ["trace_id", "feedback_id", "ts_ms", "rating", "corrected_output", "comment", "event_time"]
    joined = events.select(*given).join(known, _on_trace(earliest, latest))
    firsts = joined.groupBy(F.window("trace_time", window), "trace_id", *columns).agg(
        *first_value_columns()
    )
    wanted = F.col(RATING_NAME) == ("true" if rating == "thumbs_up" else "false")
    return firsts.filter(wanted).drop("window")


def closable(
    stream: DataFrame, last: Mapping[str, object], path: str
) -> tuple[DataFrame, Callable[[], None]]:
    """A finite stream that can be given one last row, and the function that gives it.

    The row moves the watermark past all that came before, so that state that waits for it is given
    out.  ``last`` gives the row's columns, its time among them; the others are NULL.  It comes by
    files at ``path`` and must come after all others: see ``run_to_end``.
    """
    spark, fields = stream.sparkSession, stream.schema.fields
    row = spark.range(1).select(
        *[F.lit(last.get(f.name)).cast(f.dataType).alias(f.name) for f in fields]
    )
    row.limit(0).write.parquet(path)
    closing = spark.readStream.schema(row.schema).parquet(path)
    return stream.unionByName(closing), lambda: row.write.mode("append").parquet(path)


def run_to_end(start: Callable[[], StreamingQuery], *closings: Callable[[], None]) -> None:
    """Run a query through its input, close its streams, and run it on to give out what waits.

    ``start`` starts the query, each time with the same checkpoint folder.
    """
    for give in (None, *([closings] if closings else [])):
        for closing in give or ():
            closing()
        query = start()
        try:
            query.awaitTermination()
        finally:
            query.stop()


def feedback_stats_stream(feedback: DataFrame, *by: str) -> DataFrame:
    """Running feedback counts and up rate per group, for update mode."""
    return feedback.groupBy(*by).agg(*feedback_counts()).withColumn("thumbs_up_rate", up_rate())


def serving_metrics_stream(
    requests: DataFrame, window: str = "1 hour", lateness: str = "10 minutes", by: Sequence[str] = ()
) -> DataFrame:
    """Serving metrics per tumbling window (and group), for update or append mode."""
    return (
        requests.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window), *by)
        .agg(*serving_counts())
        .select(F.col("window.start").alias("window_start"), *by, "total_requests", "total_errors",
                "average_latency_ms")
    )


def serving_totals_stream(requests: DataFrame, *by: str) -> DataFrame:
    """Running totals of the serving log and each group's first request, for complete mode."""
    return requests.groupBy(*by).agg(*serving_counts(), F.min("ts").alias("first_seen"))


def append_stream(
    stream: DataFrame,
    path: str,
    checkpoint_path: str,
    form: str = "parquet",
    partitions: int | None = None,
) -> StreamingQuery:
    """Append a stream to files, exactly once, and stop at the end of the input."""
    writer = (
        stream.writeStream.outputMode("append")
        .format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint_path)
        .option("header", True)
        .trigger(availableNow=True)
    )
    with state_settings(stream.sparkSession, partitions):
        return writer.start()


def export_stream(rows: DataFrame, fields: Sequence[str], use_corrected: bool = True) -> DataFrame:
    """Export rows (see ``trace_rows``) to training columns, row by row, for a file sink."""
    return records_wide(training_records(rows, use_corrected), fields)
