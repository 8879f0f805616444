"""N: streams run to the end of their input and compared with the batch result."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.aggregates import FEEDBACK_SUMS
from loopwright.checked.scans import RECORD_COLUMNS, RECORDS
from loopwright.operators.feedback import trace_rows
from loopwright.session import new_shared_path
from loopwright.streaming import landing, streams


def stream_of(t, table: str):
    """A given table as a file stream."""
    schema = t.table(table).schema
    return t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{table}.parquet*")


def events_stream(t):
    return stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def feedback_stream_of(t):
    return t.label_feedback(stream_of(t, "labels")).unionByName(t.event_feedback(events_stream(t)))


# Later than every event by more than any range of a join: after 2100.
CLOSING_MS = 4_200_000_000_000


def closable_streams(t):
    """Traces and feedback, and what gives each a row that moves the watermark past all."""
    traces, end_traces = streams.closable(
        t.document_traces(stream_of(t, "documents")),
        {"trace_id": "closing trace", "timestamp_ms": CLOSING_MS},
        new_shared_path(t.spark, "closing-traces"),
    )
    feedback, end_feedback = streams.closable(
        feedback_stream_of(t),
        {"trace_id": "closing", "ts_ms": CLOSING_MS, "rating": "thumbs_up"},
        new_shared_path(t.spark, "closing-feedback"),
    )
    return traces, feedback, (end_traces, end_feedback)


def cores(t):
    """One state partition per core."""
    return t.spark.sparkContext.defaultParallelism


@query(
    "N1_feedback_stream",
    uses=["traces", "feedback"],
    sql="""
    SELECT f.feedback_id, f.trace_id, f.rating, f.ts_ms
    FROM feedback f LEFT JOIN traces t ON f.trace_id = t.trace_id
    WHERE f.rating IN ('thumbs_up', 'thumbs_down')
      AND (starts_with(f.trace_id, 'degraded-')
           OR f.ts_ms BETWEEN t.timestamp_ms - 172800000 AND t.timestamp_ms + 3456000000)""",
)
def feedback_stream(t):
    traces = t.document_traces(stream_of(t, "documents"))
    accepted = streams.accepted_feedback_stream(
        feedback_stream_of(t), traces, earliest="2 days", latest="40 days"
    )
    path, state = new_shared_path(t.spark, "n1"), new_shared_path(t.spark, "n1-state")
    columns = ["feedback_id", "trace_id", "rating", "ts_ms"]
    streams.run_to_end(
        lambda: streams.append_stream(accepted.select(*columns), path, state, partitions=cores(t))
    )
    return t.spark.read.schema(
        "feedback_id string, trace_id string, rating string, ts_ms long"
    ).parquet(path)


@query(
    "N1_rejected_stream",
    uses=["traces", "feedback"],
    sql="""
    SELECT f.feedback_id, f.trace_id, f.rating, f.ts_ms
    FROM feedback f LEFT JOIN traces t ON f.trace_id = t.trace_id
     AND f.ts_ms BETWEEN t.timestamp_ms - 172800000 AND t.timestamp_ms + 3456000000
    WHERE f.rating IN ('thumbs_up', 'thumbs_down')
      AND NOT starts_with(f.trace_id, 'degraded-') AND t.trace_id IS NULL""",
)
def rejected_stream(t):
    traces, feedback, ends = closable_streams(t)
    rejected = streams.rejected_feedback_stream(
        feedback, traces, earliest="2 days", latest="40 days"
    )
    path, state = new_shared_path(t.spark, "n1r"), new_shared_path(t.spark, "n1r-state")
    columns = ["feedback_id", "trace_id", "rating", "ts_ms"]
    streams.run_to_end(
        lambda: streams.append_stream(rejected.select(*columns), path, state, partitions=cores(t)), *ends
    )
    return t.spark.read.schema(
        "feedback_id string, trace_id string, rating string, ts_ms long"
    ).parquet(path)


@query(
    "N2_feedback_stats_stream",
    uses=["feedback"],
    sql=f"""
    SELECT coalesce(user_id, 'anonymous') AS user_id, {FEEDBACK_SUMS}
    FROM feedback GROUP BY coalesce(user_id, 'anonymous')""",
)
def feedback_stats_stream(t):
    feedback = feedback_stream_of(t)
    named = feedback.withColumn("user_id", F.coalesce("user_id", F.lit("anonymous")))
    stats = streams.feedback_stats_stream(named, "user_id")
    path, state = new_shared_path(t.spark, "n2"), new_shared_path(t.spark, "n2-state")
    streams.run_to_end(lambda: landing.land_updates(stats, path, state, cores(t)))
    return landing.latest_values(t.spark, path, ["user_id"])


@query(
    "N2_compacted_stats",
    uses=["feedback"],
    sql=f"""
    SELECT coalesce(user_id, 'anonymous') AS user_id, {FEEDBACK_SUMS}
    FROM feedback GROUP BY coalesce(user_id, 'anonymous')""",
)
def compacted_stats(t):
    """The source comes in two runs, with a compaction after the first and one after the second."""
    path, state = new_shared_path(t.spark, "n2c"), new_shared_path(t.spark, "n2c-state")
    source = new_shared_path(t.spark, "n2c-source")
    parts = [t.label_feedback(t.table("labels")), t.event_feedback(t.events)]
    schema = parts[0].unionByName(parts[1]).schema
    for part in parts:
        part.write.mode("append").parquet(source)
        feedback = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
        named = feedback.withColumn("user_id", F.coalesce("user_id", F.lit("anonymous")))
        stats = streams.feedback_stats_stream(named, "user_id")
        streams.run_to_end(lambda s=stats: landing.land_updates(s, path, state, cores(t)))
        landing.compact(t.spark, path, ["user_id"])
    return landing.latest_values(t.spark, path, ["user_id"])


@query(
    "N3_serving_stream",
    uses=["requests"],
    sql="""
    SELECT epoch_us(date_trunc('hour', ts)) AS window_us, model_name, count(*) AS total_requests,
           count(*) FILTER (is_error) AS total_errors,
           round(avg(latency_ms), 6) AS average_latency_ms
    FROM requests GROUP BY date_trunc('hour', ts), model_name""",
)
def serving_stream(t):
    requests = t.request_log(events_stream(t))
    metrics = streams.serving_metrics_stream(requests, "1 hour", by=["model_name"])
    path, state = new_shared_path(t.spark, "n3"), new_shared_path(t.spark, "n3-state")
    streams.run_to_end(lambda: landing.land_updates(metrics, path, state, cores(t)))
    found = landing.latest_values(t.spark, path, ["window_start", "model_name"])
    return found.withColumn("window_us", F.unix_micros("window_start")).drop("window_start")


@query(
    "N3_serving_totals",
    uses=["requests"],
    sql="""
    SELECT CAST(row_number() OVER (ORDER BY min(ts), model_name) AS INTEGER) AS place, model_name,
           count(*) AS total_requests, count(*) FILTER (is_error) AS total_errors,
           round(avg(latency_ms), 6) AS average_latency_ms
    FROM requests GROUP BY model_name""",
)
def serving_totals(t):
    totals = streams.serving_totals_stream(t.request_log(events_stream(t)), "model_name")
    path, state = new_shared_path(t.spark, "n3t"), new_shared_path(t.spark, "n3t-state")
    streams.run_to_end(lambda: landing.replace_result(totals, path, state, cores(t)))
    # One row a model, all of which the stream's state holds.
    order = Window.partitionBy(F.lit(0)).orderBy("first_seen", "model_name")
    found = landing.current_result(t.spark, path).withColumn("place", F.row_number().over(order))
    return found.drop("first_seen")


@query(
    "N4_export_stream",
    uses=["traces", "feedback"],
    sql=RECORDS
    + """
    SELECT lang, n_chars, source, 'thumbs_up' AS _rating, trace_id AS _trace_id FROM records""",
)
def export_stream(t):
    traces, feedback, ends = closable_streams(t)
    # Longer than the tables span, so that all feedback counts, as in the batch export.
    rated = streams.rated_traces_stream(
        traces, feedback, earliest="400 days", latest="400 days", window="1 day"
    )
    rows = streams.export_stream(trace_rows(rated), RECORD_COLUMNS)
    path, state = new_shared_path(t.spark, "n4"), new_shared_path(t.spark, "n4-state")
    streams.run_to_end(lambda: streams.append_stream(rows, path, state, "json", cores(t)), *ends)
    return t.spark.read.schema(", ".join(f"{c} string" for c in RECORD_COLUMNS)).json(path)
