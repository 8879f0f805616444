"""Streams on small inputs: first values, rejects, closing rows, snapshots and whole results."""

import pytest
from pyspark.sql import functions as F

from loopwright.operators.feedback import rated_traces, trace_rows
from loopwright.streaming import landing, streams

FEEDBACK = (
    "feedback_id string, trace_id string, rating string, corrected_output string, comment string, "
    "user_id string, ts_ms long"
)
TRACES = "trace_id string, timestamp_ms long, inputs string, outputs string, model_name string"
HOUR, CLOSING = 3_600_000, 4_200_000_000_000
# The first watermark is the epoch, so all times come after it.
BASE = 1_704_067_200_000


def source(spark, folder, name, rows, schema):
    """A folder with one file a row, and the stream that reads it."""
    path = f"{folder}/{name}"
    for row in rows:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)
    if not rows:
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path)


def both(spark, folder, feedback, traces):
    feedback = source(spark, folder, "feedback", feedback, FEEDBACK)
    traces = source(spark, folder, "traces", traces, TRACES)
    last = {"trace_id": "closing", "ts_ms": CLOSING, "rating": "thumbs_up"}
    feedback, end_feedback = streams.closable(feedback, last, f"{folder}/feedback-end")
    last = {"trace_id": "closing trace", "timestamp_ms": CLOSING}
    traces, end_traces = streams.closable(traces, last, f"{folder}/traces-end")
    return feedback, traces, (end_feedback, end_traces)


def landed(spark, stream, folder, schema, ends=()):
    def start():
        return streams.append_stream(stream, f"{folder}/out", f"{folder}/state", partitions=2)

    streams.run_to_end(start, *ends)
    return spark.read.schema(schema).parquet(f"{folder}/out").collect()


def trace(number, at=0):
    return (f"t{number}", BASE + at, '{"q":"a"}', '{"a":"b"}', "m")


def given(number, trace_id, at, rating="thumbs_up", corrected=None, comment=None):
    return (f"f{number}", trace_id, rating, corrected, comment, "u", BASE + at)


def test_three_firsts_come_from_three_events(spark, tmp_path):
    feedback = [
        given(1, "t1", 10, comment="late words", rating="thumbs_up"),
        given(2, "t1", 5, rating="thumbs_down", corrected="{}", comment=""),
        given(3, "t1", 20, corrected='{"a":"fixed"}', rating="thumbs_up"),
        given(4, "t2", 7, corrected='{"a":"x"}'),
        given(5, "t2", 7, corrected='{"a":"y"}', comment="n"),
        given(6, "t3", 8 * HOUR * 24),  # after the range
        given(7, "nobody", 9),
    ]
    traces = [trace(1), trace(2), trace(3), trace(4)]
    batch_feedback = spark.createDataFrame(feedback[:5], FEEDBACK)
    batch_traces = spark.createDataFrame(traces, TRACES)
    for rating in ("thumbs_up", "thumbs_down"):
        fb, tr, ends = both(spark, f"{tmp_path}/{rating}", feedback, traces)
        rows = trace_rows(streams.rated_traces_stream(tr, fb, rating))
        found = landed(spark, rows, f"{tmp_path}/{rating}", rows.schema, ends)
        expected = trace_rows(rated_traces(batch_traces, batch_feedback, rating)).collect()
        assert sorted(found) == sorted(expected) and len(found) == 1


def test_rejects_and_accepts_share_the_events(spark, tmp_path):
    feedback = [
        given(1, "t1", HOUR),
        given(1, "t1", HOUR),  # a retry
        given(2, "nobody", HOUR),
        given(2, "nobody", HOUR),
        given(3, "t1", 9 * 24 * HOUR),  # too late for its trace
        given(4, "degraded-7", HOUR),
        given(5, "t2", HOUR, rating="unsure"),
        given(6, None, HOUR),
    ]
    schema, found = "feedback_id string, trace_id string", {}
    for make in (streams.accepted_feedback_stream, streams.rejected_feedback_stream):
        folder = f"{tmp_path}/{make.__name__}"
        fb, tr, ends = both(spark, folder, feedback, [trace(1), trace(2)])
        rows = landed(spark, make(fb, tr).select("feedback_id", "trace_id"), folder, schema, ends)
        found[make] = sorted(r[0] for r in rows)
    assert found[streams.accepted_feedback_stream] == ["f1", "f4"]
    assert found[streams.rejected_feedback_stream] == ["f2", "f3", "f6"]


def test_without_a_closing_row_rejects_wait(spark, tmp_path):
    fb = source(spark, tmp_path, "f", [given(1, "nobody", HOUR)], FEEDBACK)
    tr = source(spark, tmp_path, "t", [trace(1)], TRACES)
    rejected = streams.rejected_feedback_stream(fb, tr).select("feedback_id")
    assert landed(spark, rejected, tmp_path, "feedback_id string") == []


def totals(spark, path, keys=("k",)):
    return sorted((tuple(r) for r in landing.latest_values(spark, path, keys).collect()), key=str)


def write_batch(spark, path, number, rows):
    df = spark.createDataFrame(rows, "k string, n long").withColumn("_batch", F.lit(number).cast("long"))
    df.write.mode("overwrite").parquet(f"{path}/batches/batch={number}")


def test_compaction_changes_no_value(spark, tmp_path):
    path = f"{tmp_path}/landing"
    assert landing.compact(spark, path, ["k"]) is None and landing.latest_manifest(spark, path) is None
    write_batch(spark, path, 0, [("a", 1), ("b", 1)])
    write_batch(spark, path, 1, [("a", 2)])
    before = totals(spark, path)
    assert before == [("a", 2), ("b", 1)]
    assert landing.compact(spark, path, ["k"]) == 1
    assert totals(spark, path) == before
    assert landing.compact(spark, path, ["k"]) == 1  # nothing new: the same
    write_batch(spark, path, 1, [("a", 2)])  # the last batch is run again
    assert totals(spark, path) == before
    write_batch(spark, path, 2, [("b", 5), ("c", None), (None, 4)])
    now = sorted([("a", 2), ("b", 5), ("c", None), (None, 4)], key=str)
    assert totals(spark, path) == now
    # A compaction that died before its manifest is done again.
    write_snapshot = f"{path}/snapshots/through=2"
    spark.createDataFrame([("zzz", 1, 2)], "k string, n long, _batch long").write.parquet(write_snapshot)
    assert len(totals(spark, path)) == 4
    assert landing.compact(spark, path, ["k"]) == 2
    assert totals(spark, path) == now


def test_old_batches_are_not_read_and_expire(spark, tmp_path):
    path = f"{tmp_path}/landing"
    for number in range(6):
        write_batch(spark, path, number, [("a", number), (f"k{number}", number)])
        landing.compact(spark, path, ["k"])
    before = totals(spark, path)
    write_batch(spark, path, 0, [("a", 999), ("other", 1)])
    assert totals(spark, path) == before
    assert landing.expire(spark, path, keep=2) == [0, 1, 2, 3]
    assert totals(spark, path) == before and landing.latest_manifest(spark, path) == 5
    assert landing.expire(spark, path, keep=2) == []
    write_batch(spark, path, 6, [("a", 60)])
    landing.compact(spark, path, ["k"])
    assert dict(totals(spark, path))["a"] == 60
    with pytest.raises(ValueError, match="at least one"):
        landing.expire(spark, path, keep=0)


def test_results_are_replaced_whole(spark, tmp_path):
    path, schema = f"{tmp_path}/result", "model_name string, ts timestamp, latency_ms double, is_error boolean"
    with pytest.raises(ValueError, match="no result"):
        landing.current_result(spark, path)
    for start, rows in ((0, [("b", 1.0), ("a", 3.0)]), (10, [("a", 5.0), ("c", None)])):
        df = spark.createDataFrame(
            [(m, start + i, v, m == "c") for i, (m, v) in enumerate(rows)], "m string, s long, v double, e boolean"
        ).select(F.col("m").alias("model_name"), F.timestamp_seconds("s").alias("ts"), F.col("v").alias("latency_ms"), F.col("e").alias("is_error"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/requests")
        requests = spark.readStream.schema(schema).parquet(f"{tmp_path}/requests")
        stream = streams.serving_totals_stream(requests, "model_name")
        streams.run_to_end(lambda s=stream: landing.replace_result(s, path, f"{tmp_path}/state", 2))
    # A version that is being written has no manifest yet and is not seen.
    spark.range(3).write.parquet(f"{path}/results/version=99")
    found = landing.current_result(spark, path).orderBy("first_seen").collect()
    got = [(r["model_name"], r["total_requests"], r["total_errors"], r["average_latency_ms"]) for r in found]
    assert got == [("b", 1, 0, 1.0), ("a", 2, 0, 4.0), ("c", 1, 1, 0.0)]
