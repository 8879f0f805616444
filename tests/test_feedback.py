"""Feedback, export and recycling on literal cases."""

from datetime import datetime, timedelta, timezone

import pytest

from loopwright.operators import feedback, recycle
from loopwright.plans.flywheel import training_export
from loopwright.sources import readers, writers

FEEDBACK = (
    "feedback_id string, trace_id string, rating string, corrected_output string, "
    "comment string, user_id string, ts_ms long"
)
TRACES = "trace_id string, model_name string, timestamp_ms long, inputs string, outputs string"


@pytest.fixture
def given_feedback(spark):
    return spark.createDataFrame(
        [
            ("f1", "tr-1", "thumbs_up", None, "nice", "u1", 10),
            ("f2", "tr-1", "thumbs_down", '{"joke":"late"}', None, None, 20),
            ("f3", "tr-2", "thumbs_up", '{"joke":"better"}', "", "", 30),
            ("f4", "tr-9", "thumbs_up", None, None, None, 40),
            ("f5", "degraded-1", "thumbs_down", None, None, None, 50),
            ("f6", "tr-2", "meh", None, None, None, 60),
        ],
        FEEDBACK,
    )


@pytest.fixture
def given_traces(spark):
    return spark.createDataFrame(
        [
            ("tr-1", "m", 1704067200000, '{"topic":"cats"}', '{"joke":"one"}'),
            ("tr-2", "m", 1704067201000, '{"topic":"dogs"}', '{"joke":"two"}'),
            ("tr-3", "n", 1704067202000, "plain", "also plain"),
        ],
        TRACES,
    )


def test_ingest(given_feedback, given_traces):
    twice = given_feedback.unionByName(given_feedback)
    kept = feedback.ingest_feedback(twice, given_traces).collect()
    assert sorted(r["feedback_id"] for r in kept) == ["f1", "f2", "f3", "f5"]
    lost = feedback.reject_feedback(given_feedback, given_traces).collect()
    assert [r["feedback_id"] for r in lost] == ["f4"]


def test_ratings_in_other_forms(spark):
    flags = spark.createDataFrame(
        [("t1", True, 1, "u"), ("t2", False, 2, "u"), ("t3", None, 3, "u")],
        "trace_id string, rating boolean, ts_ms long, user_id string",
    )
    rows = {r["trace_id"]: r["rating"] for r in feedback.valid_feedback(flags).collect()}
    assert rows == {"t1": "thumbs_up", "t2": "thumbs_down"}
    texts = flags.withColumn("rating", flags["rating"].cast("string"))
    assert {r["trace_id"]: r["rating"] for r in feedback.valid_feedback(texts).collect()} == rows
    assert all(r["feedback_id"].startswith("fb-") for r in feedback.valid_feedback(flags).collect())


def test_assessments(given_feedback):
    rows = feedback.assessments(given_feedback.filter("trace_id = 'tr-1'")).collect()
    found = sorted((r["feedback_id"], r["name"], r["value"], r["source_id"]) for r in rows)
    assert found == [
        ("f1", "user_comment", "nice", "u1"),
        ("f1", "user_rating", "true", "u1"),
        ("f2", "corrected_output", '{"joke":"late"}', "anonymous"),
        ("f2", "user_rating", "false", "anonymous"),
    ]


def test_first_and_latest(given_feedback):
    long = feedback.assessments(given_feedback.filter("trace_id = 'tr-1'"))
    assert feedback.first_assessments(long).first()["user_rating"] == "true"
    assert feedback.first_assessments(long, keep="latest").first()["user_rating"] == "false"


@pytest.mark.parametrize("keep", ["first", "latest"])
def test_both_ways_to_the_values_agree(spark, given_feedback, keep):
    unrated = spark.createDataFrame([("f0", "tr-2", None, None, "c", None, 1)], FEEDBACK)
    rows = given_feedback.unionByName(unrated)
    long = feedback.first_assessments(feedback.assessments(rows), keep)
    assert sorted(map(str, feedback.first_values(rows, keep).collect())) == sorted(
        map(str, long.collect())
    )


def test_stats(given_feedback):
    row = feedback.feedback_stats(given_feedback).first()
    assert (row["total"], row["thumbs_up"], row["thumbs_down"]) == (6, 3, 2)
    assert (row["with_corrections"], row["with_comments"], row["thumbs_up_rate"]) == (2, 1, 0.5)
    assert feedback.feedback_stats(given_feedback.limit(0)).first()["thumbs_up_rate"] == 0.0


def test_history(given_feedback):
    rows = feedback.feedback_history(given_feedback, limit=2).collect()
    assert [r["feedback_id"] for r in rows] == ["f6", "f5"]
    rows = feedback.feedback_history(given_feedback, "tr-1").collect()
    assert [r["feedback_id"] for r in rows] == ["f2", "f1"]


def test_rows_of_unrated_traces(given_traces, given_feedback):
    joined = feedback.traces_with_feedback(given_traces, given_feedback)
    row = {r["trace_id"]: r for r in feedback.trace_rows(joined).collect()}["tr-3"]
    assert row["rating"] == "thumbs_down" and row["outputs"] == "" and row["comment"] == ""
    assert row["timestamp"] == "2024-01-01T00:00:02.000"


def test_export_uses_corrections(given_traces, given_feedback):
    records = {
        r["trace_id"]: r["record"]
        for r in training_export(given_traces, given_feedback, model_name="m").collect()
    }
    # Each name is looked up on its own: the first correction counts, whoever rated first.
    assert records["tr-1"]["joke"] == "late" and records["tr-2"]["joke"] == "better"
    plain = training_export(given_traces, given_feedback, use_corrected=False).collect()
    assert {r["trace_id"]: r["record"]["joke"] for r in plain} == {"tr-1": "one", "tr-2": "two"}


def test_export_range_is_inclusive(given_traces, given_feedback):
    def ids(**kw):
        return sorted(r["trace_id"] for r in training_export(given_traces, given_feedback, **kw).collect())

    assert ids(start=datetime(2024, 1, 1, 0, 0, 1)) == ["tr-2"]
    assert ids(end=datetime(2024, 1, 1)) == ["tr-1"]
    assert ids(limit=1) == ["tr-2"]
    with pytest.raises(ValueError):
        ids(limit=0)


def test_trace_folders_are_pruned(spark, given_traces, given_feedback, tmp_path):
    path = str(tmp_path / "traces")
    late = given_traces.limit(1).selectExpr(
        "'tr-7' AS trace_id", "model_name", "timestamp_ms + 2 * 86400000 AS timestamp_ms", "inputs", "outputs"
    )
    writers.write_traces(given_traces.unionByName(late), path)
    stored = readers.read_traces(spark, path)
    zone = timezone(timedelta(hours=5))
    found = feedback.rated_traces(
        stored, given_feedback, start=datetime(2024, 1, 1, 5, 0, 1, tzinfo=zone), limit=None
    )
    assert [r["trace_id"] for r in found.collect()] == ["tr-2"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "(date#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    days = readers.read_traces(spark, path, "m", end=datetime(2024, 1, 1))
    assert sorted(r["trace_id"] for r in days.collect()) == ["tr-1", "tr-2"]


def test_empty_export_keeps_a_header(spark, given_traces, given_feedback, tmp_path):
    records = training_export(given_traces, given_feedback, model_name="none")
    path = str(tmp_path / "empty")
    writers.export_records(records, path, "csv")
    assert readers.csv_header(spark, path) == ["inputs", "outputs"]
    declared = str(tmp_path / "declared")
    writers.export_records(records, declared, "csv", fields=["joke", "_rating"])
    assert readers.csv_header(spark, declared) == ["joke", "_rating"]


def test_export_field_order_and_count(spark, given_traces, given_feedback, tmp_path):
    path = str(tmp_path / "out")
    records = training_export(given_traces, given_feedback)
    counted = writers.export_records(records, path, "csv", chunk_rows=1)
    assert readers.csv_header(spark, path) == ["joke", "topic", "_rating", "_trace_id"]
    assert counted.get["total_records"] == 2
    with pytest.raises(ValueError):
        writers.export_records(records, str(tmp_path / "x"), "xml")


def test_quality_filter(spark):
    df = spark.createDataFrame(
        [("a", "good", None, "x"), ("b", "fix", "B", "y"), ("c", "bad", "C", "z"), ("d", None, None, "w")],
        "answer string, _quality string, _corrected_answer string, original_text string",
    )
    rows = recycle.recycled_rows(df).collect()
    assert sorted(map(tuple, rows)) == [("B", "y"), ("a", "x")]
    raw = recycle.recycled_rows(df, ["bad"], use_corrected=False).collect()
    assert [tuple(r) for r in raw] == [("c", "z")]


def test_keep_last_prefers_new_rows_and_is_idempotent(spark):
    old = spark.createDataFrame(
        [(1, "q", "old", "x"), (2, None, "n1", "x"), (3, "r", "r1", "x"), (4, "r", "r2", "x")],
        "ord long, original_q string, answer string, only_old string",
    )
    new = spark.createDataFrame(
        [(1, "new", "q", 1), (2, "n2", None, 2)], "ord long, answer string, original_q string, b int"
    )
    merged = recycle.merge_datasets(old, new, "ord")
    plain = recycle.drop_bookkeeping(merged)
    assert plain.columns == ["original_q", "answer"]
    expected = {("q", "new"), (None, "n2"), ("r", "r2")}
    assert set(map(tuple, plain.collect())) == expected
    again = recycle.keep_last(merged, ["original_q"], ["_source", "_ord"])
    assert set(map(tuple, recycle.drop_bookkeeping(again).collect())) == expected
    stats = recycle.merge_statistics(old, new, "ord").first()
    assert (stats["merged_count"], stats["removed_count"], stats["over_ratio"]) == (3, 3, False)


def test_merge_of_nothing(spark):
    none = spark.createDataFrame([], "ord long, a string, b string")
    stats = recycle.merge_statistics(none, none, "ord").first()
    assert stats["new_ratio"] is None and stats["over_ratio"] is False


def test_default_dedupe_keys():
    assert recycle.dedupe_keys(["original_a", "b", "original_c"]) == ["original_a", "original_c"]
    assert recycle.dedupe_keys(["_source", "a", "b", "c", "d"]) == ["a", "b"]


def test_feedback_without_ids_is_never_merged(spark):
    rows = [
        ("tr-1", "thumbs_up", None, "a", None, 5), ("tr-1", "thumbs_up", None, "b", None, 5),
        ("tr-1", "thumbs_down", None, None, "a", 5), ("tr-1", "thumbs_down", None, None, None, 5),
        ("tr-1", "thumbs_up", None, "a", None, 5),
    ]
    names = "trace_id string, rating string, corrected_output string, comment string, user_id string, ts_ms long"
    traces = spark.createDataFrame([("tr-1",)], "trace_id string")
    assert feedback.ingest_feedback(spark.createDataFrame(rows, names), traces).count() == 4


def test_first_of_one_given_id_stays(spark):
    rows = [("x", "tr-1", "thumbs_up", "b", 5), ("x", "tr-1", "thumbs_up", "a", 5), ("x", "tr-1", "thumbs_down", "c", 9)]
    names = "feedback_id string, trace_id string, rating string, comment string, ts_ms long"
    traces = spark.createDataFrame([("tr-1",)], "trace_id string")
    (row,) = feedback.ingest_feedback(spark.createDataFrame(rows, names), traces).collect()
    assert (row["ts_ms"], row["comment"]) == (5, "a")
