"""From predictions and feedback to training data."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.operators.feedback import (
    rated_traces,
    trace_rows,
    training_records,
    valid_feedback,
)
from loopwright.operators.predict import STATUS, SUCCESS, column_predict
from loopwright.operators.recycle import (
    drop_bookkeeping,
    merge_datasets,
    recycled_rows,
)
from loopwright.spec import TaskSpec


def training_export(
    traces: DataFrame,
    feedback: DataFrame,
    rating: str = "thumbs_up",
    model_name: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
    use_corrected: bool = True,
) -> DataFrame:
    """Rated traces as training records, corrections applied."""
    found = rated_traces(traces, feedback, rating, model_name, start, end, limit)
    return training_records(trace_rows(found), use_corrected)


def predicted_traces(predictions: DataFrame, spec: TaskSpec) -> DataFrame:
    """Successful predictions as traces with JSON inputs and outputs.

    Expects ``trace_id``, ``model_name`` and ``timestamp_ms`` next to the fields.
    """
    return predictions.filter(F.col(STATUS) == SUCCESS).select(
        "trace_id",
        "model_name",
        "timestamp_ms",
        F.to_json(F.struct(*spec.inputs)).alias("inputs"),
        F.to_json(F.struct(*spec.outputs)).alias("outputs"),
    )


def flywheel(
    requests: DataFrame,
    feedback: DataFrame,
    spec: TaskSpec,
    predict: Callable[[Mapping[str, Column]], Mapping[str, Column]],
    limit: int | None = None,
) -> DataFrame:
    """Predict, take in feedback, export: one lazy plan with one shuffle, on the trace id.

    Feedback on unknown traces finds no partner in that join, and an event that came twice is
    still the same first value, so ingest comes down to the rating check here.
    """
    keep = ("trace_id", "model_name", "timestamp_ms")
    traces = predicted_traces(column_predict(requests, spec, predict, keep), spec)
    return training_export(traces, valid_feedback(feedback), limit=limit)


def recycle(
    reviewed: DataFrame,
    original: DataFrame,
    review_order: str,
    original_order: str,
    levels: Sequence[str] = ("good", "fix"),
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Reviewed predictions into a new version of the dataset: filter, correct, merge, dedupe."""
    order = "ord"
    new = recycled_rows(reviewed.withColumn(order, F.col(review_order)), levels)
    base = original.withColumnRenamed(original_order, order)
    return drop_bookkeeping(merge_datasets(base, new, order, keys=keys))
