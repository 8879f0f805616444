"""Feedback on prediction traces: ingest, assessments, history, statistics, joins."""

from __future__ import annotations

import operator
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.functions.jsonmap import parse_map, training_fields, unwrap_json
from loopwright.functions.text import (
    digest_text,
    feedback_id,
    iso_text,
    millis_to_timestamp,
    utc,
)
from loopwright.operators.contracts import rating_is_valid

# Assessment names, the bypass prefix and the stand-in for no user.
RATING_NAME = "user_rating"
CORRECTION_NAME = "corrected_output"
COMMENT_NAME = "user_comment"
DEGRADED_PREFIX = "degraded-"
ANONYMOUS = "anonymous"

# What tells one feedback event from another.
EVENT_PARTS = ("trace_id", "ts_ms", "user_id", "rating", "corrected_output", "comment")


def rating_text(rating: Column, dtype: str) -> Column:
    """A rating as text, also when it was stored as a boolean (or as its text)."""
    if dtype == "boolean":
        return F.when(rating, F.lit("thumbs_up")).when(~rating, F.lit("thumbs_down"))
    return (
        F.when(F.lower(rating) == "true", F.lit("thumbs_up"))
        .when(F.lower(rating) == "false", F.lit("thumbs_down"))
        .otherwise(rating)
    )


def with_feedback_id(feedback: DataFrame) -> DataFrame:
    """Fill missing feedback ids from the event itself, so that retries are equal."""
    made = feedback_id(*[F.col(c) for c in EVENT_PARTS if c in feedback.columns])
    if "feedback_id" in feedback.columns:
        made = F.coalesce(F.col("feedback_id"), made)
    return feedback.withColumn("feedback_id", made)


def accept_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Feedback on a known trace; degraded ids pass unchecked."""
    degraded = F.coalesce(F.startswith(F.col("trace_id"), F.lit(DEGRADED_PREFIX)), F.lit(False))
    known = feedback.filter(~degraded).join(traces.select("trace_id"), "trace_id", "left_semi")
    return known.unionByName(feedback.filter(degraded))


def reject_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Feedback on traces nobody knows."""
    degraded = F.coalesce(F.startswith(F.col("trace_id"), F.lit(DEGRADED_PREFIX)), F.lit(False))
    return feedback.filter(~degraded).join(traces.select("trace_id"), "trace_id", "left_anti")


def valid_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback with an allowed rating, as text, and with an id."""
    dtype = feedback.schema["rating"].dataType.simpleString()
    rated = feedback.withColumn("rating", rating_text(F.col("rating"), dtype))
    return with_feedback_id(rated).filter(rating_is_valid(F.col("rating")))


def ingest_feedback(feedback: DataFrame, traces: DataFrame) -> DataFrame:
    """Checked feedback, one row per feedback id, ready to append.

    Of events that were given the same id the first stays; of several at one time, the one
    whose content comes first.
    """
    accepted = accept_feedback(valid_feedback(feedback), traces)
    content = [F.col(c) for c in EVENT_PARTS if c in accepted.columns]
    order = Window.partitionBy("feedback_id").orderBy("ts_ms", digest_text(*content))
    first = accepted.withColumn("_place", F.row_number().over(order))
    return first.filter("_place = 1").drop("_place")


def assessments(feedback: DataFrame) -> DataFrame:
    """One to three named values per feedback: always the rating, the rest if given."""

    def named(name: str, value: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    correction = F.col("corrected_output")
    entries = F.array(
        named(RATING_NAME, (F.col("rating") == "thumbs_up").cast("string")),
        named(CORRECTION_NAME, F.when(~correction.isin("", "{}"), correction)),
        named(COMMENT_NAME, F.when(F.col("comment") != "", F.col("comment"))),
    )
    entry = F.explode(F.filter(entries, lambda e: e["value"].isNotNull())).alias("entry")
    return feedback.select(
        "trace_id",
        "feedback_id",
        "ts_ms",
        F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.lit(ANONYMOUS)).alias("source_id"),
        F.col("rating").alias("rating_type"),
        entry,
    ).select(
        "trace_id", "entry.name", "entry.value", "source_id", "feedback_id", "ts_ms", "rating_type"
    )


def named_feedback(feedback: DataFrame, name: str, value: str) -> DataFrame:
    """One value per feedback under a name of the caller's choice."""
    return feedback.filter(F.col(value).isNotNull()).select(
        "trace_id",
        F.lit(name).alias("name"),
        F.col(value).cast("string").alias("value"),
        F.coalesce(F.nullif(F.col("user_id"), F.lit("")), F.lit(ANONYMOUS)).alias("source_id"),
    )


def assessment_value(entries: Column, name: str) -> Column:
    """The value of the first entry with that name in a list of assessments."""
    return F.try_element_at(F.filter(entries, lambda e: e["name"] == name), F.lit(1))["value"]


def first_assessments(assessed: DataFrame, keep: str = "first") -> DataFrame:
    """Long assessments to one row per trace: the first (or latest) value per name.

    One shuffle on the trace id; partial aggregation leaves one row per trace and task.
    """
    pick = {"first": F.min_by, "latest": F.max_by}[keep]
    order = F.struct("ts_ms", "feedback_id")

    def value(name: str) -> Column:
        wanted = F.col("name") == name
        return pick(F.when(wanted, F.col("value")), F.when(wanted, order)).alias(name)

    return assessed.groupBy("trace_id").agg(
        value(RATING_NAME), value(CORRECTION_NAME), value(COMMENT_NAME)
    )


def first_value_columns(keep: str = "first") -> list[Column]:
    """The first (or latest) rating, correction and comment as aggregates; each has its own row."""
    pick = {"first": F.min_by, "latest": F.max_by}[keep]
    order = F.struct("ts_ms", "feedback_id")

    def value(name: str, column: Column, given: Column) -> Column:
        return pick(F.when(given, column), F.when(given, order)).alias(name)

    rating, correction, comment = F.col("rating"), F.col("corrected_output"), F.col("comment")
    return [
        value(RATING_NAME, (rating == "thumbs_up").cast("string"), rating.isNotNull()),
        value(CORRECTION_NAME, correction, ~correction.isin("", "{}")),
        value(COMMENT_NAME, comment, comment != ""),
    ]


def first_values(feedback: DataFrame, keep: str = "first") -> DataFrame:
    """``first_assessments`` straight from the feedback rows.

    The same result without making up to three rows of each before the aggregation.
    """
    return feedback.groupBy("trace_id").agg(*first_value_columns(keep))


def traces_with_feedback(traces: DataFrame, feedback: DataFrame, keep: str = "first") -> DataFrame:
    """Every trace, with the values its users gave it."""
    return traces.join(first_values(feedback, keep), "trace_id", "left")


def in_time_range(traces: DataFrame, start: datetime | None, end: datetime | None) -> DataFrame:
    """Traces from ``start`` to ``end``, both included; a ``date`` folder column is used too."""
    for moment, within in ((start, operator.ge), (end, operator.le)):
        if moment is None:
            continue
        moment = utc(moment)
        traces = traces.filter(within(F.col("timestamp_ms"), int(moment.timestamp() * 1000)))
        if "date" in traces.columns:
            traces = traces.filter(within(F.col("date"), F.lit(moment.date())))
    return traces


def rated_traces(
    traces: DataFrame,
    feedback: DataFrame,
    rating: str = "thumbs_up",
    model_name: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
    limit: int | None = None,
    keep: str = "first",
) -> DataFrame:
    """Traces of one rating, optionally of one model and time range, newest first.

    The trace filters reach the scan.  Every row is kept unless the caller sets a ``limit``.
    """
    if limit is not None and limit < 1:
        raise ValueError("limit must be positive, or None for all rows")
    wanted = traces
    if model_name:
        wanted = wanted.filter(F.col("model_name") == model_name)
    wanted = in_time_range(wanted, start, end)
    if model_name or start or end:
        # Only the feedback of the wanted traces is aggregated.
        feedback = feedback.join(wanted.select("trace_id"), "trace_id", "left_semi")
    rated = first_values(feedback, keep).filter(
        F.col(RATING_NAME) == ("true" if rating == "thumbs_up" else "false")
    )
    found = wanted.join(rated, "trace_id")
    if limit is None:
        return found
    return found.orderBy(F.desc("timestamp_ms"), "trace_id").limit(limit)


def trace_rows(joined: DataFrame) -> DataFrame:
    """The eight export columns, all text, blanks for what is missing or is no JSON object."""

    def object_or_blank(text: Column) -> Column:
        return F.when(F.size(parse_map(text)) > 0, text).otherwise(F.lit(""))

    up = F.coalesce(F.col(RATING_NAME) == "true", F.lit(False))
    return joined.select(
        "trace_id",
        object_or_blank(F.col("inputs")).alias("inputs"),
        object_or_blank(F.col("outputs")).alias("outputs"),
        object_or_blank(unwrap_json(F.col(CORRECTION_NAME))).alias("corrected_output"),
        F.when(up, F.lit("thumbs_up")).otherwise(F.lit("thumbs_down")).alias("rating"),
        F.coalesce(F.col(COMMENT_NAME), F.lit("")).alias("comment"),
        F.coalesce(iso_text(millis_to_timestamp(F.col("timestamp_ms"))), F.lit("")).alias(
            "timestamp"
        ),
        F.coalesce(F.col("model_name"), F.lit("")).alias("model_name"),
    )


def training_records(rows: DataFrame, use_corrected: bool = True) -> DataFrame:
    """Export rows (see ``trace_rows``) as training records: a text map per trace."""
    return rows.select(
        "trace_id",
        training_fields(
            F.col("inputs"),
            F.col("outputs"),
            F.col("corrected_output") if use_corrected else None,
            F.col("trace_id"),
            F.col("rating"),
        ).alias("record"),
    )


def feedback_history(
    feedback: DataFrame, trace_id: str | None = None, limit: int | None = None
) -> DataFrame:
    """Latest feedback first, of one trace or of all; all of it unless the caller sets a limit."""
    if trace_id:
        feedback = feedback.filter(F.col("trace_id") == trace_id)
    ordered = feedback.orderBy(F.desc("ts_ms"), F.desc("feedback_id"))
    return ordered if limit is None else ordered.limit(limit)


def feedback_counts() -> list[Column]:
    """The additive part of the feedback statistics."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("rating") == "thumbs_up").alias("thumbs_up"),
        F.count_if(F.col("rating") == "thumbs_down").alias("thumbs_down"),
        F.count_if(~F.col("corrected_output").isin("", "{}")).alias("with_corrections"),
        F.count_if(F.col("comment") != "").alias("with_comments"),
    ]


def up_rate() -> Column:
    return F.round(
        F.coalesce(F.try_divide(F.col("thumbs_up"), F.col("total")), F.lit(0.0)), 6
    ).alias("thumbs_up_rate")


def feedback_stats(feedback: DataFrame, *by: str) -> DataFrame:
    """Counts and up rate of all feedback, or per group."""
    return feedback.groupBy(*by).agg(*feedback_counts()).withColumn("thumbs_up_rate", up_rate())
