"""Metrics of the serving log and the text of conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Turns that a task joins at a time; their texts are joined in a second step.
SEGMENT_TURNS = 1024


def serving_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("is_error").alias("total_errors"),
        F.round(F.coalesce(F.avg("latency_ms"), F.lit(0.0)), 6).alias("average_latency_ms"),
    ]


def serving_metrics(requests: DataFrame, *by: str) -> DataFrame:
    """Requests, errors and mean latency (errors count too)."""
    return requests.groupBy(*by).agg(*serving_counts())


def models_by_first_use(requests: DataFrame) -> DataFrame:
    """The models in use, one row each, in the order of their first request."""
    first = requests.groupBy("model_name").agg(
        F.min("ts").alias("first_seen"), F.count(F.lit(1)).alias("requests")
    )
    return first.orderBy("first_seen", "model_name")


def conversation_text(messages: DataFrame) -> DataFrame:
    """One row a conversation: its message texts joined by newlines in turn order.

    The turns of a long conversation are first joined in segments, by many tasks; one task then
    joins the segments' texts.  Messages without text are left out; messages of one turn come
    in the order of their texts.
    """
    segment = F.floor(F.col("turn") / SEGMENT_TURNS).alias("segment")

    def joined(order: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct(order, "text")))
        return F.array_join(F.transform(ordered, lambda m: m["text"]), "\n").alias("text")

    said = messages.filter(F.col("text").isNotNull())
    parts = said.groupBy("conv_id", segment).agg(joined("turn"))
    texts = parts.groupBy("conv_id").agg(joined("segment"))
    if messages.schema["text"].nullable:
        silent = messages.groupBy("conv_id").agg(F.count("text").alias("n")).filter("n = 0")
        texts = texts.union(silent.select("conv_id", F.lit("")))
    return texts
