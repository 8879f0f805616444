"""JSON text held in columns: parsing, fallbacks, merging."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAP_TYPE = "map<string,string>"


def empty_map() -> Column:
    return F.create_map().cast(MAP_TYPE)


def parse_map(text: Column) -> Column:
    """A JSON object as a text map; NULL for anything else.

    Nested values stay JSON text.
    """
    return F.from_json(text, MAP_TYPE)


def unwrap_json(text: Column) -> Column:
    """Undo one extra level of JSON encoding, when there is one."""
    inner = F.try_element_at(
        F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(1)
    )
    return F.when(F.startswith(text, F.lit('"')), inner).otherwise(text)


def parse_or_wrap(text: Column, key: str) -> Column:
    """A JSON object as a map; other text under ``key``; missing text as no fields."""
    return F.coalesce(
        parse_map(text), F.when(F.length(text) > 0, F.create_map(F.lit(key), text)), empty_map()
    )


def merge_maps(first: Column, second: Column) -> Column:
    """Union of two maps; a key of ``second`` replaces the same key of ``first``."""
    kept = F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k))
    return F.map_concat(kept, second)


def training_fields(
    inputs: Column, outputs: Column, corrected: Column | None, trace_id: Column, rating: Column
) -> Column:
    """One training record as a text map: input and output fields, then bookkeeping."""
    answer = parse_or_wrap(outputs, "output")
    if corrected is not None:
        answer = F.coalesce(parse_map(unwrap_json(corrected)), answer)
    record = merge_maps(parse_or_wrap(inputs, "input"), answer)
    marks = F.map_filter(
        F.create_map(F.lit("_trace_id"), trace_id, F.lit("_rating"), rating),
        lambda _, v: F.length(v) > 0,
    )
    return merge_maps(record, marks)
