"""Text, list, time and identifier expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text limits of stored parameters, descriptions and tags.
PARAM_LIMIT = 500
DESCRIPTION_LIMIT = 200
TAG_LIMIT = 250

# Fixed value: the characters Python's str.strip() removes that occur in text tables.
BLANKS = " \t\r\n\f\x0b"


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(BLANKS))


def truncate_text(column: Column, limit: int = PARAM_LIMIT) -> Column:
    """Text longer than ``limit`` keeps ``limit - 3`` characters and gets an ellipsis."""
    return F.when(
        F.length(column) > limit, F.concat(F.substring(column, 1, limit - 3), F.lit("..."))
    ).otherwise(column)


def value_text(df: DataFrame, name: str) -> Column:
    """A stored value as text: NULL is empty, nested values are JSON."""
    dtype = df.schema[name].dataType
    column = F.col(name)
    if isinstance(dtype, (T.StructType, T.ArrayType, T.MapType)):
        column = F.to_json(column)
    elif not isinstance(dtype, T.StringType):
        column = column.cast("string")
    return F.coalesce(column, F.lit(""))


def signature_text(inputs: Column, outputs: Column) -> Column:
    """``a, b -> c`` from two name lists."""
    return F.concat(F.array_join(inputs, ", "), F.lit(" -> "), F.array_join(outputs, ", "))


def pascal_case(words: Column) -> Column:
    """Join words, each with an upper-case head and a lower-case tail."""
    return F.array_join(
        F.transform(
            words,
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substr(w, F.lit(2)))),
        ),
        "",
    )


def program_id(
    inputs: Column, outputs: Column, model: Column, module: Column, optimizer: Column, day: Column
) -> Column:
    """Readable program name: signature, model, module, optimizer and date."""
    signature = F.array_join(F.concat(inputs, F.array(F.lit(":")), outputs), "_")
    short = F.replace(
        F.replace(optimizer, F.lit("bootstrap"), F.lit("bs")), F.lit("randomsearch"), F.lit("rs")
    )
    return F.concat(
        pascal_case(F.split(signature, "_")),
        F.lit("-"),
        pascal_case(F.split(model, "-")),
        F.lit("_"),
        module,
        F.lit("_"),
        pascal_case(F.split(short, "_")),
        F.lit("-"),
        F.date_format(day, "yyyyMMdd"),
    )


def join_names(names: Column) -> Column:
    return F.array_join(names, ",")


def split_names(text: Column) -> Column:
    """Comma text to a list; NULL or empty text is the empty list."""
    return F.when(text != "", F.split(text, ",")).otherwise(F.array().cast("array<string>"))


def score_or_null(text: Column) -> Column:
    return F.when(text != "", text.try_cast("double"))


def utc(moment: datetime) -> datetime:
    """A moment in UTC; one without a zone is taken to be in UTC already."""
    if moment.tzinfo is None:
        return moment.replace(tzinfo=timezone.utc)
    return moment.astimezone(timezone.utc)


def millis_to_timestamp(millis: Column) -> Column:
    return F.timestamp_millis(millis)


def timestamp_to_millis(ts: Column) -> Column:
    return F.unix_millis(ts)


def iso_text(ts: Column) -> Column:
    """ISO-8601 text to the millisecond, UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS")


def digest_text(*parts: Column) -> Column:
    """The parts as one text that no other parts give: each with its length, ``-`` for NULL."""
    texts = [part.cast("string") for part in parts]
    return F.concat(
        *[
            F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
            for t in texts
        ]
    )


def feedback_id(*parts: Column) -> Column:
    """``fb-`` and 16 hex digits; the same event, content included, always gets the same id."""
    seed = digest_text(*parts)
    return F.concat(F.lit("fb-"), F.substring(F.sha2(seed, 256), 1, 16))


def degraded_trace_id(seed: Column) -> Column:
    return F.concat(F.lit("degraded-"), F.substring(F.sha2(seed, 256), 1, 16))


def render_response(inputs: Mapping[str, Column], outputs: Mapping[str, Column]) -> Column:
    """One answer as text: an input block and an output block of ``name: value`` lines."""

    def block(fields: Mapping[str, Column]) -> list[Column]:
        return [
            F.concat(F.lit(f"{name}: "), F.coalesce(value.cast("string"), F.lit("")), F.lit("\n"))
            for name, value in fields.items()
        ]

    return F.concat(F.lit("Input:\n"), *block(inputs), F.lit("\nOutput:\n"), *block(outputs))


def response_entries(response: Column) -> Column:
    """``name: value`` lines after the last output marker, as name/value structs."""
    marked = F.split(response, "Output:")
    lines = F.split(F.try_element_at(marked, F.lit(-1)), "\n")
    return F.when(
        F.size(marked) > 1,
        F.transform(
            F.filter(lines, lambda line: F.contains(line, F.lit(":"))),
            lambda line: F.struct(
                strip(F.substring_index(line, ":", 1)).alias("name"),
                strip(F.substr(line, F.instr(line, ":") + 1)).alias("value"),
            ),
        ),
    )


def response_value(entries: Column, field: str) -> Column:
    """The last value given for ``field``, NULL when the response has none."""
    found = F.filter(entries, lambda e: e["name"] == field)
    return F.try_element_at(found, F.lit(-1))["value"]


def version_description(
    inputs: Column,
    outputs: Column,
    module: Column,
    optimizer: Column,
    score: Column,
    instructions: Column,
) -> Column:
    """One line per known fact about a model version; unknown facts are left out."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Input: "), inputs),
        F.concat(F.lit("Output: "), outputs),
        F.concat(F.lit("Module: "), module),
        F.concat(F.lit("Optimizer: "), optimizer),
        F.when(score.isNotNull(), F.concat(F.lit("Score: "), F.format_string("%.4f", score))),
        F.concat(F.lit("Instructions: "), truncate_text(instructions, DESCRIPTION_LIMIT)),
    )


def version_tags(tags: Mapping[str, Column], limited: Sequence[str]) -> Column:
    """Tag map without missing values; ``limited`` tags are cut to the tag limit."""
    pairs: list[Column] = []
    for name, value in tags.items():
        pairs += [F.lit(name), truncate_text(value, TAG_LIMIT) if name in limited else value]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
