"""Batch inference over tables with a predictor the caller supplies."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwright.functions.text import response_entries, response_value
from loopwright.operators.contracts import check_header_subset, program_inputs
from loopwright.spec import TaskSpec

STATUS = "_status"
SUCCESS = "success"


class Predictor(Protocol):
    """Answers one row: input texts by name to a mapping, an object or a plain value.

    A predictor may also have ``batch(rows) -> answers`` to answer many rows in one call.  If
    that call fails, its rows are asked one by one, so that each gets its own status.
    """

    def __call__(self, inputs: Mapping[str, str]) -> Any: ...


def result_fields(result: Any) -> dict[str, Any]:
    """A predictor's answer as a dict, whatever form it has."""
    if result is None:
        return {}
    if isinstance(result, Mapping):
        return dict(result)
    if hasattr(result, "toDict"):
        return dict(result.toDict())
    if hasattr(result, "__dict__"):
        return {k: v for k, v in vars(result).items() if not k.startswith("_")}
    return {"output": str(result)}


def batch_predict(
    df: DataFrame,
    spec: TaskSpec,
    make_predictor: Callable[[], Predictor],
    keep: Sequence[str] = (),
    partitions: int | None = None,
    batch_rows: int = 64,
) -> DataFrame:
    """Call the predictor on every row: inputs, outputs and ``_status``, in that order.

    The predictor (and its client) is made once per task, and a row that fails
    gets empty outputs and its error as status.  ``keep`` columns come first.
    ``partitions`` sets how many calls run at once, ``batch_rows`` how many rows a predictor
    with a ``batch`` method gets in one call.
    """
    check_header_subset(df.columns, spec.inputs).require()
    rows = program_inputs(df, spec, keep)
    if partitions:
        rows = rows.repartition(partitions)
    outputs = list(spec.outputs)
    fields = [*keep, *spec.fields, STATUS]
    schema = T.StructType(
        [rows.schema[c] for c in [*keep, *spec.inputs]]
        + [T.StructField(c, T.StringType()) for c in [*outputs, STATUS]]
    )

    def success(result: Any) -> list[str]:
        found = result_fields(result)
        return ["" if found.get(n) is None else str(found[n]) for n in outputs] + [SUCCESS]

    def answer(predictor: Predictor, inputs: Mapping[str, str]) -> list[str]:
        try:
            return success(predictor(inputs))
        except Exception as error:  # noqa: BLE001 - one bad row must not fail the job
            return ["" for _ in outputs] + [f"error: {error}"]

    def answer_all(predictor: Predictor, rows: list[dict[str, str]]) -> list[list[str]]:
        at_once = getattr(predictor, "batch", None)
        if at_once is not None:
            try:
                results = list(at_once(rows))
                if len(results) == len(rows):
                    return [success(result) for result in results]
            except Exception:  # noqa: BLE001 - each row is asked again below
                pass
        return [answer(predictor, row) for row in rows]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor = make_predictor()
        for batch in batches:
            asked = batch[list(spec.inputs)].to_dict("records")
            answers = []
            for at in range(0, len(asked), batch_rows):
                answers += answer_all(predictor, asked[at : at + batch_rows])
            for position, name in enumerate([*outputs, STATUS]):
                batch[name] = pd.Series(
                    [a[position] for a in answers], index=batch.index, dtype="object"
                )
            yield batch[fields]

    return rows.mapInPandas(run, schema)


def column_predict(
    df: DataFrame,
    spec: TaskSpec,
    predict: Callable[[Mapping[str, Column]], Mapping[str, Column]],
    keep: Sequence[str] = (),
) -> DataFrame:
    """Batch inference with a predictor that is a column expression.

    A NULL answer is a failed row.
    """
    check_header_subset(df.columns, spec.inputs).require()
    rows = program_inputs(df, spec, keep)
    answers = predict({f: F.col(f) for f in spec.inputs})
    failed = F.lit(False)
    for name in spec.outputs:
        failed = failed | answers[name].isNull()
    return rows.select(
        *keep,
        *spec.inputs,
        *[
            F.when(failed, F.lit("")).otherwise(answers[name].cast("string")).alias(name)
            for name in spec.outputs
        ],
        F.when(failed, F.lit("error: no answer")).otherwise(F.lit(SUCCESS)).alias(STATUS),
    )


def parse_responses(
    df: DataFrame, response: str, fields: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Text answers back to one column per field; a field without an answer is empty."""
    entries = df.select(*keep, response_entries(F.col(response)).alias("_entries"))
    return entries.select(
        *keep,
        *[F.coalesce(response_value(F.col("_entries"), f), F.lit("")).alias(f) for f in fields],
    )


def with_embedding(
    df: DataFrame,
    text: str,
    make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    name: str = "embedding",
) -> DataFrame:
    """Add a vector column from an encoder that is made once per task."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = make_encoder()
        for batch in batches:
            vectors = encoder(batch.fillna("").tolist())
            yield pd.Series([list(map(float, v)) for v in vectors], index=batch.index)

    return df.withColumn(name, embed(F.col(text)))
