"""Scores of a prediction against its gold values, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The names by which a metric is chosen.
EXACT_MATCH = "Exact Match"
COSINE_SIMILARITY = "Cosine Similarity"
JUDGE = "LLM-as-a-Judge"


def exact_match(gold: Sequence[Column], pred: Sequence[Column]) -> Column:
    """1 when every output field is equal; a missing value on either side gives 0."""
    if len(gold) != len(pred) or not gold:
        raise ValueError("exact match needs the same fields on both sides")
    same = reduce(lambda a, b: a & b, [g == p for g, p in zip(gold, pred)])
    return F.coalesce(same, F.lit(False)).cast("int")


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_similarity(gold: Sequence[Column], pred: Sequence[Column]) -> Column:
    """Cosine of the field vectors laid end to end; NULL for a zero vector."""
    if len(gold) != len(pred) or not gold:
        raise ValueError("cosine similarity needs the same fields on both sides")
    # The vectors are never joined: dot products of the parts add up.
    def total(pairs: Sequence[tuple[Column, Column]]) -> Column:
        return reduce(lambda a, b: a + b, [_dot(x, y) for x, y in pairs])

    norms = F.sqrt(total(list(zip(gold, gold)))) * F.sqrt(total(list(zip(pred, pred))))
    return F.try_divide(total(list(zip(gold, pred))), norms)


def judge_score(text: Column) -> Column:
    """A judge's answer as a number; anything that is not a number scores 0."""
    score = text.try_cast("double")
    return F.when(F.isnan(score), F.lit(0.0)).otherwise(F.coalesce(score, F.lit(0.0)))


def judge_input(
    fields: Sequence[str], gold: Mapping[str, Column], pred: Mapping[str, Column]
) -> list[Column]:
    """Each judge input from the gold side, else the prediction, else empty text."""
    resolved = []
    for field in fields:
        sources = [side[field].cast("string") for side in (gold, pred) if field in side]
        resolved.append(F.coalesce(*sources, F.lit("")).alias(field))
    return resolved


def make_metric(name: str, judge_outputs: Sequence[str] | None = None) -> Callable[..., Column]:
    """The scoring function for a metric name.

    Exact match and cosine take two lists of columns; the judge metric takes the
    judge's output columns by name.
    """
    if name == EXACT_MATCH:
        return exact_match
    if name == COSINE_SIMILARITY:
        return cosine_similarity
    if name == JUDGE:
        if judge_outputs is None:
            raise ValueError("the judge metric needs a judge")
        fields = tuple(judge_outputs)

        def from_judge(outputs: Mapping[str, Column]) -> Column:
            if len(fields) != 1 or fields[0] not in outputs:
                return F.lit(0.0)
            return judge_score(outputs[fields[0]])

        return from_judge
    raise ValueError(f"unknown metric: {name}")
