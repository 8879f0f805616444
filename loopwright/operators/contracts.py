"""Header contracts, example and input projections, domain checks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.text import strip
from loopwright.spec import TaskSpec

# The allowed feedback ratings.
RATINGS = ("thumbs_up", "thumbs_down")


@dataclass(frozen=True)
class HeaderReport:
    valid: bool
    expected: tuple[str, ...]
    found: tuple[str, ...]
    missing: tuple[str, ...]
    extra: tuple[str, ...]

    def require(self) -> None:
        if not self.valid:
            raise ValueError(
                f"columns do not fit: expected {list(self.expected)}, found {list(self.found)}, "
                f"missing {list(self.missing)}"
            )


def default_names(names: Sequence[str], kind: str) -> tuple[str, ...]:
    """Blank field names become ``Input1``, ``Output1`` and so on."""
    return tuple(n if n and n.strip() else f"{kind}{i}" for i, n in enumerate(names, start=1))


def _report(found: Sequence[str], expected: Sequence[str], valid: bool) -> HeaderReport:
    return HeaderReport(
        valid=valid,
        expected=tuple(expected),
        found=tuple(found),
        missing=tuple(sorted(set(expected) - set(found))),
        extra=tuple(sorted(set(found) - set(expected))),
    )


def check_header_strict(
    columns: Sequence[str], inputs: Sequence[str], outputs: Sequence[str]
) -> HeaderReport:
    """Columns must be exactly the inputs then the outputs, in order."""
    expected = [*default_names(inputs, "Input"), *default_names(outputs, "Output")]
    return _report(columns, expected, list(columns) == expected)


def check_header_subset(columns: Sequence[str], inputs: Sequence[str]) -> HeaderReport:
    """All inputs must be there; order and extra columns do not matter."""
    return _report(columns, inputs, set(inputs) <= set(columns))


def column_differences(
    left: Sequence[str], right: Sequence[str]
) -> tuple[list[str], list[str], list[str]]:
    """Columns on both sides in the left order, only left, only right."""
    return (
        [c for c in left if c in set(right)],
        [c for c in left if c not in set(right)],
        [c for c in right if c not in set(left)],
    )


def examples(df: DataFrame, spec: TaskSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Input fields as they are and output fields as text."""
    check_header_subset(df.columns, spec.fields).require()
    return df.select(*keep, *spec.inputs, *[F.col(o).cast("string").alias(o) for o in spec.outputs])


def program_inputs(df: DataFrame, spec: TaskSpec, keep: Sequence[str] = ()) -> DataFrame:
    """Input fields as text; an absent column or value is the empty text."""
    present = set(df.columns)
    return df.select(
        *keep,
        *[
            (F.coalesce(F.col(f).cast("string"), F.lit("")) if f in present else F.lit("")).alias(f)
            for f in spec.inputs
        ],
    )


def rating_is_valid(rating: Column) -> Column:
    return F.coalesce(rating.isin(*RATINGS), F.lit(False))


def split_by_rating(feedback: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback with an allowed rating, and the rest for quarantine."""
    valid = rating_is_valid(F.col("rating"))
    return feedback.filter(valid), feedback.filter(~valid)


def clean_name(name: Column) -> Column:
    """The name without outer blanks; NULL when nothing is left."""
    return F.nullif(strip(name), F.lit(""))


def name_error(name: Column) -> Column:
    return F.when(clean_name(name).isNull(), F.lit("empty_name"))
