"""Prompt text as a column: instructions, format, demos, then the row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from loopwright.spec import TaskSpec

# The wording and separators of a rendered prompt.
SECTION_BREAK = "\n\n---\n\n"
FORMAT_HEADING = "Follow the following format."
REASONING_LABEL = "Reasoning"
REASONING_LEAD = "Let's think step by step in order to"
HINT_LABEL = "Hint"

DEMO_TYPE = "struct<fields:map<string,string>,augmented:boolean,reasoning:string>"


def field_label(name: str) -> str:
    """``original_title`` reads ``Original Title``."""
    return " ".join(word[:1].upper() + word[1:] for word in name.split("_") if word)


def format_block(spec: TaskSpec) -> str:
    lines = [f"{field_label(f)}: {spec.description_of(f)}" for f in spec.inputs]
    if spec.module == "ChainOfThoughtWithHint":
        lines.append(f"{HINT_LABEL}: ${{hint}}")
    if spec.reasons:
        goal = " and ".join(spec.outputs)
        lines.append(f"{REASONING_LABEL}: {REASONING_LEAD} ${{produce the {goal}}}. We ...")
    lines += [f"{field_label(f)}: {spec.description_of(f)}" for f in spec.outputs]
    return "\n\n".join([FORMAT_HEADING, *lines])


def demo_block(spec: TaskSpec, demo: Column) -> Column:
    """Labelled demos are compact; augmented ones are spaced and show their reasoning."""

    def line(field: str) -> Column:
        return F.concat(
            F.lit(f"{field_label(field)}: "), F.coalesce(demo["fields"][field], F.lit(""))
        )

    inputs = [line(f) for f in spec.inputs]
    outputs = [line(f) for f in spec.outputs]
    labelled = F.concat_ws("\n", *inputs, *outputs)
    if not spec.reasons:
        return labelled
    thought = F.concat(F.lit(f"{REASONING_LABEL}: {REASONING_LEAD} "), demo["reasoning"])
    spaced = F.concat_ws("\n\n", *inputs, thought, *outputs)
    return F.when(demo["augmented"] & demo["reasoning"].isNotNull(), spaced).otherwise(labelled)


def row_block(spec: TaskSpec, inputs: Mapping[str, Column]) -> Column:
    lines = [
        F.concat(F.lit(f"{field_label(f)}: "), F.coalesce(inputs[f].cast("string"), F.lit("")))
        for f in spec.inputs
    ]
    if spec.module == "ChainOfThoughtWithHint" and spec.hint:
        lines.append(F.lit(f"{HINT_LABEL}: {spec.hint}"))
    if spec.reasons:
        lines.append(F.lit(f"{REASONING_LABEL}: {REASONING_LEAD}"))
    else:
        lines.append(F.lit(f"{field_label(spec.outputs[0])}:"))
    return F.concat_ws("\n\n", *lines)


def no_demos() -> Column:
    return F.array().cast(f"array<{DEMO_TYPE}>")


def render_prompt(
    spec: TaskSpec,
    demos: Column,
    inputs: Mapping[str, Column],
    instructions: Column | None = None,
) -> Column:
    """The full prompt of one row; ``demos`` is an array of ``DEMO_TYPE`` structs.

    ``instructions`` stand in for those of the task.
    """
    shown = F.array_join(F.transform(demos, lambda d: demo_block(spec, d)), SECTION_BREAK)
    return F.concat_ws(
        SECTION_BREAK,
        F.lit(spec.instructions) if instructions is None else instructions,
        F.lit(format_block(spec)),
        F.when(F.length(shown) > 0, shown),
        row_block(spec, inputs),
    )
