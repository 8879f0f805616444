"""Metrics as table operations: rows with gold fields and ``pred_<field>`` get a ``score``."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.metrics import (
    COSINE_SIMILARITY,
    EXACT_MATCH,
    JUDGE,
    cosine_similarity,
    exact_match,
    judge_input,
    judge_score,
)
from loopwright.functions.prompts import DEMO_TYPE, no_demos, render_prompt
from loopwright.operators.asking import PromptBook, with_answers
from loopwright.operators.predict import with_embedding
from loopwright.spec import TaskSpec

Scorer = Callable[[DataFrame], DataFrame]
PRED = "pred_"


@dataclass(frozen=True)
class Judge:
    """A program that scores: its task, the book of its predictor and, if compiled, its program.

    ``program`` is a table of one row with ``instructions`` and ``demos`` (see ``read_programs``).
    """

    spec: TaskSpec
    book: PromptBook
    program: DataFrame | None = None


def program_columns(program: DataFrame | None) -> tuple[Column | None, Column]:
    """Instructions (None: the task's own) and demos of a one-row program table, as literals."""
    if program is None:
        return None, no_demos()
    row = program.select(
        "instructions", F.to_json(F.col("demos").cast(f"array<{DEMO_TYPE}>")).alias("demos")
    ).first()
    if row is None:
        raise ValueError("the program table is empty")
    demos = no_demos() if row["demos"] is None else F.from_json(F.lit(row["demos"]), f"array<{DEMO_TYPE}>")
    return None if row["instructions"] is None else F.lit(row["instructions"]), demos


def _sides(spec: TaskSpec) -> tuple[list[str], list[str]]:
    return list(spec.outputs), [PRED + f for f in spec.outputs]


def exact_scorer(spec: TaskSpec) -> Scorer:
    """1 where all outputs are equal, else 0; a missing prediction scores 0."""
    gold, pred = _sides(spec)
    return lambda rows: rows.withColumn(
        "score", exact_match([F.col(c) for c in gold], [F.col(c) for c in pred])
    )


def cosine_scorer(
    spec: TaskSpec, make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]]
) -> Scorer:
    """Cosine of the texts' embeddings; a missing prediction scores 0, a zero vector NULL.

    Both sides are encoded where the rows are: nothing is shuffled.
    """
    gold, pred = _sides(spec)

    def score(rows: DataFrame) -> DataFrame:
        found = rows
        for name in (*gold, *pred):
            found = with_embedding(found, name, make_encoder, f"_vector_{name}")
        cosine = cosine_similarity(*[[F.col(f"_vector_{c}") for c in side] for side in (gold, pred)])
        missing = F.lit(False)
        for name in pred:
            missing = missing | F.col(name).isNull()
        value = F.when(missing, F.lit(0.0)).otherwise(cosine)
        return found.select(*[c for c in rows.columns if c != "score"], value.alias("score"))

    return score


def judge_scorer(judge: Judge) -> Scorer:
    """The judge's only answer as a number; anything else scores 0.

    Each judge input is the gold field of that name, else the predicted one, else empty.  Rows
    that show the judge the same are asked once.
    """
    fields = judge.spec.outputs

    def score(rows: DataFrame) -> DataFrame:
        if len(fields) != 1:
            return rows.withColumn("score", F.lit(0.0))
        names = [c for c in rows.columns if c != "score"]
        gold = {c: F.col(c) for c in names if not c.startswith(PRED)}
        pred = {c[len(PRED):]: F.col(c) for c in names if c.startswith(PRED)}
        inputs = dict(zip(judge.spec.inputs, judge_input(judge.spec.inputs, gold, pred)))
        instructions, demos = program_columns(judge.program)
        prompt = render_prompt(judge.spec, demos, inputs, instructions)
        # The judge's answer must not hide a prediction of the same name.
        own = {c: f"_row_{c}" for c in names if c == PRED + fields[0]}
        kept = rows.select(*names).withColumn("_shown", prompt).withColumnsRenamed(own)
        answered = with_answers(kept, F.col("_shown"), judge.book, fields, drop=["_shown"])
        scored = answered.withColumn("score", judge_score(F.col(PRED + fields[0]))).drop(PRED + fields[0])
        return scored.withColumnsRenamed({v: k for k, v in own.items()}).select(*names, "score")

    return score


def scorer_named(
    name: str,
    spec: TaskSpec,
    make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]] | None = None,
    judge: Judge | None = None,
) -> Scorer:
    """The table metric for a metric name."""
    if name == EXACT_MATCH:
        return exact_scorer(spec)
    if name == COSINE_SIMILARITY:
        if make_encoder is None:
            raise ValueError("cosine similarity needs an encoder")
        return cosine_scorer(spec, make_encoder)
    if name == JUDGE:
        if judge is None:
            raise ValueError("the judge metric needs a judge")
        return judge_scorer(judge)
    raise ValueError(f"unknown metric: {name}")
