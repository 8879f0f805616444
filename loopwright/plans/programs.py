"""Teachers and students made of a predictor: prompt, ask, parse, score.

Both are what ``plans.search`` and ``plans.compile`` take.  With one book for both, a prompt that
the teacher and a student without demos share is asked once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.prompts import no_demos, render_prompt
from loopwright.operators.asking import PromptBook, answers_by_prompt, with_answers
from loopwright.operators.evaluation import fan_out
from loopwright.operators.scoring import PRED, Scorer, program_columns
from loopwright.plans.search import Proposer, Student, Teacher
from loopwright.session import checkpoint, is_small, lookup_side
from loopwright.spec import TaskSpec

REASONING = "reasoning"

# The task of a proposer: the best texts so far, worst first, and the number of the proposal.
PROPOSAL = TaskSpec(
    ("tried", "proposal"),
    ("instructions",),
    "Propose better instructions than those that were tried",
    ("Instructions that were tried, each with its score",),
)


def _fields(spec: TaskSpec) -> list[str]:
    return [REASONING, *spec.outputs] if spec.reasons else list(spec.outputs)


def teacher_of(
    spec: TaskSpec, book: PromptBook, scorer: Scorer, program: DataFrame | None = None
) -> Teacher:
    """Rows with ``pred_<field>``, ``score`` and, for a task that reasons, ``reasoning``.

    The teacher runs ``program`` (one row of ``instructions`` and ``demos``), else the bare task.
    """

    def teach(rows: DataFrame) -> DataFrame:
        instructions, demos = program_columns(program)
        prompt = render_prompt(spec, demos, {f: F.col(f) for f in spec.inputs}, instructions)
        answered = with_answers(rows, prompt, book, _fields(spec))
        if spec.reasons:
            answered = answered.withColumn(REASONING, F.col(PRED + REASONING)).drop(PRED + REASONING)
        return scorer(answered)

    return teach


@dataclass(frozen=True)
class PromptStudent:
    """A student that renders prompts for a book; see ``student_of``."""

    spec: TaskSpec
    book: PromptBook
    scorer: Scorer

    def _prompt(self, rows: DataFrame, inputs: dict[str, str]) -> Column:
        own = F.lit(self.spec.instructions)
        instructions = F.coalesce("instructions", own) if "instructions" in rows.columns else own
        shown = {f: F.col(c) for f, c in inputs.items()}
        return render_prompt(self.spec, F.col("demos"), shown, instructions)

    def _scored(self, answered: DataFrame) -> DataFrame:
        return self.scorer(answered.drop(PRED + REASONING) if self.spec.reasons else answered)

    def __call__(self, rows: DataFrame) -> DataFrame:
        prompt = self._prompt(rows, {f: f for f in self.spec.inputs})
        return self._scored(
            with_answers(rows, prompt, self.book, _fields(self.spec), drop=("instructions", "demos"))
        )

    def over(self, rows: DataFrame, candidates: DataFrame, count: int | Sequence[int]) -> DataFrame:
        """The same as ``self(fan_out(rows, candidates, count))``.

        A prompt follows from its program and the text of the row's inputs.  So prompts are rendered
        for the different inputs alone, and rows look their answers up by program and inputs.  Where
        the different inputs are many, each row renders its own.
        """
        names = {f: f"_input{i}" for i, f in enumerate(self.spec.inputs)}
        texts = [F.col(f).cast("string").alias(c) for f, c in names.items()]
        inputs = checkpoint(rows.select(*texts).distinct())
        if not is_small(inputs):
            return self(fan_out(rows, candidates, count))
        parts = [c for c in ("instructions", "demos") if c in candidates.columns]
        programs = checkpoint(
            candidates.withColumn("_program", F.sha2(F.to_json(F.struct(*parts)), 256))
        )
        shown = fan_out(inputs, programs, count)
        shown = checkpoint(
            shown.select("_program", *names.values(), self._prompt(shown, names).alias("_prompt"))
            .distinct()
            .withColumn("_prompt_id", F.sha2("_prompt", 256))
        )
        prompts = shown.select("_prompt_id", F.col("_prompt").alias("prompt"))
        parsed = answers_by_prompt(prompts, self.book, _fields(self.spec))
        made = [PRED + f for f in _fields(self.spec)]
        found = shown.join(parsed, "_prompt_id", "left").select(
            F.col("_program").alias("_asked"), *names.values(), *made
        )
        found = lookup_side(found)
        each = fan_out(rows, programs.drop(*parts), count)
        kept = [c for c in each.columns if c not in {"_program", *made}]
        same = reduce(
            lambda x, y: x & y,
            [each[f].cast("string").eqNullSafe(found[c]) for f, c in names.items()],
            each["_program"] == found["_asked"],
        )
        answered = each.join(found, same, "left").select(
            *[each[c] for c in kept], *[found[c] for c in made]
        )
        return self._scored(answered)


def student_of(spec: TaskSpec, book: PromptBook, scorer: Scorer) -> Student:
    """Rows joined to candidates (``instructions``, ``demos``) with ``pred_<field>`` and ``score``.

    A candidate without instructions has the task's.  The programs are dropped once the prompt is
    rendered: rows travel to their answers without them.
    """
    return PromptStudent(spec, book, scorer)


def proposer_of(book: PromptBook, breadth: int, shown: int = 10, spec: TaskSpec = PROPOSAL) -> Proposer:
    """Proposals from a predictor: it is shown the ``shown`` best texts and asked ``breadth`` times."""

    def propose(scored: DataFrame) -> DataFrame:
        best = scored.orderBy(F.desc("percent"), "candidate_id").limit(shown)
        lines = F.array_sort(
            F.collect_list(F.struct("percent", (-F.col("candidate_id")).alias("last"), "instructions"))
        )
        line = lambda x: F.concat(F.format_number(x["percent"], 2), F.lit(" "), x["instructions"])
        tried = best.agg(F.transform(lines, line).alias("lines"))
        tried = tried.select(F.array_join("lines", "; ").alias("tried"))
        asked = tried.select("tried", F.explode(F.sequence(F.lit(1), F.lit(breadth))).alias("proposal"))
        prompt = render_prompt(spec, no_demos(), {f: F.col(f) for f in spec.inputs})
        answered = with_answers(asked, prompt, book, spec.outputs)
        return answered.select(F.col(PRED + spec.outputs[0]).alias("instructions"))

    return propose
