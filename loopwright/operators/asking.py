"""Prompts put to a predictor: each different prompt once, its answer fetched by all its rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopwright.functions.text import response_entries, response_value
from loopwright.operators.predict import STATUS, SUCCESS, Predictor, batch_predict
from loopwright.session import new_shared_path
from loopwright.spec import TaskSpec

# A predictor that is asked whole prompts: one text in, one text out.
PROMPT = TaskSpec(("prompt",), ("output",))
BOOK_SCHEMA = f"_prompt_id string, output string, {STATUS} string"


class PromptBook:
    """The answers of one predictor, kept in the shared folder; a prompt is asked only once.

    Answers stay between calls, so a prompt that two steps of a search render is asked by the first.
    Prompts that failed are asked again by the next call that has them.
    """

    def __init__(
        self,
        spark: SparkSession,
        make_predictor: Callable[[], Predictor],
        partitions: int | None = None,
        batch_rows: int = 64,
    ):
        self.spark, self.make_predictor = spark, make_predictor
        self.partitions, self.batch_rows = partitions, batch_rows
        self.path = new_shared_path(spark, "prompts")
        self.rounds: list[str] = []

    def _read(self, paths: Sequence[str]) -> DataFrame:
        return self.spark.read.schema(BOOK_SCHEMA).parquet(*paths)

    def answers(self) -> DataFrame:
        """All good answers so far: ``_prompt_id`` (a digest), ``output`` and ``_status``."""
        if not self.rounds:
            return self.spark.createDataFrame([], BOOK_SCHEMA)
        return self._read(self.rounds).filter(F.col(STATUS) == SUCCESS)

    def ask(self, prompts: DataFrame) -> DataFrame:
        """Answers to a table of ``_prompt_id`` and ``prompt``, one row a different prompt."""
        new = prompts.select("_prompt_id", "prompt").distinct()
        known = self.answers()
        if self.rounds:
            new = new.join(known.select("_prompt_id"), "_prompt_id", "left_anti")
        made = batch_predict(
            new, PROMPT, self.make_predictor, ["_prompt_id"], self.partitions, self.batch_rows
        )
        path = f"{self.path}/round-{len(self.rounds)}"
        # Written before it is read: lost executors never cause a second call.
        made.select("_prompt_id", "output", STATUS).write.parquet(path)
        self.rounds.append(path)
        return known.unionByName(self._read([path]))


def answers_by_prompt(prompts: DataFrame, book: PromptBook, fields: Sequence[str]) -> DataFrame:
    """``_prompt_id`` and ``pred_<field>`` of each prompt of a table (see ``PromptBook.ask``)."""
    answers = book.ask(prompts)
    entries = response_entries(F.col("output"))
    good = F.col(STATUS) == SUCCESS
    return answers.withColumn("_entries", F.when(good, entries)).select(
        "_prompt_id", *[response_value(F.col("_entries"), f).alias(f"pred_{f}") for f in fields]
    )


def with_answers(
    rows: DataFrame, prompt: Column, book: PromptBook, fields: Sequence[str], drop: Sequence[str] = ()
) -> DataFrame:
    """Add ``pred_<field>`` of each row's answer; NULL where the answer lacks it or the call failed.

    The prompt is rendered twice, but never travels with the row: rows meet their answers by the
    prompt's digest, in an equi join that AQE splits.  ``drop`` names columns that only the
    prompt needs.
    """
    shown = rows.withColumn("_prompt", prompt)
    digest = F.sha2("_prompt", 256).alias("_prompt_id")
    parsed = answers_by_prompt(shown.select(digest, F.col("_prompt").alias("prompt")), book, fields)
    made = [f"pred_{f}" for f in fields]
    kept = [c for c in rows.columns if c not in {*drop, *made}]
    return shown.select(*kept, digest).join(parsed, "_prompt_id", "left").select(*kept, *made)
