"""Scores over a dataset: pairing, candidate fan-out, summaries, readiness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.fingerprint import dataset_fingerprint
from loopwright.functions.metrics import judge_score
from loopwright.functions.text import value_text
from loopwright.session import broadcast_if_small

# Rows each optimiser needs at least, and is advised to have.
REQUIREMENTS = {
    "BootstrapFewShot": (10, 50),
    "BootstrapFewShotWithRandomSearch": (50, 100),
    "COPRO": (20, 100),
    "MIPROv2": (100, 200),
}
MIN_EXAMPLES = 2


def pair_predictions(gold: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Gold examples with their prediction; an example without one stays, with NULLs."""
    return gold.join(predictions, key, "left")


def fan_out(dev: DataFrame, candidates: DataFrame, count: int | Sequence[int]) -> DataFrame:
    """Every dev row once per candidate.

    ``candidates`` holds ``candidate_id`` 0 to ``count - 1`` (or a given list of ids) and is a
    written or checkpointed table.  Ids are made in place by a generator, then the programs are looked
    up by id: broadcast when their counted bytes are small, else an equi join whose few
    large keys AQE splits.
    """
    wanted = F.sequence(F.lit(0), F.lit(count - 1)) if isinstance(count, int) else F.lit(list(count))
    ids = F.explode(wanted).alias("candidate_id")
    return dev.select("*", ids).join(broadcast_if_small(candidates), "candidate_id")


def percent_score(score: Column) -> Column:
    """The evaluator's score: the mean in percent, to two digits."""
    return F.round(100 * F.avg(score), 2)


def dataset_score(scored: DataFrame, *by: str, score: str = "score") -> DataFrame:
    return scored.groupBy(*by).agg(
        percent_score(F.col(score)).alias("percent"), F.count(F.lit(1)).alias("examples")
    )


def best_candidate(scores: DataFrame, candidate: str = "candidate_id", score: str = "percent") -> DataFrame:
    """The highest score; of equal scores the lowest candidate id."""
    order = F.struct(F.col(score), -F.col(candidate))
    return scores.agg(
        F.max_by(candidate, order).alias(candidate), F.max(score).alias(score)
    )


def evaluation_summary(table: DataFrame, *by: str) -> DataFrame:
    """Mean, sample deviation (NULL for one row) and count of the scores."""
    return table.groupBy(*by).agg(
        F.round(F.avg("score"), 6).alias("eval_score_mean"),
        F.round(F.stddev_samp("score"), 6).alias("eval_score_std"),
        F.count("score").alias("eval_example_count"),
    )


def compile_summary(runs: DataFrame) -> DataFrame:
    """Baseline against final score per run, from rows of ``run_id, phase, score``."""

    def phase(name: str, value: Column) -> Column:
        return F.when(F.col("phase") == name, value)

    summed = runs.groupBy("run_id").agg(
        F.round(F.avg(phase("baseline", F.col("score"))), 6).alias("baseline_score"),
        F.round(F.avg(phase("evaluation", F.col("score"))), 6).alias("evaluation_score"),
        F.count(phase("train", F.lit(1))).alias("trainset_size"),
        F.count(phase("evaluation", F.lit(1))).alias("devset_size"),
    )
    gain = F.round(F.col("evaluation_score") - F.col("baseline_score"), 6)
    return summed.withColumn("score_improvement", gain)


def batch_stats(results: DataFrame, latency: str, *by: str) -> DataFrame:
    """Counts, latency and success rate of a batch run; zeros for an empty one."""
    summed = results.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("_status") == "success").alias("success_count"),
        F.round(F.coalesce(F.sum(latency), F.lit(0.0)), 4).alias("total_latency"),
    )

    def per_row(value: str) -> Column:
        return F.round(F.coalesce(F.try_divide(F.col(value), F.col("total_rows")), F.lit(0.0)), 6)

    return summed.select(
        *by,
        "total_rows",
        "success_count",
        (F.col("total_rows") - F.col("success_count")).alias("error_count"),
        "total_latency",
        per_row("total_latency").alias("avg_latency_per_row"),
        per_row("success_count").alias("success_rate"),
    )


def evaluation_table(results: DataFrame, metric_name: str | None = None) -> DataFrame:
    """Evaluation rows in their stored form: all text but the id and the score.

    Columns that are absent get their defaults; ``example_id`` must be there
    (see ``with_ordinal``).
    """
    present = set(results.columns)

    def text(name: str) -> Column:
        return value_text(results, name) if name in present else F.lit("")

    score = (
        judge_score(F.col("score"))
        if "score" in present
        else F.lit(0.0)
    )
    default = F.lit(metric_name or "unknown")
    metric = F.coalesce(F.col("metric_name"), default) if "metric_name" in present else default
    return results.select(
        "example_id",
        text("input").alias("input"),
        text("expected_output").alias("expected_output"),
        text("actual_output").alias("actual_output"),
        score.alias("score"),
        metric.alias("metric_name"),
    )


def dataset_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count, column list and content hash in one pass over the data."""
    names = list(columns or df.columns)
    return dataset_fingerprint(df, names).select(
        "row_count",
        F.lit(",".join(names)).alias("column_names"),
        F.col("fingerprint").alias("file_hash"),
    )


def readiness(df: DataFrame, *by: str, demos_needed: int = 8) -> DataFrame:
    """Row counts against what each optimiser needs, one row per optimiser and group."""
    needs = F.array(
        *[
            F.struct(
                F.lit(name).alias("optimizer"),
                F.lit(minimum).alias("minimum"),
                F.lit(advised).alias("recommended"),
            )
            for name, (minimum, advised) in REQUIREMENTS.items()
        ]
    )
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("row_count"))
    return counts.select(*by, "row_count", F.inline(needs)).withColumns(
        {
            "can_compile": F.col("row_count") >= MIN_EXAMPLES,
            "enough_for_demos": F.col("row_count") >= demos_needed,
            "meets_minimum": F.col("row_count") >= F.col("minimum"),
            "meets_recommended": F.col("row_count") >= F.col("recommended"),
        }
    )
