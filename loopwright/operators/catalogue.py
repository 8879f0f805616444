"""The catalogue of prompts and programs: listing, filters, sorting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.text import signature_text

MISSING_SCORE = -1.0


def with_signature(prompts: DataFrame) -> DataFrame:
    """Fill an absent or empty signature from the field lists."""
    made = signature_text(F.col("input_fields"), F.col("output_fields"))
    if "signature" in prompts.columns:
        made = F.coalesce(F.nullif(F.col("signature"), F.lit("")), made)
    return prompts.withColumn("signature", made)


def signature_contains(signature: Column, text: str) -> Column:
    return F.contains(F.lower(signature), F.lit(text.lower()))


def inputs_contain_all(inputs: Column, names: Sequence[str]) -> Column:
    """All names occur in the input side of the signature text."""
    text = F.lower(F.array_join(inputs, ", "))
    return F.forall(F.lit([n.lower() for n in names]), lambda n: F.contains(text, n))


def list_prompts(
    prompts: DataFrame,
    signature_filter: str | None = None,
    output_filter: Sequence[str] | None = None,
) -> DataFrame:
    """Prompts with signature, score text and their details as JSON."""
    listed = prompts.withColumn(
        "signature", signature_text(F.col("input_fields"), F.col("output_fields"))
    )
    if signature_filter:
        listed = listed.filter(signature_contains(F.col("signature"), signature_filter))
    if output_filter:
        listed = listed.filter(inputs_contain_all(F.col("input_fields"), output_filter))
    details = [c for c in prompts.columns if c not in ("example_data", "file_name")]
    return listed.select(
        F.col("file_name").alias("id"),
        "signature",
        F.coalesce(F.col("evaluation_score").cast("string"), F.lit("N/A")).alias("eval_score"),
        F.to_json(F.struct(*details)).alias("details"),
    )


def score_order(score: Column) -> Column:
    """A score as a number for sorting; what is no number comes last."""
    return F.coalesce(score.cast("string").try_cast("double"), F.lit(MISSING_SCORE))


def sort_catalogue(listed: DataFrame, by: str = "score", ascending: bool = False) -> DataFrame:
    """Sort by score or by id; the id breaks ties."""
    key = score_order(F.col("eval_score")) if by == "score" else F.col("id")
    return listed.orderBy(key.asc() if ascending else key.desc(), "id")


def signatures(listed: DataFrame) -> DataFrame:
    """The distinct signatures, sorted."""
    return listed.select("signature").distinct().orderBy("signature")


def common_files(programs: DataFrame, prompts: DataFrame) -> DataFrame:
    """File names that occur on both sides."""
    return programs.select("file_name").intersect(prompts.select("file_name"))


def list_programs(programs: DataFrame, prompts: DataFrame) -> DataFrame:
    """Prompts that also have a program file, sorted by file name."""
    both = with_signature(prompts).join(programs.select("file_name"), "file_name", "left_semi")
    stem = F.replace(F.col("file_name"), F.lit(".json"), F.lit(""))
    name = F.coalesce(F.col("human_readable_id"), stem) if "human_readable_id" in prompts.columns else stem
    return both.orderBy("file_name").select(
        name.alias("id"),
        "signature",
        F.coalesce(F.col("llm_model"), F.lit("N/A")).alias("model"),
        F.coalesce(F.col("evaluation_score").cast("string"), F.lit("N/A")).alias("eval_score"),
    )


def with_registered_flag(prompts: DataFrame, versions: DataFrame) -> DataFrame:
    """Whether the run behind a prompt is the run of a model version."""
    runs = versions.filter(F.col("run_id") != "").select("run_id").distinct()
    marked = runs.withColumn("_known", F.lit(True))
    return prompts.join(marked, "run_id", "left").withColumn(
        "registered", F.coalesce(F.col("_known"), F.lit(False))
    ).drop("_known")
