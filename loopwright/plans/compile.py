"""The compile job: from a labelled table to a stored, scored program."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.functions.prompts import DEMO_TYPE
from loopwright.functions.text import program_id
from loopwright.operators.contracts import examples
from loopwright.operators.demos import program_document
from loopwright.operators.evaluation import (
    MIN_EXAMPLES,
    dataset_profile,
    dataset_score,
    evaluation_table,
)
from loopwright.operators.ordinal import key_at_rank, split_at
from loopwright.plans import search
from loopwright.session import checkpoint, new_shared_path
from loopwright.sources.writers import append_log, write_csv
from loopwright.spec import TaskSpec

# The optimiser names.
BOOTSTRAP = "BootstrapFewShot"
RANDOM_SEARCH = "BootstrapFewShotWithRandomSearch"
INSTRUCTIONS = "COPRO"
JOINT = "MIPROv2"
TRAIN_RATIO = 0.8
OPTIMIZERS = (BOOTSTRAP, RANDOM_SEARCH, INSTRUCTIONS, JOINT)


@dataclass(frozen=True)
class CompiledProgram:
    summary: DataFrame
    program: DataFrame
    scores: DataFrame | None
    path: str
    evaluation: DataFrame | None = None


def compile_program(
    data: DataFrame,
    spec: TaskSpec,
    key: str,
    optimizer: str,
    teacher: search.Teacher,
    student: search.Student,
    instructions: DataFrame | None = None,
    num_candidates: int = search.NUM_CANDIDATES,
    num_batches: int = search.NUM_BATCHES,
    run_id: str = "run",
    run_date: str = "1970-01-01",
    model: str = "N/A",
    teacher_model: str = "N/A",
    metric_name: str | None = None,
    propose: search.Proposer | None = None,
    depth: int = 3,
) -> CompiledProgram:
    """Split, score the baseline, optimise, score again, and store the results.

    ``instructions`` (``candidate_id, instructions``) is needed by the instruction searches; with
    ``propose`` the first of them goes on for ``depth`` rounds with the texts that it proposes.
    Below ``path`` of the result, in the shared folder, are then the dataset (``dataset`` as CSV,
    ``examples`` with the keys), the program (``program``, for ``read_programs``), its prompt
    document (``prompt``, for ``read_prompts``), the score of each dev example (``evaluation``) and
    the run summary (``runs``).  The source is read once; all steps run on ``examples``.  A
    student that returns its outputs as ``pred_<field>`` has them in the evaluation rows.
    """
    if optimizer not in OPTIMIZERS:
        raise ValueError(f"unsupported optimizer: {optimizer}")
    if optimizer in (INSTRUCTIONS, JOINT) and instructions is None:
        raise ValueError(f"{optimizer} needs a table of instructions")
    spark = data.sparkSession
    path = new_shared_path(spark, "compiled")
    rows = examples(data, spec, keep=[key])
    rows.write.parquet(f"{path}/examples")
    rows = spark.read.schema(rows.schema).parquet(f"{path}/examples")
    total, first_dev = key_at_rank(rows, [key], fraction=TRAIN_RATIO)
    if total < MIN_EXAMPLES:
        raise ValueError("at least two examples are required")
    train, dev = split_at(rows, [key], first_dev)

    no_demos = F.array().cast(f"array<{DEMO_TYPE}>")
    base = checkpoint(
        spark.range(1).select(
            F.lit(0).alias("candidate_id"),
            F.lit(spec.instructions).alias("instructions"),
            no_demos.alias("demos"),
        )
    )
    scores = None
    if optimizer == BOOTSTRAP:
        found = search.bootstrap_demos(train, spec, key, teacher)
        demos = found.agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct("position", key))), lambda p: p["position"]
            ).alias("order"),
            F.map_from_entries(F.collect_list(F.struct("position", "demo"))).alias("by_position"),
        ).select(F.transform("order", lambda p: F.col("by_position")[p]).alias("demos"))
        program = demos.select(
            F.lit(0).alias("candidate_id"), F.lit(spec.instructions).alias("instructions"), "demos"
        )
    elif optimizer == RANDOM_SEARCH:
        candidates = search.candidate_programs(train, spec, key, teacher, num_candidates).select(
            "candidate_id", F.lit(spec.instructions).alias("instructions"), "demos"
        )
        scores = search.random_search(dev, candidates, num_candidates, student)
    elif optimizer == INSTRUCTIONS:
        if propose is None:
            candidates = checkpoint(instructions.withColumn("demos", no_demos))
            scores = search.instruction_search(train, instructions, candidates.count(), student)
        else:
            scores = search.instruction_rounds(train, instructions, student, propose, depth)
            candidates = scores.select("candidate_id", "instructions", no_demos.alias("demos"))
    else:
        sets = search.candidate_programs(
            train,
            spec,
            key,
            teacher,
            num_candidates,
            search.JOINT_MAX_BOOTSTRAPPED,
            search.JOINT_MAX_LABELED,
        )
        candidates = search.joint_candidates(instructions, sets, num_candidates)
        scores = search.racing_search(
            dev, candidates, candidates.count(), key, student, num_batches
        )
    if scores is not None:
        program = candidates.join(scores.filter("best").select("candidate_id"), "candidate_id").select(
            F.lit(0).alias("candidate_id"), "instructions", "demos"
        )
    program = checkpoint(program)

    # Baseline and result are two candidates of one scoring pass.
    both = base.unionByName(program.withColumn("candidate_id", F.lit(1)))
    scored = search.studied(dev, checkpoint(both), 2, student)
    answered = [f"pred_{name}" for name in spec.outputs if f"pred_{name}" in scored.columns]
    scored = scored.select("candidate_id", key, *spec.fields, *answered, "score")
    scored.write.parquet(f"{path}/scored")
    scored = spark.read.schema(scored.schema).parquet(f"{path}/scored")
    final = dataset_score(scored, "candidate_id")
    actual = F.struct(*[F.col(a).alias(a.removeprefix("pred_")) for a in answered])
    results = scored.filter("candidate_id = 1").select(
        F.col(key).alias("example_id"),
        F.to_json(F.struct(*spec.inputs)).alias("input"),
        F.to_json(F.struct(*spec.outputs)).alias("expected_output"),
        *([F.to_json(actual).alias("actual_output")] if answered else []),
        "score",
    )
    evaluation = evaluation_table(results, metric_name)
    append_log(evaluation.withColumn("run_id", F.lit(run_id)), f"{path}/evaluation", run_date)
    profile = dataset_profile(rows.select(*spec.fields)).first()

    def of(candidate: int, value: str) -> Column:
        return F.max(F.when(F.col("candidate_id") == candidate, F.col(value)))

    summary = final.agg(
        F.lit(run_id).alias("run_id"),
        F.lit(optimizer).alias("optimizer"),
        F.lit(spec.signature).alias("signature"),
        F.lit(profile["row_count"]).cast("long").alias("row_count"),
        F.lit(profile["column_names"]).alias("column_names"),
        F.lit(profile["file_hash"]).alias("file_hash"),
        (F.lit(profile["row_count"]) - of(0, "examples")).alias("trainset_size"),
        of(0, "examples").alias("devset_size"),
        of(0, "percent").alias("baseline_score"),
        of(1, "percent").alias("evaluation_score"),
        F.round(of(1, "percent") - of(0, "percent"), 2).alias("score_improvement"),
    )
    summary = checkpoint(summary)
    write_csv(rows.select(*spec.fields), f"{path}/dataset")
    texts = program.select(
        program_document(F.col("demos"), F.col("instructions")).alias("program"), "instructions"
    )
    texts.select("program").coalesce(1).write.text(f"{path}/program")
    found = summary.first()  # the one summary row
    names, outputs = (F.array(*map(F.lit, n)) for n in (spec.inputs, spec.outputs))
    described = {
        "input_fields": names,
        "input_descriptions": F.array(*[F.lit(spec.description_of(n)) for n in spec.inputs]),
        "output_fields": outputs,
        "output_descriptions": F.array(*[F.lit(spec.description_of(n)) for n in spec.outputs]),
        "dspy_module": F.lit(spec.module),
        "llm_model": F.lit(model),
        "teacher_model": F.lit(teacher_model),
        "optimizer": F.lit(optimizer),
        "instructions": F.col("instructions"),
        "signature": F.lit(spec.signature),
        "evaluation_score": F.lit(found["evaluation_score"]),
        "baseline_score": F.lit(found["baseline_score"]),
        "optimized_prompt": F.col("program"),
        "human_readable_id": program_id(
            names, outputs, F.lit(model), F.lit(spec.module), F.lit(optimizer),
            F.lit(run_date).cast("date"),
        ),
        "mlflow_run_id": F.lit(run_id),
    }
    document = texts.select(
        F.to_json(F.struct(*[c.alias(n) for n, c in described.items()])).alias("document")
    )
    document.coalesce(1).write.text(f"{path}/prompt")
    append_log(summary, f"{path}/runs", run_date)
    return CompiledProgram(summary, program, scores, path, evaluation)
