"""The model registry and its runs as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.functions.text import (
    millis_to_timestamp,
    score_or_null,
    split_names,
    truncate_text,
    version_description,
    version_tags,
)
from loopwright.operators.contracts import clean_name, name_error
from loopwright.operators.ordinal import with_group_ordinal
from loopwright.session import lookup_side

# Stages and the aliases that stand for them.
STAGE_ALIASES = {"Production": "champion", "Staging": "challenger"}
CLEARING_STAGES = ("Archived", "None")
LIMITED_TAGS = ("input_fields", "output_fields", "signature")


def version_number(column: str = "version") -> Column:
    return F.col(column).cast("long")


def latest_versions(versions: DataFrame, *by: str) -> DataFrame:
    """The row with the highest numeric version per model (and per ``by``)."""
    groups = ["model_name", *by]
    rest = [c for c in versions.columns if c not in groups]
    # A rank of one is pruned to a row per model and task before the shuffle.
    order = Window.partitionBy(*groups).orderBy(version_number().desc_nulls_last())
    newest = versions.withColumn("_place", F.row_number().over(order)).filter("_place = 1")
    return newest.select(*groups, *rest)


def with_run_score(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Add the score of each version's run, NULL when the run is gone."""
    return versions.join(runs.select("run_id", "evaluation_score"), "run_id", "left")


def list_models(models: DataFrame, versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Every registered model with its latest version; ``"0"`` when it has none."""
    latest = with_run_score(latest_versions(versions), runs)
    return models.join(latest, "model_name", "left").select(
        F.col("model_name").alias("name"),
        F.coalesce(F.col("version"), F.lit("0")).alias("latest_version"),
        F.coalesce(F.col("stage"), F.lit("None")).alias("current_stage"),
        "description",
        "evaluation_score",
    )


def list_versions(
    versions: DataFrame,
    runs: DataFrame,
    aliases: DataFrame | None = None,
    model_name: str | None = None,
    stage: str | None = None,
) -> DataFrame:
    """Versions with score and creation time, highest number first.

    ``aliases`` holds ``model_name, alias, version``; a version has few of them.
    """
    if model_name:
        versions = versions.filter(F.col("model_name") == model_name)
    if stage:
        versions = versions.filter(F.col("stage") == stage)
    found = with_run_score(versions, runs)
    if aliases is not None:
        named = aliases.groupBy("model_name", "version").agg(
            F.array_join(F.array_sort(F.collect_set("alias")), ",").alias("aliases")
        )
        found = found.join(named, ["model_name", "version"], "left")
    else:
        found = found.withColumn("aliases", F.lit(None).cast("string"))
    return found.select(
        "model_name",
        "version",
        "stage",
        F.coalesce(F.col("aliases"), F.lit("")).alias("aliases"),
        millis_to_timestamp(F.col("creation_timestamp")).alias("created_at"),
        "evaluation_score",
        "run_id",
    ).orderBy("model_name", version_number().desc())


def version_metadata(versions: DataFrame) -> DataFrame:
    """Tags of a version as typed columns."""
    tag = lambda name: F.col("tags")[name]
    return versions.select(
        "model_name",
        "version",
        "stage",
        "run_id",
        "creation_timestamp",
        split_names(tag("input_fields")).alias("input_fields"),
        split_names(tag("output_fields")).alias("output_fields"),
        score_or_null(tag("evaluation_score")).alias("evaluation_score"),
        F.coalesce(tag("dspy_module"), F.lit("")).alias("dspy_module"),
        F.coalesce(tag("optimizer"), F.lit("")).alias("optimizer"),
        F.coalesce(tag("signature"), F.lit("")).alias("signature"),
    )


def flatten_models(models: DataFrame) -> DataFrame:
    """One row per model and latest version, from a nested ``latest_versions`` list."""
    return models.select("model_name", "description", F.inline("latest_versions"))


def prompt_of_run(
    runs: DataFrame, prompt_artifacts: DataFrame, program_artifacts: DataFrame
) -> DataFrame:
    """The prompt of each run: its own artifact, else rebuilt from the program and run."""
    params = lambda name: F.col("params")[name]
    own = prompt_artifacts.select("run_id", F.struct("*").alias("own"))
    program = program_artifacts.select(
        "run_id", F.struct(F.col("instructions")).alias("program")
    )
    joined = runs.join(own, "run_id", "left").join(program, "run_id", "left")

    def field(name: str, fallback: Column) -> Column:
        return F.when(F.col("own").isNotNull(), F.col(f"own.{name}")).otherwise(fallback).alias(name)

    def param(name: str) -> Column:
        return F.coalesce(params(name), F.lit("N/A"))

    return joined.filter(F.col("own").isNotNull() | F.col("program").isNotNull()).select(
        "run_id",
        field(
            "human_readable_id",
            F.coalesce(
                params("human_readable_id"),
                F.concat(F.lit("MLflow-"), F.substring("run_id", 1, 8)),
            ),
        ),
        field("input_fields", F.coalesce(params("input_fields"), F.lit(""))),
        field("output_fields", F.coalesce(params("output_fields"), F.lit(""))),
        field("dspy_module", param("dspy_module")),
        field("llm_model", param("llm_model")),
        field("teacher_model", param("teacher_model")),
        field("optimizer", param("optimizer")),
        field("instructions", F.coalesce(F.col("program.instructions"), F.lit(""))),
        field(
            "evaluation_score",
            F.coalesce(F.col("metrics")["evaluation_score"].cast("string"), F.lit("N/A")),
        ),
        F.col("own").isNull().alias("extracted_from_program"),
    )


def run_params(runs: DataFrame, params: Sequence[str]) -> DataFrame:
    """Run parameters in long form, as text within the stored limit."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(p).alias("param"),
                truncate_text(F.coalesce(F.col(p).cast("string"), F.lit(""))).alias("value"),
            )
            for p in params
        ]
    )
    return runs.select("run_id", F.inline(pairs))


def current_aliases(events: DataFrame) -> DataFrame:
    """Who holds each alias now, from a log of stage changes.

    Moving a version to a stage sets that stage's alias; archiving a version, or taking it
    out of all stages, removes the aliases it holds at that time.  Only the last setting of
    an alias counts, and only if no later event clears that version.
    """
    alias = F.col("stage")
    for stage, name in STAGE_ALIASES.items():
        alias = F.when(F.col("stage") == stage, F.lit(name)).otherwise(alias)
    moment = F.struct("ts", "event_id")
    held = (
        events.filter(F.col("stage").isin(*STAGE_ALIASES))
        .groupBy("model_name", alias.alias("alias"))
        .agg(F.max_by("version", moment).alias("version"), F.max(moment).alias("set_at"))
    )
    cleared = (
        events.filter(F.col("stage").isin(*CLEARING_STAGES))
        .groupBy("model_name", "version")
        .agg(F.max(moment).alias("cleared_at"))
    )
    gone = (
        (held["model_name"] == cleared["model_name"])
        & (held["version"] == cleared["version"])
        & (cleared["cleared_at"] > held["set_at"])
    )
    return held.join(cleared, gone, "left_anti").select("model_name", "alias", "version")


def alias_history(events: DataFrame) -> DataFrame:
    """Who holds each alias now, from one log of stage moves, settings and deletions.

    ``action`` is ``stage`` (with ``stage``), ``set`` or ``delete`` (with ``alias``).  Moving a
    version to a stage sets that stage's alias; taking it out of all stages clears every alias it
    holds then, also hand-set ones; deleting an alias clears it, whoever holds it.  An alias
    belongs to its last setting unless a later event clears it.
    """
    moved = F.col("action") == "stage"
    alias = F.when(F.col("action").isin("set", "delete"), F.col("alias"))
    for stage, name in STAGE_ALIASES.items():
        alias = F.when(moved & (F.col("stage") == stage), F.lit(name)).otherwise(alias)
    moment = F.struct("ts", "event_id")
    named = events.withColumn("alias", alias)
    # The last event that names an alias decides, map-side pruned: a setting or a deletion.
    last = (
        named.filter(F.col("alias").isNotNull())
        .groupBy("model_name", "alias")
        .agg(F.max(F.struct("ts", "event_id", "action", "version")).alias("last"))
        .filter(F.col("last.action") != "delete")
        .select(
            "model_name", "alias", "last.version",
            F.struct("last.ts", "last.event_id").alias("set_at"),
        )
    )
    cleared = (
        events.filter(moved & F.col("stage").isin(*CLEARING_STAGES))
        .groupBy("model_name", "version")
        .agg(F.max(moment).alias("cleared_at"))
    )
    gone = (
        (last["model_name"] == cleared["model_name"])
        & (last["version"] == cleared["version"])
        & (cleared["cleared_at"] > last["set_at"])
    )
    return last.join(cleared, gone, "left_anti").select("model_name", "alias", "version")


def alias_state(events: DataFrame) -> DataFrame:
    """Who holds each alias now, from a log of ``set`` and ``delete`` actions."""
    moment = F.struct("ts", "event_id")
    last = events.groupBy("model_name", "alias").agg(
        F.max_by(F.struct("action", "version"), moment).alias("last")
    )
    return last.filter(F.col("last.action") == "set").select(
        "model_name", "alias", F.col("last.version").alias("version")
    )


def resolve_versions(requests: DataFrame, versions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The version a request means: a given version, else its alias, its stage, or the latest.

    The three lookup tables hold one row per model (and alias or stage).
    """
    by_alias = lookup_side(
        aliases.select("model_name", "alias", F.col("version").alias("_by_alias"))
    )
    by_stage = lookup_side(
        latest_versions(versions.select("model_name", "stage", "version"), "stage").select(
            "model_name", "stage", F.col("version").alias("_by_stage")
        )
    )
    # The latest version of a model is the highest of its stages: no second pass is needed.
    number = F.col("_by_stage").cast("long")
    latest = lookup_side(
        by_stage.groupBy("model_name").agg(F.max_by("_by_stage", number).alias("_latest"))
    )
    resolved = (
        F.when(F.col("version").isNotNull(), F.col("version"))
        .when(F.col("alias").isNotNull(), F.col("_by_alias"))
        .when(F.col("stage").isNotNull(), F.col("_by_stage"))
        .otherwise(F.col("_latest"))
    )
    return (
        requests.join(by_alias, ["model_name", "alias"], "left")
        .join(by_stage, ["model_name", "stage"], "left")
        .join(latest, "model_name", "left")
        .select(*requests.columns, resolved.alias("resolved_version"))
    )


def next_versions(requests: DataFrame, versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Give each request the next free version number of its model, in key order."""
    highest = lookup_side(
        versions.groupBy("model_name").agg(F.max(version_number()).alias("_highest"))
    )
    numbered = with_group_ordinal(requests, ["model_name"], keys, "_place")
    return numbered.join(highest, "model_name", "left").select(
        *requests.columns,
        (F.coalesce(F.col("_highest"), F.lit(0)) + F.col("_place") + 1)
        .cast("string")
        .alias("version"),
    )


def registration_checks(requests: DataFrame) -> DataFrame:
    """Clean model names and name the reason why a request cannot be registered."""
    error = F.coalesce(
        name_error(F.col("model_name")),
        F.when(F.coalesce(F.col("run_id"), F.lit("")) == "", F.lit("no_run_id")),
    )
    return requests.withColumns({"error_code": error, "model_name": clean_name(F.col("model_name"))})


def with_version_facts(requests: DataFrame) -> DataFrame:
    """Add the description and the tag map of a version to be."""
    facts = {
        name: F.col(name)
        for name in ("input_fields", "output_fields", "dspy_module", "optimizer", "signature")
    }
    score = F.col("evaluation_score")
    return requests.withColumns(
        {
            "description": version_description(
                facts["input_fields"],
                facts["output_fields"],
                facts["dspy_module"],
                facts["optimizer"],
                score,
                F.col("instructions"),
            ),
            "tags": version_tags(
                {**facts, "evaluation_score": score.cast("string")}, LIMITED_TAGS
            ),
        }
    )


def register(requests: DataFrame, versions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Registration results: new versions for good requests, error codes for the others."""
    checked = with_version_facts(registration_checks(requests))
    good = next_versions(checked.filter(F.col("error_code").isNull()), versions, keys)
    bad = checked.filter(F.col("error_code").isNotNull()).withColumn(
        "version", F.lit(None).cast("string")
    )
    return good.unionByName(bad).withColumn("success", F.col("error_code").isNull())


def prediction_log(results: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Trace rows for predictions: result text, resolved version, latency, status."""
    return results.join(requests, key).select(
        F.coalesce(F.col("trace_id"), F.concat(F.lit("degraded-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16))).alias("trace_id"),
        "model_name",
        F.col("resolved_version").alias("model_version"),
        "timestamp_ms",
        "inputs",
        "outputs",
        "latency_ms",
        (F.col("_status") != "success").alias("is_error"),
    )
