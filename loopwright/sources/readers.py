"""Scans: CSV datasets, prompt and program documents, trace tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loopwright.functions.jsonmap import MAP_TYPE
from loopwright.functions.text import utc

# Keys of a prompt document, by type.
PROMPT_LISTS = ("input_fields", "input_descriptions", "input_descs", "output_fields",
                "output_descriptions", "output_descs")
PROMPT_TEXTS = ("dspy_module", "llm_model", "teacher_model", "optimizer", "instructions",
                "signature", "evaluation_score", "baseline_score", "optimized_prompt",
                "usage_instructions", "human_readable_id", "mlflow_run_id", "example_data")
# Demo keys that are not content.
DEMO_MARKS = ("augmented", "reasoning", "rationale")


def files_with_breaks(spark: SparkSession, path: str) -> list[str]:
    """The CSV files whose cells may hold line breaks; of all others it is proved that none does.

    A cell with a break leaves a quote open at the end of its line, so the line has an odd number of
    quotes.  Lines are counted by many tasks; a name a file comes to the driver, which lists them
    anyway.  A lone carriage return also counts as a break.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lone = F.contains(F.rtrim("value", F.lit("\r")), F.lit("\r"))
    odd = lines.filter((quotes % 2 == 1) | lone)
    return [r[0] for r in odd.select("_metadata.file_path").distinct().collect()]


def read_csv(
    spark: SparkSession, path: str, columns: Sequence[str], multi_line: bool | None = None
) -> DataFrame:
    """A CSV dataset, all text.  The file's header must name ``columns``, in order.

    An explicit schema saves the inference pass, and text keeps values as written.  Cells may
    hold line breaks.  Files that have such cells (see ``files_with_breaks``) are read by one task
    each, all others are split over many.  ``multi_line`` set to True or False leaves out the
    count, for files that are known to have such cells or not.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])

    def scan(whole: bool) -> DataFrame:
        return (
            spark.read.schema(schema)
            .option("header", True)
            .option("enforceSchema", False)
            .option("multiLine", whole)
            .option("escape", '"')
            # A quoted empty cell is an empty text; only a bare one is NULL.
            .option("nullValue", "\u0000")
            .csv(path)
        )

    if multi_line is not None:
        return scan(multi_line)
    broken = files_with_breaks(spark, path)
    if not broken:
        return scan(False)
    file = F.col("_metadata.file_path")
    whole, split = scan(True).filter(file.isin(broken)), scan(False).filter(~file.isin(broken))
    return whole.select(*columns).unionByName(split.select(*columns))


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """The column names of a CSV dataset, for the header contracts."""
    return spark.read.option("header", True).option("multiLine", True).option(
        "escape", '"'
    ).csv(path).columns


def read_prompts(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Prompt documents, one row each, with defaults for missing keys and the file name."""
    schema = T.StructType(
        [T.StructField(n, T.ArrayType(T.StringType())) for n in PROMPT_LISTS]
        + [T.StructField(n, T.StringType()) for n in PROMPT_TEXTS]
    )
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    none = F.array().cast("array<string>")

    def names(*options: str) -> Column:
        return F.coalesce(*[F.col(o) for o in options], none).alias(options[0])

    def text(name: str, default: str = "") -> Column:
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    return raw.select(
        F.col("_metadata.file_name").alias("file_name"),
        names("input_fields"),
        names("input_descriptions", "input_descs"),
        names("output_fields"),
        names("output_descriptions", "output_descs"),
        text("dspy_module", "Predict"),
        text("llm_model", "N/A"),
        text("teacher_model", "N/A"),
        text("optimizer", "N/A"),
        text("instructions"),
        F.coalesce(
            F.nullif(F.col("signature"), F.lit("")),
            F.concat(
                F.array_join(F.coalesce("input_fields", none), ", "),
                F.lit(" -> "),
                F.array_join(F.coalesce("output_fields", none), ", "),
            ),
        ).alias("signature"),
        text("evaluation_score", "N/A"),
        text("optimized_prompt"),
        "human_readable_id",
        F.col("mlflow_run_id").alias("run_id"),
    )


def demo_struct(demo: Column) -> Column:
    """A demo as read (a text map) to content fields, flag and reasoning."""
    return F.struct(
        F.map_filter(demo, lambda k, _: ~k.isin(*DEMO_MARKS)).alias("fields"),
        F.coalesce(demo["augmented"] == "true", F.lit(False)).alias("augmented"),
        F.coalesce(demo["reasoning"], demo["rationale"]).alias("reasoning"),
    )


def read_programs(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Compiled programs, one row per file (or line), with the demos of all their modules.

    The modules of a program are its top-level keys, whatever they are called.
    """
    if whole_files:
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.read.text(path)
    modules = F.from_json(F.col("value"), MAP_TYPE)
    demos = F.flatten(
        F.transform(
            F.map_values(modules),
            lambda m: F.coalesce(
                F.from_json(m, f"struct<demos:array<{MAP_TYPE}>>")["demos"],
                F.array().cast(f"array<{MAP_TYPE}>"),
            ),
        )
    )
    return text.select(
        F.col("_metadata.file_name").alias("file_name"),
        F.transform(demos, demo_struct).alias("demos"),
        F.col("value").alias("_document"),
    )


# Folder names cannot be empty: a mark stands before the names that need it.
FOLDER_MARK = "~"


def folder_of_model(name: Column) -> Column:
    marked = (name == "") | F.startswith(name, F.lit(FOLDER_MARK))
    return F.when(marked, F.concat(F.lit(FOLDER_MARK), name)).otherwise(name)


def model_of_folder(folder: Column) -> Column:
    marked = F.startswith(folder, F.lit(FOLDER_MARK))
    return F.when(marked, F.substring(folder, 2, 1 << 30)).otherwise(folder)


def read_traces(
    spark: SparkSession,
    path: str,
    model_name: str | None = None,
    start: datetime | None = None,
    end: datetime | None = None,
) -> DataFrame:
    """A trace table foldered by model and day; the filters skip whole folders.

    Whole days are read; ``rated_traces`` cuts to the moment.
    """
    # The folder names are read as they are: no guess turns model 007 into a number.
    stored = spark.read.parquet(path).schema
    kinds = {"model_name": T.StringType(), "date": T.DateType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in stored])
    traces = spark.read.schema(schema).parquet(path)
    traces = traces.withColumn("model_name", model_of_folder(F.col("model_name")))
    if model_name is not None:
        traces = traces.filter(F.col("model_name") == model_name)
    if start:
        traces = traces.filter(F.col("date") >= F.lit(utc(start).date()))
    if end:
        traces = traces.filter(F.col("date") <= F.lit(utc(end).date()))
    return traces
