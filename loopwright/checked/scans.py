"""S: scans and sinks, written and read back."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.operators.evaluation import evaluation_table
from loopwright.operators.feedback import rated_traces, trace_rows, training_records
from loopwright.session import new_shared_path
from loopwright.sources import readers, writers
from loopwright.views import EPOCH_MS

FIRST_RATING = """
    first_rated AS (
        SELECT trace_id,
               arg_min(rating = 'thumbs_up', (ts_ms, feedback_id)) AS up,
               arg_min(corrected_output, (ts_ms, feedback_id))
                 FILTER (corrected_output NOT IN ('', '{}')) AS corrected,
               arg_min(comment, (ts_ms, feedback_id)) FILTER (comment <> '') AS comment
        FROM feedback GROUP BY trace_id)"""

RECORDS = f"""
    WITH {FIRST_RATING},
    plain AS (
        SELECT t.trace_id, t.timestamp_ms, t.inputs,
               CASE WHEN json_valid(t.outputs) THEN t.outputs ELSE '{{}}' END AS outputs,
               CASE WHEN r.corrected LIKE '"%' THEN json_extract_string(r.corrected, '$')
                    ELSE r.corrected END AS corrected
        FROM traces t JOIN first_rated r ON t.trace_id = r.trace_id
        WHERE r.up),
    records AS (
        SELECT trace_id,
               CASE WHEN corrected IS NOT NULL
                    THEN coalesce(corrected->>'lang', inputs->>'lang')
                    ELSE coalesce(outputs->>'lang', inputs->>'lang') END AS lang,
               CASE WHEN corrected IS NOT NULL THEN corrected->>'n_chars'
                    ELSE outputs->>'n_chars' END AS n_chars,
               inputs->>'source' AS source
        FROM plain)"""

RECORD_COLUMNS = ("lang", "n_chars", "source", "_rating", "_trace_id")


def up_rated_records(t):
    rows = trace_rows(rated_traces(t.traces, t.feedback, limit=None))
    return training_records(rows)


@query(
    "S1_csv_scan",
    uses=["qa_examples"],
    sql="SELECT CAST(example_id AS VARCHAR) AS example_id, question, answer FROM qa_examples",
)
def csv_scan(t):
    path = new_shared_path(t.spark, "s1")
    columns = ["example_id", "question", "answer"]
    writers.write_csv(t.qa_examples.select(*columns), path)
    return readers.read_csv(t.spark, path, columns)


@query(
    "S2_prompt_scan",
    uses=["prompts"],
    sql="""
    SELECT replace(file_name, '.json', '') AS human_readable_id,
           replace(input_fields, ',', ', ') || ' -> ' || output_fields AS signature,
           evaluation_score, 'N/A' AS teacher_model, 'about ' || output_fields AS descs,
           llm_model
    FROM prompts""",
)
def prompt_scan(t):
    path = new_shared_path(t.spark, "s2")
    descs = F.array(F.concat(F.lit("about "), F.col("output_fields")[0]))
    older = F.startswith(F.col("run_id"), F.lit("run-1"))
    documents = t.prompts.select(
        F.replace(F.col("file_name"), F.lit(".json"), F.lit("")).alias("human_readable_id"),
        "input_fields",
        "output_fields",
        # Both spellings of the key occur.
        F.when(older, descs).alias("output_descs"),
        F.when(~F.coalesce(older, F.lit(False)), descs).alias("output_descriptions"),
        F.nullif(F.col("evaluation_score"), F.lit("N/A")).alias("evaluation_score"),
        "llm_model",
    )
    documents.write.json(path)
    return readers.read_prompts(t.spark, path, multi_line=False).select(
        "human_readable_id",
        "signature",
        "evaluation_score",
        "teacher_model",
        F.array_join("output_descriptions", ",").alias("descs"),
        "llm_model",
    )


@query(
    "S3_program_scan",
    uses=["demos"],
    sql="""
    SELECT CAST(program_id AS VARCHAR) AS program_id, question, answer, augmented, reasoning
    FROM demos""",
)
def program_scan(t):
    path = new_shared_path(t.spark, "s3")
    demo = lambda d: F.struct(
        F.when(d["augmented"], True).alias("augmented"),
        d["fields"]["question"].alias("question"),
        d["fields"]["answer"].alias("answer"),
        d["reasoning"].alias("rationale"),
    )
    module = F.to_json(F.struct(F.transform("demos", demo).alias("demos")))
    key = F.when(F.col("program_id") % 2 == 0, "cot.predict").otherwise("predictor")
    line = F.concat(
        F.lit('{"program_id":'), F.col("program_id").cast("string"), F.lit(',"'), key, F.lit('":'),
        module, F.lit("}"),
    )
    t.programs.select(line.alias("value")).write.text(path)
    programs = readers.read_programs(t.spark, path, whole_files=False)
    return programs.select(
        F.get_json_object("_document", "$.program_id").alias("program_id"),
        F.explode("demos").alias("demo"),
    ).select(
        "program_id",
        F.col("demo.fields")["question"].alias("question"),
        F.col("demo.fields")["answer"].alias("answer"),
        "demo.augmented",
        "demo.reasoning",
    )


@query(
    "S4_csv_sink",
    uses=["dataset_new"],
    sql="""
    SELECT CAST(ord AS VARCHAR) AS ord, answer, original_text, original_lang, batch
    FROM dataset_new""",
)
def csv_sink(t):
    path = new_shared_path(t.spark, "s4")
    writers.write_csv(t.dataset_new, path)
    return readers.read_csv(t.spark, path, t.dataset_new.columns)


@query(
    "S5_training_csv_sink",
    uses=["traces", "feedback"],
    sql=RECORDS
    + """
    SELECT lang, n_chars, source, 'thumbs_up' AS _rating, trace_id AS _trace_id FROM records""",
)
def training_csv_sink(t):
    path = new_shared_path(t.spark, "s5")
    writers.export_records(up_rated_records(t), path, "csv")
    return readers.read_csv(t.spark, path, RECORD_COLUMNS)


@query(
    "S6_training_json_sink",
    uses=["traces", "feedback"],
    sql=RECORDS
    + """
    SELECT lang, n_chars, source, 'thumbs_up' AS _rating, trace_id AS _trace_id FROM records""",
)
def training_json_sink(t):
    path = new_shared_path(t.spark, "s6")
    writers.export_records(up_rated_records(t), path, "json")
    return t.spark.read.schema(", ".join(f"{c} string" for c in RECORD_COLUMNS)).json(path)


@query(
    "S7_chunked_export",
    uses=["traces", "feedback"],
    sql=RECORDS
    + """
    SELECT count(*) AS total_records, count(*) AS rows_read, true AS chunks_fit FROM records""",
)
def chunked_export(t):
    path = new_shared_path(t.spark, "s7")
    counted = writers.export_records(
        up_rated_records(t), path, "csv", fields=RECORD_COLUMNS, chunk_rows=100
    )
    files = (
        readers.read_csv(t.spark, path, RECORD_COLUMNS)
        .groupBy(F.col("_metadata.file_name").alias("file_name"))
        .count()
    )
    return files.agg(
        F.lit(counted.get["total_records"]).cast("long").alias("total_records"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows_read"),
        F.coalesce(F.max("count") <= 100, F.lit(True)).alias("chunks_fit"),
    )


@query(
    "S9_trace_scan",
    uses=["traces"],
    sql=f"""
    SELECT trace_id, model_name, timestamp_ms, inputs, outputs FROM traces
    WHERE model_name = 'src1' AND timestamp_ms < {EPOCH_MS} + 86400000""",
)
def trace_scan(t):
    from datetime import datetime

    path = new_shared_path(t.spark, "s9")
    writers.write_traces(t.traces, path)
    found = readers.read_traces(t.spark, path, "src1", datetime(2024, 1, 1), datetime(2024, 1, 1))
    return found.select("trace_id", "model_name", "timestamp_ms", "inputs", "outputs")


@query(
    "S9_model_folders",
    uses=["traces"],
    sql="""
    SELECT trace_id, CASE source WHEN 'src1' THEN '007' WHEN 'src2' THEN '12' WHEN 'src3' THEN ''
                     WHEN 'src4' THEN '~x' WHEN 'src5' THEN NULL ELSE source END AS model_name
    FROM (SELECT *, model_name AS source FROM traces)""",
)
def model_folders(t):
    path = new_shared_path(t.spark, "s9")
    names = {"src1": "007", "src2": "12", "src3": "", "src4": "~x"}
    name = F.col("model_name")
    for source, shown in names.items():
        name = F.when(F.col("model_name") == source, shown).otherwise(name)
    name = F.when(F.col("model_name") == "src5", F.lit(None)).otherwise(name)
    writers.write_traces(t.traces.withColumn("model_name", name), path)
    return readers.read_traces(t.spark, path).select("trace_id", "model_name")


@query(
    "S8_empty_export",
    uses=["feedback"],
    sql="SELECT 'inputs' AS name, count(*) FILTER (rating = 'nobody') AS rows FROM feedback"
    " UNION ALL SELECT 'outputs', count(*) FILTER (rating = 'nobody') FROM feedback",
)
def empty_export(t):
    path = new_shared_path(t.spark, "s8")
    nobody = t.feedback.filter(F.col("rating") == "nobody")
    record = F.create_map(F.lit("n"), "comment").cast("map<string,string>").alias("record")
    writers.export_records(nobody.select(record), path, "csv")
    header = readers.csv_header(t.spark, path)
    rows = readers.read_csv(t.spark, path, header).agg(F.count("*").alias("rows"))
    return rows.select(F.explode(F.lit(header)).alias("name"), "rows")


@query(
    "S10_log_append",
    uses=["predictions"],
    sql="""
    SELECT run_date, metric_name, count(*) AS rows_logged, round(sum(score), 4) AS score_sum
    FROM (SELECT '2024-01-01' AS run_date, 'Exact Match' AS metric_name,
                 coalesce(CAST(gold_flag = pred_flag AS DOUBLE), 0) AS score FROM predictions
          UNION ALL
          SELECT '2024-01-02', 'status', coalesce(CAST(gold_status = pred_status AS DOUBLE), 0)
          FROM predictions)
    GROUP BY run_date, metric_name""",
)
def log_append(t):
    path = new_shared_path(t.spark, "s10")
    for day, metric, gold, pred in (
        ("2024-01-01", "Exact Match", "gold_flag", "pred_flag"),
        ("2024-01-02", "status", "gold_status", "pred_status"),
    ):
        rows = t.predictions.select(
            "example_id",
            F.col(gold).alias("expected_output"),
            F.col(pred).alias("actual_output"),
            (F.col(gold) == F.col(pred)).cast("double").alias("score"),
        )
        writers.append_log(evaluation_table(rows, metric), path, day)
    return (
        t.spark.read.parquet(path)
        .groupBy(F.col("run_date").cast("string").alias("run_date"), "metric_name")
        .agg(
            F.count(F.lit(1)).alias("rows_logged"),
            F.round(F.sum("score"), 4).alias("score_sum"),
        )
    )
