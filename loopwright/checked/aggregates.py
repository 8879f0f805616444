"""A and M: aggregates, scores and evaluation tables."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.functions import metrics
from loopwright.operators import catalogue, demos, evaluation, feedback, registry, serving

EXACT = "CASE WHEN gold_flag = pred_flag AND gold_status = pred_status THEN 1 ELSE 0 END"


def scored(t):
    score = metrics.exact_match(
        [F.col("gold_flag"), F.col("gold_status")], [F.col("pred_flag"), F.col("pred_status")]
    )
    return t.predictions.withColumn("score", score)


SCORES = f"""
    SELECT candidate_id, round(100 * avg({EXACT}), 2) AS percent, count(*) AS examples
    FROM predictions GROUP BY candidate_id"""


@query("A1_dataset_score", uses=["predictions"], sql=SCORES)
def dataset_score(t):
    return evaluation.dataset_score(scored(t), "candidate_id")


@query(
    "A2_evaluation_summary",
    uses=["predictions"],
    sql=f"""
    SELECT status AS metric_name, round(avg({EXACT}), 6) AS eval_score_mean,
           round(stddev_samp({EXACT}), 6) AS eval_score_std, count(*) AS eval_example_count
    FROM predictions GROUP BY status""",
)
def evaluation_summary(t):
    rows = scored(t).withColumnRenamed("status", "metric_name")
    return evaluation.evaluation_summary(evaluation.evaluation_table(rows), "metric_name")


@query(
    "A3_compile_summary",
    uses=["predictions"],
    sql=f"""
    WITH phases AS (
        SELECT 'run-' || candidate_id AS run_id,
               CASE WHEN judge_score = '0' THEN 'baseline' WHEN judge_score = '1' THEN 'evaluation'
                    ELSE 'train' END AS phase, {EXACT} AS score FROM predictions),
    sums AS (
        SELECT run_id, round(avg(score) FILTER (phase = 'baseline'), 6) AS baseline_score,
               round(avg(score) FILTER (phase = 'evaluation'), 6) AS evaluation_score,
               count(*) FILTER (phase = 'train') AS trainset_size,
               count(*) FILTER (phase = 'evaluation') AS devset_size
        FROM phases GROUP BY run_id)
    SELECT *, round(evaluation_score - baseline_score, 6) AS score_improvement FROM sums""",
)
def compile_summary(t):
    judge = F.col("judge_score")
    rows = scored(t).select(
        F.concat(F.lit("run-"), F.col("candidate_id").cast("string")).alias("run_id"),
        F.when(judge == "0", "baseline").when(judge == "1", "evaluation").otherwise("train").alias(
            "phase"
        ),
        "score",
    )
    return evaluation.compile_summary(rows)


@query(
    "A4_batch_stats",
    uses=["predictions"],
    sql="""
    WITH sums AS (
        SELECT candidate_id, count(*) AS total_rows,
               count(*) FILTER (status = 'success') AS success_count,
               round(sum(latency), 4) AS total_latency
        FROM predictions GROUP BY candidate_id)
    SELECT candidate_id, total_rows, success_count, total_rows - success_count AS error_count,
           total_latency, round(total_latency / total_rows, 6) AS avg_latency_per_row,
           round(success_count / total_rows, 6) AS success_rate
    FROM sums""",
)
def batch_stats(t):
    return evaluation.batch_stats(
        t.predictions.withColumnRenamed("status", "_status"), "latency", "candidate_id"
    )


FEEDBACK_SUMS = """
           count(*) AS total, count(*) FILTER (rating = 'thumbs_up') AS thumbs_up,
           count(*) FILTER (rating = 'thumbs_down') AS thumbs_down,
           count(*) FILTER (corrected_output NOT IN ('', '{}')) AS with_corrections,
           count(*) FILTER (comment <> '') AS with_comments,
           round(count(*) FILTER (rating = 'thumbs_up') / count(*), 6) AS thumbs_up_rate"""


@query(
    "A5_feedback_stats",
    uses=["feedback"],
    sql=f"SELECT {FEEDBACK_SUMS} FROM feedback",
)
def feedback_stats(t):
    return feedback.feedback_stats(t.feedback)


@query(
    "A5_feedback_stats_per_model",
    uses=["feedback", "traces"],
    sql=f"""
    SELECT t.model_name, {FEEDBACK_SUMS}
    FROM feedback f JOIN traces t ON f.trace_id = t.trace_id GROUP BY t.model_name""",
)
def feedback_stats_per_model(t):
    rated = t.feedback.join(t.traces.select("trace_id", "model_name"), "trace_id")
    return feedback.feedback_stats(rated, "model_name")


@query(
    "A6_serving_metrics",
    uses=["requests"],
    sql="""
    SELECT count(*) AS total_requests, count(*) FILTER (is_error) AS total_errors,
           round(avg(latency_ms), 6) AS average_latency_ms FROM requests""",
)
def serving_metrics(t):
    return serving.serving_metrics(t.requests)


@query(
    "A6_models_in_use",
    uses=["requests"],
    sql="""
    SELECT model_name, epoch_us(min(ts)) AS first_seen_us, count(*) AS requests
    FROM requests GROUP BY model_name""",
)
def models_in_use(t):
    found = serving.models_by_first_use(t.requests)
    return found.select("model_name", F.unix_micros("first_seen").alias("first_seen_us"), "requests")


@query(
    "A7_demo_stats",
    uses=["demos"],
    sql="""
    SELECT program_id, CAST(count(*) AS INTEGER) AS total,
           CAST(count(*) FILTER (augmented) AS INTEGER) AS augmented,
           CAST(count(*) FILTER (NOT augmented) AS INTEGER) AS labeled,
           'answer,question' AS fields, bool_or(reasoning IS NOT NULL) AS has_reasoning
    FROM demos GROUP BY program_id""",
)
def demo_stats(t):
    stats = demos.demo_stats(t.programs)
    return stats.withColumn("fields", F.array_join("fields", ","))


@query(
    "A9_best_candidate",
    uses=["predictions"],
    sql=f"""
    SELECT candidate_id, percent FROM ({SCORES})
    ORDER BY percent DESC, candidate_id LIMIT 1""",
)
def best_candidate(t):
    return evaluation.best_candidate(evaluation.dataset_score(scored(t), "candidate_id"))


@query(
    "A10_distinct_signatures",
    uses=["prompts"],
    sql="""
    SELECT DISTINCT replace(input_fields, ',', ', ') || ' -> ' || output_fields AS signature
    FROM prompts""",
)
def distinct_signatures(t):
    return catalogue.signatures(catalogue.with_signature(t.prompts))


def _cell(name: str) -> str:
    text = f"CAST({name} AS VARCHAR)"
    return f"coalesce(length({text}) || ':' || {text}, '~')"


def fingerprint_sql(view: str, columns: list[str]) -> str:
    cells = " || ".join(_cell(c) for c in sorted(columns))
    lanes = ", ".join(
        f"coalesce(sum(CAST('0x' || substring(h, {1 + 15 * i}, 15) AS BIGINT)), 0) AS lane{i}"
        for i in range(4)
    )
    return f"""
    SELECT row_count, sha256(concat_ws('|', row_count, lane0, lane1, lane2, lane3)) AS digest
    FROM (SELECT count(*) AS row_count, {lanes}
          FROM (SELECT sha256({cells}) AS h FROM {view}))"""


@query(
    "A11_dataset_profile",
    uses=["dataset_original"],
    sql=f"""
    SELECT row_count, 'original_lang,original_text,answer,n_chars' AS column_names,
           digest AS file_hash
    FROM ({fingerprint_sql('dataset_original', ['original_lang', 'original_text', 'answer', 'n_chars'])})""",
)
def dataset_profile(t):
    return evaluation.dataset_profile(
        t.dataset_original, ["original_lang", "original_text", "answer", "n_chars"]
    )


@query(
    "A12_training_readiness",
    sql="""
    SELECT source, row_count, optimizer, minimum, recommended, row_count >= 2 AS can_compile,
           row_count >= 8 AS enough_for_demos, row_count >= minimum AS meets_minimum,
           row_count >= recommended AS meets_recommended
    FROM (SELECT source, count(*) AS row_count FROM documents GROUP BY source),
         (VALUES ('BootstrapFewShot', 10, 50), ('BootstrapFewShotWithRandomSearch', 50, 100),
                 ('COPRO', 20, 100), ('MIPROv2', 100, 200)) needs(optimizer, minimum, recommended)""",
)
def training_readiness(t):
    return evaluation.readiness(t.table("documents"), "source")


@query(
    "A13_latest_version",
    uses=["model_versions"],
    sql="""
    SELECT model_name, arg_max(version, CAST(version AS BIGINT)) AS version,
           arg_max(run_id, CAST(version AS BIGINT)) AS run_id,
           arg_max(stage, CAST(version AS BIGINT)) AS stage
    FROM model_versions GROUP BY model_name""",
)
def latest_version(t):
    rows = t.model_versions.select("model_name", "version", "run_id", "stage")
    return registry.latest_versions(rows)


@query(
    "M1_exact_match",
    uses=["predictions"],
    sql=f"SELECT example_id, {EXACT} AS score FROM predictions",
)
def exact_match(t):
    return scored(t).select("example_id", "score")


@query(
    "M2_cosine_similarity",
    uses=["embedding_pairs"],
    sql="""
    SELECT example_id,
           round(list_cosine_similarity(CAST(gold_vec AS DOUBLE[]), CAST(pred_vec AS DOUBLE[])), 6)
             AS score,
           round(list_cosine_similarity(
               list_concat(CAST(gold_vec AS DOUBLE[]), CAST(pred_vec AS DOUBLE[])),
               list_concat(CAST(pred_vec AS DOUBLE[]), CAST(pred_vec AS DOUBLE[]))), 6) AS two_fields
    FROM embedding_pairs""",
)
def cosine_similarity(t):
    gold, pred = F.col("gold_vec"), F.col("pred_vec")
    return t.embedding_pairs.select(
        "example_id",
        F.round(metrics.cosine_similarity([gold], [pred]), 6).alias("score"),
        F.round(metrics.cosine_similarity([gold, pred], [pred, pred]), 6).alias("two_fields"),
    )


@query(
    "M3_judge_score",
    uses=["predictions"],
    sql="""
    SELECT example_id, gold_flag AS flag, pred_status AS verdict, '' AS style,
           CASE WHEN judge_score IN ('0', '1') THEN CAST(judge_score AS DOUBLE) ELSE 0.0 END
             AS score
    FROM predictions""",
)
def judge_score(t):
    gold = {"flag": F.col("gold_flag")}
    pred = {"flag": F.col("pred_flag"), "verdict": F.col("pred_status")}
    judge = metrics.make_metric(metrics.JUDGE, judge_outputs=["judge_score"])
    return t.predictions.select(
        "example_id",
        *metrics.judge_input(["flag", "verdict", "style"], gold, pred),
        judge({"judge_score": F.col("judge_score")}).alias("score"),
    )


@query(
    "M5_evaluation_table",
    uses=["predictions"],
    sql="""
    SELECT example_id, '' AS input, coalesce(gold_flag, '') AS expected_output,
           coalesce(pred_flag, '') AS actual_output,
           coalesce(TRY_CAST(nullif(nullif(judge_score, 'n/a'), 'NaN') AS DOUBLE), 0.0) AS score,
           'unknown' AS metric_name
    FROM predictions""",
)
def evaluation_table(t):
    rows = t.predictions.select(
        "example_id",
        F.col("gold_flag").alias("expected_output"),
        F.col("pred_flag").alias("actual_output"),
        F.col("judge_score").alias("score"),
    )
    return evaluation.evaluation_table(rows)
