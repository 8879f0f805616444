"""J: joins and lookups."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.scans import FIRST_RATING
from loopwright.functions.metrics import exact_match
from loopwright.operators import catalogue, demos, evaluation, feedback, registry


@query(
    "J1_programs_with_prompts",
    uses=["prompts", "program_files"],
    sql="""
    SELECT replace(p.file_name, '.json', '') AS id,
           replace(input_fields, ',', ', ') || ' -> ' || output_fields AS signature
    FROM prompts p JOIN program_files f ON p.file_name = f.file_name""",
)
def programs_with_prompts(t):
    return catalogue.list_programs(t.program_files, t.prompts).select("id", "signature")


@query(
    "J2_registered_flag",
    uses=["prompts", "model_versions"],
    sql="""
    SELECT file_name, run_id IS NOT NULL AND run_id IN (
             SELECT arg_max(run_id, CAST(version AS BIGINT)) FROM model_versions
             GROUP BY model_name, stage) AS registered
    FROM prompts""",
)
def registered_flag(t):
    latest = registry.latest_versions(t.model_versions, "stage")
    return catalogue.with_registered_flag(t.prompts, latest).select("file_name", "registered")


@query(
    "J3_version_scores",
    uses=["model_versions", "runs"],
    sql="""
    SELECT v.model_name, v.version, r.evaluation_score
    FROM model_versions v LEFT JOIN runs r ON v.run_id = r.run_id""",
)
def version_scores(t):
    return registry.with_run_score(t.model_versions, t.runs).select(
        "model_name", "version", "evaluation_score"
    )


RUN_PARAMS = """
    SELECT 'run-' || p_partkey AS run_id,
           CASE WHEN p_size % 3 = 0 THEN 'named-' || p_partkey END AS human_readable_id,
           'topic' AS input_fields, CASE WHEN p_size % 2 = 0 THEN 'gpt-4o' END AS llm_model,
           CAST(p_size AS DOUBLE) AS score
    FROM part"""


@query(
    "J4_prompt_of_run",
    uses=["prompts"],
    sql=f"""
    WITH run_rows AS ({RUN_PARAMS}),
    programs AS (SELECT DISTINCT 'run-' || l_partkey AS run_id FROM lineitem)
    SELECT r.run_id,
           CASE WHEN p.run_id IS NOT NULL THEN replace(p.file_name, '.json', '')
                ELSE coalesce(r.human_readable_id, 'MLflow-' || substring(r.run_id, 1, 8)) END
             AS human_readable_id,
           CASE WHEN p.run_id IS NOT NULL THEN p.input_fields ELSE r.input_fields END
             AS input_fields,
           CASE WHEN p.run_id IS NOT NULL THEN p.llm_model ELSE coalesce(r.llm_model, 'N/A') END
             AS llm_model,
           CASE WHEN p.run_id IS NOT NULL THEN p.optimizer ELSE 'N/A' END AS optimizer,
           CASE WHEN p.run_id IS NOT NULL THEN '' ELSE 'of ' || r.run_id END AS instructions,
           CASE WHEN p.run_id IS NOT NULL THEN p.evaluation_score
                ELSE CAST(r.score AS VARCHAR) END AS evaluation_score,
           p.run_id IS NULL AS extracted_from_program
    FROM run_rows r LEFT JOIN prompts p ON r.run_id = p.run_id
    LEFT JOIN programs g ON r.run_id = g.run_id
    WHERE p.run_id IS NOT NULL OR g.run_id IS NOT NULL""",
)
def prompt_of_run(t):
    part, size = F.col("p_partkey").cast("string"), F.col("p_size")
    params = F.create_map(
        F.lit("human_readable_id"),
        F.when(size % 3 == 0, F.concat(F.lit("named-"), part)),
        F.lit("input_fields"),
        F.lit("topic"),
        F.lit("llm_model"),
        F.when(size % 2 == 0, "gpt-4o"),
    )
    runs = t.table("part").select(
        F.concat(F.lit("run-"), part).alias("run_id"),
        F.map_filter(params, lambda _, v: v.isNotNull()).alias("params"),
        F.create_map(F.lit("evaluation_score"), size.cast("double")).alias("metrics"),
    )
    own = t.prompts.filter(F.col("run_id").isNotNull()).select(
        "run_id",
        F.replace(F.col("file_name"), F.lit(".json"), F.lit("")).alias("human_readable_id"),
        F.array_join("input_fields", ",").alias("input_fields"),
        F.array_join("output_fields", ",").alias("output_fields"),
        "dspy_module",
        "llm_model",
        F.lit("N/A").alias("teacher_model"),
        "optimizer",
        F.lit("").alias("instructions"),
        "evaluation_score",
    )
    key = F.replace(F.replace(F.col("file_name"), F.lit(".json"), F.lit("")), F.lit("p"), F.lit("run-"))
    programs = t.program_files.select(
        key.alias("run_id"), F.concat(F.lit("of "), key).alias("instructions")
    )
    return registry.prompt_of_run(runs, own, programs).drop(
        "output_fields", "dspy_module", "teacher_model"
    )


@query(
    "J5_traces_with_feedback",
    uses=["traces", "feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id, t.model_name,
           CASE WHEN r.trace_id IS NOT NULL
                THEN CASE WHEN r.up THEN 'true' ELSE 'false' END END AS user_rating,
           r.corrected AS corrected_output, r.comment AS user_comment
    FROM traces t LEFT JOIN first_rated r ON t.trace_id = r.trace_id""",
)
def traces_with_feedback(t):
    return feedback.traces_with_feedback(t.traces, t.feedback).select(
        "trace_id", "model_name", "user_rating", "corrected_output", "user_comment"
    )


@query(
    "J6_accepted_feedback",
    uses=["traces", "feedback"],
    sql="""
    SELECT feedback_id, trace_id, rating FROM feedback
    WHERE starts_with(trace_id, 'degraded-') OR trace_id IN (SELECT trace_id FROM traces)""",
)
def accepted_feedback(t):
    found = feedback.accept_feedback(t.feedback, t.traces)
    return found.select("feedback_id", "trace_id", "rating")


@query(
    "J6_rejected_feedback",
    uses=["traces", "feedback"],
    sql="""
    SELECT feedback_id, trace_id, rating FROM feedback
    WHERE NOT starts_with(trace_id, 'degraded-')
      AND trace_id NOT IN (SELECT trace_id FROM traces)""",
)
def rejected_feedback(t):
    found = feedback.reject_feedback(t.feedback, t.traces)
    return found.select("feedback_id", "trace_id", "rating")


# The stage log replayed event by event: an alias is held by its last setter, unless that
# version was archived later.
ALIAS_HOLDERS = """
    SELECT s.model_name, s.alias, s.version
    FROM (SELECT model_name, CASE stage WHEN 'Production' THEN 'champion' ELSE 'challenger' END
                   AS alias, version, ts, event_id,
                 row_number() OVER (PARTITION BY model_name, stage ORDER BY ts DESC, event_id DESC)
                   AS place
          FROM alias_events WHERE stage IN ('Production', 'Staging')) s
    WHERE s.place = 1 AND NOT EXISTS (
        SELECT 1 FROM alias_events a
        WHERE a.stage = 'Archived' AND a.model_name = s.model_name AND a.version = s.version
          AND (a.ts > s.ts OR (a.ts = s.ts AND a.event_id > s.event_id)))"""


def version_requests(t):
    """Requests for a model by version, alias, stage or nothing, one per order."""
    key, how = F.col("o_orderkey"), F.substring("o_orderpriority", 1, 1)
    return t.table("orders").select(
        key.alias("request_id"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 25).cast("string")).alias("model_name"),
        F.when(how.isin("1"), (key % 3 + 1).cast("string")).alias("version"),
        F.when(how.isin("1", "2"), "champion").when(how == "3", "challenger").alias("alias"),
        F.when(how.isin("3", "4"), "Archived").alias("stage"),
    )


VERSION_REQUESTS = """
    SELECT o_orderkey AS request_id, 'm' || o_custkey % 25 AS model_name,
           CASE WHEN left(o_orderpriority, 1) = '1' THEN CAST(o_orderkey % 3 + 1 AS VARCHAR) END
             AS version,
           CASE WHEN left(o_orderpriority, 1) IN ('1', '2') THEN 'champion'
                WHEN left(o_orderpriority, 1) = '3' THEN 'challenger' END AS alias,
           CASE WHEN left(o_orderpriority, 1) IN ('3', '4') THEN 'Archived' END AS stage
    FROM orders"""

RESOLVED = f"""
    asked AS ({VERSION_REQUESTS}), holders AS ({ALIAS_HOLDERS}),
    stages AS (SELECT model_name, stage, CAST(max(CAST(version AS BIGINT)) AS VARCHAR) AS version
               FROM alias_events GROUP BY ALL),
    newest AS (SELECT model_name, CAST(max(CAST(version AS BIGINT)) AS VARCHAR) AS version
               FROM alias_events GROUP BY ALL),
    resolved AS (
        SELECT q.request_id, q.model_name,
               CASE WHEN q.version IS NOT NULL THEN q.version
                    WHEN q.alias IS NOT NULL THEN h.version
                    WHEN q.stage IS NOT NULL THEN s.version
                    ELSE n.version END AS resolved_version
        FROM asked q LEFT JOIN holders h ON q.model_name = h.model_name AND q.alias = h.alias
        LEFT JOIN stages s ON q.model_name = s.model_name AND q.stage = s.stage
        LEFT JOIN newest n ON q.model_name = n.model_name)"""


def resolved_requests(t):
    holders = registry.current_aliases(t.alias_events)
    return registry.resolve_versions(version_requests(t), t.alias_events, holders)


@query(
    "J7_version_lookup",
    uses=["alias_events"],
    sql=f"WITH {RESOLVED} SELECT request_id, model_name, resolved_version FROM resolved",
)
def version_lookup(t):
    return resolved_requests(t).select("request_id", "model_name", "resolved_version")


@query(
    "J8_gold_prediction",
    uses=["predictions"],
    sql="""
    SELECT example_id, gold_flag, pred_flag,
           CASE WHEN gold_flag = pred_flag AND gold_status = pred_status THEN 1 ELSE 0 END AS score
    FROM predictions""",
)
def gold_prediction(t):
    gold = t.predictions.select("example_id", "gold_flag", "gold_status")
    answered = t.predictions.select("example_id", "pred_flag", "pred_status")
    pairs = evaluation.pair_predictions(gold, answered, "example_id")
    score = exact_match(
        [F.col("gold_flag"), F.col("gold_status")], [F.col("pred_flag"), F.col("pred_status")]
    )
    return pairs.select("example_id", "gold_flag", "pred_flag", score.alias("score"))


@query(
    "J9_candidate_fan_out",
    uses=["qa_examples"],
    sql="""
    SELECT r.r_regionkey AS candidate_id, r.r_name AS instructions, q.example_id,
           CASE WHEN (length(q.question) + r.r_regionkey) % 3 = 0 THEN 1 ELSE 0 END AS score
    FROM qa_examples q, region r""",
)
def candidate_fan_out(t):
    candidates = t.table("region").select(
        F.col("r_regionkey").alias("candidate_id"), F.col("r_name").alias("instructions")
    )
    rows = evaluation.fan_out(t.qa_examples, candidates, candidates.count())
    right = (F.length("question") + F.col("candidate_id")) % 3 == 0
    predicted = rows.withColumn("pred", F.when(right, F.col("answer")))
    return predicted.select(
        "candidate_id",
        "instructions",
        "example_id",
        exact_match([F.col("answer")], [F.col("pred")]).alias("score"),
    )


PROGRAM_STATS = """
    SELECT program_id, CAST(count(*) AS INTEGER) AS total,
           CAST(count(*) FILTER (augmented) AS INTEGER) AS augmented,
           CAST(count(*) FILTER (NOT augmented) AS INTEGER) AS labeled,
           'answer, question' AS fields, bool_or(reasoning IS NOT NULL) AS has_reasoning
    FROM demos GROUP BY program_id"""


@query(
    "J10_program_comparison",
    uses=["demos"],
    sql=f"""
    WITH stats AS ({PROGRAM_STATS})
    SELECT a.program_id AS first_id, b.program_id AS second_id, a.total AS first_total,
           b.total AS second_total, a.augmented AS first_augmented,
           b.augmented AS second_augmented, a.labeled AS first_labeled,
           b.labeled AS second_labeled,
           CASE WHEN b.total > a.total THEN '+' ELSE '' END || (b.total - a.total) AS total_change,
           CASE WHEN b.augmented > a.augmented THEN '+' ELSE '' END
             || (b.augmented - a.augmented) AS augmented_change,
           CASE WHEN b.labeled > a.labeled THEN '+' ELSE '' END
             || (b.labeled - a.labeled) AS labeled_change,
           a.fields AS first_fields, b.fields AS second_fields,
           a.has_reasoning AS first_has_reasoning, b.has_reasoning AS second_has_reasoning
    FROM stats a JOIN stats b ON b.program_id = a.program_id + 1""",
)
def program_comparison(t):
    stats = demos.demo_stats(t.programs)
    pairs = stats.select(
        F.col("program_id").alias("first_id"), (F.col("program_id") + 1).alias("second_id")
    )
    return demos.compare_programs(stats, pairs)
