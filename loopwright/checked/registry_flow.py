"""R: the model registry and its runs."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.joins import ALIAS_HOLDERS, RESOLVED, resolved_requests
from loopwright.operators import catalogue, feedback, registry


@query(
    "R1_list_models",
    uses=["models", "model_versions", "runs"],
    sql="""
    SELECT m.model_name AS name, coalesce(v.version, '0') AS latest_version,
           coalesce(v.stage, 'None') AS current_stage, m.description, r.evaluation_score
    FROM models m
    LEFT JOIN (SELECT model_name, arg_max(version, CAST(version AS BIGINT)) AS version,
                      arg_max(stage, CAST(version AS BIGINT)) AS stage,
                      arg_max(run_id, CAST(version AS BIGINT)) AS run_id
               FROM model_versions GROUP BY model_name) v ON m.model_name = v.model_name
    LEFT JOIN runs r ON v.run_id = r.run_id""",
)
def list_models(t):
    return registry.list_models(t.models, t.model_versions, t.runs)


@query(
    "R2_list_versions",
    uses=["alias_events"],
    sql=f"""
    WITH holders AS ({ALIAS_HOLDERS}),
    versions AS (
        SELECT model_name, version, arg_max(stage, (ts, event_id)) AS stage,
               max(event_id) AS event_id, min(epoch_us(ts) // 1000) AS created
        FROM alias_events GROUP BY model_name, version)
    SELECT v.model_name, v.version, v.stage,
           coalesce((SELECT string_agg(alias, ',' ORDER BY alias) FROM holders h
                     WHERE h.model_name = v.model_name AND h.version = v.version), '') AS aliases,
           v.created AS created_ms, CAST(p.p_size AS DOUBLE) AS evaluation_score,
           'run-' || v.event_id AS run_id
    FROM versions v LEFT JOIN part p ON p.p_partkey = v.event_id""",
)
def list_versions(t):
    events = t.alias_events
    versions = events.groupBy("model_name", "version").agg(
        F.max_by("stage", F.struct("ts", "event_id")).alias("stage"),
        F.concat(F.lit("run-"), F.max("event_id").cast("string")).alias("run_id"),
        F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("creation_timestamp"),
    )
    listed = registry.list_versions(versions, t.runs, registry.current_aliases(events))
    return listed.withColumn("created_ms", F.unix_millis("created_at")).drop("created_at")


@query(
    "R2_staged_versions",
    uses=["model_versions", "runs"],
    sql="""
    SELECT v.model_name, v.version, v.stage, r.evaluation_score, v.run_id
    FROM model_versions v LEFT JOIN runs r ON v.run_id = r.run_id
    WHERE v.stage = 'Production'""",
)
def staged_versions(t):
    listed = registry.list_versions(t.model_versions, t.runs, stage="Production")
    return listed.drop("aliases", "created_at")


@query(
    "R3_version_metadata",
    uses=["model_versions"],
    sql="""
    SELECT model_name, version, stage, run_id, creation_timestamp,
           replace(tag_input_fields, ',', '|') AS input_fields, tag_output_fields AS output_fields,
           TRY_CAST(tag_score AS DOUBLE) AS evaluation_score, '' AS dspy_module, 'COPRO' AS optimizer,
           '' AS signature
    FROM model_versions""",
)
def version_metadata(t):
    tagged = t.model_versions.withColumn(
        "tags",
        F.create_map(
            F.lit("input_fields"),
            F.col("tag_input_fields"),
            F.lit("output_fields"),
            F.col("tag_output_fields"),
            F.lit("evaluation_score"),
            F.col("tag_score"),
            F.lit("optimizer"),
            F.lit("COPRO"),
        ),
    )
    found = registry.version_metadata(tagged)
    return found.withColumns(
        {c: F.array_join(c, "|") for c in ("input_fields", "output_fields")}
    )


REGISTRATIONS = """
    SELECT c_custkey AS request_id,
           CASE WHEN c_nationkey = 3 THEN '  ' WHEN c_nationkey = 4 THEN NULL
                ELSE ' Brand#' || c_nationkey || ' ' END AS model_name,
           CASE WHEN c_nationkey = 7 THEN '' WHEN c_nationkey = 8 THEN NULL
                ELSE 'run-c' || c_custkey END AS run_id,
           c_acctbal AS evaluation_score, c_name AS instructions, c_mktsegment AS signature
    FROM customer"""


@query(
    "R4_register",
    uses=["model_versions"],
    sql=f"""
    WITH asked AS (
        SELECT *, nullif(trim(model_name), '') AS clean,
               CASE WHEN coalesce(trim(model_name), '') = '' THEN 'empty_name'
                    WHEN coalesce(run_id, '') = '' THEN 'no_run_id' END AS error_code
        FROM ({REGISTRATIONS})),
    highest AS (SELECT model_name, max(CAST(version AS BIGINT)) AS top FROM model_versions
                GROUP BY model_name)
    SELECT request_id, clean AS model_name, error_code, error_code IS NULL AS success,
           CASE WHEN error_code IS NULL THEN CAST(coalesce(top, 0) + row_number() OVER (
               PARTITION BY clean, error_code IS NULL ORDER BY request_id) AS VARCHAR) END
             AS version,
           'Input: topic' || chr(10) || 'Output: joke' || chr(10) || 'Module: Predict' || chr(10)
             || 'Optimizer: COPRO' || chr(10) || 'Score: ' || printf('%.4f', evaluation_score)
             || chr(10) || 'Instructions: ' || instructions AS description,
           signature AS signature_tag
    FROM asked LEFT JOIN highest h ON asked.clean = h.model_name""",
)
def register(t):
    nation, customer = F.col("c_nationkey"), F.col("c_custkey").cast("string")
    asked = t.table("customer").select(
        F.col("c_custkey").alias("request_id"),
        F.when(nation == 3, "  ")
        .when(nation != 4, F.concat(F.lit(" Brand#"), nation.cast("string"), F.lit(" ")))
        .alias("model_name"),
        F.when(nation == 7, "").when(nation != 8, F.concat(F.lit("run-c"), customer)).alias("run_id"),
        F.col("c_acctbal").alias("evaluation_score"),
        F.col("c_name").alias("instructions"),
        F.col("c_mktsegment").alias("signature"),
        F.lit("topic").alias("input_fields"),
        F.lit("joke").alias("output_fields"),
        F.lit("Predict").alias("dspy_module"),
        F.lit("COPRO").alias("optimizer"),
    )
    done = registry.register(asked, t.model_versions, ["request_id"])
    return done.select(
        "request_id",
        "model_name",
        "error_code",
        "success",
        "version",
        "description",
        F.col("tags")["signature"].alias("signature_tag"),
    )


@query(
    "R5_flattened_models",
    uses=["model_versions"],
    sql="""
    SELECT model_name, stage, CAST(max(CAST(version AS BIGINT)) AS VARCHAR) AS version,
           arg_max(run_id, CAST(version AS BIGINT)) AS run_id,
           'family ' || model_name AS description
    FROM model_versions GROUP BY model_name, stage""",
)
def flattened_models(t):
    # A model lists its latest version per stage: four rows at most.
    latest = registry.latest_versions(t.model_versions, "stage")
    models = latest.groupBy("model_name").agg(
        F.collect_list(F.struct("stage", "version", "run_id")).alias("latest_versions")
    )
    described = models.withColumn("description", F.concat(F.lit("family "), "model_name"))
    return registry.flatten_models(described)


@query(
    "R6_program_list",
    uses=["prompts", "program_files"],
    sql="""
    SELECT replace(p.file_name, '.json', '') AS id,
           replace(input_fields, ',', ', ') || ' -> ' || output_fields AS signature,
           llm_model AS model, evaluation_score AS eval_score
    FROM prompts p JOIN program_files f ON p.file_name = f.file_name""",
)
def program_list(t):
    scored = t.prompts.withColumn(
        "evaluation_score", F.nullif(F.col("evaluation_score"), F.lit("N/A"))
    )
    return catalogue.list_programs(t.program_files, scored)


@query(
    "R7_run_params",
    sql="""
    WITH params AS (
        SELECT doc_id AS run_id, 'lang' AS param, lang AS value FROM documents
        UNION ALL SELECT doc_id, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents
        UNION ALL SELECT doc_id, 'text', text FROM documents)
    SELECT run_id, param, CASE WHEN length(value) > 500 THEN substring(value, 1, 497) || '...'
                               ELSE coalesce(value, '') END AS value
    FROM params""",
)
def run_params(t):
    rows = t.table("documents").withColumnRenamed("doc_id", "run_id")
    return registry.run_params(rows, ["lang", "n_chars", "text"])


@query(
    "R8_prediction_log",
    uses=["alias_events"],
    sql=f"""
    WITH {RESOLVED},
    answers AS (
        SELECT o_orderkey AS request_id,
               CASE WHEN o_totalprice >= 20000 THEN 'tr-' || o_orderkey
                    ELSE 'degraded-' || left(sha256(CAST(o_orderkey AS VARCHAR)), 16) END
                 AS trace_id,
               CASE WHEN o_totalprice < 40000 THEN '' ELSE o_orderstatus END AS outputs,
               o_totalprice AS latency_ms, o_totalprice < 40000 AS is_error
        FROM orders)
    SELECT a.trace_id, r.model_name, r.resolved_version AS model_version, a.outputs, a.latency_ms,
           a.is_error
    FROM answers a JOIN resolved r ON a.request_id = r.request_id""",
)
def prediction_log(t):
    price, order = F.col("o_totalprice"), F.col("o_orderkey")
    results = t.table("orders").select(
        order.alias("request_id"),
        F.when(price >= 20000, F.concat(F.lit("tr-"), order.cast("string"))).alias("trace_id"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp_ms"),
        F.col("o_orderpriority").alias("inputs"),
        F.when(price < 40000, "").otherwise(F.col("o_orderstatus")).alias("outputs"),
        price.alias("latency_ms"),
        F.when(price < 40000, "error: timeout").otherwise("success").alias("_status"),
    )
    logged = registry.prediction_log(results, resolved_requests(t), "request_id")
    return logged.drop("inputs", "timestamp_ms")


@query(
    "R9_named_feedback",
    uses=["feedback"],
    sql="""
    SELECT trace_id, 'remark' AS name, comment AS value, coalesce(user_id, 'anonymous') AS source_id
    FROM feedback WHERE comment IS NOT NULL""",
)
def named_feedback(t):
    return feedback.named_feedback(t.feedback, "remark", "comment")
