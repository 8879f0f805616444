"""F: the feedback flow, from ingest to training records."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.scans import FIRST_RATING, RECORDS
from loopwright.operators import feedback
from loopwright.plans.flywheel import flywheel, training_export
from loopwright.spec import TaskSpec
from loopwright.views import EPOCH_MS


@query(
    "F1_feedback_ingest",
    uses=["traces", "feedback"],
    sql="""
    SELECT feedback_id, trace_id, rating, ts_ms FROM feedback
    WHERE rating IN ('thumbs_up', 'thumbs_down')
      AND (starts_with(trace_id, 'degraded-') OR trace_id IN (SELECT trace_id FROM traces))""",
)
def feedback_ingest(t):
    # Retries arrive twice and are kept once.
    retried = t.feedback.unionByName(t.feedback)
    found = feedback.ingest_feedback(retried, t.traces)
    return found.select("feedback_id", "trace_id", "rating", "ts_ms")


@query(
    "F1_ids_from_content",
    uses=["traces", "feedback"],
    sql="""
    SELECT DISTINCT trace_id, ts_ms // 86400000 * 86400000 AS ts_ms, user_id, rating,
           corrected_output, comment
    FROM feedback
    WHERE rating IN ('thumbs_up', 'thumbs_down')
      AND (starts_with(trace_id, 'degraded-') OR trace_id IN (SELECT trace_id FROM traces))""",
)
def ids_from_content(t):
    # Feedback without ids that shares trace and time; retries arrive twice.
    rows = t.feedback.drop("feedback_id").withColumn(
        "ts_ms", F.floor(F.col("ts_ms") / 86400000) * 86400000
    )
    found = feedback.ingest_feedback(rows.unionByName(rows), t.traces)
    return found.drop("feedback_id")


@query(
    "F2_assessments",
    uses=["feedback"],
    sql="""
    WITH named AS (
        SELECT *, coalesce(user_id, 'anonymous') AS source_id,
               CASE WHEN rating = 'thumbs_up' THEN 'true' ELSE 'false' END AS up FROM feedback)
    SELECT trace_id, 'user_rating' AS name, up AS value, source_id, feedback_id, rating AS rating_type
    FROM named
    UNION ALL SELECT trace_id, 'corrected_output', corrected_output, source_id, feedback_id, rating
    FROM named WHERE corrected_output NOT IN ('', '{}')
    UNION ALL SELECT trace_id, 'user_comment', comment, source_id, feedback_id, rating
    FROM named WHERE comment <> ''""",
)
def assessments(t):
    return feedback.assessments(t.feedback).drop("ts_ms")


@query(
    "F3_assessment_lookup",
    uses=["feedback"],
    sql="SELECT feedback_id, comment, CAST(NULL AS VARCHAR) AS other, rating FROM feedback",
)
def assessment_lookup(t):
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    listed = t.feedback.select(
        "feedback_id",
        F.array(
            entry("user_rating", F.col("rating")),
            entry("user_comment", F.col("comment")),
            entry("user_comment", F.lit("a later one")),
        ).alias("entries"),
    )
    return listed.select(
        "feedback_id",
        feedback.assessment_value(F.col("entries"), "user_comment").alias("comment"),
        feedback.assessment_value(F.col("entries"), "other").alias("other"),
        feedback.assessment_value(F.col("entries"), "user_rating").alias("rating"),
    )


@query(
    "F4_latest_assessments",
    uses=["feedback"],
    sql="""
    SELECT trace_id,
           arg_max(CASE WHEN rating = 'thumbs_up' THEN 'true' ELSE 'false' END,
                   (ts_ms, feedback_id)) AS user_rating,
           arg_max(corrected_output, (ts_ms, feedback_id))
             FILTER (corrected_output NOT IN ('', '{}')) AS corrected_output,
           arg_max(comment, (ts_ms, feedback_id)) FILTER (comment <> '') AS user_comment
    FROM feedback GROUP BY trace_id""",
)
def latest_assessments(t):
    return feedback.first_assessments(feedback.assessments(t.feedback), keep="latest")


@query(
    "F5_rated_traces",
    uses=["traces", "feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id, t.model_name, t.inputs, t.outputs, r.corrected AS corrected_output,
           r.comment AS user_comment
    FROM traces t JOIN first_rated r ON t.trace_id = r.trace_id
    WHERE NOT r.up""",
)
def rated_traces(t):
    found = feedback.rated_traces(t.traces, t.feedback, rating="thumbs_down")
    return found.select(
        "trace_id", "model_name", "inputs", "outputs", "corrected_output", "user_comment"
    )


TRACE_ROWS = f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id, t.inputs, CASE WHEN json_valid(t.outputs) THEN t.outputs ELSE '' END
             AS outputs,
           coalesce(CASE WHEN r.corrected LIKE '"%' THEN json_extract_string(r.corrected, '$')
                         ELSE r.corrected END, '') AS corrected_output,
           CASE WHEN r.up THEN 'thumbs_up' ELSE 'thumbs_down' END AS rating,
           coalesce(r.comment, '') AS comment,
           strftime(make_timestamp(t.timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') AS timestamp,
           t.model_name
    FROM traces t LEFT JOIN first_rated r ON t.trace_id = r.trace_id"""


@query("F6_trace_rows", uses=["traces", "feedback"], sql=TRACE_ROWS)
def trace_rows(t):
    return feedback.trace_rows(feedback.traces_with_feedback(t.traces, t.feedback))


def record_columns(records, *names):
    return records.select("trace_id", *[F.col("record")[n].alias(n) for n in names])


@query(
    "F7_training_export",
    uses=["traces", "feedback"],
    sql=RECORDS + " SELECT trace_id, lang, n_chars, source, 'thumbs_up' AS _rating FROM records",
)
def training_data(t):
    return record_columns(
        training_export(t.traces, t.feedback), "lang", "n_chars", "source", "_rating"
    )


@query(
    "F7_original_outputs",
    uses=["traces", "feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id,
           CASE WHEN json_valid(t.outputs) THEN t.outputs->>'lang' ELSE t.inputs->>'lang' END
             AS lang,
           CASE WHEN json_valid(t.outputs) THEN t.outputs->>'n_chars' END AS n_chars,
           t.inputs->>'source' AS source
    FROM traces t JOIN first_rated r ON t.trace_id = r.trace_id WHERE r.up""",
)
def original_outputs(t):
    exported = training_export(t.traces, t.feedback, use_corrected=False)
    return record_columns(exported, "lang", "n_chars", "source")


FLYWHEEL_SPEC = TaskSpec(("lang", "n_chars"), ("label",), "Label the document")


def label_predictor(inputs):
    """A predictor as a column: very short documents get no answer."""
    size = inputs["n_chars"].cast("long")
    return {"label": F.when(size >= 100, F.concat(inputs["lang"], F.lit("-"), (size % 3).cast("string")))}


def flywheel_requests(t):
    return t.table("documents").select(
        F.concat(F.lit("tr-"), F.col("doc_id").cast("string")).alias("trace_id"),
        F.col("source").alias("model_name"),
        (F.col("doc_id") * 60000 + EPOCH_MS).alias("timestamp_ms"),
        "lang",
        "n_chars",
    )


def flywheel_records(t, limit=None):
    return record_columns(
        flywheel(flywheel_requests(t), t.feedback, FLYWHEEL_SPEC, label_predictor, limit),
        "lang",
        "n_chars",
        "label",
        "_rating",
    )


@query(
    "F8_flywheel",
    uses=["feedback"],
    sql=f"""
    WITH predicted AS (
        SELECT 'tr-' || doc_id AS trace_id, lang, CAST(n_chars AS VARCHAR) AS n_chars,
               lang || '-' || n_chars % 3 AS label
        FROM documents WHERE n_chars >= 100),
    accepted AS (
        SELECT * FROM feedback WHERE rating IN ('thumbs_up', 'thumbs_down')
          AND trace_id IN (SELECT trace_id FROM predicted)),
    {FIRST_RATING.replace('FROM feedback', 'FROM accepted')},
    joined AS (
        SELECT p.*, CASE WHEN r.corrected LIKE '"%' THEN json_extract_string(r.corrected, '$')
                         ELSE r.corrected END AS corrected
        FROM predicted p JOIN first_rated r ON p.trace_id = r.trace_id WHERE r.up)
    SELECT trace_id, coalesce(corrected->>'lang', lang) AS lang,
           coalesce(corrected->>'n_chars', n_chars) AS n_chars,
           CASE WHEN corrected IS NULL THEN label END AS label, 'thumbs_up' AS _rating
    FROM joined""",
)
def flywheel_query(t):
    return flywheel_records(t)
