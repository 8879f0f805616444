"""W and O: positions, splits, ranks, sorts, limits and samples."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.joins import ALIAS_HOLDERS
from loopwright.checked.scans import FIRST_RATING
from loopwright.operators import catalogue, feedback, ordinal, registry


@query(
    "W2_train_dev_split",
    uses=["predictions"],
    sql="""
    SELECT example_id, CASE WHEN place <= floor(0.8 * n) THEN 'train' ELSE 'dev' END AS split
    FROM (SELECT example_id, row_number() OVER (ORDER BY example_id) AS place,
                 count(*) OVER () AS n FROM predictions)""",
)
def train_dev_split(t):
    return ordinal.with_split(t.predictions.select("example_id"), ["example_id"])


@query(
    "W3_example_ids",
    uses=["predictions"],
    sql="""
    SELECT example_id, gold_flag, row_number() OVER (ORDER BY example_id) - 1 AS position
    FROM predictions""",
)
def example_ids(t):
    rows = t.predictions.select("example_id", "gold_flag")
    return ordinal.with_ordinal(rows, ["example_id"], "position")


@query(
    "W4_next_versions",
    uses=["model_versions"],
    sql="""
    SELECT request_id, q.model_name,
           CAST(coalesce(highest, 0)
                + row_number() OVER (PARTITION BY q.model_name ORDER BY request_id) AS VARCHAR)
             AS version
    FROM (SELECT o_orderkey AS request_id, 'Brand#' || o_custkey % 40 AS model_name FROM orders) q
    LEFT JOIN (SELECT model_name, max(CAST(version AS BIGINT)) AS highest FROM model_versions
               GROUP BY model_name) v ON q.model_name = v.model_name""",
)
def next_versions(t):
    asked = t.table("orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")).alias("model_name"),
    )
    return registry.next_versions(asked, t.model_versions, ["request_id"])


@query("W5_current_aliases", uses=["alias_events"], sql=ALIAS_HOLDERS)
def current_aliases(t):
    return registry.current_aliases(t.alias_events)


@query(
    "W5_alias_actions",
    uses=["alias_events"],
    sql="""
    SELECT model_name, alias, version FROM (
        SELECT model_name, stage AS alias, version, event_id % 5 = 0 AS deleted,
               row_number() OVER (PARTITION BY model_name, stage ORDER BY ts DESC, event_id DESC)
                 AS place
        FROM alias_events) WHERE place = 1 AND NOT deleted""",
)
def alias_actions(t):
    log = t.alias_events.withColumnRenamed("stage", "alias").withColumn(
        "action", F.when(F.col("event_id") % 5 == 0, "delete").otherwise("set")
    )
    return registry.alias_state(log)


@query(
    "W5_alias_history",
    uses=["alias_events"],
    sql="""
    WITH log AS (
        SELECT *, CASE event_id % 3 WHEN 0 THEN 'stage' WHEN 1 THEN 'set' ELSE 'delete' END AS action,
               'pick' || (event_id % 4) AS picked FROM alias_events),
    named AS (
        SELECT *, CASE WHEN action <> 'stage' THEN picked WHEN stage = 'Production' THEN 'champion'
                       WHEN stage = 'Staging' THEN 'challenger' END AS alias FROM log)
    SELECT model_name, alias, version FROM named s
    WHERE alias IS NOT NULL AND action <> 'delete'
      AND NOT EXISTS (SELECT 1 FROM named l WHERE l.model_name = s.model_name
                      AND l.alias = s.alias AND (l.ts, l.event_id) > (s.ts, s.event_id))
      AND NOT EXISTS (SELECT 1 FROM log c WHERE c.model_name = s.model_name
                      AND c.version = s.version AND c.action = 'stage' AND c.stage = 'Archived'
                      AND (c.ts, c.event_id) > (s.ts, s.event_id))""",
)
def alias_history(t):
    kind = F.col("event_id") % 3
    log = t.alias_events.withColumns(
        {
            "action": F.when(kind == 0, "stage").when(kind == 1, "set").otherwise("delete"),
            "alias": F.concat(F.lit("pick"), (F.col("event_id") % 4).cast("string")),
        }
    )
    return registry.alias_history(log)


@query(
    "W6_first_assessment",
    uses=["feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT trace_id, CASE WHEN up THEN 'true' ELSE 'false' END AS user_rating,
           corrected AS corrected_output, comment AS user_comment FROM first_rated""",
)
def first_assessment(t):
    return feedback.first_assessments(feedback.assessments(t.feedback))


@query(
    "O1_catalogue_sort",
    uses=["prompts"],
    sql="""
    SELECT file_name AS id, evaluation_score AS eval_score,
           coalesce(TRY_CAST(evaluation_score AS DOUBLE), -1.0) AS sort_score FROM prompts""",
)
def catalogue_sort(t):
    listed = catalogue.sort_catalogue(catalogue.list_prompts(t.prompts))
    return listed.select(
        "id", "eval_score", catalogue.score_order(F.col("eval_score")).alias("sort_score")
    )


@query(
    "O2_version_sort",
    uses=["model_versions"],
    sql="""
    SELECT model_name, version,
           row_number() OVER (PARTITION BY model_name ORDER BY CAST(version AS BIGINT) DESC) - 1
             AS place
    FROM model_versions""",
)
def version_sort(t):
    rows = t.model_versions.select(
        "model_name", "version", (-registry.version_number()).alias("_newest")
    )
    return ordinal.with_group_ordinal(rows, ["model_name"], ["_newest"], "place").drop("_newest")


@query(
    "O3_feedback_history",
    uses=["feedback"],
    sql="""
    SELECT feedback_id, trace_id, rating, ts_ms FROM feedback
    ORDER BY ts_ms DESC, feedback_id DESC LIMIT 100""",
)
def feedback_history(t):
    return feedback.feedback_history(t.feedback, limit=100).select("feedback_id", "trace_id", "rating", "ts_ms")


@query(
    "O3_trace_history",
    uses=["feedback"],
    sql="""
    SELECT feedback_id, trace_id, rating, ts_ms FROM feedback WHERE trace_id = 'tr-4'
    ORDER BY ts_ms DESC, feedback_id DESC LIMIT 100""",
)
def trace_history(t):
    found = feedback.feedback_history(t.feedback, trace_id="tr-4", limit=100)
    return found.select("feedback_id", "trace_id", "rating", "ts_ms")


@query(
    "O4_export_limit",
    uses=["traces", "feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id, t.timestamp_ms FROM traces t JOIN first_rated r ON t.trace_id = r.trace_id
    WHERE r.up ORDER BY t.timestamp_ms DESC, t.trace_id LIMIT 1000""",
)
def export_limit(t):
    return feedback.rated_traces(t.traces, t.feedback, limit=1000).select("trace_id", "timestamp_ms")


@query(
    "O5_row_at_position",
    uses=["predictions"],
    sql="""
    SELECT example_id, gold_flag FROM predictions ORDER BY example_id LIMIT 1 OFFSET 1000""",
)
def row_at_position(t):
    rows = t.predictions.select("example_id", "gold_flag")
    return ordinal.row_at(rows, ["example_id"], 1000)


@query(
    "O5_random_rows",
    uses=["predictions"],
    sql="""
    SELECT example_id, gold_flag FROM predictions
    ORDER BY sha256('seven-' || example_id), example_id LIMIT 5""",
)
def random_rows(t):
    rows = t.predictions.select("example_id", "gold_flag")
    return ordinal.random_rows(rows, "example_id", "seven", 5)


@query(
    "O6_sample_per_seed",
    uses=["qa_examples"],
    sql="""
    SELECT seed, example_id, draw FROM (
        SELECT s.seed, q.example_id, CAST(row_number() OVER (
                   PARTITION BY s.seed ORDER BY sha256(s.seed || '-' || q.example_id), q.example_id)
                 AS INTEGER) AS draw
        FROM qa_examples q, (VALUES ('a'), ('b'), ('c')) s(seed)) WHERE draw <= 16""",
)
def sample_per_seed(t):
    drawn = ordinal.sample_per_seed(
        t.qa_examples.select("example_id"), "example_id", ["a", "b", "c"], 16
    )
    return drawn.select("seed", "example_id", "draw")
