"""P and U: projections, filters, contract checks, set operations, recycling."""

from datetime import datetime

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.scans import FIRST_RATING
from loopwright.functions import text
from loopwright.operators import catalogue, contracts, recycle
from loopwright.operators.feedback import rated_traces
from loopwright.plans.flywheel import recycle as recycle_plan
from loopwright.spec import TaskSpec


@query(
    "P3_example_projection",
    uses=["dataset_original"],
    sql="""
    SELECT ord, original_lang, original_text, CAST(n_chars AS VARCHAR) AS n_chars
    FROM dataset_original""",
)
def example_projection(t):
    spec = TaskSpec(("original_lang", "original_text"), ("n_chars",))
    return contracts.examples(t.dataset_original, spec, keep=["ord"])


@query(
    "P4_input_projection",
    uses=["reviewed"],
    sql="""
    SELECT _row_id, original_text, coalesce(_corrected_answer, '') AS _corrected_answer,
           '' AS style
    FROM reviewed""",
)
def input_projection(t):
    spec = TaskSpec(("original_text", "_corrected_answer", "style"), ("answer",))
    return contracts.program_inputs(t.reviewed, spec, keep=["_row_id"])


SIGNED = """
    SELECT file_name, replace(input_fields, ',', ', ') || ' -> ' || output_fields AS signature,
           input_fields, output_fields, evaluation_score, llm_model, dspy_module, optimizer, run_id
    FROM prompts"""


@query(
    "P5_signature_text",
    uses=["prompts"],
    sql=f"SELECT file_name, signature FROM ({SIGNED})",
)
def signature_text(t):
    return catalogue.with_signature(t.prompts).select("file_name", "signature")


@query(
    "P6_signature_filter",
    uses=["prompts"],
    sql=f"""
    SELECT file_name, signature FROM ({SIGNED})
    WHERE contains(lower(signature), 'originalcontent')""",
)
def signature_filter(t):
    listed = catalogue.list_prompts(t.prompts, signature_filter="ORIGINALcontent")
    return listed.select(F.col("id").alias("file_name"), "signature")


@query(
    "P7_input_filter",
    uses=["prompts"],
    sql=f"""
    SELECT file_name, signature FROM ({SIGNED})
    WHERE contains(lower(input_fields), 'topic') AND contains(lower(input_fields), 'joke')""",
)
def input_filter(t):
    listed = catalogue.list_prompts(t.prompts, output_filter=["Topic", "joke"])
    return listed.select(F.col("id").alias("file_name"), "signature")


@query(
    "P8_details_json",
    uses=["prompts"],
    sql="""
    SELECT file_name AS id,
           '{"input_fields":["' || replace(input_fields, ',', '","') || '"],"output_fields":["'
           || output_fields || '"],"evaluation_score":"' || evaluation_score || '",'
           || CASE WHEN run_id IS NULL THEN '' ELSE '"run_id":"' || run_id || '",' END
           || '"llm_model":"' || llm_model || '","dspy_module":"' || dspy_module
           || '","optimizer":"' || optimizer || '"}' AS details
    FROM prompts""",
)
def details_json(t):
    shown = t.prompts.withColumn("example_data", F.lit("left out"))
    return catalogue.list_prompts(shown).select("id", "details")


@query(
    "P9_quality_filter",
    uses=["reviewed"],
    sql="""
    SELECT 'reviewed' AS kind, _row_id FROM reviewed WHERE _quality IN ('good', 'fix')
    UNION ALL SELECT 'unreviewed', _row_id FROM reviewed WHERE _status = 'success'
    UNION ALL SELECT 'plain', _row_id FROM reviewed""",
)
def quality_filter(t):
    parts = {
        "reviewed": t.reviewed,
        "unreviewed": t.reviewed.drop("_quality"),
        "plain": t.reviewed.drop("_quality", "_status"),
    }
    found = [
        recycle.filter_quality(df).select(F.lit(kind).alias("kind"), "_row_id")
        for kind, df in parts.items()
    ]
    return found[0].union(found[1]).union(found[2])


@query(
    "P10_correction_overlay",
    uses=["reviewed"],
    sql="SELECT _row_id, coalesce(_corrected_answer, answer) AS answer FROM reviewed",
)
def correction_overlay(t):
    return recycle.apply_corrections(t.reviewed).select("_row_id", "answer")


@query(
    "P10_correction_counts",
    uses=["reviewed"],
    sql="SELECT count(_corrected_answer) AS applied_answer FROM reviewed",
)
def correction_counts(t):
    return recycle.correction_counts(t.reviewed)


@query(
    "P11_drop_bookkeeping",
    uses=["reviewed"],
    sql="SELECT original_lang, original_text, answer FROM reviewed",
)
def drop_bookkeeping(t):
    return recycle.drop_bookkeeping(t.reviewed)


@query(
    "P12_rating_check",
    uses=["feedback"],
    sql="""
    SELECT feedback_id, rating, rating IN ('thumbs_up', 'thumbs_down') AS valid FROM feedback""",
)
def rating_check(t):
    valid, invalid = contracts.split_by_rating(t.feedback)
    return valid.select("feedback_id", "rating", F.lit(True).alias("valid")).union(
        invalid.select("feedback_id", "rating", F.lit(False).alias("valid"))
    )


@query(
    "P13_name_check",
    sql="""
    SELECT p_partkey, nullif(trim(name), '') AS name,
           CASE WHEN coalesce(trim(name), '') = '' THEN 'empty_name' END AS error_code
    FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '   ' WHEN p_size % 7 = 0 THEN NULL
                                 ELSE '  ' || p_name || ' ' END AS name FROM part)""",
)
def name_check(t):
    size = F.col("p_size")
    name = F.when(size % 5 == 0, "   ").when(size % 7 != 0, F.concat(F.lit("  "), "p_name", F.lit(" ")))
    named = t.table("part").select("p_partkey", name.alias("name"))
    return named.select(
        "p_partkey",
        contracts.clean_name(F.col("name")).alias("name"),
        contracts.name_error(F.col("name")).alias("error_code"),
    )


@query(
    "P14_export_predicate",
    uses=["traces", "feedback"],
    sql=f"""
    WITH {FIRST_RATING}
    SELECT t.trace_id, t.timestamp_ms
    FROM traces t JOIN first_rated r ON t.trace_id = r.trace_id
    WHERE r.up AND t.model_name = 'src3'
      AND t.timestamp_ms BETWEEN 1704067260000 AND 1704110400000""",
)
def export_predicate(t):
    return rated_traces(
        t.traces,
        t.feedback,
        model_name="src3",
        start=datetime(2024, 1, 1, 0, 1),
        end=datetime(2024, 1, 1, 12),
        limit=None,
    ).select("trace_id", "timestamp_ms")


@query(
    "P15_truncation",
    sql="""
    SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 497) || '...'
                        ELSE text END AS param,
           CASE WHEN length(text) > 250 THEN substring(text, 1, 247) || '...'
                ELSE text END AS tag
    FROM documents""",
)
def truncation(t):
    return t.table("documents").select(
        "doc_id",
        text.truncate_text(F.col("text")).alias("param"),
        text.truncate_text(F.col("text"), text.TAG_LIMIT).alias("tag"),
    )


UNION_COMMON = """
    SELECT 0 AS side, ord, original_lang, original_text, answer FROM dataset_original
    UNION ALL SELECT 1, ord, original_lang, original_text, answer FROM dataset_new"""


@query("U1_union_common", uses=["dataset_original", "dataset_new"], sql=UNION_COMMON)
def union_common(t):
    both = recycle.union_common(t.dataset_original, t.dataset_new, "ord", source="side")
    return both.withColumnRenamed("_ord", "ord")


@query(
    "U2_common_files",
    uses=["prompts", "program_files"],
    sql="SELECT file_name FROM prompts INTERSECT SELECT file_name FROM program_files",
)
def common_files(t):
    return catalogue.common_files(t.program_files, t.prompts)


MERGED = f"""
    SELECT original_lang, original_text, answer, side, ord FROM (
        SELECT *, row_number() OVER (PARTITION BY original_lang, original_text
                                     ORDER BY side DESC, ord DESC) AS place
        FROM ({UNION_COMMON})) WHERE place = 1"""


@query("W1_keep_last", uses=["dataset_original", "dataset_new"], sql=MERGED)
def keep_last(t):
    merged = recycle.merge_datasets(t.dataset_original, t.dataset_new, "ord")
    return merged.withColumnsRenamed({"_source": "side", "_ord": "ord"})


@query(
    "A8_merge_statistics",
    uses=["dataset_original", "dataset_new"],
    sql=f"""
    SELECT o.n AS original_count, w.n AS new_count, m.n AS merged_count,
           o.n + w.n - m.n AS removed_count, round(w.n / (o.n + w.n), 6) AS new_ratio,
           round(w.n / m.n, 6) AS new_share, w.n / (o.n + w.n) > 0.5 AS over_ratio
    FROM (SELECT count(*) AS n FROM dataset_original) o,
         (SELECT count(*) AS n FROM dataset_new) w,
         (SELECT count(*) AS n FROM ({MERGED})) m""",
)
def merge_statistics(t):
    return recycle.merge_statistics(t.dataset_original, t.dataset_new, "ord")


@query(
    "U4_recycle",
    uses=["reviewed", "dataset_original"],
    sql="""
    SELECT original_lang, original_text, answer FROM (
        SELECT *, row_number() OVER (PARTITION BY original_lang, original_text
                                     ORDER BY side DESC, ord DESC) AS place
        FROM (SELECT 0 AS side, ord, original_lang, original_text, answer FROM dataset_original
              UNION ALL
              SELECT 1, _row_id, original_lang, original_text, coalesce(_corrected_answer, answer)
              FROM reviewed WHERE _quality IN ('good', 'fix'))) WHERE place = 1""",
)
def recycled(t):
    return recycle_plan(t.reviewed, t.dataset_original, "_row_id", "ord")
