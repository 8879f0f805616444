"""T: text, JSON, time, hash and map expressions."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.aggregates import fingerprint_sql
from loopwright.functions import jsonmap, text
from loopwright.functions.fingerprint import dataset_fingerprint
from loopwright.operators.serving import conversation_text


@query(
    "T1_program_id",
    uses=["prompts"],
    sql="""
    SELECT file_name,
           CASE input_fields WHEN 'joke,topic' THEN 'JokeTopic' WHEN 'topic' THEN 'Topic'
                ELSE 'OriginalcontentStyle' END || ':' || upper(left(output_fields, 1))
             || substring(output_fields, 2) || '-Gpt4oMini_ChainOfThought_BsFewShot-20240305' AS id
    FROM prompts""",
)
def program_id(t):
    made = text.program_id(
        F.col("input_fields"),
        F.col("output_fields"),
        F.col("llm_model"),
        F.col("dspy_module"),
        F.col("optimizer"),
        F.lit("2024-03-05").cast("date"),
    )
    return t.prompts.select("file_name", made.alias("id"))


@query(
    "T2_value_text",
    sql="""
    SELECT event_id, CAST(user_id AS VARCHAR) AS number, coalesce(nullif(props, '{"k": 1}'), '')
             AS words, '{"user":' || user_id || ',"kind":"' || event_type || '"}' AS nested
    FROM events""",
)
def value_text(t):
    rows = t.table("events").select(
        "event_id",
        F.col("user_id").alias("number"),
        F.nullif(F.col("props"), F.lit('{"k": 1}')).alias("words"),
        F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind")).alias("nested"),
    )
    return rows.select(
        "event_id",
        *[text.value_text(rows, c).alias(c) for c in ("number", "words", "nested")],
    )


@query(
    "T3_fingerprint",
    uses=["predictions"],
    sql="SELECT row_count, digest AS fingerprint FROM ("
    + fingerprint_sql("predictions", ["example_id", "gold_flag", "pred_flag", "judge_score"])
    + ")",
)
def fingerprint(t):
    return dataset_fingerprint(
        t.predictions.select("example_id", "gold_flag", "pred_flag", "judge_score")
    )


@query(
    "T4_trace_io",
    uses=["traces"],
    sql="""
    SELECT trace_id, inputs->>'lang' AS lang, inputs->>'source' AS source,
           CASE WHEN json_valid(outputs) THEN outputs->>'n_chars' END AS n_chars
    FROM traces""",
)
def trace_io(t):
    inputs, outputs = jsonmap.parse_map(F.col("inputs")), jsonmap.parse_map(F.col("outputs"))
    return t.traces.select(
        "trace_id",
        inputs["lang"].alias("lang"),
        inputs["source"].alias("source"),
        outputs["n_chars"].alias("n_chars"),
    )


@query(
    "T5_record_fallback",
    uses=["traces"],
    sql="""
    SELECT trace_id, CASE WHEN NOT json_valid(outputs) THEN outputs END AS output,
           CASE WHEN json_valid(outputs) THEN outputs->>'n_chars' END AS n_chars,
           CASE WHEN json_valid(outputs) THEN 2 ELSE 1 END AS fields
    FROM traces""",
)
def record_fallback(t):
    rows = t.traces.select(
        "trace_id", jsonmap.parse_or_wrap(F.col("outputs"), "output").alias("record")
    )
    return rows.select(
        "trace_id",
        F.col("record")["output"].alias("output"),
        F.col("record")["n_chars"].alias("n_chars"),
        F.size("record").alias("fields"),
    )


@query(
    "T6_map_merge",
    uses=["traces"],
    sql="""
    SELECT trace_id,
           coalesce(CASE WHEN json_valid(outputs) THEN outputs->>'lang' END, inputs->>'lang') AS lang,
           inputs->>'source' AS source, trace_id AS marked,
           CASE WHEN json_valid(outputs) THEN 4 ELSE 4 END AS fields
    FROM traces""",
)
def map_merge(t):
    rows = t.traces.select(
        "trace_id",
        jsonmap.training_fields(
            F.col("inputs"), F.col("outputs"), None, F.col("trace_id"), F.lit("")
        ).alias("record"),
    )
    return rows.select(
        "trace_id",
        F.col("record")["lang"].alias("lang"),
        F.col("record")["source"].alias("source"),
        F.col("record")["_trace_id"].alias("marked"),
        F.size("record").alias("fields"),
    )


RESPONSE = """
    SELECT example_id, 'Input:' || chr(10) || 'question: ' || question || chr(10) || chr(10)
           || 'Output:' || chr(10) || 'answer: ' || answer || chr(10) || 'note: ' || chr(10)
             AS response
    FROM qa_examples"""


def responses(t):
    rendered = text.render_response(
        {"question": F.col("question")},
        {"answer": F.col("answer"), "note": F.lit(None).cast("string")},
    )
    return t.qa_examples.select("example_id", rendered.alias("response"))


@query("T7_render_response", uses=["qa_examples"], sql=RESPONSE)
def render_response(t):
    return responses(t)


# Only the first line of an answer is on the line of its name; later lines that read
# "answer: ..." or "note: ..." would win, so the SQL looks at every line.
@query(
    "T8_parse_response",
    uses=["qa_examples"],
    sql=f"""
    WITH responses AS ({RESPONSE}),
    lines AS (
        SELECT example_id, unnest(string_split(list_extract(string_split(response, 'Output:'), -1),
                                               chr(10))) AS line,
               generate_subscripts(string_split(list_extract(string_split(response, 'Output:'), -1),
                                                chr(10)), 1) AS place
        FROM responses),
    pairs AS (
        SELECT example_id, place, trim(line[:instr(line, ':') - 1]) AS name,
               trim(line[instr(line, ':') + 1:]) AS value
        FROM lines WHERE contains(line, ':'))
    SELECT example_id, arg_max(value, place) FILTER (name = 'answer') AS answer,
           arg_max(value, place) FILTER (name = 'note') AS note,
           arg_max(value, place) FILTER (name = 'question') AS question
    FROM pairs GROUP BY example_id""",
)
def parse_response(t):
    rows = responses(t).select(
        "example_id", text.response_entries(F.col("response")).alias("entries")
    )
    return rows.select(
        "example_id",
        *[
            text.response_value(F.col("entries"), f).alias(f)
            for f in ("answer", "note", "question")
        ],
    )


@query(
    "T9_conversation_text",
    sql="""
    SELECT conv_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text), '') AS text
    FROM conversations GROUP BY conv_id""",
)
def conversation(t):
    return conversation_text(t.table("conversations"))


@query(
    "T9_long_conversation",
    sql="""
    SELECT role, coalesce(string_agg(text, chr(10) ORDER BY conv_id * 1000 + turn, text), '') AS text
    FROM conversations GROUP BY role""",
)
def long_conversation(t):
    # All that a role ever said as one conversation, far longer than a segment.
    said = t.table("conversations").select(
        F.col("role").alias("conv_id"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("turn"),
        "text",
    )
    return conversation_text(said).withColumnRenamed("conv_id", "role")


@query(
    "T10_field_lists",
    uses=["model_versions"],
    sql="""
    SELECT model_name, version, 2 AS inputs, CASE WHEN tag_output_fields = '' THEN 0 ELSE 1 END
             AS outputs, tag_input_fields AS joined, TRY_CAST(tag_score AS DOUBLE) AS score
    FROM model_versions""",
)
def field_lists(t):
    names = text.split_names(F.col("tag_input_fields"))
    return t.model_versions.select(
        "model_name",
        "version",
        F.size(names).alias("inputs"),
        F.size(text.split_names(F.col("tag_output_fields"))).alias("outputs"),
        text.join_names(names).alias("joined"),
        text.score_or_null(F.col("tag_score")).alias("score"),
    )


@query(
    "T11_times",
    uses=["traces"],
    sql="""
    SELECT trace_id, strftime(make_timestamp(timestamp_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g')
             AS iso, timestamp_ms AS millis
    FROM traces""",
)
def times(t):
    ts = text.millis_to_timestamp(F.col("timestamp_ms"))
    return t.traces.select(
        "trace_id", text.iso_text(ts).alias("iso"), text.timestamp_to_millis(ts).alias("millis")
    )


@query(
    "T12_version_description",
    sql="""
    SELECT doc_id, 'Input: topic' || chr(10) || 'Output: joke' || chr(10)
           || CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'Module: Predict' || chr(10) END
           || 'Optimizer: COPRO' || chr(10)
           || CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'Score: ' || printf('%.4f', n_chars / 8.0)
                                                   || chr(10) END
           || 'Instructions: ' || CASE WHEN length(text) > 200 THEN substring(text, 1, 197) || '...'
                                       ELSE text END AS description,
           CASE WHEN length(text) > 250 THEN substring(text, 1, 247) || '...' ELSE text END
             AS signature_tag,
           CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 2 END AS tags
    FROM documents""",
)
def version_description(t):
    module = F.when(F.col("doc_id") % 3 != 0, "Predict")
    score = F.when(F.col("doc_id") % 2 != 0, F.col("n_chars") / 8.0)
    tags = text.version_tags({"dspy_module": module, "signature": F.col("text")}, ["signature"])
    return t.table("documents").select(
        "doc_id",
        text.version_description(
            F.lit("topic"), F.lit("joke"), module, F.lit("COPRO"), score, F.col("text")
        ).alias("description"),
        tags["signature"].alias("signature_tag"),
        F.size(tags).alias("tags"),
    )


@query(
    "T14_feedback_id",
    uses=["feedback"],
    sql="""
    SELECT feedback_id AS source_id,
           'fb-' || left(sha256(
               coalesce(length(trace_id) || ':' || trace_id, '-')
               || coalesce(length(CAST(ts_ms AS VARCHAR)) || ':' || ts_ms, '-')
               || coalesce(length(user_id) || ':' || user_id, '-')
               || coalesce(length(comment) || ':' || comment, '-')), 16) AS made_id,
           'degraded-' || left(sha256(feedback_id), 16) AS degraded_id
    FROM feedback""",
)
def feedback_ids(t):
    return t.feedback.select(
        F.col("feedback_id").alias("source_id"),
        text.feedback_id(*[F.col(c) for c in ("trace_id", "ts_ms", "user_id", "comment")]).alias(
            "made_id"
        ),
        text.degraded_trace_id(F.col("feedback_id")).alias("degraded_id"),
    )
