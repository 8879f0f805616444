"""The tables the checked queries run on, derived from the given star-schema tables.

``Tables`` builds each of them with the DataFrame API; ``VIEW_SQL`` says the same in SQL for
the checking engine.  Each uses the whole of its source tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: 2024-01-01 UTC in milliseconds, where the derived clocks start.
EPOCH_MS = 1704067200000
MINUTE_MS = 60000

VIEW_SQL = {
    "qa_examples": """
        SELECT u.conv_id * 1000 + u.turn AS example_id, u.conv_id AS conv_id,
               u.text AS question, a.text AS answer
        FROM conversations u JOIN conversations a
          ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
        WHERE u.role = 'user' AND a.role = 'assistant'""",
    "traces": """
        SELECT 'tr-' || doc_id AS trace_id, source AS model_name,
               CAST(doc_id % 3 + 1 AS VARCHAR) AS model_version,
               1704067200000 + doc_id * 60000 AS timestamp_ms,
               '{"lang":"' || lang || '","source":"' || source || '"}' AS inputs,
               CASE WHEN doc_id % 50 = 7 THEN 'plain text answer'
                    ELSE '{"n_chars":"' || n_chars || '","lang":"out-' || lang || '"}' END AS outputs
        FROM documents""",
    "feedback": """
        SELECT 'fb-' || doc_id AS feedback_id, 'tr-' || doc_id AS trace_id,
               CASE WHEN quality = 1 THEN 'thumbs_up' ELSE 'thumbs_down' END AS rating,
               CASE WHEN toxic = 1 AND doc_id % 2 = 0 THEN '{"n_chars":"0"}'
                    WHEN toxic = 1 THEN '"{\\"n_chars\\":\\"0\\"}"' END AS corrected_output,
               CASE WHEN doc_id % 5 = 0 THEN 'note ' || doc_id END AS comment,
               'u' || doc_id % 7 AS user_id,
               1704067200000 + doc_id * 60000 + 3600000 AS ts_ms
        FROM labels
        UNION ALL
        SELECT 'ev-' || event_id,
               CASE WHEN event_type = 'error' THEN 'degraded-' || event_id
                    WHEN event_type = 'signup' THEN 'tr-new-' || event_id
                    ELSE 'tr-' || user_id END,
               CASE WHEN event_type = 'error' AND value < 5 THEN 'unsure'
                    WHEN event_type = 'view' THEN 'thumbs_down' ELSE 'thumbs_up' END,
               CASE WHEN event_type = 'purchase' THEN '{"n_chars":"1","lang":"fixed"}'
                    WHEN event_type = 'view' THEN '{}' END,
               CASE WHEN event_type = 'click' THEN props
                    WHEN event_type = 'view' THEN '' END,
               CASE WHEN event_type <> 'error' THEN 'u' || user_id END,
               epoch_us(ts) // 1000
        FROM events""",
    "predictions": """
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                         CAST(round(l_extendedprice * 100) AS BIGINT)) AS example_id,
               CAST(l_suppkey % 5 AS INTEGER) AS candidate_id,
               l_returnflag AS gold_flag, l_linestatus AS gold_status,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    WHEN l_orderkey % 4 = 0 THEN 'X' ELSE l_returnflag END AS pred_flag,
               CASE WHEN l_partkey % 6 = 0 THEN 'X' ELSE l_linestatus END AS pred_status,
               CASE WHEN l_linenumber = 7 THEN 'n/a' WHEN l_linenumber = 6 THEN 'NaN'
                    ELSE CAST(l_linenumber % 2 AS VARCHAR) END AS judge_score,
               CASE WHEN l_linenumber = 5 THEN 'error: timeout' ELSE 'success' END AS status,
               l_quantity AS latency
        FROM lineitem""",
    "requests": """
        SELECT event_id AS request_id, ts, 'model-' || user_id % 5 AS model_name,
               value AS latency_ms, event_type = 'error' AS is_error
        FROM events""",
    "reviewed": """
        SELECT d.doc_id AS _row_id, d.lang AS original_lang, d.text AS original_text,
               d.source AS answer,
               CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 'good' WHEN l.quality = 1 THEN 'fix'
                    WHEN l.quality = 0 THEN 'bad' END AS _quality,
               CASE WHEN l.quality = 1 AND l.toxic = 1 THEN 'fixed-' || d.source END
                 AS _corrected_answer,
               CASE WHEN d.doc_id % 9 = 0 THEN 'error: timeout' ELSE 'success' END AS _status
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "dataset_original": """
        SELECT doc_id AS ord, lang AS original_lang, text AS original_text, source AS answer,
               n_chars
        FROM documents""",
    "dataset_new": """
        SELECT d.doc_id AS ord, 'new-' || d.source AS answer, d.text AS original_text,
               d.lang AS original_lang, 'v2' AS batch
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "models": """
        SELECT p_brand AS model_name, 'family ' || min(p_type) AS description
        FROM part GROUP BY p_brand
        UNION ALL
        SELECT s_name, NULL FROM supplier""",
    "model_versions": """
        SELECT p_brand AS model_name, CAST(p_partkey + 1 AS VARCHAR) AS version,
               CASE WHEN p_partkey % 7 = 0 THEN 'run-lost-' ELSE 'run-' END || p_partkey AS run_id,
               CASE p_size % 4 WHEN 0 THEN 'Production' WHEN 1 THEN 'Staging'
                    WHEN 2 THEN 'Archived' ELSE 'None' END AS stage,
               1704067200000 + p_partkey * 1000 AS creation_timestamp,
               'topic,style' AS tag_input_fields,
               CASE WHEN p_size % 2 = 0 THEN '' ELSE 'joke' END AS tag_output_fields,
               CASE WHEN p_partkey % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS tag_score
        FROM part""",
    "runs": """
        SELECT 'run-' || p_partkey AS run_id, CAST(p_size AS DOUBLE) AS evaluation_score,
               CAST(p_size % 10 AS DOUBLE) AS baseline_score, p_name AS instructions
        FROM part""",
    "alias_events": """
        SELECT o_orderkey AS event_id, o_orderdate AS ts, 'm' || o_custkey % 20 AS model_name,
               CAST(o_orderkey % 5 + 1 AS VARCHAR) AS version,
               CASE o_orderstatus WHEN 'F' THEN 'Production' WHEN 'O' THEN 'Staging'
                    ELSE 'Archived' END AS stage
        FROM orders""",
    "prompts": """
        SELECT 'p' || p_partkey || '.json' AS file_name,
               CASE WHEN p_size % 3 = 0 THEN 'joke,topic' WHEN p_size % 3 = 1 THEN 'topic'
                    ELSE 'OriginalContent,Style' END AS input_fields,
               CASE WHEN p_size % 2 = 0 THEN 'funny' ELSE 'joke' END AS output_fields,
               CASE WHEN p_partkey % 6 = 0 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END
                 AS evaluation_score,
               CASE WHEN p_partkey % 4 <> 0 THEN 'run-' || p_partkey END AS run_id,
               'gpt-4o-mini' AS llm_model, 'ChainOfThought' AS dspy_module,
               'bootstrap_few_shot' AS optimizer
        FROM part""",
    "program_files": """
        SELECT DISTINCT 'p' || l_partkey || '.json' AS file_name FROM lineitem""",
    "demos": """
        SELECT CAST(vec_id // 16 AS BIGINT) AS program_id, vec_id AS demo_id,
               vec_id % 5 = 0 AS augmented,
               CASE WHEN vec_id % 5 = 0 THEN 'because of ' || vec_id END AS reasoning,
               'item ' || vec_id AS question, CAST(label AS VARCHAR) AS answer
        FROM embeddings""",
    "embedding_pairs": """
        SELECT a.vec_id AS example_id, a.embedding AS gold_vec, b.embedding AS pred_vec
        FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
}


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


class Tables:
    """The given tables, and the derived ones, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def qa_examples(self) -> DataFrame:
        turns = self.table("conversations")
        asked = turns.filter(F.col("role") == "user").select(
            "conv_id", "turn", F.col("text").alias("question")
        )
        answered = turns.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
        )
        return asked.join(answered, ["conv_id", "turn"]).select(
            (F.col("conv_id") * 1000 + F.col("turn")).alias("example_id"),
            "conv_id",
            "question",
            "answer",
        )

    @cached_property
    def traces(self) -> DataFrame:
        return self.document_traces(self.table("documents"))

    @staticmethod
    def document_traces(documents: DataFrame) -> DataFrame:
        """A trace of each row of a table (or stream) of documents."""
        doc = F.col("doc_id")
        made = _text('{"n_chars":"', F.col("n_chars"), '","lang":"out-', F.col("lang"), '"}')
        return documents.select(
            _text("tr-", doc).alias("trace_id"),
            F.col("source").alias("model_name"),
            (doc % 3 + 1).cast("string").alias("model_version"),
            (doc * MINUTE_MS + EPOCH_MS).alias("timestamp_ms"),
            _text('{"lang":"', F.col("lang"), '","source":"', F.col("source"), '"}').alias("inputs"),
            F.when(doc % 50 == 7, F.lit("plain text answer")).otherwise(made).alias("outputs"),
        )

    @staticmethod
    def label_feedback(labels: DataFrame) -> DataFrame:
        """Feedback events from a table (or stream) of labels."""
        doc, toxic = F.col("doc_id"), F.col("toxic") == 1
        return labels.select(
            _text("fb-", doc).alias("feedback_id"),
            _text("tr-", doc).alias("trace_id"),
            F.when(F.col("quality") == 1, "thumbs_up").otherwise("thumbs_down").alias("rating"),
            F.when(toxic & (doc % 2 == 0), '{"n_chars":"0"}')
            .when(toxic, '"{\\"n_chars\\":\\"0\\"}"')
            .alias("corrected_output"),
            F.when(doc % 5 == 0, _text("note ", doc)).alias("comment"),
            _text("u", doc % 7).alias("user_id"),
            (doc * MINUTE_MS + EPOCH_MS + 3600000).alias("ts_ms"),
        )

    @staticmethod
    def event_feedback(events: DataFrame) -> DataFrame:
        """Feedback events from a table (or stream) of events."""
        kind, event, user = F.col("event_type"), F.col("event_id"), F.col("user_id")
        return events.select(
            _text("ev-", event).alias("feedback_id"),
            F.when(kind == "error", _text("degraded-", event))
            .when(kind == "signup", _text("tr-new-", event))
            .otherwise(_text("tr-", user))
            .alias("trace_id"),
            F.when((kind == "error") & (F.col("value") < 5), "unsure")
            .when(kind == "view", "thumbs_down")
            .otherwise("thumbs_up")
            .alias("rating"),
            F.when(kind == "purchase", '{"n_chars":"1","lang":"fixed"}')
            .when(kind == "view", "{}")
            .alias("corrected_output"),
            F.when(kind == "click", F.col("props")).when(kind == "view", "").alias("comment"),
            F.when(kind != "error", _text("u", user)).alias("user_id"),
            F.unix_millis("ts").alias("ts_ms"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        return self.label_feedback(self.table("labels")).unionByName(
            self.event_feedback(self.events)
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def predictions(self) -> DataFrame:
        line = F.col("l_linenumber")
        cents = F.round(F.col("l_extendedprice") * 100).cast("long")
        return self.table("lineitem").select(
            F.concat_ws(
                "-",
                *[
                    c.cast("string")
                    for c in (F.col("l_orderkey"), line, F.col("l_partkey"), F.col("l_suppkey"), cents)
                ],
            ).alias("example_id"),
            (F.col("l_suppkey") % 5).cast("int").alias("candidate_id"),
            F.col("l_returnflag").alias("gold_flag"),
            F.col("l_linestatus").alias("gold_status"),
            F.when(F.col("l_orderkey") % 11 == 0, F.lit(None))
            .when(F.col("l_orderkey") % 4 == 0, "X")
            .otherwise(F.col("l_returnflag"))
            .alias("pred_flag"),
            F.when(F.col("l_partkey") % 6 == 0, "X")
            .otherwise(F.col("l_linestatus"))
            .alias("pred_status"),
            F.when(line == 7, "n/a")
            .when(line == 6, "NaN")
            .otherwise((line % 2).cast("string"))
            .alias("judge_score"),
            F.when(line == 5, "error: timeout").otherwise("success").alias("status"),
            F.col("l_quantity").alias("latency"),
        )

    @staticmethod
    def request_log(events: DataFrame) -> DataFrame:
        """Serving log rows from a table (or stream) of events."""
        return events.select(
            F.col("event_id").alias("request_id"),
            "ts",
            _text("model-", F.col("user_id") % 5).alias("model_name"),
            F.col("value").alias("latency_ms"),
            (F.col("event_type") == "error").alias("is_error"),
        )

    @cached_property
    def requests(self) -> DataFrame:
        return self.request_log(self.events)

    @cached_property
    def reviewed(self) -> DataFrame:
        good, toxic = F.col("quality") == 1, F.col("toxic") == 1
        docs = self.table("documents").join(self.table("labels"), "doc_id", "left")
        return docs.select(
            F.col("doc_id").alias("_row_id"),
            F.col("lang").alias("original_lang"),
            F.col("text").alias("original_text"),
            F.col("source").alias("answer"),
            F.when(good & ~toxic, "good")
            .when(good, "fix")
            .when(F.col("quality") == 0, "bad")
            .alias("_quality"),
            F.when(good & toxic, _text("fixed-", F.col("source"))).alias("_corrected_answer"),
            F.when(F.col("doc_id") % 9 == 0, "error: timeout").otherwise("success").alias("_status"),
        )

    @cached_property
    def dataset_original(self) -> DataFrame:
        return self.table("documents").select(
            F.col("doc_id").alias("ord"),
            F.col("lang").alias("original_lang"),
            F.col("text").alias("original_text"),
            F.col("source").alias("answer"),
            "n_chars",
        )

    @cached_property
    def dataset_new(self) -> DataFrame:
        labelled = self.table("documents").join(self.table("labels").select("doc_id"), "doc_id")
        return labelled.select(
            F.col("doc_id").alias("ord"),
            _text("new-", F.col("source")).alias("answer"),
            F.col("text").alias("original_text"),
            F.col("lang").alias("original_lang"),
            F.lit("v2").alias("batch"),
        )

    @cached_property
    def models(self) -> DataFrame:
        brands = self.table("part").groupBy(F.col("p_brand").alias("model_name")).agg(
            _text("family ", F.min("p_type")).alias("description")
        )
        return brands.unionByName(
            self.table("supplier").select(
                F.col("s_name").alias("model_name"), F.lit(None).cast("string").alias("description")
            )
        )

    @cached_property
    def model_versions(self) -> DataFrame:
        part, size = F.col("p_partkey"), F.col("p_size")
        return self.table("part").select(
            F.col("p_brand").alias("model_name"),
            (part + 1).cast("string").alias("version"),
            F.when(part % 7 == 0, _text("run-lost-", part))
            .otherwise(_text("run-", part))
            .alias("run_id"),
            F.when(size % 4 == 0, "Production")
            .when(size % 4 == 1, "Staging")
            .when(size % 4 == 2, "Archived")
            .otherwise("None")
            .alias("stage"),
            (part * 1000 + EPOCH_MS).alias("creation_timestamp"),
            F.lit("topic,style").alias("tag_input_fields"),
            F.when(size % 2 == 0, "").otherwise("joke").alias("tag_output_fields"),
            F.when(part % 5 == 0, "").otherwise(size.cast("string")).alias("tag_score"),
        )

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("part").select(
            _text("run-", F.col("p_partkey")).alias("run_id"),
            F.col("p_size").cast("double").alias("evaluation_score"),
            (F.col("p_size") % 10).cast("double").alias("baseline_score"),
            F.col("p_name").alias("instructions"),
        )

    @cached_property
    def alias_events(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").alias("event_id"),
            F.col("o_orderdate").alias("ts"),
            _text("m", F.col("o_custkey") % 20).alias("model_name"),
            (F.col("o_orderkey") % 5 + 1).cast("string").alias("version"),
            F.when(status == "F", "Production")
            .when(status == "O", "Staging")
            .otherwise("Archived")
            .alias("stage"),
        )

    @cached_property
    def prompts(self) -> DataFrame:
        part, size = F.col("p_partkey"), F.col("p_size")
        inputs = (
            F.when(size % 3 == 0, "joke,topic")
            .when(size % 3 == 1, "topic")
            .otherwise("OriginalContent,Style")
        )
        return self.table("part").select(
            _text("p", part, ".json").alias("file_name"),
            F.split(inputs, ",").alias("input_fields"),
            F.array(F.when(size % 2 == 0, "funny").otherwise("joke")).alias("output_fields"),
            F.when(part % 6 == 0, "N/A").otherwise(size.cast("string")).alias("evaluation_score"),
            F.when(part % 4 != 0, _text("run-", part)).alias("run_id"),
            F.lit("gpt-4o-mini").alias("llm_model"),
            F.lit("ChainOfThought").alias("dspy_module"),
            F.lit("bootstrap_few_shot").alias("optimizer"),
        )

    @cached_property
    def program_files(self) -> DataFrame:
        return (
            self.table("lineitem")
            .select(_text("p", F.col("l_partkey"), ".json").alias("file_name"))
            .distinct()
        )

    @cached_property
    def demos(self) -> DataFrame:
        vec, fifth = F.col("vec_id"), F.col("vec_id") % 5 == 0
        return self.table("embeddings").select(
            F.floor(vec / 16).cast("long").alias("program_id"),
            vec.alias("demo_id"),
            fifth.alias("augmented"),
            F.when(fifth, _text("because of ", vec)).alias("reasoning"),
            _text("item ", vec).alias("question"),
            F.col("label").cast("string").alias("answer"),
        )

    @cached_property
    def programs(self) -> DataFrame:
        """One row per program with its (at most 16) demos in order."""
        listed = self.demos.groupBy("program_id").agg(
            F.collect_list(F.struct("demo_id", "question", "answer", "augmented", "reasoning")).alias(
                "rows"
            )
        )
        return listed.select(
            "program_id",
            F.transform(
                F.array_sort("rows"),
                lambda d: F.struct(
                    F.create_map(
                        F.lit("question"), d["question"], F.lit("answer"), d["answer"]
                    ).alias("fields"),
                    d["augmented"].alias("augmented"),
                    d["reasoning"].alias("reasoning"),
                ),
            ).alias("demos"),
        )

    @cached_property
    def embedding_pairs(self) -> DataFrame:
        vectors = self.table("embeddings")
        after = vectors.select(
            (F.col("vec_id") - 1).alias("example_id"), F.col("embedding").alias("pred_vec")
        )
        return vectors.select(
            F.col("vec_id").alias("example_id"), F.col("embedding").alias("gold_vec")
        ).join(after, "example_id")
