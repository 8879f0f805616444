"""B: batch inference, prompts, responses and embeddings."""

import hashlib

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.texts import RESPONSE, responses
from loopwright.functions.prompts import render_prompt
from loopwright.operators import predict
from loopwright.spec import TaskSpec

QA = TaskSpec(("question",), ("answer_code", "note"), "Answer the question")


class DigestPredictor:
    """Answers with a digest of the question and refuses one question in eight."""

    def __call__(self, inputs):
        digest = hashlib.sha256(inputs["question"].encode("utf-8")).hexdigest()
        if digest[0] in "01":
            raise ValueError(f"refused {digest[:4]}")
        return {"answer_code": digest[:8], "note": None}


@query(
    "B1_batch_predict",
    uses=["qa_examples"],
    sql="""
    SELECT example_id, question,
           CASE WHEN left(code, 1) IN ('0', '1') THEN '' ELSE left(code, 8) END AS answer_code,
           '' AS note,
           CASE WHEN left(code, 1) IN ('0', '1') THEN 'error: refused ' || left(code, 4)
                ELSE 'success' END AS _status
    FROM (SELECT *, sha256(question) AS code FROM qa_examples)""",
)
def batch_predict(t):
    return predict.batch_predict(t.qa_examples, QA, DigestPredictor, keep=["example_id"])


@query(
    "B1_column_predict",
    uses=["qa_examples"],
    sql="""
    SELECT example_id, question, CASE WHEN n > 60 THEN left(code, 8) ELSE '' END AS answer_code,
           CASE WHEN n > 60 THEN CAST(n AS VARCHAR) ELSE '' END AS note,
           CASE WHEN n > 60 THEN 'success' ELSE 'error: no answer' END AS _status
    FROM (SELECT *, sha256(question) AS code, length(question) AS n FROM qa_examples)""",
)
def column_predict(t):
    def answer(inputs):
        size = F.length(inputs["question"])
        return {
            "answer_code": F.when(size > 60, F.left(F.sha2(inputs["question"], 256), F.lit(8))),
            "note": size,
        }

    return predict.column_predict(t.qa_examples, QA, answer, keep=["example_id"])


@query(
    "T15_result_forms",
    uses=["qa_examples"],
    sql="""
    SELECT example_id, CASE WHEN left(code, 1) IN ('0', '1', '2', '3') THEN ''
                            ELSE left(code, 8) END AS output, 'success' AS _status
    FROM (SELECT *, sha256(question) AS code FROM qa_examples)""",
)
def result_forms(t):
    class Answer:
        def __init__(self, output):
            self.output = output
            self._hidden = "not a field"

    def make():
        def answer(inputs):
            code = hashlib.sha256(inputs["question"].encode("utf-8")).hexdigest()
            if code[0] in "0123":
                return None
            if code[0] in "4567":
                return {"output": code[:8]}
            return Answer(code[:8]) if code[0] in "89ab" else code[:8]

        return answer

    spec = TaskSpec(("question",), ("output",))
    found = predict.batch_predict(t.qa_examples, spec, make, keep=["example_id"])
    return found.select("example_id", "output", "_status")


@query(
    "B3_prompt_rendering",
    uses=["demos"],
    sql="""
    WITH shown AS (
        SELECT program_id, string_agg(
                 'Question: ' || question
                 || CASE WHEN augmented
                         THEN chr(10) || chr(10) || 'Reasoning: Let''s think step by step in order to '
                              || reasoning || chr(10) || chr(10)
                         ELSE chr(10) END || 'Answer: ' || answer,
                 chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY demo_id) AS demos
        FROM demos GROUP BY program_id)
    SELECT d.demo_id,
           'Label the item' || sep || 'Follow the following format.' || nl || 'Question: The item'
           || nl || 'Reasoning: Let''s think step by step in order to ${produce the answer}. We ...'
           || nl || 'Answer: ${answer}' || sep || s.demos || sep || 'Question: ' || d.question || nl
           || 'Reasoning: Let''s think step by step in order to' AS prompt
    FROM demos d JOIN shown s ON d.program_id = s.program_id,
         (SELECT chr(10) || chr(10) AS nl,
                 chr(10) || chr(10) || '---' || chr(10) || chr(10) AS sep)""",
)
def prompt_rendering(t):
    spec = TaskSpec(("question",), ("answer",), "Label the item", ("The item",), (), "ChainOfThought")
    rows = t.demos.select("program_id", "demo_id", "question").join(t.programs, "program_id")
    return rows.select(
        "demo_id",
        render_prompt(spec, F.col("demos"), {"question": F.col("question")}).alias("prompt"),
    )


@query(
    "B4_parsed_responses",
    uses=["qa_examples"],
    sql=f"""
    WITH responses AS ({RESPONSE}),
    lines AS (
        SELECT example_id, unnest(string_split(list_extract(string_split(response, 'Output:'), -1),
                                               chr(10))) AS line,
               generate_subscripts(string_split(list_extract(string_split(response, 'Output:'), -1),
                                                chr(10)), 1) AS place
        FROM responses)
    SELECT example_id,
           coalesce(arg_max(trim(line[instr(line, ':') + 1:]), place)
                      FILTER (trim(line[:instr(line, ':') - 1]) = 'answer'), '') AS answer,
           '' AS missing
    FROM lines WHERE contains(line, ':') GROUP BY example_id""",
)
def parsed_responses(t):
    return predict.parse_responses(
        responses(t), "response", ["answer", "missing"], keep=["example_id"]
    )


@query(
    "B5_embedding",
    uses=["qa_examples"],
    sql="""
    SELECT example_id, CAST(length(question) AS DOUBLE) AS chars,
           CAST(length(question) - length(replace(question, ' ', '')) AS DOUBLE) AS spaces
    FROM qa_examples""",
)
def embedding(t):
    def make():
        return lambda texts: [[len(x), x.count(" ")] for x in texts]

    rows = predict.with_embedding(t.qa_examples, "question", make)
    return rows.select(
        "example_id",
        F.col("embedding")[0].cast("double").alias("chars"),
        F.col("embedding")[1].cast("double").alias("spaces"),
    )
