"""K: demo bootstrapping and program search with predictors that are columns."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.aggregates import fingerprint_sql
from loopwright.functions.metrics import exact_match
from loopwright.operators.ordinal import split_train_dev
from loopwright.plans import compile as compiling
from loopwright.plans import search
from loopwright.sources.readers import read_programs, read_prompts
from loopwright.spec import TaskSpec

FLAGS = TaskSpec(("gold_status",), ("gold_flag",), "Give the flag of the line")


def log_teacher(rows):
    """The logged prediction of each row is the teacher's answer."""
    return rows.withColumns(
        {
            "pred_gold_flag": F.col("pred_flag"),
            "reasoning": F.concat(F.lit("produce "), "pred_flag"),
            "score": exact_match([F.col("gold_flag")], [F.col("pred_flag")]),
        }
    )


def lookup(demos, status):
    """The answer of the first demo with the same input."""
    same = F.filter(demos, lambda d: d["fields"]["gold_status"] == status)
    return F.try_element_at(same, F.lit(1))["fields"]["gold_flag"]


def lookup_student(rows):
    """Answers as the demos do; without a fitting demo there is no answer."""
    answer = lookup(F.col("demos"), F.col("gold_status"))
    return rows.withColumns(
        {"pred_gold_flag": answer, "score": exact_match([F.col("gold_flag")], [answer])}
    )


def instruction_student(rows):
    """Right when instruction and row fit each other."""
    right = (F.length("instructions") + F.length("example_id")) % 3 == 0
    answer = F.when(right, F.col("gold_flag")).otherwise("X")
    return rows.withColumn("score", exact_match([F.col("gold_flag")], [answer]))


def joint_student(rows):
    """Needs a fitting demo, or else a fitting instruction."""
    right = (F.length("instructions") + F.length("example_id")) % 3 == 0
    answer = F.coalesce(
        lookup(F.col("demos"), F.col("gold_status")), F.when(right, F.col("gold_flag"))
    )
    return rows.withColumn("score", exact_match([F.col("gold_flag")], [answer]))


def train_and_dev(t):
    rows = t.predictions.select("example_id", "gold_status", "gold_flag", "pred_flag")
    return split_train_dev(rows, ["example_id"])


def instruction_table(t):
    return t.table("region").select(
        F.col("r_regionkey").alias("candidate_id"), F.col("r_name").alias("instructions")
    )


SPLIT = """
    placed AS (
        SELECT *, row_number() OVER (ORDER BY example_id) <= floor(0.8 * count(*) OVER ()) AS train
        FROM predictions)"""


def demo_sets(
    count: int,
    bootstrapped: int,
    labeled: int,
    passed: str = "pred_flag = gold_flag",
    inputs: str = "gold_status",
) -> str:
    """Demo sets of candidates 1 to ``count - 1`` as SQL views."""
    seeds = ", ".join(f"('{i}')" for i in range(1, count))
    return f"""
    draws AS (
        SELECT s.seed, p.example_id, {inputs}, gold_flag, {passed} AS passed,
               sha256(s.seed || '-' || p.example_id) AS draw
        FROM placed p, (VALUES {seeds}) s(seed) WHERE train),
    made AS (
        SELECT *, 0 AS kind FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY draw, example_id) AS place
            FROM draws WHERE passed AND seed <> '1') WHERE place <= {bootstrapped}),
    labelled AS (
        SELECT *, 1 AS kind FROM (
            SELECT *, row_number() OVER (PARTITION BY seed ORDER BY draw, example_id) AS place
            FROM draws) WHERE place <= {labeled + bootstrapped}
          AND (seed, example_id) NOT IN (SELECT (seed, example_id) FROM made)),
    picks AS (
        SELECT *, row_number() OVER (PARTITION BY seed ORDER BY kind, place) AS position
        FROM (SELECT * FROM made UNION ALL SELECT * FROM labelled)),
    demo_rows AS (
        SELECT CAST(seed AS INTEGER) AS candidate_id, position, example_id, {inputs}, gold_flag,
               kind = 0 AS augmented
        FROM picks WHERE kind = 0 OR position <= {labeled}),
    answers AS (
        SELECT candidate_id, {inputs}, arg_min(gold_flag, position) AS answer
        FROM demo_rows GROUP BY candidate_id, {inputs})"""


MARKED = """
    SELECT candidate_id, percent, examples,
           candidate_id = arg_max(candidate_id, (percent, -candidate_id)) OVER () AS best
    FROM scores"""


@query(
    "K1_bootstrap_demos",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT},
    made AS (
        SELECT example_id, gold_flag, 0 AS draw FROM placed
        WHERE train AND pred_flag = gold_flag ORDER BY example_id LIMIT 4),
    labelled AS (
        SELECT example_id, gold_flag, row_number() OVER (
                 ORDER BY sha256('0-' || example_id), example_id) AS draw
        FROM placed WHERE train AND example_id NOT IN (SELECT example_id FROM made)),
    both_kinds AS (
        SELECT *, row_number() OVER (ORDER BY draw, example_id) AS position
        FROM (SELECT * FROM made UNION ALL SELECT * FROM labelled WHERE draw <= 16))
    SELECT CAST(position AS INTEGER) AS position, example_id, gold_flag AS answer,
           draw = 0 AS augmented, CASE WHEN draw = 0 THEN 'produce ' || gold_flag END AS reasoning
    FROM both_kinds WHERE position <= 16""",
)
def bootstrap_demos(t):
    train, _ = train_and_dev(t)
    found = search.bootstrap_demos(train, FLAGS, "example_id", log_teacher, max_labeled=16)
    return found.select(
        "position",
        "example_id",
        F.col("demo.fields")["gold_flag"].alias("answer"),
        "demo.augmented",
        "demo.reasoning",
    )


@query(
    "K2_random_search",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT}, {demo_sets(4, 2, 4)},
    scores AS (
        SELECT c.candidate_id,
               round(100 * avg(CASE WHEN a.answer = p.gold_flag THEN 1 ELSE 0 END), 2) AS percent,
               count(*) AS examples
        FROM placed p CROSS JOIN (SELECT unnest(range(4))::INTEGER AS candidate_id) c
        LEFT JOIN answers a ON a.candidate_id = c.candidate_id AND a.gold_status = p.gold_status
        WHERE NOT p.train GROUP BY c.candidate_id)
    {MARKED}""",
)
def random_search(t):
    train, dev = train_and_dev(t)
    programs = search.candidate_programs(
        train, FLAGS, "example_id", log_teacher, 4, max_bootstrapped=2, max_labeled=4
    )
    return search.random_search(dev, programs, 4, lookup_student)


@query(
    "K3_instruction_search",
    uses=["predictions"],
    sql=f"""
    WITH scores AS (
        SELECT r_regionkey AS candidate_id,
               round(100 * avg(CASE WHEN (length(r_name) + length(example_id)) % 3 = 0
                                    THEN 1 ELSE 0 END), 2) AS percent, count(*) AS examples
        FROM predictions, region GROUP BY r_regionkey)
    {MARKED}""",
)
def instruction_search(t):
    rows = t.predictions.select("example_id", "gold_status", "gold_flag")
    instructions = instruction_table(t)
    return search.instruction_search(
        rows, instructions, instructions.count(), instruction_student
    )


@query(
    "K4_joint_search",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT}, {demo_sets(3, 2, 4)},
    batches AS (
        SELECT * FROM (
            SELECT p.*, b.batch, row_number() OVER (
                     PARTITION BY b.batch ORDER BY sha256(b.batch || '-' || example_id), example_id)
                     AS draw
            FROM placed p, (SELECT 'batch' || unnest(range(6)) AS batch) b WHERE NOT train)
        WHERE draw <= 50),
    per_batch AS (
        SELECT CAST(r.r_regionkey * 3 + c.demo_set AS INTEGER) AS candidate_id, p.batch,
               round(100 * avg(CASE
                   WHEN a.answer IS NOT NULL THEN CASE WHEN a.answer = p.gold_flag THEN 1 ELSE 0 END
                   WHEN (length(r.r_name) + length(p.example_id)) % 3 = 0 THEN 1 ELSE 0 END), 2)
                 AS percent, count(*) AS examples
        FROM batches p CROSS JOIN region r
        CROSS JOIN (SELECT unnest(range(3))::INTEGER AS demo_set) c
        LEFT JOIN answers a ON a.candidate_id = c.demo_set AND a.gold_status = p.gold_status
        GROUP BY ALL),
    scores AS (
        SELECT candidate_id, round(avg(percent), 4) AS percent,
               CAST(sum(examples) AS BIGINT) AS examples
        FROM per_batch GROUP BY candidate_id)
    {MARKED}""",
)
def joint_search(t):
    train, dev = train_and_dev(t)
    sets = search.candidate_programs(
        train, FLAGS, "example_id", log_teacher, 3, max_bootstrapped=2, max_labeled=4
    )
    instructions = instruction_table(t)
    programs = search.joint_candidates(instructions, sets, 3)
    return search.joint_search(
        dev,
        programs,
        instructions.count() * 3,
        "example_id",
        joint_student,
        num_batches=6,
        batch_rows=50,
    )


@query(
    "K4_racing_search",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT}, {demo_sets(3, 2, 4)},
    batches AS (
        SELECT * FROM (
            SELECT p.*, b.batch, row_number() OVER (
                     PARTITION BY b.batch ORDER BY sha256(b.batch || '-' || example_id), example_id)
                     AS draw
            FROM placed p, (SELECT 'batch' || unnest(range(30)) AS batch) b WHERE NOT train)
        WHERE draw <= 25),
    per_batch AS (
        SELECT CAST(r.r_regionkey * 3 + c.demo_set AS INTEGER) AS candidate_id, p.batch,
               round(100 * avg(CASE
                   WHEN a.answer IS NOT NULL THEN CASE WHEN a.answer = p.gold_flag THEN 1 ELSE 0 END
                   WHEN (length(r.r_name) + length(p.example_id)) % 3 = 0 THEN 1 ELSE 0 END), 2)
                 AS percent, count(*) AS examples
        FROM batches p CROSS JOIN region r
        CROSS JOIN (SELECT unnest(range(3))::INTEGER AS demo_set) c
        LEFT JOIN answers a ON a.candidate_id = c.demo_set AND a.gold_status = p.gold_status
        GROUP BY ALL),
    scores AS (
        SELECT candidate_id, round(avg(percent), 4) AS percent,
               CAST(sum(examples) AS BIGINT) AS examples, CAST(count(*) AS INTEGER) AS batches
        FROM per_batch GROUP BY candidate_id)
    SELECT * FROM scores ORDER BY percent DESC, candidate_id LIMIT 1""",
)
def racing_search(t):
    """The winner, which saw all batches: that of the full search."""
    train, dev = train_and_dev(t)
    sets = search.candidate_programs(
        train, FLAGS, "example_id", log_teacher, 3, max_bootstrapped=2, max_labeled=4
    )
    instructions = instruction_table(t)
    programs = search.joint_candidates(instructions, sets, 3)
    scores = search.racing_search(
        dev, programs, instructions.count() * 3, "example_id", joint_student
    )
    return scores.filter("best").drop("best")


def digest_teacher(rows):
    """Right for the half of the rows whose key digest starts low."""
    right = F.left(F.sha2("example_id", 256), F.lit(1)) < "8"
    answer = F.when(right, F.col("gold_flag")).otherwise("X")
    return rows.withColumns(
        {"pred_gold_flag": answer, "score": exact_match([F.col("gold_flag")], [answer])}
    )


@query(
    "K5_compile",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT},
    made AS (
        SELECT gold_status, gold_flag, row_number() OVER (ORDER BY example_id) AS position
        FROM placed WHERE train AND left(sha256(example_id), 1) < '8'
        ORDER BY example_id LIMIT 4),
    answers AS (SELECT gold_status, arg_min(gold_flag, position) AS answer FROM made
                GROUP BY gold_status),
    final AS (
        SELECT round(100 * avg(CASE WHEN a.answer = p.gold_flag THEN 1 ELSE 0 END), 2) AS score,
               count(*) AS n
        FROM placed p LEFT JOIN answers a ON a.gold_status = p.gold_status WHERE NOT train)
    SELECT 'k5' AS run_id, 'BootstrapFewShot' AS optimizer, 'gold_status -> gold_flag' AS signature,
           row_count, 'gold_status,gold_flag' AS column_names, digest AS file_hash,
           row_count - n AS trainset_size, n AS devset_size, CAST(0 AS DOUBLE) AS baseline_score,
           score AS evaluation_score, score AS score_improvement
    FROM final, ({fingerprint_sql('predictions', ['gold_status', 'gold_flag'])})""",
)
def compiled(t):
    return compiled_flags(t).summary


def compiled_flags(t):
    return compiling.compile_program(
        t.predictions,
        FLAGS,
        "example_id",
        compiling.BOOTSTRAP,
        digest_teacher,
        lookup_student,
        run_id="k5",
        model="gpt-4o-mini",
    )


MADE = f"""
    WITH {SPLIT},
    made AS (
        SELECT gold_status, gold_flag, row_number() OVER (ORDER BY example_id) AS position
        FROM placed WHERE train AND left(sha256(example_id), 1) < '8'
        ORDER BY example_id LIMIT 4),
    answers AS (SELECT gold_status, arg_min(gold_flag, position) AS answer FROM made
                GROUP BY gold_status)"""


@query(
    "K5_program_reload",
    uses=["predictions"],
    sql=MADE + """
    SELECT CAST(position AS INTEGER) AS position, gold_status, gold_flag, true AS augmented
    FROM made""",
)
def program_reload(t):
    read = read_programs(t.spark, f"{compiled_flags(t).path}/program")
    demos = read.select(F.posexplode("demos").alias("place", "demo"))
    return demos.select(
        (F.col("place") + 1).alias("position"),
        F.col("demo.fields")["gold_status"].alias("gold_status"),
        F.col("demo.fields")["gold_flag"].alias("gold_flag"),
        "demo.augmented",
    )


@query(
    "K5_metadata",
    uses=["predictions"],
    sql=MADE + """
    SELECT 'gold_status' AS inputs, 'gold_flag' AS outputs, 'Predict' AS dspy_module,
           'gpt-4o-mini' AS llm_model, 'BootstrapFewShot' AS optimizer,
           'gold_status -> gold_flag' AS signature, 'k5' AS run_id,
           'GoldStatus:GoldFlag-Gpt4oMini_Predict_Bootstrapfewshot-19700101' AS human_readable_id,
           round(100 * avg(CASE WHEN a.answer = p.gold_flag THEN 1 ELSE 0 END), 2) AS score
    FROM placed p LEFT JOIN answers a ON a.gold_status = p.gold_status WHERE NOT train""",
)
def program_metadata(t):
    read = read_prompts(t.spark, f"{compiled_flags(t).path}/prompt")
    return read.select(
        F.array_join("input_fields", ",").alias("inputs"),
        F.array_join("output_fields", ",").alias("outputs"),
        "dspy_module",
        "llm_model",
        "optimizer",
        "signature",
        "run_id",
        "human_readable_id",
        F.col("evaluation_score").cast("double").alias("score"),
    )


@query(
    "K5_evaluation_rows",
    uses=["predictions"],
    sql=MADE + """
    SELECT example_id, '{"gold_status":"' || p.gold_status || '"}' AS input,
           '{"gold_flag":"' || p.gold_flag || '"}' AS expected_output,
           CASE WHEN a.answer IS NULL THEN '{}' ELSE '{"gold_flag":"' || a.answer || '"}' END
             AS actual_output,
           CAST(coalesce(a.answer = p.gold_flag, false) AS DOUBLE) AS score, 'unknown' AS metric_name
    FROM placed p LEFT JOIN answers a ON a.gold_status = p.gold_status WHERE NOT train""",
)
def program_evaluation(t):
    return compiled_flags(t).evaluation
