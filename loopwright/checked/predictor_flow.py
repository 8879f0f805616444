"""K and M with predictors that read whole prompts: asked once a prompt, parsed, scored."""

from pyspark.sql import functions as F

from loopwright.catalog import query
from loopwright.checked.aggregates import fingerprint_sql
from loopwright.checked.search_flow import MARKED, SPLIT, demo_sets, instruction_table
from loopwright.functions.metrics import COSINE_SIMILARITY, EXACT_MATCH, JUDGE
from loopwright.functions.prompts import SECTION_BREAK
from loopwright.operators.asking import PromptBook
from loopwright.operators.ordinal import split_train_dev
from loopwright.operators.scoring import (
    Judge,
    cosine_scorer,
    exact_scorer,
    judge_scorer,
    scorer_named,
)
from loopwright.plans import compile as compiling
from loopwright.plans import search
from loopwright.plans.programs import proposer_of, student_of, teacher_of
from loopwright.spec import TaskSpec

FLAGS = TaskSpec(("gold_status", "pred_status"), ("gold_flag",), "Give the flag of the line")
VERDICT = TaskSpec(("gold_flag", "verdict"), ("rating",), "Rate the verdict")


def shown_values(block):
    """The values of a prompt's ``Label: value`` lines."""
    return [line.partition(": ")[2] for line in block.split("\n") if ": " in line]


class DemoReader:
    """Answers as the first demo with the same inputs, else by a rule of its instructions.

    It refuses rows whose logged status is X and for which no demo fits.
    """

    def __call__(self, inputs):
        instructions, _, *demos, row = inputs["prompt"].split(SECTION_BREAK)
        asked = shown_values(row)
        for demo in demos:
            *given, flag = shown_values(demo)
            if given == asked:
                return f"Output:\ngold_flag: {flag}\n"
        if asked[1] == "X":
            raise ValueError("unknown status")
        found = "N" if asked[0] == "O" else "AR"[len(instructions) % 2]
        return f"Input:\nOutput:\ngold_flag: {found}\nstyle: none\n"


# What DemoReader says without a fitting demo, given the SQL text of the instructions.
def rule(instructions: str) -> str:
    return f"""CASE WHEN p.pred_status <> 'X' THEN
        CASE WHEN p.gold_status = 'O' THEN 'N'
             WHEN length({instructions}) % 2 = 0 THEN 'A' ELSE 'R' END END"""


BARE = rule(f"'{FLAGS.instructions}'")
PASSED = f"coalesce({BARE} = p.gold_flag, false)"


def program_runner(t, spec=FLAGS):
    book = PromptBook(t.spark, DemoReader, partitions=t.spark.sparkContext.defaultParallelism)
    scorer = exact_scorer(spec)
    return teacher_of(spec, book, scorer), student_of(spec, book, scorer)


def train_and_dev(t):
    return split_train_dev(t.predictions.select("example_id", *FLAGS.fields), ["example_id"])


@query(
    "K1_predictor_demos",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT},
    made AS (
        SELECT example_id, gold_status, pred_status, gold_flag, 0 AS draw FROM placed p
        WHERE train AND {PASSED} ORDER BY example_id LIMIT 4),
    labelled AS (
        SELECT example_id, gold_status, pred_status, gold_flag, row_number() OVER (
                 ORDER BY sha256('0-' || example_id), example_id) AS draw
        FROM placed WHERE train AND example_id NOT IN (SELECT example_id FROM made)),
    both_kinds AS (
        SELECT *, row_number() OVER (ORDER BY draw, example_id) AS position
        FROM (SELECT * FROM made UNION ALL SELECT * FROM labelled WHERE draw <= 16))
    SELECT CAST(position AS INTEGER) AS position, example_id, gold_status, pred_status,
           gold_flag AS answer, draw = 0 AS augmented
    FROM both_kinds WHERE position <= 16""",
)
def predictor_demos(t):
    teacher, _ = program_runner(t)
    train, _ = train_and_dev(t)
    found = search.bootstrap_demos(train, FLAGS, "example_id", teacher, max_labeled=16)
    fields = F.col("demo.fields")
    return found.select(
        "position",
        "example_id",
        fields["gold_status"].alias("gold_status"),
        fields["pred_status"].alias("pred_status"),
        fields["gold_flag"].alias("answer"),
        "demo.augmented",
    )


SEARCHED = f"""
    WITH {SPLIT}, {demo_sets(4, 2, 4, PASSED, "gold_status, pred_status")}"""


@query(
    "K2_predictor_search",
    uses=["predictions"],
    sql=SEARCHED + f""",
    scores AS (
        SELECT c.candidate_id, round(100 * avg(CASE WHEN coalesce(a.answer, {BARE}) = p.gold_flag
                                                    THEN 1 ELSE 0 END), 2) AS percent,
               count(*) AS examples
        FROM placed p CROSS JOIN (SELECT unnest(range(4))::INTEGER AS candidate_id) c
        LEFT JOIN answers a ON a.candidate_id = c.candidate_id AND a.gold_status = p.gold_status
                           AND a.pred_status = p.pred_status
        WHERE NOT p.train GROUP BY c.candidate_id)
    {MARKED}""",
)
def predictor_search(t):
    teacher, student = program_runner(t)
    train, dev = train_and_dev(t)
    programs = search.candidate_programs(
        train, FLAGS, "example_id", teacher, 4, max_bootstrapped=2, max_labeled=4
    )
    return search.random_search(dev, programs, 4, student)


@query(
    "K3_predictor_instructions",
    uses=["predictions"],
    sql=f"""
    WITH scores AS (
        SELECT r_regionkey AS candidate_id,
               round(100 * avg(CASE WHEN {rule('r_name')} = gold_flag THEN 1 ELSE 0 END), 2) AS percent,
               count(*) AS examples
        FROM predictions p, region GROUP BY r_regionkey)
    {MARKED}""",
)
def predictor_instructions(t):
    _, student = program_runner(t)
    rows = t.predictions.select("example_id", *FLAGS.fields)
    instructions = instruction_table(t)
    return search.instruction_search(rows, instructions, instructions.count(), student)


class Improver:
    """Proposes the best text shown, which comes last, with one more mark for each proposal."""

    def __call__(self, inputs):
        tried, number = shown_values(inputs["prompt"].split(SECTION_BREAK)[-1])[:2]
        best = tried.split("; ")[-1].partition(" ")[2]
        return f"Output:\ninstructions: {best}{'+' * int(number)}\n"


def scored_round(number: int, texts: str) -> str:
    """SQL of one round: new texts with their ids, and all scores so far."""
    before = "" if not number else f"SELECT * FROM scored{number - 1} UNION ALL "
    return f"""
    new{number} AS ({texts}),
    scored{number} AS (
        {before}SELECT {number} AS round, n.candidate_id, instructions,
               round(100 * avg(CASE WHEN {rule('instructions')} = gold_flag THEN 1 ELSE 0 END), 2)
                 AS percent, count(*) AS examples
        FROM predictions p, new{number} n GROUP BY n.candidate_id, instructions)"""


def proposed_round(number: int) -> str:
    before = f"scored{number - 1}"
    return scored_round(number, f"""
        SELECT CAST((SELECT count(*) FROM {before}) + row_number() OVER (ORDER BY text) - 1 AS INTEGER)
                 AS candidate_id, text AS instructions
        FROM (SELECT DISTINCT best || repeat('+', k) AS text
              FROM (SELECT arg_max(instructions, (percent, -candidate_id)) AS best FROM {before}),
                   (SELECT unnest([1, 2, 3]) AS k))
        WHERE text NOT IN (SELECT instructions FROM {before})""")


@query(
    "K3_instruction_rounds",
    uses=["predictions"],
    sql=f"""
    WITH {scored_round(0, "SELECT r_regionkey AS candidate_id, r_name AS instructions FROM region")},
    {proposed_round(1)}, {proposed_round(2)}
    SELECT *, candidate_id = arg_max(candidate_id, (percent, -candidate_id)) OVER () AS best
    FROM scored2""",
)
def instruction_rounds(t):
    _, student = program_runner(t)
    rows = t.predictions.select("example_id", *FLAGS.fields)
    propose = proposer_of(PromptBook(t.spark, Improver), breadth=3)
    return search.instruction_rounds(rows, instruction_table(t), student, propose, depth=3)


@query(
    "K5_predictor_compile",
    uses=["predictions"],
    sql=f"""
    WITH {SPLIT},
    made AS (
        SELECT gold_status, pred_status, gold_flag FROM placed p
        WHERE train AND {PASSED} ORDER BY example_id LIMIT 4),
    answers AS (SELECT gold_status, pred_status, min(gold_flag) AS answer FROM made GROUP BY ALL),
    final AS (
        SELECT round(100 * avg(CASE WHEN {BARE} = p.gold_flag THEN 1 ELSE 0 END), 2) AS bare,
               round(100 * avg(CASE WHEN coalesce(a.answer, {BARE}) = p.gold_flag
                                    THEN 1 ELSE 0 END), 2) AS score,
               count(*) AS n
        FROM placed p LEFT JOIN answers a
          ON a.gold_status = p.gold_status AND a.pred_status = p.pred_status WHERE NOT train)
    SELECT 'k5p' AS run_id, 'BootstrapFewShot' AS optimizer,
           'gold_status, pred_status -> gold_flag' AS signature,
           row_count, 'gold_status,pred_status,gold_flag' AS column_names, digest AS file_hash,
           row_count - n AS trainset_size, n AS devset_size, bare AS baseline_score,
           score AS evaluation_score, round(score - bare, 2) AS score_improvement
    FROM final, ({fingerprint_sql('predictions', ['gold_status', 'pred_status', 'gold_flag'])})""",
)
def predictor_compile(t):
    teacher, student = program_runner(t)
    done = compiling.compile_program(
        t.predictions, FLAGS, "example_id", compiling.BOOTSTRAP, teacher, student, run_id="k5p"
    )
    return done.summary


class VerdictJudge:
    """Rates what it is shown; some answers are no number, and some calls fail."""

    def __call__(self, inputs):
        flag, verdict = shown_values(inputs["prompt"].split(SECTION_BREAK)[-1])
        if verdict == "X":
            return "Output:\nrating: n/a\n"
        if flag == "A":
            raise ValueError("no opinion")
        return f"Output:\nrating: {1 if flag == 'R' and verdict == 'F' else 0.5}\n"


def judged_rows(t):
    return t.predictions.select(
        "example_id",
        "gold_flag",
        F.col("pred_flag").alias("pred_gold_flag"),
        F.col("pred_status").alias("pred_verdict"),
    )


RATED = """CASE WHEN pred_status = 'X' OR gold_flag = 'A' THEN 0.0
                WHEN gold_flag = 'R' AND pred_status = 'F' THEN 1.0 ELSE 0.5 END"""


@query(
    "M3_judge_run",
    uses=["predictions"],
    sql=f"""
    SELECT example_id, gold_flag, pred_flag AS pred_gold_flag, pred_status AS pred_verdict,
           CAST({RATED} AS DOUBLE) AS score
    FROM predictions""",
)
def judge_run(t):
    judge = Judge(VERDICT, PromptBook(t.spark, VerdictJudge))
    return judge_scorer(judge)(judged_rows(t))


def character_encoder():
    return lambda texts: [[len(x), x.count(" "), x.count("e")] for x in texts]


@query(
    "M2_text_cosine",
    uses=["qa_examples"],
    sql="""
    WITH v AS (
        SELECT example_id, [CAST(length(answer) AS DOUBLE), length(answer) - length(replace(answer, ' ', '')),
                            length(answer) - length(replace(answer, 'e', ''))] AS a,
               [CAST(length(question) AS DOUBLE), length(question) - length(replace(question, ' ', '')),
                length(question) - length(replace(question, 'e', ''))] AS b
        FROM qa_examples)
    SELECT example_id, round(list_cosine_similarity(a, b), 9) AS score FROM v""",
)
def text_cosine(t):
    spec = TaskSpec(("conv_id",), ("answer",))
    rows = t.qa_examples.withColumn("pred_answer", F.col("question"))
    scored = cosine_scorer(spec, character_encoder)(rows)
    return scored.select("example_id", F.round("score", 9).alias("score"))


@query(
    "M4_metric_by_name",
    uses=["predictions"],
    sql=f"""
    SELECT 'Exact Match' AS metric_name, count(*) AS examples,
           round(avg(CASE WHEN gold_flag = pred_flag THEN 1.0 ELSE 0.0 END), 6) AS score
    FROM predictions
    UNION ALL
    SELECT 'Cosine Similarity', count(*), round(avg(CASE WHEN pred_flag IS NULL THEN 0.0 ELSE 1.0 END), 6)
    FROM predictions
    UNION ALL
    SELECT 'LLM-as-a-Judge', count(*), round(avg({RATED}), 6) FROM predictions""",
)
def metric_by_name(t):
    rows, spec = judged_rows(t), TaskSpec(("example_id",), ("gold_flag",))
    judge = Judge(VERDICT, PromptBook(t.spark, VerdictJudge))
    found = None
    for name in (EXACT_MATCH, COSINE_SIMILARITY, JUDGE):
        scored = scorer_named(name, spec, character_encoder, judge)(rows)
        one = scored.agg(
            F.lit(name).alias("metric_name"),
            F.count(F.lit(1)).alias("examples"),
            F.round(F.avg(F.col("score").cast("double")), 6).alias("score"),
        )
        found = one if found is None else found.unionByName(one)
    return found
