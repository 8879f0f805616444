"""Prompt books, table metrics, and searches that a predictor drives, on small cases."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from loopwright.functions.metrics import COSINE_SIMILARITY, EXACT_MATCH, JUDGE
from loopwright.functions.prompts import DEMO_TYPE, SECTION_BREAK
from loopwright.operators.asking import PromptBook, with_answers
from loopwright.operators.evaluation import fan_out
from loopwright.operators.scoring import (
    Judge,
    cosine_scorer,
    exact_scorer,
    judge_scorer,
    program_columns,
    scorer_named,
)
from loopwright.plans import compile as compiling
from loopwright.plans import search
from loopwright.plans.programs import proposer_of, student_of, teacher_of
from loopwright.spec import TaskSpec

# Workers cannot import this file.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

QA = TaskSpec(("question",), ("answer",), "Answer")
DEMOS = f"array<{DEMO_TYPE}>"


def counted(spark, answer):
    """A predictor and the number of calls it gets, over all tasks."""
    calls = spark.sparkContext.accumulator(0)

    def make():
        def ask(inputs):
            calls.add(1)
            return answer(inputs["prompt"])

        return ask

    return make, calls


def echo(prompt):
    question = prompt.split(SECTION_BREAK)[-1].split("\n")[0].partition(": ")[2]
    if question == "boom":
        raise RuntimeError("no answer")
    return f"Output:\nanswer: {question.upper()}\n" if question else "nothing to say"


def questions(spark, texts, answers=None):
    rows = [(i, q, (answers or texts)[i]) for i, q in enumerate(texts)]
    return spark.createDataFrame(rows, "id int, question string, answer string")


def test_equal_prompts_are_asked_once_in_all_calls(spark):
    make, calls = counted(spark, echo)
    book = PromptBook(spark, make)
    rows = questions(spark, ["a", "b", "a", None, "a", "boom", "", "boom"]).repartition(4)
    found = with_answers(rows, F.concat_ws(SECTION_BREAK, F.lit("x"), F.concat(F.lit("Question: "), F.coalesce("question", F.lit("")))), book, ["answer"])
    got = {r["id"]: r["pred_answer"] for r in found.collect()}
    assert got == {0: "A", 1: "B", 2: "A", 3: None, 4: "A", 5: None, 6: None, 7: None}
    assert calls.value == 4
    assert found.columns == ["id", "question", "answer", "pred_answer"]
    found.collect()
    assert calls.value == 4  # answers are written, not made again
    teacher = teacher_of(QA, book, exact_scorer(QA))
    teacher(rows).collect()
    assert calls.value == 8  # other prompts; the failed one is asked
    teacher(questions(spark, ["a", "boom", "c"])).collect()
    assert calls.value == 10  # "c" is new, "boom" had failed
    assert book.answers().count() == 3 + 3 + 1  # NULL and empty questions render the same


def test_teacher_and_student_share_a_book(spark):
    make, calls = counted(spark, echo)
    book = PromptBook(spark, make)
    rows = questions(spark, ["a", "b", "boom"], ["A", "x", "BOOM"])
    taught = teacher_of(QA, book, exact_scorer(QA))(rows).orderBy("id").collect()
    assert [r["score"] for r in taught] == [1, 0, 0]
    assert calls.value == 3
    bare = rows.filter("id < 2").select(
        "*", F.lit(0).alias("candidate_id"), F.lit(None).cast("string").alias("instructions"),
        F.array().cast(DEMOS).alias("demos"),
    )
    learnt = student_of(QA, book, exact_scorer(QA))(bare)
    assert learnt.columns == ["id", "question", "answer", "candidate_id", "pred_answer", "score"]
    assert [r["score"] for r in learnt.orderBy("id").collect()] == [1, 0]
    assert calls.value == 3  # the bare student renders the teacher's prompts


def test_reasoning_and_a_teacher_with_a_program(spark):
    spec = TaskSpec(("question",), ("answer",), "Think", module="ChainOfThought")

    def answer(prompt):
        demos = prompt.count("Question: ") - 2
        return f"Output:\nreasoning: {demos} demos\nanswer: {prompt.split(SECTION_BREAK)[0]}\n"

    make, _ = counted(spark, answer)
    rows = questions(spark, ["q"], ["Reason well"])
    program = spark.createDataFrame(
        [("Reason well", [({"question": "a", "answer": "b"}, True, "so")])], f"instructions string, demos {DEMOS}"
    )
    book = PromptBook(spark, make)
    row = teacher_of(spec, book, exact_scorer(spec), program)(rows).first()
    assert (row["reasoning"], row["pred_answer"], row["score"]) == ("1 demos", "Reason well", 1)
    row = teacher_of(spec, book, exact_scorer(spec))(rows).first()
    assert (row["reasoning"], row["pred_answer"], row["score"]) == ("0 demos", "Think", 0)
    with pytest.raises(ValueError, match="empty"):
        program_columns(program.limit(0))


def programs_and_rows(spark):
    demo = [({"question": "a", "answer": "b"}, False, None)]
    programs = spark.createDataFrame(
        [(0, "Answer", []), (1, None, demo), (2, "Answer", []), (3, "Say", demo)],
        f"candidate_id int, instructions string, demos {DEMOS}",
    ).localCheckpoint()
    rows = questions(spark, ["a", "b", None, "", "a", "boom", "b"] * 5).withColumn("pred_answer", F.lit("x"))
    return rows.union(rows.limit(3)), programs


def test_rows_render_no_prompts_when_inputs_are_few(spark, capsys):
    make, calls = counted(spark, echo)
    rows, programs = programs_and_rows(spark)
    student = student_of(QA, PromptBook(spark, make), exact_scorer(QA))
    scores = search.score_candidates(rows, programs, 4, student)
    scores.explain()
    assert "sha2" not in capsys.readouterr().out
    assert {r["examples"] for r in scores.collect()} == {38}
    # NULL and empty inputs make one prompt; programs 0 and 2 make the same ones.
    assert calls.value == 3 * 4


@pytest.mark.parametrize("few", [True, False])
def test_a_student_over_candidates_answers_as_over_joined_rows(spark, monkeypatch, few):
    make, _ = counted(spark, echo)
    rows, programs = programs_and_rows(spark)
    student = student_of(QA, PromptBook(spark, make), exact_scorer(QA))
    wanted = [0, 1, 3]
    key = lambda r: tuple(str(v) for v in r)
    joined = student(fan_out(rows, programs, wanted))
    expected = sorted(joined.collect(), key=key)
    if not few:
        monkeypatch.setattr("loopwright.plans.programs.is_small", lambda df: False)
    found = search.studied(rows, programs, wanted, student)
    assert found.columns == joined.columns and sorted(found.collect(), key=key) == expected


def test_judge_sees_gold_first_and_keeps_the_row(spark):
    def answer(prompt):
        row = prompt.split(SECTION_BREAK)[-1]
        if "Verdict: same" in row:
            return "Output:\nrating: 0.75\n"
        return "Output:\nrating: NaN\n" if "Verdict: odd" in row else "no marker"

    make, calls = counted(spark, answer)
    spec = TaskSpec(("answer", "verdict", "unknown"), ("rating",), "Rate")
    rows = spark.createDataFrame(
        [(1, "a", "b", "same", "own"), (2, "a", "c", "same", "own"), (3, "a", "b", "odd", "own"), (4, None, None, None, None)],
        "id int, answer string, pred_answer string, pred_verdict string, pred_rating string",
    )
    found = judge_scorer(Judge(spec, PromptBook(spark, make)))(rows)
    assert found.columns == [*rows.columns, "score"]
    got = {r["id"]: (r["score"], r["pred_rating"]) for r in found.collect()}
    assert got == {1: (0.75, "own"), 2: (0.75, "own"), 3: (0.0, "own"), 4: (0.0, None)}
    assert calls.value == 3
    two = TaskSpec(("answer",), ("rating", "why"), "Rate")
    assert {r["score"] for r in judge_scorer(Judge(two, PromptBook(spark, make)))(rows).collect()} == {0.0}
    assert calls.value == 3


def test_cosine_of_missing_predictions_and_zero_vectors(spark):
    spec = TaskSpec(("q",), ("a", "b"))
    rows = spark.createDataFrame(
        [(1, "xx", "y", "xx", "y"), (2, "xx", "y", None, "y"), (3, "", "", "", "")],
        "q int, a string, b string, pred_a string, pred_b string",
    )
    scored = cosine_scorer(spec, lambda: lambda texts: [[len(t)] for t in texts])(rows)
    assert scored.columns == [*rows.columns, "score"]
    assert {r["q"]: r["score"] and round(r["score"], 9) for r in scored.collect()} == {1: 1.0, 2: 0.0, 3: None}


def test_metric_names(spark):
    assert scorer_named(EXACT_MATCH, QA)
    for name, need in ((COSINE_SIMILARITY, "encoder"), (JUDGE, "judge"), ("other", "unknown")):
        with pytest.raises(ValueError, match=need):
            scorer_named(name, QA)


@pytest.mark.parametrize("optimizer", [compiling.BOOTSTRAP, compiling.RANDOM_SEARCH, compiling.INSTRUCTIONS])
def test_a_compile_asks_each_prompt_once(spark, optimizer):
    asked = spark.sparkContext.accumulator(0)

    def make():
        def ask(inputs):
            asked.add(1)
            return echo(inputs["prompt"])

        return ask

    book = PromptBook(spark, make)
    texts = [f"q{i % 7}" for i in range(60)]
    rows = questions(spark, texts, [t.upper() if i % 3 else "no" for i, t in enumerate(texts)])
    scorer = exact_scorer(QA)
    instructions = spark.createDataFrame([(0, "Answer"), (1, "Answer well")], "candidate_id int, instructions string")
    done = compiling.compile_program(
        rows, QA, "id", optimizer, teacher_of(QA, book, scorer), student_of(QA, book, scorer),
        instructions=instructions, num_candidates=4, run_id="p",
    )
    summary = done.summary.first()
    assert summary["devset_size"] == 12
    assert asked.value == book.answers().count()  # every good answer came from one call
    evaluation = done.evaluation.collect()
    assert len(evaluation) == 12 and all(r["actual_output"] for r in evaluation)


def test_compile_with_proposed_instructions(spark):
    def study(prompt):
        instructions, _, row = prompt.split(SECTION_BREAK)
        question = row.split("\n")[0].partition(": ")[2]
        known = question in instructions
        return f"Output:\nanswer: {'yes' if known else 'no'}\n"

    def improve(prompt):
        row = prompt.split(SECTION_BREAK)[-1]
        tried, number = (line.partition(": ")[2] for line in row.split("\n\n")[:2])
        return f"Output:\ninstructions: {tried.split('; ')[-1].partition(' ')[2]} q{number}\n"

    rows = questions(spark, [f"q{i % 4}" for i in range(40)], ["yes"] * 40)
    make, calls = counted(spark, study)
    book = PromptBook(spark, make)
    proposals, asked = counted(spark, improve)
    first = spark.createDataFrame([(0, "Answer")], "candidate_id int, instructions string")
    done = compiling.compile_program(
        rows, QA, "id", compiling.INSTRUCTIONS, teacher_of(QA, book, exact_scorer(QA)),
        student_of(QA, book, exact_scorer(QA)), instructions=first, run_id="c",
        propose=proposer_of(PromptBook(spark, proposals), breadth=3), depth=4,
    )
    assert done.scores.agg(F.max("round")).first()[0] == 3 and asked.value == 9
    best = done.scores.filter("best").first()
    assert best["percent"] == 75.0 and done.program.first()["instructions"] == best["instructions"]
    assert done.summary.first()["evaluation_score"] == 75.0  # q1, q2 and q3, not q0
    assert calls.value == book.answers().count()


def test_an_empty_table_asks_nothing(spark):
    make, calls = counted(spark, echo)
    book = PromptBook(spark, make)
    rows = questions(spark, ["a"]).limit(0)
    assert teacher_of(QA, book, exact_scorer(QA))(rows).collect() == []
    assert calls.value == 0
