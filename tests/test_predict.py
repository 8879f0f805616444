"""Batch inference, prompts, programs and search on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from loopwright.functions.prompts import DEMO_TYPE, render_prompt
from loopwright.operators import demos, predict
from loopwright.plans import compile as compiling
from loopwright.plans import search
from loopwright.sources import readers, writers
from loopwright.spec import TaskSpec

QA = TaskSpec(("question",), ("answer",))


def test_batch_predict_isolates_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, None)], "id int, question string")

    def make():
        def answer(inputs):
            if inputs["question"] == "boom":
                raise RuntimeError("no answer")
            return {"answer": inputs["question"].upper(), "extra": 1}

        return answer

    found = predict.batch_predict(df, QA, make, keep=["id"], partitions=2)
    assert found.columns == ["id", "question", "answer", "_status"]
    rows = {r["id"]: (r["question"], r["answer"], r["_status"]) for r in found.collect()}
    assert rows == {
        1: ("a", "A", "success"),
        2: ("boom", "", "error: no answer"),
        3: ("", "", "success"),
    }


def test_batch_predictor(spark):
    class Many:
        def __call__(self, inputs):
            if inputs["question"] == "boom":
                raise RuntimeError("alone")
            return "one"

        def batch(self, rows):
            if any(row["question"] == "boom" for row in rows):
                raise RuntimeError("together")
            return [{"answer": "many"} for _ in rows]

    def statuses(questions):
        df = spark.createDataFrame([(q,) for q in questions], "question string").coalesce(1)
        rows = predict.batch_predict(df, QA, Many).collect()
        return [(r["answer"], r["_status"]) for r in rows]

    assert statuses(["a", "b"]) == [("many", "success")] * 2
    assert statuses(["a", "boom"]) == [("", "success"), ("", "error: alone")]


def test_batch_predict_checks_the_header(spark):
    df = spark.createDataFrame([("a",)], "wrong_field string")
    with pytest.raises(ValueError):
        predict.batch_predict(df, QA, lambda: None)


def test_result_forms():
    class Answer:
        def __init__(self):
            self.joke, self._private = "x", 1

    assert predict.result_fields(None) == {}
    assert predict.result_fields({"a": 1}) == {"a": 1}
    assert predict.result_fields(Answer()) == {"joke": "x"}
    assert predict.result_fields("text") == {"output": "text"}


def prompt(spark, spec, demo_rows):
    df = spark.createDataFrame([("cats", demo_rows)], f"topic string, demos array<{DEMO_TYPE}>")
    return df.select(render_prompt(spec, F.col("demos"), {"topic": F.col("topic")})).first()[0]


def test_prompt_layout(spark):
    spec = TaskSpec(("topic",), ("joke",), "Tell a joke", ("The topic",), ("The joke",), "ChainOfThought")
    shown = [
        ({"topic": "dogs", "joke": "woof"}, True, "think of dogs"),
        ({"topic": "food", "joke": "yum"}, False, None),
    ]
    assert prompt(spark, spec, shown) == (
        "Tell a joke\n\n---\n\nFollow the following format.\n\nTopic: The topic\n\n"
        "Reasoning: Let's think step by step in order to ${produce the joke}. We ...\n\n"
        "Joke: The joke\n\n---\n\nTopic: dogs\n\n"
        "Reasoning: Let's think step by step in order to think of dogs\n\nJoke: woof\n\n---\n\n"
        "Topic: food\nJoke: yum\n\n---\n\nTopic: cats\n\n"
        "Reasoning: Let's think step by step in order to"
    )


def test_prompt_of_other_modules(spark):
    plain = TaskSpec(("topic",), ("joke",), "Tell a joke")
    assert prompt(spark, plain, []).endswith("---\n\nTopic: cats\n\nJoke:")
    hinted = TaskSpec(
        ("topic",), ("joke",), "Tell a joke", module="ChainOfThoughtWithHint", hint="be short"
    )
    assert "Topic: cats\n\nHint: be short\n\nReasoning:" in prompt(spark, hinted, [])


def test_program_files(spark, tmp_path):
    folder = tmp_path / "programs"
    folder.mkdir()
    shipped = {"demos": [{"augmented": True, "joke": "a", "rationale": "r", "funny": "1"}, {"joke": "b"}]}
    (folder / "one.json").write_text(json.dumps({"cot": shipped, "meta": 3}, indent=2))
    (folder / "two.json").write_text(json.dumps({"predictor": {"demos": [{"joke": "c"}]}}))
    (folder / "none.json").write_text(json.dumps({"cot": {"lm": None}}))
    programs = readers.read_programs(spark, str(folder))
    stats = {
        r["file_name"]: r for r in demos.demo_stats(programs, key="file_name").collect()
    }
    one = stats["one.json"]
    assert (one["total"], one["augmented"], one["labeled"], one["has_reasoning"]) == (2, 1, 1, True)
    assert one["fields"] == ["funny", "joke"]
    assert stats["two.json"]["total"] == 1 and stats["none.json"]["total"] == 0


def test_prompt_files(spark, tmp_path):
    (tmp_path / "p1.json").write_text(
        json.dumps(
            {"input_fields": ["joke", "topic"], "output_fields": ["funny"],
             "input_descs": ["the joke"], "evaluation_score": 100.0, "llm_model": "gpt-4o-mini"},
            indent=4,
        )
    )
    (tmp_path / "p2.json").write_text(json.dumps({"input_fields": ["a"], "signature": "a -> z"}))
    rows = {r["file_name"]: r for r in readers.read_prompts(spark, str(tmp_path)).collect()}
    assert rows["p1.json"]["signature"] == "joke, topic -> funny"
    assert rows["p1.json"]["input_descriptions"] == ["the joke"]
    assert rows["p1.json"]["evaluation_score"] == "100.0"
    assert rows["p2.json"]["signature"] == "a -> z" and rows["p2.json"]["output_fields"] == []
    assert rows["p2.json"]["evaluation_score"] == rows["p2.json"]["teacher_model"] == "N/A"


def test_csv_keeps_text_whole(spark, tmp_path):
    rows = [('say "hi", you', " lead and trail "), ("two\nlines", ""), ("é, ü", None), ("back\\slash", "\\")]
    df = spark.createDataFrame(rows, "a string, b string")
    path = str(tmp_path / "csv")
    writers.write_csv(df, path)
    assert readers.csv_header(spark, path) == ["a", "b"]
    assert sorted(map(str, readers.read_csv(spark, path, ["a", "b"]).collect())) == sorted(
        map(str, df.collect())
    )


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"q{i % 5}", "yes" if i % 5 < 3 else "no") for i in range(60)]
    return spark.createDataFrame(rows, "key long, question string, answer string")


def teacher(rows):
    answer = F.when(F.col("key") % 4 == 0, F.col("answer")).otherwise("wrong")
    return rows.withColumns({"pred_answer": answer, "score": (answer == F.col("answer")).cast("int")})


def student(rows):
    same = F.filter("demos", lambda d: d["fields"]["question"] == F.col("question"))
    answer = F.try_element_at(same, F.lit(1))["fields"]["answer"]
    return rows.withColumn("score", F.coalesce((answer == F.col("answer")).cast("int"), F.lit(0)))


def test_bootstrap_takes_the_first_passing_rows(labelled):
    found = search.bootstrap_demos(labelled, QA, "key", teacher, max_labeled=6).orderBy("position")
    rows = found.collect()
    assert [r["key"] for r in rows[:4]] == [0, 4, 8, 12]
    assert [r["demo"]["augmented"] for r in rows] == [True] * 4 + [False] * 2
    assert len({r["key"] for r in rows}) == 6


def test_bootstrap_goes_on_past_the_probe(spark):
    rows = [(i, "q", "yes") for i in range(6000)]
    df = spark.createDataFrame(rows, "key long, question string, answer string")

    asked = []

    def late(found):
        asked.append(found)
        right = F.col("key") >= 5400
        return found.withColumns({"pred_answer": F.col("answer"), "score": right.cast("int")})

    found = search.bootstrap_demos(df, QA, "key", late).orderBy("position").collect()
    assert [r["key"] for r in found] == [5400, 5401, 5402, 5403]
    # Three rounds, and no row was asked twice.
    assert [part.count() for part in asked] == [256, 4096 - 256, 6000 - 4096]
    asked.clear()
    seeded = search.first_passing_per_seed(df, QA, "key", late, ["1", "2"], 4, 1.0)
    assert seeded.count() == 8 and seeded.filter("key < 5400").count() == 0
    assert sum(part.count() for part in asked) <= 6000


def test_seeded_rounds_equal_one_pass(spark, monkeypatch):
    """The rounds pick what ranking all passing rows would pick."""
    df = spark.createDataFrame([(i, "q", "yes") for i in range(3000)], "key long, question string, answer string")

    def rare(rows):
        right = F.col("key") % 97 == 0
        return rows.withColumns({"pred_answer": F.col("answer"), "score": right.cast("int")})

    def picked(first, growth):
        monkeypatch.setattr(search, "PROBE_ROWS", first)
        monkeypatch.setattr(search, "PROBE_GROWTH", growth)
        rows = search.first_passing_per_seed(df, QA, "key", rare, ["a", "b", "c"], 5, 1.0)
        return sorted((r["seed"], r["draw"], r["key"]) for r in rows.collect())

    assert picked(8, 8) == picked(100, 3) == picked(1000, 100) == picked(5000, 16)
    monkeypatch.setattr(search, "SORTED_ROWS", 10)  # heads are cut at keys
    ordered = search.first_passing(df, QA, "key", rare, 5, 1.0).collect()
    assert sorted(r["key"] for r in ordered) == [0, 97, 194, 291, 388]


def test_heads_stop_when_enough_pass(spark):
    df = spark.createDataFrame([(i, "q", "yes") for i in range(20_000)], "key long, question string, answer string")
    asked = []

    def some(rows):
        asked.append(rows)
        right = (F.col("key") % 100 == 99).cast("int")
        return rows.withColumns({"pred_answer": F.col("answer"), "score": right})

    found = search.first_passing(df, QA, "key", some, 4, 1.0).collect()
    assert sorted(r["key"] for r in found) == [99, 199, 299, 399]
    assert sum(part.count() for part in asked) == 4096
    asked.clear()
    assert search.first_passing_per_seed(df, QA, "key", some, ["a", "b"], 4, 1.0).count() == 8
    assert sum(part.count() for part in asked) < 12_000


def candidates_of(spark, chances):
    rows = [(i, str(c)) for i, c in enumerate(chances)]
    df = spark.createDataFrame(rows, "candidate_id int, instructions string")
    return df.withColumn("demos", F.array().cast(f"array<{DEMO_TYPE}>"))


def test_racing_finds_the_winner_with_fewer_rows(spark):
    dev = spark.createDataFrame([(i, "q", "a") for i in range(4000)], "key long, question string, answer string")
    asked = []

    def chance(rows):
        asked.append(rows.count())
        draw = F.pmod(F.xxhash64("key", "candidate_id"), F.lit(1000)) / 1000
        return rows.withColumn("score", (draw < F.col("instructions").cast("double")).cast("int"))

    chances = [0.1, 0.2, 0.85, 0.5, 0.8, 0.15, 0.3, 0.05]
    programs = candidates_of(spark, chances)
    full = {r["candidate_id"]: r for r in search.joint_search(dev, programs, 8, "key", chance, 30, 40).collect()}
    rows_of_full = sum(asked)
    asked.clear()
    raced = {r["candidate_id"]: r for r in search.racing_search(dev, programs, 8, "key", chance, 30, 40).collect()}
    assert [c for c, r in raced.items() if r["best"]] == [c for c, r in full.items() if r["best"]] == [2]
    assert raced[2]["percent"] == full[2]["percent"] and raced[2]["batches"] == 30
    assert rows_of_full == 8 * 30 * 40 and sum(asked) < 0.6 * rows_of_full
    assert raced[7]["batches"] < 30 and sum(r["examples"] for r in raced.values()) == sum(asked)


def test_racing_keeps_equals_and_odd_inputs(spark):
    dev = spark.createDataFrame([(i, "q", "a") for i in range(30)], "key long, question string, answer string")
    programs = candidates_of(spark, ["x", "x", "x"])
    found = search.racing_search(dev, programs, 3, "key", lambda r: r.withColumn("score", F.lit(1)), 5, 10)
    rows = sorted(found.collect())
    assert [(r["candidate_id"], r["percent"], r["batches"], r["best"]) for r in rows] == [
        (0, 100.0, 5, True), (1, 100.0, 5, False), (2, 100.0, 5, False),
    ]
    none = search.racing_search(dev.limit(0), programs, 3, "key", lambda r: r.withColumn("score", F.lit(1)), 5, 10)
    assert none.collect() == []


def test_bounds_shrink_and_hold():
    assert search.race_radius(0.5, 0, 0, 0.01) == float("inf")
    wide, narrow = search.race_radius(0.5, 50, 100, 0.01), search.race_radius(0.5, 5000, 10_000, 0.01)
    assert narrow < wide < 0.5
    assert search.race_radius(0.0, 0, 10_000, 0.01) < narrow / 5  # no spread: the Bernstein bound


def test_instruction_rounds_go_on_from_the_scores(spark):
    rows = spark.createDataFrame([(i, "q", "a") for i in range(10)], "key long, question string, answer string")
    first = spark.createDataFrame([(0, "a"), (1, "bbb")], "candidate_id int, instructions string")
    seen = []

    def by_length(rows):
        return rows.withColumn("score", (F.col("key") < F.length("instructions")).cast("int"))

    def longer(scored):
        best = scored.orderBy(F.desc("percent")).first()["instructions"]
        seen.append(best)
        made = [(best + "+",), (best + "++",), ("a",), (None,), ("",), (best + "+",)]
        return spark.createDataFrame(made, "instructions string")

    found = search.instruction_rounds(rows, first, by_length, longer, 3).orderBy("candidate_id").collect()
    assert [(r["round"], r["instructions"], r["percent"]) for r in found] == [
        (0, "a", 10.0), (0, "bbb", 30.0), (1, "bbb+", 40.0), (1, "bbb++", 50.0), (2, "bbb+++", 60.0), (2, "bbb++++", 70.0),
    ]
    assert [r["best"] for r in found] == [False] * 5 + [True] and seen == ["bbb", "bbb++"]
    stopped = search.instruction_rounds(rows, first, by_length, lambda s: first.select("instructions"), 5)
    assert stopped.agg(F.max("round")).first()[0] == 0
    with pytest.raises(ValueError):
        search.instruction_rounds(rows, first, by_length, longer, 0)


@pytest.mark.parametrize("optimizer", compiling.OPTIMIZERS)
def test_compile_with_each_optimizer(spark, labelled, optimizer):
    texts = spark.createDataFrame([(0, "Answer"), (1, "Answer well")], "candidate_id int, instructions string")
    done = compiling.compile_program(
        labelled, QA, "key", optimizer, teacher, student, texts, num_candidates=3, num_batches=2
    )
    row = done.summary.first()
    assert (row["row_count"], row["trainset_size"], row["devset_size"]) == (60, 48, 12)
    assert row["baseline_score"] == 0.0 and row["evaluation_score"] >= 0.0
    assert spark.read.json(f"{done.path}/program").count() == 1
    assert len(readers.csv_header(spark, f"{done.path}/dataset")) == 2
    assert spark.read.parquet(f"{done.path}/runs").count() == 1
    if done.scores is not None:
        assert done.scores.filter("best").count() == 1


def test_compile_rejects_bad_calls(spark, labelled):
    with pytest.raises(ValueError):
        compiling.compile_program(labelled, QA, "key", "SGD", teacher, student)
    with pytest.raises(ValueError):
        compiling.compile_program(labelled, QA, "key", compiling.INSTRUCTIONS, teacher, student)
    with pytest.raises(ValueError):
        compiling.compile_program(
            labelled.limit(1), QA, "key", compiling.BOOTSTRAP, teacher, student
        )
