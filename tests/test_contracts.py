"""Header contracts, projections and metric choice."""

import pytest
from pyspark.sql import functions as F

from loopwright.functions import metrics
from loopwright.operators import contracts
from loopwright.spec import TaskSpec


def test_strict_header():
    good = contracts.check_header_strict(["a", "b"], ["a"], ["b"])
    assert good.valid
    swapped = contracts.check_header_strict(["b", "a"], ["a"], ["b"])
    assert not swapped.valid and swapped.missing == ()
    named = contracts.check_header_strict(["Input1", "b"], [""], ["b"])
    assert named.valid
    with pytest.raises(ValueError):
        swapped.require()


def test_subset_header():
    assert contracts.check_header_subset(["x", "b", "a"], ["a", "b"]).valid
    short = contracts.check_header_subset(["x"], ["b", "a"])
    assert not short.valid and short.missing == ("a", "b")


def test_column_differences():
    assert contracts.column_differences(["a", "b", "c"], ["c", "d", "a"]) == (
        ["a", "c"],
        ["b"],
        ["d"],
    )


def test_examples_need_their_columns(spark):
    df = spark.createDataFrame([("q", 1)], "question string, answer int")
    rows = contracts.examples(df, TaskSpec(("question",), ("answer",)))
    assert rows.first()["answer"] == "1"
    with pytest.raises(ValueError):
        contracts.examples(df, TaskSpec(("wrong_field",), ("answer",)))


def test_absent_inputs_are_empty(spark):
    df = spark.createDataFrame([(None,)], "question string")
    row = contracts.program_inputs(df, TaskSpec(("question", "style"), ("a",))).first()
    assert tuple(row) == ("", "")


def test_names(spark):
    df = spark.createDataFrame([(" m ",), ("  ",), ("",), (None,)], "n string")
    rows = df.select(
        contracts.clean_name(F.col("n")).alias("n"), contracts.name_error(F.col("n")).alias("e")
    ).collect()
    assert [tuple(r) for r in rows] == [("m", None)] + [(None, "empty_name")] * 3


def test_metric_choice():
    assert metrics.make_metric("Exact Match") is metrics.exact_match
    assert metrics.make_metric("Cosine Similarity") is metrics.cosine_similarity
    with pytest.raises(ValueError):
        metrics.make_metric("LLM-as-a-Judge")
    with pytest.raises(ValueError):
        metrics.make_metric("BLEU")


def test_exact_match(spark):
    df = spark.createDataFrame(
        [("1", "a", "1", "a"), ("1", "a", "0", "a"), ("1", "a", None, "a"), (None, "a", None, "a")],
        "g1 string, g2 string, p1 string, p2 string",
    )
    score = metrics.exact_match([F.col("g1"), F.col("g2")], [F.col("p1"), F.col("p2")])
    assert [r[0] for r in df.select(score).collect()] == [1, 0, 0, 0]


def test_cosine(spark):
    df = spark.sql(
        "SELECT array(1.0, 0.0) AS a, array(1.0, 0.0) AS same, array(0.0, 2.0) AS cross,"
        " array(0.0, 0.0) AS zero"
    )
    cos = lambda x, y: metrics.cosine_similarity([F.col(x)], [F.col(y)])
    row = df.select(cos("a", "same"), cos("a", "cross"), cos("a", "zero")).first()
    assert tuple(row) == (1.0, 0.0, None)


def test_judge(spark):
    df = spark.createDataFrame([("0.5",), ("bad",), (None,), ("NaN",), (" 1 ",)], "s string")
    rows = df.select(metrics.judge_score(F.col("s"))).collect()
    assert [r[0] for r in rows] == [0.5, 0.0, 0.0, 0.0, 1.0]
    two = metrics.make_metric(metrics.JUDGE, judge_outputs=["a", "b"])
    assert df.select(two({"a": F.col("s"), "b": F.col("s")})).first()[0] == 0.0


def test_unknown_module():
    with pytest.raises(ValueError):
        TaskSpec(("a",), ("b",), module="ReAct")
