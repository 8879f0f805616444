"""Text, JSON and hash expressions on literal cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from loopwright.functions import jsonmap, text
from loopwright.functions.fingerprint import dataset_fingerprint


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("length", "limit", "expected"), [(500, 500, 500), (501, 500, 500), (10, 500, 10), (300, 250, 250)]
)
def test_truncation_limits(spark, length, limit, expected):
    cut = value(spark, text.truncate_text(F.lit("x" * length), limit))
    assert len(cut) == expected
    assert cut.endswith("...") == (length > limit)


def test_program_id(spark):
    made = text.program_id(
        F.lit(["joke", "topic"]),
        F.lit(["funny"]),
        F.lit("gpt-4o-mini"),
        F.lit("ChainOfThought"),
        F.lit("BootstrapFewShotWithRandomSearch"),
        F.lit(datetime.date(2024, 10, 3)),
    )
    assert value(spark, made) == (
        "JokeTopic:Funny-Gpt4oMini_ChainOfThought_Bootstrapfewshotwithrandomsearch-20241003"
    )
    short = text.program_id(
        F.lit(["original_title"]),
        F.lit(["a"]),
        F.lit("m"),
        F.lit("Predict"),
        F.lit("bootstrap_randomsearch"),
        F.lit(datetime.date(2025, 1, 9)),
    )
    assert value(spark, short) == "OriginalTitle:A-M_Predict_BsRs-20250109"


def test_response_round_trip(spark):
    rendered = text.render_response(
        {"topic": F.lit("cats")}, {"joke": F.lit("a: b"), "style": F.lit(None).cast("string")}
    )
    assert value(spark, rendered) == "Input:\ntopic: cats\n\nOutput:\njoke: a: b\nstyle: \n"
    entries = text.response_entries(rendered)
    assert value(spark, text.response_value(entries, "joke")) == "a: b"
    assert value(spark, text.response_value(entries, "style")) == ""
    assert value(spark, text.response_value(entries, "topic")) is None


@pytest.mark.parametrize(
    ("response", "expected"),
    [
        ("no marker, joke: x", None),
        ("Output:\njoke: first\njoke:  second ", "second"),
        ("Output: old\nOutput:\n\tjoke : new\r\n", "new"),
        ("Error: timeout", None),
        ("Output:", None),
    ],
)
def test_response_parsing(spark, response, expected):
    entries = text.response_entries(F.lit(response))
    assert value(spark, text.response_value(entries, "joke")) == expected


def test_value_text(spark):
    df = spark.sql("SELECT 1 AS a, 'x' AS b, CAST(NULL AS STRING) AS c, array(1, 2) AS d, 'é' AS e")
    row = df.select(*[text.value_text(df, c).alias(c) for c in df.columns]).first()
    assert tuple(row) == ("1", "x", "", "[1,2]", "é")


def test_names(spark):
    assert value(spark, text.split_names(F.lit(""))) == []
    assert value(spark, text.split_names(F.lit(None).cast("string"))) == []
    assert value(spark, text.split_names(F.lit("a,b"))) == ["a", "b"]
    assert value(spark, text.score_or_null(F.lit("0.85"))) == 0.85
    assert value(spark, text.score_or_null(F.lit("")))is None


def test_feedback_id_is_stable(spark):
    made = text.feedback_id(F.lit("tr-1"), F.lit(5), F.lit("u1"))
    found = value(spark, made)
    assert found == value(spark, made)
    assert found.startswith("fb-") and len(found) == 19


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ('{"a":"1","b":[1,2]}', {"a": "1", "b": "[1,2]"}),
        ("not json", {"input": "not json"}),
        ("", {}),
        (None, {}),
    ],
)
def test_parse_or_wrap(spark, raw, expected):
    assert value(spark, jsonmap.parse_or_wrap(F.lit(raw).cast("string"), "input")) == expected


def test_corrections_win_at_both_encodings(spark):
    for corrected in ('{"joke":"fixed"}', '"{\\"joke\\":\\"fixed\\"}"'):
        record = jsonmap.training_fields(
            F.lit('{"topic":"cats"}'),
            F.lit('{"joke":"old","topic":"dogs"}'),
            F.lit(corrected),
            F.lit("tr-1"),
            F.lit("thumbs_up"),
        )
        assert value(spark, record) == {
            "topic": "cats",
            "joke": "fixed",
            "_trace_id": "tr-1",
            "_rating": "thumbs_up",
        }


def test_outputs_overwrite_inputs(spark):
    record = jsonmap.training_fields(
        F.lit('{"lang":"en"}'), F.lit('{"lang":"de"}'), None, F.lit("t"), F.lit("")
    )
    assert value(spark, record) == {"lang": "de", "_trace_id": "t"}


def fingerprint(df):
    return dataset_fingerprint(df).first()["fingerprint"]


def test_fingerprint_ignores_order_but_not_content(spark):
    base = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "a int, b string")
    same = spark.createDataFrame([(None, 2), ("x", 1), (None, 2)], "b string, a int")
    assert fingerprint(base) == fingerprint(same)
    assert len(fingerprint(base)) == 64
    for rows in ([(1, "y"), (2, None), (2, None)], [(1, "x"), (2, None)], [(1, "x"), (2, ""), (2, None)]):
        assert fingerprint(base) != fingerprint(spark.createDataFrame(rows, "a int, b string"))
    empty = base.limit(0)
    assert len(fingerprint(empty)) == 64


def test_cell_borders_count(spark):
    left = spark.createDataFrame([("ab", "c")], "x string, y string")
    right = spark.createDataFrame([("a", "bc")], "x string, y string")
    assert fingerprint(left) != fingerprint(right)
