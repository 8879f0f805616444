"""Registry tables on literal cases, and aliases against an event-by-event replay."""

import random

from loopwright.operators import registry
from loopwright.operators.evaluation import evaluation_summary, evaluation_table, readiness

VERSIONS = "model_name string, version string, stage string, run_id string, creation_timestamp long"


def test_latest_is_numeric(spark):
    df = spark.createDataFrame(
        [("m", "9", "None", "r9", 1), ("m", "10", "Staging", "r10", 2)], VERSIONS
    )
    assert registry.latest_versions(df).first()["version"] == "10"
    runs = spark.createDataFrame([("r10", 0.85)], "run_id string, evaluation_score double")
    models = spark.createDataFrame([("m", "d"), ("empty", None)], "model_name string, description string")
    rows = {r["name"]: r for r in registry.list_models(models, df, runs).collect()}
    assert rows["m"]["latest_version"] == "10" and rows["m"]["evaluation_score"] == 0.85
    assert rows["empty"]["latest_version"] == "0" and rows["empty"]["current_stage"] == "None"
    listed = registry.list_versions(df, runs, model_name="m").collect()
    assert [r["version"] for r in listed] == ["10", "9"]


def replay(events):
    aliases = {}
    for _, _, model, version, stage in sorted(events):
        if stage in registry.STAGE_ALIASES:
            aliases[model, registry.STAGE_ALIASES[stage]] = version
        else:
            for key in [k for k, v in aliases.items() if k[0] == model and v == version]:
                del aliases[key]
    return {(m, a, v) for (m, a), v in aliases.items()}


def test_aliases_equal_a_replay(spark):
    pick = random.Random(3)
    stages = ["Production", "Staging", "Archived", "None"]
    events = [
        (pick.randrange(300), i, f"m{pick.randrange(6)}", str(pick.randrange(4)), pick.choice(stages))
        for i in range(400)
    ]
    df = spark.createDataFrame(
        events, "ts long, event_id long, model_name string, version string, stage string"
    )
    found = registry.current_aliases(df).collect()
    assert {(r["model_name"], r["alias"], r["version"]) for r in found} == replay(events)


def test_resolution_order(spark):
    versions = spark.createDataFrame(
        [("m", "1", "Production", "a", 1), ("m", "2", "Production", "b", 1), ("m", "11", "None", "c", 1)],
        VERSIONS,
    )
    aliases = spark.createDataFrame([("m", "champion", "1")], "model_name string, alias string, version string")
    asked = spark.createDataFrame(
        [
            (1, "m", "7", "champion", "Production"),
            (2, "m", None, "champion", "Production"),
            (3, "m", None, None, "Production"),
            (4, "m", None, None, None),
            (5, "m", None, "unknown", None),
            (6, "x", None, None, None),
        ],
        "id int, model_name string, version string, alias string, stage string",
    )
    rows = registry.resolve_versions(asked, versions, aliases).collect()
    assert {r["id"]: r["resolved_version"] for r in rows} == {
        1: "7", 2: "1", 3: "2", 4: "11", 5: None, 6: None,
    }


def test_register(spark):
    asked = spark.createDataFrame(
        [(i, f" m{i % 2} ", f"run{i}", 0.5, "x" * 300, "a -> b", "a", "b", "Predict", "COPRO") for i in range(5)]
        + [(9, " ", "run9", 0.5, "i", "s", "a", "b", "p", "o"), (10, "m0", "", None, "i", "s", "a", "b", "p", "o")],
        "request_id int, model_name string, run_id string, evaluation_score double, instructions string,"
        " signature string, input_fields string, output_fields string, dspy_module string, optimizer string",
    )
    have = spark.createDataFrame([("m1", "4", "None", "r", 1)], VERSIONS)
    rows = {r["request_id"]: r for r in registry.register(asked, have, ["request_id"]).collect()}
    assert [rows[i]["version"] for i in (0, 2, 4)] == ["1", "2", "3"]
    assert [rows[i]["version"] for i in (1, 3)] == ["5", "6"]
    assert rows[9]["error_code"] == "empty_name" and rows[10]["error_code"] == "no_run_id"
    assert not rows[9]["success"] and rows[0]["success"]
    lines = rows[0]["description"].split("\n")
    assert lines[:5] == ["Input: a", "Output: b", "Module: Predict", "Optimizer: COPRO", "Score: 0.5000"]
    assert lines[5] == "Instructions: " + "x" * 197 + "..."
    assert rows[0]["tags"]["evaluation_score"] == "0.5"
    assert "Score" not in rows[10]["description"] and "evaluation_score" not in rows[10]["tags"]


def test_evaluation_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, "x", None)], "example_id int, input string, score double")
    rows = evaluation_table(df).orderBy("example_id").collect()
    assert tuple(rows[0]) == (1, "", "", "", 1.0, "unknown")
    assert rows[1]["score"] == 0.0
    one = evaluation_summary(evaluation_table(df.limit(1))).first()
    assert one["eval_score_std"] is None and one["eval_example_count"] == 1


def test_readiness(spark):
    rows = {r["optimizer"]: r for r in readiness(spark.range(60)).collect()}
    assert rows["BootstrapFewShot"]["meets_recommended"] and not rows["MIPROv2"]["meets_minimum"]
    assert rows["COPRO"]["meets_minimum"] and not rows["COPRO"]["meets_recommended"]
    assert not any(r["can_compile"] for r in readiness(spark.range(1)).collect())
