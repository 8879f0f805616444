"""Positions, splits and samples against plain Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loopwright.operators import ordinal


@pytest.fixture(scope="module")
def skewed(spark):
    """Two thirds of the rows in one group, keys in no order."""
    rows = [("hot", i) for i in range(400)] + [(f"g{i % 7}", 1000 + i) for i in range(200)]
    rows += [(None, 5000 + i) for i in range(10)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "grp string, k long").repartition(5)


def test_ordinal_is_dense_and_ordered(skewed):
    rows = ordinal.with_ordinal(skewed, ["k"]).collect()
    assert [r["ordinal"] for r in sorted(rows, key=lambda r: r["k"])] == list(range(610))


def test_group_ordinal(skewed):
    rows = ordinal.with_group_ordinal(skewed, ["grp"], ["k"], "place", partitions=6).collect()
    groups = {}
    for row in sorted(rows, key=lambda r: r["k"]):
        groups.setdefault(row["grp"], []).append(row["place"])
    assert len(rows) == 610
    assert all(places == list(range(len(places))) for places in groups.values())


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.sets(st.integers(-1000, 1000), min_size=0, max_size=40))
def test_split_sizes(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(3)
    train, dev = ordinal.split_train_dev(df, ["k"])
    expected, cut = sorted(keys), int(0.8 * len(keys))
    assert sorted(r["k"] for r in train.collect()) == expected[:cut]
    assert sorted(r["k"] for r in dev.collect()) == expected[cut:]


def test_rank_by_narrowing(spark, skewed, monkeypatch):
    """With small limits the pivot rounds are taken, for one key column and for two."""
    monkeypatch.setattr(ordinal, "_GATHER_ROWS", 5)
    monkeypatch.setattr(ordinal, "_PIVOTS", 60)
    keys = sorted(r["k"] for r in skewed.select("k").collect())
    for rank in (0, 1, 299, 400, 608, 609):
        assert ordinal.key_at_rank(skewed, ["k"], rank)[1]["k"] == keys[rank]
    pairs = [(f"f{i // 10}", i % 10) for i in range(300)]
    df = spark.createDataFrame(pairs, "file string, line int").repartition(4)
    assert tuple(ordinal.key_at_rank(df, ["file", "line"], 123)[1]) == sorted(pairs)[123]
    same = spark.createDataFrame([(1,)] * 50, "k int")
    with pytest.raises(ValueError):
        ordinal.key_at_rank(same, ["k"], 20)


def test_draws_fall_back_to_all_rows(skewed, monkeypatch):
    """A limit that lets too few rows pass changes nothing in the result."""
    usual = ordinal.sample_per_seed(skewed, "k", ["a", "b"], 20).collect()
    ranked = ordinal._ranked_draws
    monkeypatch.setattr(
        ordinal, "_ranked_draws", lambda *a: ranked(*a[:4], "0001" if a[4] else None)
    )
    again = ordinal.sample_per_seed(skewed, "k", ["a", "b"], 20).collect()
    assert sorted(map(str, usual)) == sorted(map(str, again))


def test_split_on_two_keys(spark):
    rows = [(f"f{i // 10}", i % 10) for i in range(35)]
    df = spark.createDataFrame(rows, "file string, line int").repartition(4)
    train, dev = ordinal.split_train_dev(df, ["file", "line"])
    assert sorted(map(tuple, train.collect())) == rows[:28]
    assert sorted(map(tuple, dev.collect())) == rows[28:]


def test_row_at(skewed):
    assert ordinal.row_at(skewed, ["k"], 0).first()["k"] == 0
    assert ordinal.row_at(skewed, ["k"], 609).first()["k"] == 5009
    assert ordinal.row_at(skewed, ["k"], 610).count() == 0


def test_samples_are_reproducible(skewed):
    first = ordinal.sample_per_seed(skewed, "k", ["a", "b"], 20).collect()
    again = ordinal.sample_per_seed(skewed.repartition(2), "k", ["a", "b"], 20).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    for seed in "ab":
        picked = [r["k"] for r in first if r["seed"] == seed]
        assert len(picked) == len(set(picked)) == 20
    one = ordinal.random_rows(skewed, "k", "s", 3).collect()
    assert sorted(one) == sorted(ordinal.random_rows(skewed, "k", "s", 3).collect())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning"), "ExistingRDD" in plan


def test_wide_rows_are_shuffled_once_and_not_stored(spark, tmp_path):
    path = f"{tmp_path}/rows"
    spark.range(5000).selectExpr("id % 3 AS g", "id AS k", "repeat('x', 50) AS wide").write.parquet(path)
    rows = spark.read.parquet(path)
    assert exchanges(ordinal.with_ordinal(rows, ["k"], partitions=20)) == (1, False)
    grouped = ordinal.with_group_ordinal(rows, ["g"], ["k"], partitions=20)
    assert exchanges(grouped)[0] == 1
    assert all(r["ordinal"] == r["k"] // 3 for r in grouped.collect())


@pytest.mark.parametrize("ranges", [1, 2, 3, 7, 64, 1000])
def test_any_number_of_ranges(spark, skewed, ranges):
    keys = sorted(r["k"] for r in skewed.collect())
    bounds = ordinal._bounds(skewed, ["k"], ranges)
    number = ordinal._range_number(skewed, ["k"], bounds)
    cuts = [r["k"] for r in bounds]
    for row in skewed.select("k", number.alias("n")).collect():
        assert row["n"] == sum(c <= row["k"] for c in cuts)
    found = ordinal.with_ordinal(skewed, ["k"], partitions=ranges).collect()
    assert [r["ordinal"] for r in sorted(found, key=lambda r: r["k"])] == list(range(len(keys)))
    grouped = ordinal.with_group_ordinal(skewed, ["grp"], ["k"], partitions=ranges).collect()
    places = {}
    for row in sorted(grouped, key=lambda r: r["k"]):
        assert row["ordinal"] == places.setdefault(row["grp"], 0)
        places[row["grp"]] += 1


def test_ordinals_of_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([], "_range int, k long, g string")
    assert ordinal.with_ordinal(df, ["k"]).collect() == []
    assert ordinal.with_group_ordinal(df, ["g"], ["k"]).collect() == []
    df = spark.createDataFrame([(9, 2, "a"), (8, 1, "a"), (7, 5, None)], "_range int, k long, g string")
    found = ordinal.with_group_ordinal(df, ["g"], ["k"]).collect()
    assert sorted((r["_range"], r["ordinal"]) for r in found) == [(7, 0), (8, 0), (9, 1)]


def test_sampled_bounds_give_even_ranges(spark):
    rows = spark.range(40_000).selectExpr("id * id % 1000003 AS a", "id AS b")
    bounds = ordinal._bounds(rows, ["a", "b"], 8)
    number = ordinal._range_number(rows, ["a", "b"], bounds)
    sizes = [r["count"] for r in rows.groupBy(number.alias("n")).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * min(sizes)
