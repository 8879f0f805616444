import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopwright.llm.hard_negatives import Residues, mine_hard_negatives, primes_for

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_primes_cover_both_signs():
    assert primes_for(100) == [251] and primes_for(125) == [251, 241]
    product = math.prod(primes_for(1 << 55))
    assert product > 2 << 55 and all(p <= 251 for p in primes_for(1 << 55))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 2600), st.sampled_from([3, 256, 100_000, 1 << 22]))
def test_products_are_exact(seed, width, size):
    draw = np.random.default_rng(seed)
    a, b = (draw.integers(-size, size + 1, (n, width)) for n in (3, 4))
    a[0], b[0] = size, -size  # the extreme score
    system = Residues(float(size) ** 2 * width * (1 + 1e-9))
    found = system.scores(system.parts(a.astype(float)), system.parts(b.astype(float)))
    expected = a.astype(object) @ b.T.astype(object)
    assert (found == expected).all()


def brute(rows, step=50, positives=5, negatives=3, low=50, high=95):
    one = {}
    for v, e, label in rows:
        if v is None or label is None or e is None:
            continue
        if any(x is None or not math.isfinite(x) for x in e):
            continue
        e = [float(np.float32(x)) for x in e]
        if v not in one or (label, e) < one[v]:
            one[v] = (label, e)
    made = {v: (label, [math.floor(256 * x) for x in e]) for v, (label, e) in one.items()}
    score = lambda a, b: sum(x * y for x, y in zip(made[a][1], made[b][1]))
    out = []
    for a in made:
        if a % step:
            continue
        others = sorted((-score(a, v), v) for v in made if v != a)
        same = [(-s, v) for s, v in others if made[v][0] == made[a][0]][:positives]
        rest = [(-s, v) for s, v in others if made[v][0] != made[a][0]]
        for ps, p in same:
            fits = [(s, v) for s, v in rest if low * ps <= 100 * s <= high * ps][:negatives]
            out += [(a, p, k + 1, v, ps, s) for k, (s, v) in enumerate(fits)]
    return sorted(out)


def found(llm, rows, **options):
    df = llm.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("place", "block", "part", "rank", "score", "anchor_id", "count"):
        df = df.withColumn(name, F.lit("x"))
    step = options.pop("step", 50)
    return sorted(tuple(r) for r in mine_hard_negatives(df, F.col("vec_id") % step == 0, **options).collect())


def cloud(count, width, labels, seed=1, size=1.0):
    draw = random.Random(seed)
    return [
        (v, [draw.gauss(0.3, 0.4) * size for _ in range(width)], draw.choice(labels)) for v in range(count)
    ]


@pytest.mark.parametrize("block", [1, 8 * 12 * 4, 1 << 25])
def test_same_as_brute_force_in_any_blocks(llm, block):
    rows = cloud(300, 12, [0, 1, 1, 2])
    expected = brute(rows, step=20)
    assert len(expected) > 100
    assert found(llm, rows, step=20, block_bytes=block) == expected


def test_large_values_need_more_primes(llm):
    rows = cloud(120, 5, [0, 1], size=4000.0)
    assert found(llm, rows, step=10) == brute(rows, step=10)


def test_hot_label_and_equal_vectors(llm):
    rows = [(v, [0.5, 0.25, -0.1], 3) for v in range(200)]
    rows += [(v, [0.4, 0.2, -0.1 * (v % 3)], 4) for v in range(200, 330)]
    expected = brute(rows)
    assert expected and found(llm, rows) == expected


def test_odd_rows(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        *cloud(90, 4, [1, 2], seed=4),
        *cloud(10, 4, [1, 2], seed=4),  # the first ten again
        (5, [9.0, 9.0], 0),  # another row of an id; the least label stays
        (-50, [0.3, 0.2], 1),  # a shorter vector, a negative id
        (200, [], 1), (250, [0.0] * 4, 2), (300, [-0.5, -0.4, -0.9, -0.2], 2),
        (None, [1.0] * 4, 1), (350, None, 1), (400, [1.0] * 4, None),
        (450, [1.0, None], 1), (500, [1.0, nan], 1), (550, [inf, 1.0], 2), (600, [-inf], 1),
    ]
    expected = brute(rows, step=10)
    assert expected and found(llm, rows, step=10) == expected


def test_empty_table_and_no_anchor(llm):
    assert found(llm, []) == [] and found(llm, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert found(llm, [(50, [1.0], 1)]) == []


def test_scores_that_fit_no_window_are_an_error(llm):
    with pytest.raises(ValueError, match="too large"):
        found(llm, [(50, [1e30], 1)])
