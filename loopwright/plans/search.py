"""Demo bootstrapping and the search for the best program, as table jobs.

A *teacher* takes example rows and returns them with predicted outputs ``pred_<field>``, a
``score`` and, if it gives one, its ``reasoning``.  A *student* takes dev rows joined to a
candidate (``instructions`` and ``demos``) and returns them with a ``score``.  Both are plain
DataFrame functions: a column expression or a batch prediction.  A student may also have
``over(rows, candidates, count)``, which answers as ``student(fan_out(...))`` does but joins them itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.functions.prompts import DEMO_TYPE
from loopwright.operators.evaluation import (
    best_candidate,
    dataset_score,
    fan_out,
    percent_score,
)
from loopwright.operators.ordinal import key_at_rank, sample_per_seed, seeded_rank
from loopwright.session import checkpoint
from loopwright.spec import TaskSpec

Teacher = Callable[[DataFrame], DataFrame]
Student = Callable[[DataFrame], DataFrame]
# Takes scored instructions (candidate_id, instructions, percent), returns new ones as a column.
Proposer = Callable[[DataFrame], DataFrame]

# Demo caps, candidate and batch counts used by default.
MAX_BOOTSTRAPPED = 4
MAX_LABELED = 4
JOINT_MAX_BOOTSTRAPPED = 8
JOINT_MAX_LABELED = 16
NUM_CANDIDATES = 10
NUM_BATCHES = 30

# Rows that the teacher tries first, and how much more it tries from round to round.
PROBE_ROWS, PROBE_GROWTH = 256, 16
# Heads up to so many rows are sorted at once; longer ones are cut at a key.
SORTED_ROWS = 10_000

# Chance that racing drops the candidate whose true mean is best.
RACE_RISK = 0.05


def demo_of(spec: TaskSpec, predicted: bool, has_reasoning: bool) -> Column:
    """A train row as a demo; predicted ones hold the teacher's outputs and reasoning."""
    pairs: list[Column] = []
    for name in spec.fields:
        source = f"pred_{name}" if predicted and name in spec.outputs else name
        pairs += [F.lit(name), F.col(source).cast("string")]
    reasoning = F.col("reasoning") if predicted and has_reasoning else F.lit(None).cast("string")
    return F.struct(
        F.create_map(*pairs).alias("fields"),
        F.lit(predicted).alias("augmented"),
        reasoning.alias("reasoning"),
    ).cast(DEMO_TYPE)


def _passing(scored: DataFrame, spec: TaskSpec, key: str, threshold: float) -> DataFrame:
    demo = demo_of(spec, True, "reasoning" in scored.columns)
    return scored.filter(F.col("score") >= threshold).select(key, demo.alias("demo"))


def _probe_sizes(total: int) -> Iterator[int]:
    """How many rows are tried in all after each round; the last number is ``total``."""
    size = PROBE_ROWS
    while size < total:
        yield size
        size *= PROBE_GROWTH
    yield total


def _head(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The first rows in key order; a long head is found by its last key, not by sorting."""
    if size <= SORTED_ROWS:
        return checkpoint(rows.orderBy(key).limit(size))
    _, cut = key_at_rank(rows, [key], rank=size)
    return rows if cut is None else rows.filter(F.col(key) < F.lit(cut[key]))


def first_passing(
    train: DataFrame, spec: TaskSpec, key: str, teacher: Teacher, count: int, threshold: float
) -> DataFrame:
    """The first ``count`` rows in key order that the teacher gets right.

    Teacher calls are dear, so growing heads of the split are tried, each row once, until enough
    pass: it answers at most some sixteen times the rows that were needed.
    """

    def best(rows: DataFrame) -> DataFrame:
        return rows.orderBy(key).limit(count)

    total, found, rest, tried = train.count(), None, train, 0
    for size in _probe_sizes(total):
        part = _head(rest, key, size - tried)
        passed = checkpoint(best(_passing(teacher(part), spec, key, threshold)))
        found = passed if found is None else checkpoint(best(found.unionByName(passed)))
        if size == total or found.count() >= count:
            break
        rest = rest.filter(F.col(key) > F.lit(part.agg(F.max(key).alias("last")).first()["last"]))
        tried = size
    return found


def first_passing_per_seed(
    train: DataFrame,
    spec: TaskSpec,
    key: str,
    teacher: Teacher,
    seeds: Sequence[str],
    count: int,
    threshold: float,
) -> DataFrame:
    """The same for several seeds at once, each with its own row order.

    A round tries the rows that come early for some seed, told by their draws alone.  The teacher
    sees a row once, however many seeds and rounds drew it.
    """
    total, passing, before = train.count(), None, None
    order = Window.partitionBy("seed").orderBy("_draw", key)

    def early(limit: str | None) -> Column:
        if limit is None:
            return F.lit(True)
        # Written out seed by seed: a lambda is not compiled.
        draws = [seeded_rank(s, F.col(key)) < limit for s in seeds]
        return reduce(lambda x, y: x | y, draws, F.lit(False))

    for size in _probe_sizes(total):
        limit = None if size == total else f"{int(size / total * (1 << 64)):016x}"
        part = train.filter(early(limit))
        if before is not None:
            part = part.filter(~early(before))
        if limit is not None:
            # Few rows, which the teacher reads more than once.
            part = checkpoint(part)
        passed = checkpoint(_passing(teacher(part), spec, key, threshold))
        passing = passed if passing is None else passing.unionByName(passed)
        drawn = passing.withColumn("seed", F.explode(F.lit(list(seeds)))).withColumn(
            "_draw", seeded_rank(F.col("seed"), F.col(key))
        )
        if limit is not None:
            # Later rows of a seed may still be untried.
            drawn = drawn.filter(F.col("_draw") < limit)
        ranked = drawn.withColumn("draw", F.row_number().over(order))
        found = checkpoint(ranked.filter(F.col("draw") <= count).drop("_draw"))
        full = found.groupBy("seed").count().filter(F.col("count") >= count).count()
        if size == total or full == len(set(seeds)):
            return found
        before = limit
    return found


def bootstrap_demos(
    train: DataFrame,
    spec: TaskSpec,
    key: str,
    teacher: Teacher,
    seed: str = "0",
    max_bootstrapped: int = MAX_BOOTSTRAPPED,
    max_labeled: int = MAX_LABELED,
    threshold: float = 1.0,
) -> DataFrame:
    """Demos of a bootstrapped program: teacher-made ones first, then labelled rows.

    Columns ``position, key, demo``.  Labelled rows fill up to ``max_labeled`` in all.
    """
    made = first_passing(train, spec, key, teacher, max_bootstrapped, threshold)
    rest = train.join(made.select(key), key, "left_anti")
    labelled = sample_per_seed(rest, key, [seed], max_labeled).select(
        key, demo_of(spec, False, False).alias("demo"), F.col("draw")
    )
    both = made.select(key, "demo", F.lit(0).alias("draw")).unionByName(labelled)
    # At most max_bootstrapped + max_labeled rows are ordered here.
    order = Window.partitionBy(F.lit(0)).orderBy("draw", key)
    return (
        both.withColumn("position", F.row_number().over(order))
        .filter(F.col("demo.augmented") | (F.col("position") <= max_labeled))
        .select("position", key, "demo")
    )


def candidate_programs(
    train: DataFrame,
    spec: TaskSpec,
    key: str,
    teacher: Teacher,
    count: int = NUM_CANDIDATES,
    max_bootstrapped: int = MAX_BOOTSTRAPPED,
    max_labeled: int = MAX_LABELED,
    threshold: float = 1.0,
) -> DataFrame:
    """Demo sets for a random search: ``candidate_id, demos`` with ids 0 to ``count - 1``.

    Candidate 0 has no demos, candidate 1 only labelled ones, the others are bootstrapped
    from row orders of their own.
    """
    if count < 3:
        raise ValueError("a random search needs at least three candidates")
    seeds = [str(i) for i in range(1, count)]
    made = first_passing_per_seed(
        train, spec, key, teacher, seeds[1:], max_bootstrapped, threshold
    ).select("seed", key, "demo", F.lit(0).alias("kind"), "draw")
    labelled = sample_per_seed(
        train.select(key, demo_of(spec, False, False).alias("demo")),
        key,
        seeds,
        max_labeled + max_bootstrapped,
    ).select("seed", key, "demo", F.lit(1).alias("kind"), "draw")
    fresh = labelled.join(made.select("seed", key), ["seed", key], "left_anti")
    order = Window.partitionBy("seed").orderBy("kind", "draw")
    kept = (
        made.unionByName(fresh.select(*made.columns))
        .withColumn("position", F.row_number().over(order))
        .filter((F.col("kind") == 0) | (F.col("position") <= max_labeled))
    )
    sets = kept.groupBy(F.col("seed").cast("int").alias("candidate_id")).agg(
        F.array_sort(F.collect_list(F.struct("position", "kind", "draw", key))).alias("picks"),
        F.map_from_entries(F.collect_list(F.struct("position", "demo"))).alias("by_position"),
    )
    sets = sets.select(
        "candidate_id",
        F.transform("picks", lambda p: F.col("by_position")[p["position"]]).alias("demos"),
    )
    empty = train.sparkSession.range(1).select(
        F.lit(0).alias("candidate_id"), F.array().cast(f"array<{DEMO_TYPE}>").alias("demos")
    )
    return checkpoint(empty.unionByName(sets))


def studied(
    rows: DataFrame, candidates: DataFrame, count: int | Sequence[int], student: Student
) -> DataFrame:
    """The student's rows for every row with every candidate."""
    over = getattr(student, "over", None)
    return student(fan_out(rows, candidates, count)) if over is None else over(rows, candidates, count)


def score_candidates(
    rows: DataFrame,
    candidates: DataFrame,
    count: int | Sequence[int],
    student: Student,
    *by: str,
) -> DataFrame:
    """Score of every candidate over the rows (and per ``by``)."""
    return dataset_score(studied(rows, candidates, count, student), "candidate_id", *by)


def random_search(
    dev: DataFrame, candidates: DataFrame, count: int, student: Student
) -> DataFrame:
    """All demo sets scored on dev, the best one marked."""
    return mark_best(score_candidates(dev, candidates, count, student))


def instruction_search(
    rows: DataFrame, instructions: DataFrame, count: int, student: Student
) -> DataFrame:
    """All instruction texts (``candidate_id, instructions``) scored, the best one marked."""
    programs = instructions.withColumn("demos", F.array().cast(f"array<{DEMO_TYPE}>"))
    return mark_best(score_candidates(rows, programs, count, student))


def instruction_rounds(
    rows: DataFrame,
    instructions: DataFrame,
    student: Student,
    propose: Proposer,
    depth: int,
) -> DataFrame:
    """Instruction search in rounds: the scores so far make the proposals of the next round.

    Starts from ``instructions`` (``candidate_id`` 0 to n - 1, ``instructions``).  ``propose``
    takes the scored table and returns rows of ``instructions``; texts that were scored before, NULL
    and empty ones are left out.  New ids go on from the old ones, in the order of the texts.  Ends after
    ``depth`` scored rounds, or when nothing new is proposed.  Returns ``round`` (from 0),
    ``candidate_id``, ``instructions``, ``percent``, ``examples`` and ``best``.
    """
    if depth < 1:
        raise ValueError("at least one round is needed")
    new = checkpoint(instructions.select("candidate_id", "instructions"))
    known, scored = 0, None
    for number in range(depth):
        count = new.count()
        if not count:
            break
        programs = checkpoint(new.withColumn("demos", F.array().cast(f"array<{DEMO_TYPE}>")))
        ids = list(range(known, known + count))
        scores = score_candidates(rows, programs, ids, student)
        part = new.join(scores, "candidate_id").withColumn("round", F.lit(number))
        # One row a candidate; the proposer and the next round read it.
        scored = checkpoint(part if scored is None else scored.unionByName(part))
        known += count
        if number + 1 < depth:
            texts = propose(scored.select("candidate_id", "instructions", "percent"))
            texts = texts.select("instructions").filter(F.col("instructions") != "").distinct()
            fresh = texts.join(scored.select("instructions"), "instructions", "left_anti")
            order = Window.partitionBy(F.lit(0)).orderBy("instructions")
            place = F.row_number().over(order) + F.lit(known - 1)
            new = checkpoint(fresh.select(place.cast("int").alias("candidate_id"), "instructions"))
    if scored is None:
        raise ValueError("there are no instructions to begin with")
    return mark_best(scored.select("round", "candidate_id", "instructions", "percent", "examples"))


def joint_candidates(
    instructions: DataFrame, demo_sets: DataFrame, num_demo_sets: int
) -> DataFrame:
    """Every instruction with every demo set, as one candidate table.

    Ids are ``instruction * num_demo_sets + demo_set``.
    """
    pairs = instructions.select(
        F.col("candidate_id").alias("instruction_id"),
        "instructions",
        F.explode(F.sequence(F.lit(0), F.lit(num_demo_sets - 1))).alias("demo_set_id"),
    )
    sets = demo_sets.select(F.col("candidate_id").alias("demo_set_id"), "demos")
    joined = pairs.join(sets, "demo_set_id").select(
        (F.col("instruction_id") * num_demo_sets + F.col("demo_set_id"))
        .cast("int")
        .alias("candidate_id"),
        "instruction_id",
        "demo_set_id",
        "instructions",
        "demos",
    )
    return checkpoint(joined)


def joint_search(
    dev: DataFrame,
    candidates: DataFrame,
    count: int,
    key: str,
    student: Student,
    num_batches: int = NUM_BATCHES,
    batch_rows: int = 25,
) -> DataFrame:
    """Candidates scored on mini-batches of dev; the best mean over the batches is marked."""
    seeds = [f"batch{i}" for i in range(num_batches)]
    batches = sample_per_seed(dev, key, seeds, batch_rows).withColumnRenamed("seed", "batch")
    per_batch = score_candidates(batches, candidates, count, student, "batch")
    means = per_batch.groupBy("candidate_id").agg(
        F.round(F.avg("percent"), 4).alias("percent"), F.sum("examples").alias("examples")
    )
    return mark_best(means)


def race_radius(mean: float, squares: float, examples: int, risk: float) -> float:
    """How far the true mean of scores in [0, 1] may lie from that of the examples seen.

    The smaller of Hoeffding's bound and the empirical Bernstein bound, each at half the risk.
    """
    if not examples:
        return math.inf
    spread = max(0.0, squares / examples - mean * mean)
    hoeffding = math.sqrt(math.log(4 / risk) / (2 * examples))
    part = math.log(6 / risk) / examples
    return min(hoeffding, math.sqrt(2 * spread * part) + 3 * part)


def racing_search(
    dev: DataFrame,
    candidates: DataFrame,
    count: int,
    key: str,
    student: Student,
    num_batches: int = NUM_BATCHES,
    batch_rows: int = 25,
    risk: float = RACE_RISK,
) -> DataFrame:
    """``joint_search`` that stops asking about candidates which can hardly win.

    The mini-batches are those of ``joint_search`` and come in rounds of 1, 1, 2, 4, ... .  After
    each round a candidate goes when the upper bound of its mean lies below the best lower bound; the
    bounds hold for all candidates and rounds together but for a chance of ``risk``.  Scores must
    lie in [0, 1].  Survivors see all batches, so their ``percent`` is that of ``joint_search``; that
    of the others is over the ``batches`` they saw.  The best survivor is marked.
    """
    seeds = [f"batch{i}" for i in range(num_batches)]
    drawn = sample_per_seed(dev, key, seeds, batch_rows).withColumnRenamed("seed", "batch")
    drawn = checkpoint(drawn)
    rounds, done = [], 0
    while done < num_batches:
        size = min(max(1, done), num_batches - done)
        rounds.append(seeds[done : done + size])
        done += size
    each_risk = risk / max(1, count * len(rounds))
    alive, seen = list(range(count)), None
    for batches in rounds:
        rows = drawn.filter(F.col("batch").isin(batches))
        scored = studied(rows, candidates, alive, student).groupBy("candidate_id", "batch").agg(
            percent_score(F.col("score")).alias("percent"),
            F.count(F.lit(1)).alias("examples"),
            F.sum(F.col("score").cast("double")).alias("total"),
            F.sum(F.pow(F.col("score").cast("double"), 2)).alias("squares"),
        )
        # A row for each candidate and batch.
        part = checkpoint(scored)
        seen = part if seen is None else seen.unionByName(part)
        bounds = {}
        sums = seen.filter(F.col("candidate_id").isin(alive)).groupBy("candidate_id")
        for row in sums.agg(*[F.sum(c).alias(c) for c in ("total", "squares", "examples")]).collect():
            mean = (row["total"] or 0.0) / row["examples"]
            radius = race_radius(mean, row["squares"] or 0.0, row["examples"], each_risk)
            bounds[row["candidate_id"]] = (mean - radius, mean + radius)
        least = max((low for low, _ in bounds.values()), default=-math.inf)
        alive = [c for c in alive if c not in bounds or bounds[c][1] >= least]
    means = seen.groupBy("candidate_id").agg(
        F.round(F.avg("percent"), 4).alias("percent"),
        F.sum("examples").alias("examples"),
        F.count(F.lit(1)).cast("int").alias("batches"),
    )
    means = checkpoint(means)
    best = best_candidate(means.filter(F.col("candidate_id").isin(alive)))
    return means.join(
        best.select("candidate_id", F.lit(True).alias("best")), "candidate_id", "left"
    ).withColumn("best", F.coalesce("best", F.lit(False)))


def mark_best(scores: DataFrame) -> DataFrame:
    """Flag the best candidate.  The scores, one row per candidate, are computed once."""
    scores = checkpoint(scores)
    best = best_candidate(scores).select("candidate_id", F.lit(True).alias("best"))
    return scores.join(best, "candidate_id", "left").withColumn(
        "best", F.coalesce(F.col("best"), F.lit(False))
    )
