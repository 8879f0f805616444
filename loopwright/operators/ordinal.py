"""Positions, splits and samples over data that has no order of its own.

Order always comes from key columns, which must be unique and not NULL.  Nothing
here sorts a whole table, or a whole group, inside one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from loopwright.session import broadcast_if_small, checkpoint

# A rank is looked up directly among this many keys; more are narrowed down first.
_GATHER_ROWS = 100_000
_PIVOTS = 10_000
_MAX_ROUNDS = 24


# Sampled keys for each range; with so many, ranges differ little in size.
_SAMPLED = 100


def _bounds(df: DataFrame, keys: Sequence[str], ranges: int) -> list[Row]:
    """Keys that cut the table into some ``ranges`` ranges of like size, from a sample of its keys."""
    found = df.select(*keys)
    total = found.count()
    if ranges < 2 or not total:
        return []
    share = min(1.0, ranges * _SAMPLED / total)
    sample = found.sample(share, seed=1) if share < 1 else found
    # About _SAMPLED keys a range come to the driver, whatever the table's size.
    taken = sample.orderBy(*keys).collect()
    cuts = [taken[len(taken) * i // ranges] for i in range(1, ranges)] if taken else []
    return list(dict.fromkeys(cuts))


def _range_number(df: DataFrame, keys: Sequence[str], bounds: Sequence[Row]) -> Column:
    """How many bounds are at or below the row's key: a binary search in a literal array.

    A row's range follows from its key alone, so tasks that are run again agree.
    """
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[_key_literal(df, keys, row) for row in bounds])
    bits = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    key = _key_struct(keys)

    def step(below: Column, bit: Column) -> Column:
        cut = F.get(cuts, below + bit - 1)
        return F.when(cut.isNotNull() & (cut <= key), below + bit).otherwise(below)

    return F.aggregate(F.lit(bits), F.lit(0), step)


def _range_count(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _fresh(df: DataFrame, name: str) -> str:
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_ordinal(
    df: DataFrame, keys: Sequence[str], name: str = "ordinal", partitions: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in key order.

    Rows fall into ranges by literal bounds; a narrow scan counts each range.  Then every row
    is shuffled once, to its range, and numbered there.  Nothing but counts is kept.
    """
    bounds = _bounds(df, keys, _range_count(df, partitions))
    place = _fresh(df, "_range")
    ranged = df.withColumn(place, _range_number(df, keys, bounds))
    counts = {r[place]: r["count"] for r in ranged.groupBy(place).count().collect()}
    starts = list(accumulate((counts.get(i, 0) for i in range(len(bounds))), initial=0))
    order = Window.partitionBy(place).orderBy(*keys)
    start = F.element_at(F.lit(starts), F.col(place) + 1)
    return ranged.withColumn(
        name, (start + F.row_number().over(order) - 1).cast("long")
    ).drop(place)


def with_group_ordinal(
    df: DataFrame,
    groups: Sequence[str],
    keys: Sequence[str],
    name: str = "ordinal",
    partitions: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row inside its group, in key order.

    A group may span any number of ranges, so a hot group is never gathered: a row's position
    is that in its part of the group, plus the sizes of the group's earlier parts.  At most one
    group goes on from one range into the next, so there are fewer such sums than ranges.
    """
    both = [*groups, *keys]
    bounds = _bounds(df, both, _range_count(df, partitions))
    place = _fresh(df, "_range")
    ranged = df.withColumn(place, _range_number(df, both, bounds))
    parts = ranged.groupBy(place, *groups).count()
    earlier = Window.partitionBy(*groups).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.withColumn("_before", F.sum("count").over(earlier)).filter("_before > 0")
    sums = sums.select(
        F.col(place).alias("_at"), *[F.col(g).alias(f"_g_{g}") for g in groups], "_before"
    )
    same = ranged[place] == F.col("_at")
    for g in groups:
        same = same & ranged[g].eqNullSafe(F.col(f"_g_{g}"))
    order = Window.partitionBy(place, *groups).orderBy(*keys)
    # Fewer rows than ranges.
    joined = ranged.join(F.broadcast(checkpoint(sums)), same, "left")
    position = F.row_number().over(order) - 1 + F.coalesce("_before", F.lit(0))
    return joined.withColumn(name, position.cast("long")).select(*df.columns, name)


def _key_struct(keys: Sequence[str]) -> Column:
    return F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)


def _key_literal(df: DataFrame, keys: Sequence[str], row: Row) -> Column:
    parts = [F.lit(row[k]).cast(df.schema[k].dataType).alias(k) for k in keys]
    return parts[0] if len(keys) == 1 else F.struct(*parts)


def key_at_rank(
    df: DataFrame, keys: Sequence[str], rank: int | None = None, fraction: float | None = None
) -> tuple[int, Row | None]:
    """Row count, and the key of the row at a 0-based rank (or at ``int(fraction * n)``).

    Nothing is shuffled: each round samples pivots, counts the keys between them in one
    scan of the key columns, and goes on inside the interval that holds the rank, whose keys
    are written once.
    """
    key, found = _key_struct(keys), df.select(*keys)
    total = inside = found.count()
    if rank is None:
        rank = int(fraction * total)
    if not 0 <= rank < total:
        return total, None
    for attempt in range(_MAX_ROUNDS):
        if inside <= _GATHER_ROWS:
            return total, found.orderBy(*keys).offset(rank).first()
        pivots = found.sample(min(1.0, _PIVOTS / inside), seed=attempt).orderBy(*keys).collect()
        if not pivots:
            continue
        place, margin = rank * len(pivots) // inside, 2 * int(len(pivots) ** 0.5)
        low = _key_literal(df, keys, pivots[max(0, place - margin)])
        high = _key_literal(df, keys, pivots[min(len(pivots) - 1, place + margin)])
        below, between = found.agg(
            F.count_if(key < low), F.count_if((key >= low) & (key < high))
        ).first()
        if rank < below:
            found, inside = found.filter(key < low), below
        elif rank < below + between:
            found, inside = found.filter((key >= low) & (key < high)), between
            rank -= below
        else:
            found, inside = found.filter(key >= high), inside - below - between
            rank -= below + between
        # What is left is a few percent of the keys: later rounds read it, not the source.
        found = checkpoint(found)
    raise ValueError(f"the keys {list(keys)} are not unique")


def mark_split(
    df: DataFrame, keys: Sequence[str], first_dev: Row | None, name: str = "split"
) -> DataFrame:
    """Rows before the key ``first_dev`` are ``train``, the others ``dev``; no key, no dev."""
    if first_dev is None:
        return df.withColumn(name, F.lit("train"))
    before = _key_struct(keys) < _key_literal(df, keys, first_dev)
    return df.withColumn(name, F.when(before, F.lit("train")).otherwise(F.lit("dev")))


def with_split(
    df: DataFrame, keys: Sequence[str], ratio: float = 0.8, name: str = "split"
) -> DataFrame:
    """Mark the first ``int(ratio * n)`` rows in key order ``train``, the rest ``dev``.

    The cut is found on the keys alone; the rows themselves only pass a filter.
    """
    _, first_dev = key_at_rank(df, keys, fraction=ratio)
    return mark_split(df, keys, first_dev, name)


def split_at(
    df: DataFrame, keys: Sequence[str], first_dev: Row | None
) -> tuple[DataFrame, DataFrame]:
    marked = mark_split(df, keys, first_dev, "_split")
    return tuple(
        marked.filter(F.col("_split") == part).drop("_split") for part in ("train", "dev")
    )


def split_train_dev(
    df: DataFrame, keys: Sequence[str], ratio: float = 0.8
) -> tuple[DataFrame, DataFrame]:
    """The two parts of ``with_split`` as DataFrames."""
    return split_at(df, keys, key_at_rank(df, keys, fraction=ratio)[1])


def row_at(df: DataFrame, keys: Sequence[str], position: int) -> DataFrame:
    """The row at a 0-based position in key order; empty when there is none."""
    _, row = key_at_rank(df, keys, rank=position)
    if row is None:
        return df.limit(0)
    return df.filter(_key_struct(keys) == _key_literal(df, keys, row))


def seeded_rank(seed: Column | str, key: Column) -> Column:
    """A reproducible shuffle key: SHA-256 of seed and row key."""
    seed = F.lit(seed) if isinstance(seed, str) else seed.cast("string")
    return F.sha2(F.concat_ws("-", seed, key.cast("string")), 256)


def random_rows(df: DataFrame, key: str, seed: str, count: int = 1) -> DataFrame:
    """``count`` rows picked without replacement; the same seed picks the same rows."""
    return (
        df.withColumn("_draw", seeded_rank(seed, F.col(key)))
        .orderBy("_draw", key)
        .limit(count)
        .drop("_draw")
    )


def sample_per_seed(df: DataFrame, key: str, seeds: Sequence[str], count: int) -> DataFrame:
    """For every seed an own sample of ``count`` rows, with ``seed`` and 1-based ``draw``.

    Draws are uniform, so nearly all rows can be ruled out by their draw alone; what is left
    is ranked.  Should too few rows pass, all are ranked.  Only keys are drawn and ranked; the
    picked ones (at most ``count`` a seed) then fetch their rows.
    """
    total = df.count()
    wanted = 4 * count + 64
    if total > 4 * wanted:
        limit = f"{int(wanted / total * (1 << 64)):016x}"
        found = checkpoint(_ranked_draws(df.select(key), key, seeds, count, limit))
        if found.count() == count * len(set(seeds)):
            return _picked_rows(df, key, found)
    return _picked_rows(df, key, checkpoint(_ranked_draws(df.select(key), key, seeds, count, None)))


def _picked_rows(df: DataFrame, key: str, picks: DataFrame) -> DataFrame:
    return df.join(broadcast_if_small(picks), key).select(*df.columns, "seed", "draw")


def _ranked_draws(
    df: DataFrame, key: str, seeds: Sequence[str], count: int, limit: str | None
) -> DataFrame:
    wanted = F.lit(list(seeds))
    if limit is not None:
        # Seeds that rule the row out never become rows.
        early = [F.when(seeded_rank(s, F.col(key)) < limit, F.lit(s)) for s in seeds]
        wanted = F.array_compact(F.array(*early))
    drawn = df.withColumn("seed", F.explode(wanted)).withColumn(
        "_draw", seeded_rank(F.col("seed"), F.col(key))
    )
    order = Window.partitionBy("seed").orderBy("_draw", key)
    return (
        drawn.withColumn("draw", F.row_number().over(order))
        .filter(F.col("draw") <= count)
        .drop("_draw")
    )
