"""From reviewed predictions back to a training set: filter, correct, merge, dedupe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.operators.contracts import column_differences

# Review levels kept by default and the advised share of new rows.
QUALITY_LEVELS = ("good", "fix")
MAX_NEW_RATIO = 0.5

CORRECTION_PREFIX = "_corrected_"
KEY_PREFIX = "original_"


def filter_quality(df: DataFrame, levels: Sequence[str] = QUALITY_LEVELS) -> DataFrame:
    """Rows of the wanted review levels; without reviews, rows that succeeded."""
    if "_quality" in df.columns:
        return df.filter(F.col("_quality").isin(*levels))
    if "_status" in df.columns:
        return df.filter(F.col("_status") == "success")
    return df


def correction_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    """(column, its correction) for every correction column with a base column."""
    bases = [(c.removeprefix(CORRECTION_PREFIX), c) for c in columns if c.startswith(CORRECTION_PREFIX)]
    return [(base, fix) for base, fix in bases if base in columns]


def apply_corrections(df: DataFrame) -> DataFrame:
    """A correction that is there replaces the value it corrects."""
    return df.withColumns(
        {base: F.coalesce(F.col(fix), F.col(base)) for base, fix in correction_pairs(df.columns)}
    )


def correction_counts(df: DataFrame) -> DataFrame:
    """How many corrections each column would get, as one row of ``applied_<column>``."""
    pairs = correction_pairs(df.columns)
    if not pairs:
        raise ValueError("no correction columns")
    return df.agg(*[F.count(fix).alias(f"applied_{base}") for base, fix in pairs])


def drop_bookkeeping(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def recycled_rows(
    reviewed: DataFrame, levels: Sequence[str] = QUALITY_LEVELS, use_corrected: bool = True
) -> DataFrame:
    """Reviewed predictions as plain training rows."""
    kept = filter_quality(reviewed, levels)
    return drop_bookkeeping(apply_corrections(kept) if use_corrected else kept)


def union_common(
    original: DataFrame, new: DataFrame, order_key: str, source: str = "_source"
) -> DataFrame:
    """All rows of both sides on their common columns, original side first.

    ``order_key`` gives each side's row order and is kept as ``_ord``; the
    source column is 0 for original rows and 1 for new ones.
    """
    common, _, _ = column_differences(
        [c for c in original.columns if c != order_key], [c for c in new.columns if c != order_key]
    )

    def side(df: DataFrame, tag: int) -> DataFrame:
        return df.select(F.lit(tag).alias(source), F.col(order_key).alias("_ord"), *common)

    return side(original, 0).unionByName(side(new, 1))


def dedupe_keys(columns: Sequence[str]) -> list[str]:
    """The ``original_`` columns, else the first half of the columns."""
    data = [c for c in columns if not c.startswith("_")]
    return [c for c in data if c.startswith(KEY_PREFIX)] or data[: len(data) // 2]


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row, by ``order``, of every key; NULL keys are equal.

    The key hash leads the sort, so long text keys are compared only on a tie,
    and each task passes on one row per key: a hot key shrinks before the shuffle.
    """
    window = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*[F.desc(c) for c in order])
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def merge_datasets(
    original: DataFrame,
    new: DataFrame,
    order_key: str,
    dedupe: bool = True,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Original and new rows in one set; of equal keys the newest row stays.

    Keeps ``_source`` and ``_ord`` for order and statistics; drop them with
    ``drop_bookkeeping``.
    """
    both = union_common(original, new, order_key)
    if not dedupe:
        return both
    return keep_last(both, list(keys or dedupe_keys(both.columns)), ["_source", "_ord"])


def merge_statistics(
    original: DataFrame,
    new: DataFrame,
    order_key: str,
    keys: Sequence[str] | None = None,
    max_new_ratio: float = MAX_NEW_RATIO,
) -> DataFrame:
    """One row of counts and shares for a deduplicating merge.

    Both sides are read once: rows are counted per key and side, and a key is one merged row.
    """
    both = union_common(original, new, order_key)
    per_key = both.groupBy(*(keys or dedupe_keys(both.columns))).agg(
        F.count_if(F.col("_source") == 0).alias("old_rows"),
        F.count_if(F.col("_source") == 1).alias("new_rows"),
    )

    def total(name: str) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    totals = per_key.agg(
        total("old_rows").alias("original_count"),
        total("new_rows").alias("new_count"),
        F.count(F.lit(1)).alias("merged_count"),
    )
    before = F.col("original_count") + F.col("new_count")
    ratio = F.try_divide(F.col("new_count"), before)
    return totals.select(
        "original_count",
        "new_count",
        "merged_count",
        (before - F.col("merged_count")).alias("removed_count"),
        F.round(ratio, 6).alias("new_ratio"),
        F.round(F.try_divide(F.col("new_count"), F.col("merged_count")), 6).alias("new_share"),
        F.coalesce(ratio > max_new_ratio, F.lit(False)).alias("over_ratio"),
    )
