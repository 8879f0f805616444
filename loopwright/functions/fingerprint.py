"""Content fingerprint of a table: one pass, partial sums only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANES = 4
LANE_DIGITS = 15
PARTS = 3
PART_BITS = 20


def row_digest(columns: Sequence[str]) -> Column:
    """SHA-256 over length-prefixed cells in column-name order; NULL is its own mark."""
    cells = []
    for name in sorted(columns):
        text = F.col(name).cast("string")
        cells.append(
            F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("~"))
        )
    return F.sha2(F.concat(*cells), 256)


def lanes(digest: Column) -> list[Column]:
    """The first 60 hex digits of a digest as four numbers of 60 bits."""
    return [
        F.conv(F.substring(digest, 1 + i * LANE_DIGITS, LANE_DIGITS), 16, 10)
        .cast("long")
        .alias(f"lane{i}")
        for i in range(LANES)
    ]


def lane_sums() -> list[Column]:
    """Sums of the lanes that together stand for the multiset of row digests.

    Each lane is summed in three 20-bit parts: plain long sums, which hold for 2^43 rows, are
    several times faster than decimal ones.
    """
    mask = F.lit((1 << PART_BITS) - 1)
    return [
        F.sum(F.shiftright(f"lane{i}", j * PART_BITS).bitwiseAND(mask)).alias(f"lane{i}_{j}")
        for i in range(LANES)
        for j in range(PARTS)
    ]


def lane_digest() -> Column:
    """The fingerprint from ``row_count`` and the sums of ``lane_sums``."""
    totals = []
    for i in range(LANES):
        parts = [
            F.coalesce(F.col(f"lane{i}_{j}"), F.lit(0)).cast("decimal(20,0)")
            * F.lit(1 << (j * PART_BITS)).cast("decimal(14,0)")
            for j in range(PARTS)
        ]
        totals.append((parts[0] + parts[1] + parts[2]).cast("decimal(38,0)").cast("string"))
    return F.sha2(F.concat_ws("|", F.col("row_count").cast("string"), *totals), 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row: row count and 64 hex digits that ignore row and column order.

    Add an ordinal column to ``columns`` to make the result depend on row order.
    """
    names = list(columns or df.columns)
    digests = df.select(row_digest(names).alias("digest"))
    sums = digests.select(*lanes(F.col("digest"))).agg(
        F.count(F.lit(1)).alias("row_count"), *lane_sums()
    )
    return sums.select("row_count", lane_digest().alias("fingerprint"))
