"""Programs as rows of demos: statistics and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Demo keys that are bookkeeping, and both names of the reasoning.
REASONING_KEYS = ("reasoning", "rationale")
BOOKKEEPING_KEYS = ("augmented", "reasoning")


def program_document(demos: Column, instructions: Column) -> Column:
    """A program as the JSON text that ``read_programs`` reads: one module with its demos."""
    none = F.create_map().cast("map<string,string>")

    def shown(demo: Column) -> Column:
        marks = F.create_map(
            F.lit("augmented"), demo["augmented"].cast("string"),
            F.lit(REASONING_KEYS[1]), demo["reasoning"],
        )
        both = F.map_concat(F.coalesce(demo["fields"], none), marks)
        return F.map_filter(both, lambda _, v: v.isNotNull())

    module = F.struct(
        F.transform(demos, shown).alias("demos"), instructions.alias("signature_instructions")
    )
    return F.to_json(F.struct(module.alias("predict")))


def demo_stats(programs: DataFrame, demos: str = "demos", key: str = "program_id") -> DataFrame:
    """Counts over each program's demo array, without a shuffle.

    Demos are structs of ``fields`` (text map), ``augmented`` and ``reasoning``.
    """
    array = F.coalesce(F.col(demos), F.array())
    names = F.array_distinct(F.flatten(F.transform(array, lambda d: F.map_keys(d["fields"]))))
    return programs.select(
        key,
        F.size(array).alias("total"),
        F.size(F.filter(array, lambda d: d["augmented"])).alias("augmented"),
        F.size(F.filter(array, lambda d: ~F.coalesce(d["augmented"], F.lit(False)))).alias(
            "labeled"
        ),
        F.array_sort(F.array_except(names, F.lit(list(BOOKKEEPING_KEYS)))).alias("fields"),
        F.exists(array, lambda d: d["reasoning"].isNotNull()).alias("has_reasoning"),
    )


def _signed(difference: Column) -> Column:
    return F.when(difference > 0, F.concat(F.lit("+"), difference.cast("string"))).otherwise(
        difference.cast("string")
    )


def compare_programs(stats: DataFrame, pairs: DataFrame, key: str = "program_id") -> DataFrame:
    """Statistics of two programs side by side, for pairs of ``first_id, second_id``."""
    counts = ("total", "augmented", "labeled")

    def side(name: str) -> DataFrame:
        return stats.select(
            F.col(key).alias(f"{name}_id"),
            *[F.col(c).alias(f"{name}_{c}") for c in counts],
            F.array_join("fields", ", ").alias(f"{name}_fields"),
            F.col("has_reasoning").alias(f"{name}_has_reasoning"),
        )

    joined = pairs.join(side("first"), "first_id").join(side("second"), "second_id")
    return joined.select(
        "first_id",
        "second_id",
        *[f"{s}_{c}" for c in counts for s in ("first", "second")],
        *[_signed(F.col(f"second_{c}") - F.col(f"first_{c}")).alias(f"{c}_change") for c in counts],
        "first_fields",
        "second_fields",
        "first_has_reasoning",
        "second_has_reasoning",
    )
