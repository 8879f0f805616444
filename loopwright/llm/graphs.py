"""Connected components of links between numbered items, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import stored


def _apart(links: DataFrame) -> DataFrame:
    """Each link between different items once, the smaller item first."""
    return (
        links.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _roots(edges: DataFrame) -> DataFrame:
    """``id`` and ``root``: every item hooks to its smallest neighbour, and on to the end of that chain."""
    both = edges.union(edges.select("b", "a"))
    hooked = both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.first("a")).alias("root")
    )
    hooked = stored(hooked, "hooks")
    while True:
        # Doubling: the number of joins is the logarithm of the longest chain.
        further = hooked.select(F.col("id").alias("root"), F.col("root").alias("next"))
        jumped = stored(hooked.join(further, "root").select("id", "root", "next"), "hooks")
        hooked = jumped.select("id", F.col("next").alias("root"))
        if not jumped.filter("root <> next").limit(1).count():
            return hooked


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id`` and ``component`` (the smallest id reachable) of every linked item.

    ``links`` has columns ``a`` and ``b``.  Each round shrinks the trees of hooked items to their
    roots, so links vanish from round to round.  All steps are written to the shared folder;
    nothing comes to the driver but whether something is left.
    """
    edges, labels = stored(_apart(links.select("a", "b")), "links"), None
    for _ in range(rounds):
        roots = _roots(edges)
        if labels is None:
            labels = roots.withColumnRenamed("root", "component")
        else:
            on = roots.select(F.col("id").alias("component"), "root")
            labels = stored(
                labels.join(on, "component", "left").select(
                    "id", F.coalesce("root", "component").alias("component")
                ),
                "labels",
            )
        ends = [
            roots.select(F.col("id").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b")
        ]
        shrunk = edges.join(ends[0], "a").join(ends[1], "b").filter("r_a <> r_b")
        edges = stored(
            _apart(shrunk.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))), "links"
        )
        if not edges.limit(1).count():
            return labels
    raise ValueError(f"components did not settle in {rounds} rounds")
