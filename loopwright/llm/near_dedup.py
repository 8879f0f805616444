"""Near-duplicate documents: min-hash bands propose, a Bayesian test prunes, full sets decide.

Two documents are linked when their sets of five-word shingles have a Jaccard similarity of 0.75
or more.  Equal sets form a class and are handled as one.  Classes that share a band of their
min-hash signatures are candidates.  A candidate's signatures are compared batch by batch, and
it is dropped once the posterior chance of a similarity of 0.75 falls below the miss
probability.  The others are confirmed on their full sets.

Buckets are not expanded into pairs at once: first each bucket's members are compared with its
hub, the class that shares most bands overall.  In what is left, shingles that few classes have
are told apart: pairs that share such a shingle are listed by it, and for all others only the
frequent shingles count, which bounds their similarity.  Pairs that are not connected yet, and
that the bound allows, are compared; so no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import fresh, give_back, in_batches, stored
from loopwright.llm.graphs import components
from loopwright.llm.shingles import MinHasher, constants, mixed, set_key, shingle_sets
from loopwright.session import broadcast_if_small

PERCENT = 75
# 32 bands of 4: a pair at exactly 0.75 shares none with a chance of 5 in a million.
BANDS, ROWS = 32, 4
BATCH = 16
MISS = 1e-7
# Shingles that so many open classes have at most are listed class by class.
SCARCE = 16

_SIGNED = "doc_id long, text_key long, n_shingles long, c1 long, c2 long, signature binary"


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per document: size and 128-bit name of its shingle set, and the set's signature."""

    def make():
        hasher = MinHasher(bands * rows)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else t.encode() for t in batch.column(2).to_pylist()]
            sets = shingle_sets(texts)
            keys = [set_key(s) for s in sets]
            signatures = [hasher.signature(s).tobytes() if len(s) else None for s in sets]
            return pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([len(s) for s in sets], type=pa.int64()),
                    pa.array([k[0] for k in keys], type=pa.int64()),
                    pa.array([k[1] for k in keys], type=pa.int64()),
                    pa.array(signatures, type=pa.binary()),
                ],
                names=[c.split()[0] for c in _SIGNED.split(", ")],
            )

        return each

    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")
    return in_batches(keyed, make, _SIGNED)


def banded(classes: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """A row for each band of each class: ``band`` (hash of its number and values), ``node``, ``n``."""

    def make():
        salt = constants(bands, 11)
        factors = constants(rows, 13) | np.uint64(1)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            count = batch.num_rows
            values = np.frombuffer(
                b"".join(batch.column(2).to_pylist()), dtype=np.uint32
            ).reshape(count, bands, rows)
            keys = mixed((values.astype(np.uint64) * factors).sum(axis=2) + salt)
            return pa.record_batch(
                [
                    pa.array(mixed(keys).view(np.int64).ravel()),
                    pa.array(np.repeat(batch.column(0).to_numpy(), bands)),
                    pa.array(np.repeat(batch.column(1).to_numpy(), bands)),
                ],
                names=["band", "node", "n"],
            )

        return each

    return in_batches(classes.select("node", "n", "signature"), make, "band long, node long, n long")


def least_matches(
    compared: int, percent: int = PERCENT, miss: float = MISS
) -> int:
    """Fewest equal values among ``compared`` that leave a similarity of ``percent`` likely enough.

    With a uniform prior, the posterior chance of a similarity of t or more after m of n equal
    values is the chance of at most m successes in n + 1 trials of probability t.
    """
    t, chance = percent / 100, 0.0
    for m in range(compared + 1):
        chance += comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if chance >= miss:
            return m
    return compared


def likely(
    pairs: DataFrame,
    classes: DataFrame,
    hashes: int = BANDS * ROWS,
    percent: int = PERCENT,
    batch_size: int = BATCH,
    miss: float = MISS,
) -> DataFrame:
    """The pairs (``a``, ``b``) that pass the sequential test on their signatures."""
    steps = [
        (end, least_matches(end, percent, miss)) for end in range(batch_size, hashes + 1, batch_size)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint32).reshape(
                    batch.num_rows, hashes
                )
                for c in (2, 3)
            )
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for end, least in steps:
                matches += (left[alive, done:end] == right[alive, done:end]).sum(axis=1)
                passed = matches >= least
                alive, matches, done = alive[passed], matches[passed], end
            yield pa.record_batch(
                [batch.column(c).take(pa.array(alive)) for c in (0, 1)], names=["a", "b"]
            )
        give_back()

    sides = [
        classes.select(F.col("node").alias(c), F.col("signature").alias(f"s_{c}")) for c in "ab"
    ]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame, repeated: DataFrame) -> DataFrame:
    """``node`` and the whole shingle set (sorted hashes) of the classes wanted, each once.

    ``wanted`` has ``node``, its document ``rep`` and both halves of its set's name; ``repeated`` the
    ids (``rep``) that several rows have.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else t.encode() for t in batch.column(3).to_pylist()]
            sets = shingle_sets(texts)
            names = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            # One id may have several texts: the set's name tells which one is meant.
            meant = [i for i, (s, name) in enumerate(zip(sets, names)) if set_key(s) == name]
            return pa.record_batch(
                [
                    batch.column(0).take(pa.array(meant, type=pa.int64())),
                    pa.array([sets[i].tobytes() for i in meant], type=pa.binary()),
                ],
                names=["node", "items"],
            )

        return each

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    found = texts.join(broadcast_if_small(wanted), "rep").select("rep", "node", "c1", "c2", "text")

    def sets(rows: DataFrame) -> DataFrame:
        return in_batches(rows.select("node", "c1", "c2", "text"), make, "node long, items binary")

    if not repeated.limit(1).count():
        return sets(found)
    again = broadcast_if_small(repeated)
    copies = sets(found.join(again, "rep", "left_semi")).dropDuplicates(["node"])
    return sets(found.join(again, "rep", "left_anti")).union(copies)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3)):
                left, right = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(left, right, assume_unique=True))
                found.append(100 * both >= percent * (len(left) + len(right) - both))
            mask = pa.array(found, type=pa.bool_())
            yield pa.record_batch(
                [batch.column(c).filter(mask) for c in (0, 1)], names=["a", "b"]
            )
        give_back()

    sides = [sets.select(F.col("node").alias(c), F.col("items").alias(f"i_{c}")) for c in "ab"]
    joined = pairs.join(sides[0], "a").join(sides[1], "b")
    return joined.select("a", "b", "i_a", "i_b").mapInArrow(run, "a long, b long")


def _alike_in_size(left: str, right: str, percent: int) -> F.Column:
    return (100 * F.col(left) >= percent * F.col(right)) & (
        100 * F.col(right) >= percent * F.col(left)
    )


def _pairs(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def hub_pairs(members: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Each bucket's members with its hub: the member that shares most buckets."""
    degree = members.groupBy("node").agg(F.count("*").alias("degree"))
    hubs = (
        members.join(degree, "node")
        .groupBy("band")
        .agg(F.max(F.struct("degree", "node", "n")).alias("hub"))
        .select("band", F.col("hub.node").alias("y"), F.col("hub.n").alias("n_y"))
    )
    met = members.withColumnRenamed("node", "x").join(hubs, "band")
    return _pairs(met.filter("x <> y").filter(_alike_in_size("n", "n_y", percent)))


def _in_mixed_buckets(rows: DataFrame) -> DataFrame:
    """The rows of the buckets that hold more than one component."""
    mixed_buckets = (
        rows.groupBy("band")
        .agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
        .filter("lo < hi")
        .select("band")
    )
    return rows.join(mixed_buckets, "band", "left_semi")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that links have not connected wholly, with their components."""
    known = members.join(labels.withColumnRenamed("id", "node"), "node", "left").select(
        "band", "node", "n", F.coalesce("component", "node").alias("component")
    )
    return _in_mixed_buckets(known)


def shingle_rows(sets: DataFrame) -> DataFrame:
    """One row for each shingle (``item``) of each set (``node``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, items in zip(batch.column(0), batch.column(1)):
                values = np.frombuffer(items.as_buffer(), dtype=np.int64)
                nodes = np.full(len(values), node.as_py(), dtype=np.int64)
                yield pa.record_batch([pa.array(values), pa.array(nodes)], names=["item", "node"])

    return sets.mapInArrow(run, "item long, node long")


def scarce_shingles(sets: DataFrame, most: int = SCARCE) -> tuple[DataFrame, DataFrame]:
    """The rows (``item``, ``node``) of shingles of 2 to ``most`` sets, and each node's own count.

    The second table has ``node`` and ``own``: how many of its shingles no other set has.
    """
    rows = shingle_rows(sets)
    counted = rows.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node"))
    counted = stored(counted.filter(F.col("n") <= most), "scarce-items")
    shared = counted.filter("n > 1").select("item")
    own = counted.filter("n = 1").groupBy("node").agg(F.count("*").alias("own"))
    return stored(rows.join(shared, "item", "left_semi").distinct(), "scarce-rows"), own


def _possible(most: F.Column, n_x: str, n_y: str, percent: int) -> F.Column:
    """Whether sets of these sizes with so many common items at most can be similar enough."""
    return 100 * most >= percent * (F.col(n_x) + F.col(n_y) - most)


def open_pairs(
    open_rows: DataFrame, scarce: DataFrame, own: DataFrame, percent: int = PERCENT
) -> DataFrame:
    """Pairs of open classes in different components that may still be similar enough."""
    counts = scarce.groupBy("node").agg(F.count("*").alias("scarce"))
    left = stored(
        open_rows.join(own, "node", "left").join(counts, "node", "left").select(
            "band", "node", "n", "component",
            (F.col("n") - F.coalesce("own", F.lit(0)) - F.coalesce("scarce", F.lit(0))).alias(
                "frequent"
            ),
        ),
        "open-members",
    )

    def side(rows: DataFrame, key: str, mark: str, *more: str) -> DataFrame:
        names = ("node", "n", "component", "frequent", *more)
        return rows.select(key, *[F.col(c).alias(f"{c}_{mark}") for c in names])

    apart = (F.col("node_x") < F.col("node_y")) & (F.col("component_x") != F.col("component_y"))
    frequent = F.least("frequent_x", "frequent_y")

    # Pairs without a scarce shingle in common share frequent ones at most; they meet in a band.
    able = _in_mixed_buckets(left.filter(100 * F.col("frequent") >= percent * F.col("n")))
    able = stored(able, "able-members")
    # A pair is met in the first band it shares only; a class has a row for each of its bands.
    bands = able.groupBy("node").agg(F.collect_list("band").alias("bands"))
    able = stored(able.join(bands, "node"), "able-bands")
    first = F.array_min(F.array_intersect("bands_x", "bands_y"))
    met = side(able, "band", "x", "bands").join(side(able, "band", "y", "bands"), "band").filter(
        apart & _possible(frequent, "n_x", "n_y", percent) & (F.col("band") == first)
    )
    # Pairs with scarce shingles in common, however few bands they share.
    nodes = left.select("node", "n", "component", "frequent").distinct()
    held = stored(scarce.join(nodes, "node"), "scarce-members")
    listed = (
        side(held, "item", "x").join(side(held, "item", "y"), "item").filter(apart)
        .groupBy("node_x", "node_y")
        .agg(
            F.first("n_x").alias("n_x"),
            F.first("n_y").alias("n_y"),
            F.first(frequent).alias("frequent"),
            F.count("*").alias("met"),
        )
        .filter(_possible(F.col("frequent") + F.col("met"), "n_x", "n_y", percent))
    )
    names = [F.col("node_x").alias("x"), F.col("node_y").alias("y")]
    return _pairs(met.select(*names).union(listed.select(*names)))


def find_groups(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per document: ``doc_id``, ``text_key`` (hash of its text), ``n_shingles``, ``component_id``, ``kept``.

    ``component_id`` is the smallest doc_id that links reach; a document alone, or without words,
    has its own and is kept.  Rows with NULL ids are never a group's name: they get their
    class's component if another document has the same shingles, else NULL, and are kept only
    then.  Repeated rows get equal answers.  An empty table gives no rows; other columns
    are ignored.
    """
    rows = stored(signed(docs), "signatures")
    classes = stored(
        rows.filter("n_shingles > 0 and doc_id is not null")
        .groupBy("c1", "c2")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("signature").alias("signature"),
        )
        # A number of its own for each class: 64 bits of the name would meet by chance in 10^10.
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    again = rows.groupBy(F.col("doc_id").alias("rep")).count().filter("count > 1")
    repeated = stored(again.filter("rep is not null").select("rep"), "repeated-ids")
    bands = banded(classes)
    shared = (
        bands.groupBy("band")
        .agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
        .filter("lo < hi")
        .select("band")
    )
    members = stored(bands.join(shared, "band", "left_semi"), "bucket-members")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.select("node", "rep", "c1", "c2").join(nodes, "node", "left_semi")
        return stored(full_sets(docs, stored(wanted, "set-documents"), repeated), "full-sets")

    near = stored(likely(hub_pairs(members, percent), classes, percent=percent), "hub-pairs")
    both = near.select("a").union(near.select("b")).distinct().withColumnRenamed("a", "node")
    links = stored(confirmed(near, sets_of(both), percent), "hub-links")
    labels = components(links)

    rest = stored(open_members(members, labels), "open-members")
    sets = sets_of(rest.select("node").distinct())
    more = open_pairs(rest, *scarce_shingles(sets), percent).join(near, ["a", "b"], "left_anti")
    found = stored(confirmed(likely(more, classes, percent=percent), sets, percent), "open-links")
    if found.limit(1).count():
        labels = components(stored(links.union(found), "all-links"))

    # A group's name is the smallest document in it; classes without links name themselves.
    grouped = classes.select("node", "rep", "c1", "c2").join(
        labels.withColumnRenamed("id", "node"), "node", "left"
    ).withColumn("component", F.coalesce("component", "node"))
    names = grouped.groupBy("component").agg(F.min("rep").alias("name"))
    named = grouped.join(names, "component").select("c1", "c2", "name")
    has_words = F.col("n_shingles") > 0
    joined = rows.select("doc_id", "text_key", "n_shingles", "c1", "c2").join(
        named, ["c1", "c2"], "left"
    )
    component = F.when(has_words, F.col("name")).otherwise(F.col("doc_id"))
    found = joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
    return found.withColumn(
        "kept",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates of others: of each group the one with the smallest id.

    Of rows that repeat an id and its text one stays; rows without words all stay.  The columns
    are those of ``docs``.
    """
    key = fresh(docs, "_text_key")
    groups = stored(find_groups(docs), "groups")
    doc, text = fresh(docs, "_doc"), fresh(docs, "_text")
    names = [F.col("doc_id").alias(doc), F.col("text_key").alias(text)]
    again = groups.filter("kept and n_shingles > 0").groupBy("doc_id", "text_key").count()
    again = stored(again.filter("count > 1").select(*names), "repeated-rows")
    gone = stored(groups.filter("not kept").select(*names).distinct(), "dropped-rows")
    rows = docs.withColumn(key, F.xxhash64("text"))

    def meet(table: DataFrame, how: str) -> DataFrame:
        same = F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(key) == F.col(text))
        return kept.join(broadcast_if_small(table), same, how)

    kept = rows
    kept = meet(gone, "left_anti")
    if again.limit(1).count():
        kept = meet(again, "left_anti").union(
            meet(again, "left_semi").dropDuplicates(["doc_id", key])
        )
    return kept.drop(key)
