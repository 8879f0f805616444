"""Hard negatives by exact integer scores from a residue number system.

Vectors are scaled and floored to integers.  Scores are inner products; they are found as matrix
products modulo several small primes.  Residues are centred, so that each product of float32
matrices stays below 2**24 and is exact; the signed score follows from its residues by Chinese
remaindering.  Anchors are a stated query set: they go in blocks of bounded size against all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import stored
from loopwright.session import lookup_side

SCALE = 256.0
# Bytes of one block of anchors, as float64; the driver and each worker hold one block.
BLOCK_BYTES = 32 * 1024 * 1024
# Anchors whose scores against one batch of rows are held at a time.
STRIP = 512
# Exact sums of float32 products end here; largest prime of the system.
EXACT, LARGEST = 1 << 24, 251
NO_SCORE, NO_ID = -(1 << 62), (1 << 63) - 1


def primes_for(bound: float) -> list[int]:
    """Small primes, from the largest down, whose product exceeds all signed scores up to ``bound``."""
    chosen, product = [], 1
    for p in range(LARGEST, 1, -1):
        if product > 2 * bound + 1:
            return chosen
        if all(p % d for d in range(2, int(p**0.5) + 1)):
            chosen.append(p)
            product *= p
    raise ValueError("scores are too large")


class Residues:
    """Exact inner products of integer vectors with absolute values of at most ``bound``."""

    def __init__(self, bound: float):
        self.primes = primes_for(bound)
        product = 1
        self.steps = []
        for p in self.primes:
            self.steps.append((product, pow(product % p, -1, p)))
            product *= p
        self.shift = product // 2

    def parts(self, vectors: np.ndarray) -> list[np.ndarray]:
        """Centred residues of whole float64 numbers modulo each prime, as float32."""
        out = []
        for p in self.primes:
            rest = np.fmod(vectors, p)
            rest -= p * np.round(rest / p)
            out.append(rest.astype(np.float32))
        return out

    def scores(self, left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        """All signed inner products of two sets of vectors, given by their parts."""
        total = None
        for p, (scale, inverse), a, b in zip(self.primes, self.steps, left, right):
            width = EXACT // (p // 2) ** 2
            rest = np.full((len(a), len(b)), self.shift % p, dtype=np.int64)
            for at in range(0, a.shape[1], width):
                rest += (a[:, at : at + width] @ b[:, at : at + width].T).astype(np.int64)
            # The next digit in the mixed radix of the primes; the sum may wrap only at the last.
            digit = rest if total is None else (rest - total % p) * inverse
            digit %= p
            total = digit if total is None else total + digit * np.int64(scale)
        return (total.view(np.uint64) - np.uint64(self.shift % (1 << 64))).view(np.int64)


def first_places(groups: np.ndarray, keep: int) -> np.ndarray:
    """Where sorted group numbers have their first ``keep`` entries."""
    rank = np.arange(len(groups)) - np.searchsorted(groups, groups, "left")
    return rank < keep


class _Best:
    """For each group its first entries by descending score, then ascending id."""

    def __init__(self, keep: int):
        self.keep = keep
        self.group, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        group = np.concatenate([self.group, group])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, group))
        group, score, ids = group[order], score[order], ids[order]
        kept = first_places(group, self.keep)
        self.group, self.score, self.id = group[kept], score[kept], ids[kept]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as scaled and floored float64 numbers, with zeros after the shorter ones."""
    lengths = column.value_lengths().to_numpy()
    flat = np.floor(column.flatten().to_numpy().astype(np.float64) * SCALE)
    if len(lengths) and (lengths == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def one_row_an_id(rows: DataFrame) -> DataFrame:
    """Of rows with the same ``vec_id`` the least by label, then vector; others stay unmoved."""
    repeated = rows.groupBy("vec_id").count().filter("count > 1").select("vec_id")
    repeated = lookup_side(repeated)
    if not repeated.limit(1).count():
        return rows
    least = (
        rows.join(repeated, "vec_id", "left_semi")
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "embedding")).alias("row"))
        .select("vec_id", "row.label", "row.embedding")
    )
    return rows.join(repeated, "vec_id", "left_anti").union(least)


def _numbered(anchors: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """The written anchors with a ``block`` of at most ``per_block`` rows each, and how many blocks."""
    anchors = stored(anchors.withColumn("place", F.monotonically_increasing_id()), "anchors")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND((1 << 33) - 1)
    counts = sorted(anchors.groupBy(part.alias("part")).count().collect())  # a row a partition
    starts, at = {}, 0
    for row in counts:
        starts[row["part"]] = at
        at += row["count"]
    if not at:
        return anchors.withColumn("block", F.lit(0)), 0
    offsets = anchors.sparkSession.createDataFrame(list(starts.items()), "part long, start long")
    # One row a partition is broadcast.
    numbered = anchors.withColumn("part", part).join(F.broadcast(offsets), "part")
    block = F.floor((F.col("start") + inside) / per_block).cast("int")
    return numbered.withColumn("block", block), -(-at // per_block)


def _search(
    rows: DataFrame, width: int, make: Callable[[], tuple[Callable, Callable]], schema: str
) -> DataFrame:
    """Feed each task's rows to what ``make`` prepares, and give out its result at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take, result = make()
        for batch in batches:
            if batch.num_rows:
                ids, labels = (np.asarray(batch.column(c).to_numpy(), dtype=np.int64) for c in (0, 1))
                take(ids, labels, _matrix(batch.column(2), width))
        yield result()

    return rows.mapInArrow(run, schema)


def _top(df: DataFrame, keys: list[str], score: str, by: str, keep: int) -> DataFrame:
    """First rows of each key; no key has more than ``keep`` rows from each task."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), by)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= keep)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column | str,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """For each anchor and positive the best different-label rows inside the positive's window.

    ``vectors`` has ``vec_id``, ``embedding`` (an array of numbers) and ``label``; ``is_anchor``
    is a condition on them.  Returns ``anchor_id``, ``positive_id``, ``rank`` (int, from 1),
    ``negative_id``, ``positive_score``, ``negative_score``.

    A component x counts as floor(256 * x).  Higher scores come first, then smaller ids.  An
    anchor's positives are the first ``positives`` other rows of its label; a negative's score lies
    between ``low`` and ``high`` per cent of the positive's (so a negative positive score has none).
    Rows with a NULL id, label, vector or component, or with one that is not finite, take no part.
    Of rows with the same id one takes part (least label, then vector).  Shorter vectors are
    followed by zeros; empty ones score 0.  Scores beyond 2**55 are an error.  Empty tables, and
    anchors without positives or negatives, give no rows.  Other columns are ignored.

    Anchors go in blocks of at most ``block_bytes`` through all rows: twice a block, first for its
    positives, then for its negatives.  Rows are never shuffled; a task gives out at most the
    best few of each anchor.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").filter(fine)
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    rows = one_row_an_id(rows)
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(F.floor(x * SCALE).cast("double"), 2))
    size = rows.agg(F.max(F.size("embedding")).alias("width"), F.max(square).alias("bound")).first()
    width, bound = size["width"] or 0, (size["bound"] or 0.0) * (1 + 1e-9)
    if bound > 1 << 55:
        raise ValueError("scores are too large for exact windows")
    spark = rows.sparkSession
    anchors, blocks = _numbered(rows.filter(is_anchor), max(1, block_bytes // (8 * max(1, width))))
    share = (low, high)
    found = [
        _block_negatives(spark, rows, anchors.filter(F.col("block") == b), width, bound, positives, negatives, share)
        for b in range(blocks)
    ]
    if not found:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _block_negatives(spark, rows, block, width, bound, positives, negatives, share) -> DataFrame:
    """The result for one block of anchors."""
    held = block.select("vec_id", "label", "embedding").toArrow().combine_chunks()
    ids, labels = (held.column(c).to_numpy().astype(np.int64) for c in (0, 1))
    order = np.argsort(ids)
    column = held.column(2).combine_chunks()
    given = spark.sparkContext.broadcast((ids[order], labels[order], _matrix(column, width)[order]))

    def make_positives():
        system = Residues(bound)
        a_ids, a_labels, a_vectors = given.value
        parts, best = system.parts(a_vectors), _Best(positives)

        def take(r_ids, r_labels, vectors):
            r_parts = system.parts(vectors)
            for label in np.intersect1d(a_labels, r_labels):
                mine, theirs = np.flatnonzero(a_labels == label), np.flatnonzero(r_labels == label)
                theirs = theirs[np.argsort(r_ids[theirs], kind="stable")]
                right = [x[theirs] for x in r_parts]
                for at in range(0, len(mine), STRIP):
                    own = mine[at : at + STRIP]
                    scores = system.scores([x[own] for x in parts], right)
                    scores[a_ids[own][:, None] == r_ids[theirs]] = NO_SCORE
                    top = np.argsort(-scores, axis=1, kind="stable")[:, :positives]
                    score = np.take_along_axis(scores, top, 1).ravel()
                    real = score != NO_SCORE
                    best.add(np.repeat(own, top.shape[1])[real], score[real], r_ids[theirs][top].ravel()[real])

        def result():
            return pa.record_batch(
                [pa.array(x) for x in (best.group, a_ids[best.group], best.id, best.score)],
                names=["place", "anchor_id", "positive_id", "positive_score"],
            )

        return take, result

    schema = "place long, anchor_id long, positive_id long, positive_score long"
    pairs = _top(
        _search(rows, width, make_positives, schema), ["place", "anchor_id"], "positive_score", "positive_id", positives
    )
    pairs = stored(pairs, "positives")
    # At most ``positives`` rows an anchor of this block.
    chosen = pairs.select("place", "rank", "positive_id", "positive_score").toArrow()
    place, slot, p_ids, p_scores = (chosen.column(c).to_numpy().astype(np.int64) for c in range(4))
    table = np.full((2, len(ids), positives), NO_SCORE, dtype=np.int64)
    table[0, place, slot - 1], table[1, place, slot - 1] = p_ids, p_scores
    positive_table = spark.sparkContext.broadcast(table)
    low, high = share

    def make_negatives():
        system = Residues(bound)
        a_ids, a_labels, a_vectors = given.value
        p_ids, p_scores = positive_table.value
        parts, best = system.parts(a_vectors), _Best(negatives)
        real = p_scores != NO_SCORE
        # Whole numbers with low * p <= 100 * n <= high * p; an empty window where there is no positive.
        least = np.where(real, -((-low * np.where(real, p_scores, 0)) // 100), 1)
        most = np.where(real, high * np.where(real, p_scores, 0) // 100, 0)
        least, most = np.where(least <= most, least, NO_ID), np.where(least <= most, most, NO_SCORE)
        lowest, highest = least.min(axis=1, initial=NO_ID), most.max(axis=1, initial=NO_SCORE)

        def take(r_ids, r_labels, vectors):
            r_parts = system.parts(vectors)
            for at in range(0, len(a_ids), STRIP):
                own = slice(at, at + STRIP)
                scores = system.scores([x[own] for x in parts], r_parts)
                inside = (scores >= lowest[own, None]) & (scores <= highest[own, None])
                inside &= a_labels[own, None] != r_labels
                anchor, row = np.nonzero(inside)
                score, anchor = scores[anchor, row], anchor + at
                for s in range(positives):
                    fits = (score >= least[anchor, s]) & (score <= most[anchor, s])
                    best.add(anchor[fits] * positives + s, score[fits], r_ids[row[fits]])

        def result():
            anchor, s = best.group // positives, best.group % positives
            columns = (a_ids[anchor], p_ids[anchor, s], best.id, p_scores[anchor, s], best.score)
            names = ["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"]
            return pa.record_batch([pa.array(x) for x in columns], names=names)

        return take, result

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = _search(rows, width, make_negatives, schema)
    best = _top(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", negatives)
    return stored(
        best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives"
    )
