"""Importance resampling: documents are drawn as if the raw corpus were the target text.

Target and raw text are each modelled as a bag of hashed words and word pairs.  A document's log
weight is the log of the ratio of its chances under the two models.  Adding Gumbel noise to the
log weights and taking the largest k draws k documents without replacement, each with a chance
in proportion to its weight among those left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import in_batches, stored
from loopwright.llm.shingles import mixed, word_hashes
from loopwright.operators.ordinal import key_at_rank
from loopwright.session import broadcast_if_small

BUCKETS = 10_000
SMOOTHING = 1.0


def gram_buckets(texts: list[bytes | None], buckets: int = BUCKETS) -> list[np.ndarray]:
    """For each text the buckets of its words (A-Z in lower case) and of its word pairs."""
    out: list[np.ndarray] = []
    for at in range(0, len(texts), 64):
        hashes, counts = word_hashes(texts[at : at + 64])
        pairs = mixed(hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:])
        ends = np.cumsum(counts)
        for start, end in zip(ends - counts, ends):
            own = np.concatenate([hashes[start:end], pairs[start : max(start, end - 1)]])
            out.append((own % np.uint64(buckets)).astype(np.int64))
    return out


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket``, ``raw`` and ``target``: counts over all rows and over those marked target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, buckets), dtype=np.int64)
        for batch in batches:
            texts = [None if t is None else t.encode() for t in batch.column(0).to_pylist()]
            for own, target in zip(gram_buckets(texts, buckets), batch.column(1).to_pylist()):
                totals[0] += (counted := np.bincount(own, minlength=buckets))
                if target:
                    totals[1] += counted
        # One row a filled bucket and task, whatever the task's rows.
        filled = np.flatnonzero(totals[0])
        yield pa.record_batch(
            [pa.array(filled), pa.array(totals[0][filled]), pa.array(totals[1][filled])],
            names=["bucket", "raw", "target"],
        )

    return (
        rows.select("text", "target")
        .mapInArrow(run, "bucket long, raw long, target long")
        .groupBy("bucket")
        .agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    )


def log_ratios(counts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log of target chance over raw chance of each bucket, both smoothed."""
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for row in counts.collect():  # at most one row a bucket
        raw[row["bucket"]], target[row["bucket"]] = row["raw"], row["target"]
    raw, target = raw + SMOOTHING, target + SMOOTHING
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(seed: int, *keys: str) -> Column:
    """Reproducible Gumbel noise of a row, from a hash of its keys."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    uniform = (bits.cast("double") + 0.5) / float(1 << 53)
    return -F.log(-F.log(uniform))


def resample(
    docs: DataFrame,
    target_ids: DataFrame,
    fraction: float = 0.85,
    seed: int = 1,
    buckets: int = BUCKETS,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_grams``, ``log_weight``, ``draw``, ``kept``.

    ``target_ids`` names the documents that make up the target text (``doc_id``; NULL and unknown
    ids are ignored, repeated ones count once).  The ``int(fraction * n)`` rows with the largest
    ``draw`` (log weight plus Gumbel noise) are kept; rows that are equal in all columns share a
    draw, and the last place goes to all of them or none.  Texts without words weigh 0 (a ratio of
    one).  Without target text every weight is that of the smoothed models.  An empty table gives
    no rows; other columns are ignored.
    """
    wanted = target_ids.select(F.col("doc_id").cast("long")).dropna().distinct()
    wanted = broadcast_if_small(stored(wanted.withColumn("target", F.lit(True)), "target-ids"))
    marked = docs.select(F.col("doc_id").cast("long"), "text").join(wanted, "doc_id", "left")
    ratios = log_ratios(bucket_counts(marked, buckets), buckets)

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if t is None else t.encode() for t in batch.column(1).to_pylist()]
            owns = gram_buckets(texts, buckets)
            return pa.record_batch(
                [
                    batch.column(0),
                    pa.array([zlib.crc32(t or b"") for t in texts], type=pa.int64()),
                    pa.array([len(o) for o in owns], type=pa.int64()),
                    pa.array([float(ratios[o].sum()) for o in owns], type=pa.float64()),
                ],
                names=["doc_id", "text_crc32", "n_grams", "log_weight"],
            )

        return each

    weighed = in_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, text_crc32 long, n_grams long, log_weight double",
    ).withColumn("draw", F.col("log_weight") + gumbel(seed, "doc_id", "text_crc32"))
    weighed = stored(weighed, "weights")
    total = weighed.count()
    out = int(total * (1 - fraction) + 0.5)
    # Everything from the first kept draw on; found by narrowing, not by sorting the table.
    _, first = key_at_rank(weighed, ["draw"], rank=out) if 0 < out < total else (total, None)
    kept = F.lit(out == 0) if first is None else F.col("draw") >= first["draw"]
    return weighed.select("doc_id", "n_grams", "log_weight", "draw", kept.alias("kept"))
