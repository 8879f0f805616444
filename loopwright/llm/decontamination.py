"""Benchmark decontamination: rare word pairs find passages, local alignment scores them.

An alignment that scores at least T has T - 1 of the item's pairs of adjacent words unbroken, as each
edit costs one point and breaks one run.  So a copy, however it is edited, holds SEEDS of any
(words - T + SEEDS) pairs of its item: the item's rarest ones are its seeds.  How rare pairs are is
counted over all documents; it decides on the work alone, never on what is found.  A
stretch with enough seeds, then with enough pairs, is aligned with the item (Smith-Waterman on
words), which scores edited and paraphrased copies.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import fresh, give_back, in_batches, stored
from loopwright.session import BROADCAST_BYTES, broadcast_if_small

# Items of fewer words are not looked for.
FEWEST = 4
# An alignment counts from this share of the item's words, and from so many words.
MIN_SHARE, MIN_SCORE = 0.5, 8
MATCH, MISMATCH, GAP = 1, -1, -1
# Seeds that a stretch must have to be looked at; FEWEST - 1 at most.
SEEDS = 3
# Words that are searched together.
PART_WORDS = 1 << 18
# Counted pairs that a task gives out at once.
PART_PAIRS = 1 << 16

_WORD = re.compile(r"\w+")
_FOUND = (
    "doc_id long, text_key long, item_id long, item_key long, score long, item_words long, "
    "start_word long, end_word long"
)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of word numbers: score, and its first and last + 1 place in the passage.

    Word number 0 is no word of any item and never matches.  Time is the product of the lengths,
    space that of the passage.
    """
    score, end, row = _best(passage, item)
    if not score:
        return 0, 0, 0
    # The same alignment from its end backwards ends where it starts.
    back = _best(passage[:end][::-1], item[: row + 1][::-1])
    return score, end - back[1], end


def _best(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    places = np.arange(len(passage) + 1)
    above = np.zeros(len(passage) + 1, dtype=np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        here = np.maximum(above + GAP, 0)
        step = np.where(passage == word, MATCH, MISMATCH) if word else MISMATCH
        here[1:] = np.maximum(here[1:], above[:-1] + step)
        # Gaps along the passage: the running maximum with the gap cost taken out.
        here = np.maximum.accumulate(here - GAP * places) + GAP * places
        top = int(here.argmax())
        if here[top] > best[0]:
            best = int(here[top]), top, i
        above = here
    return best


class Items:
    """The test items of one block: their words as numbers, their pairs, and the score each needs."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        self.vocabulary: dict[str, int] = {}
        self.ids: list[int | None] = []
        self.words: list[np.ndarray] = []
        number = self.vocabulary
        for item, text in dict.fromkeys(rows):
            words = words_of(text)
            if len(words) >= FEWEST:
                self.ids.append(item)
                self.words.append(
                    np.array([number.setdefault(w, len(number) + 1) for w in words], dtype=np.int64)
                )
        self.pairs = [self.pair_keys(w) for w in self.words]
        self.keys = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *self.pairs]))
        self.needs = np.array([_needed(len(w)) for w in self.words], dtype=np.int64)
        # Words that an alignment of the score needed can span in a document.
        self.spans = np.array([2 * len(w) for w in self.words], dtype=np.int64) - self.needs

    def pair_keys(self, ids: np.ndarray) -> np.ndarray:
        """A number for each pair of adjacent word numbers; 0 where one is no word of an item."""
        first, second = ids[:-1], ids[1:]
        return np.where((first > 0) & (second > 0), first * (len(self.vocabulary) + 1) + second, 0)

    def seeds(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Seeds in order, where each one's items begin and end in the list, and that list."""
        found: dict[int, list[int]] = {}
        for i, (pairs, need) in enumerate(zip(self.pairs, self.needs)):
            rarest = sorted(pairs.tolist(), key=lambda g: counts.get(g, 0))
            for seed in set(rarest[: len(pairs) + 1 - need + SEEDS]):
                found.setdefault(seed, []).append(i)
        keys = sorted(found)
        bounds = np.cumsum([0, *(len(found[k]) for k in keys)])
        owners = np.array([i for k in keys for i in found[k]], dtype=np.int64)
        return np.array(keys, dtype=np.int64), bounds, owners


def _needed(words: int) -> int:
    return math.ceil(max(MIN_SHARE * words, min(MIN_SCORE, words)))


def item_blocks(benchmark: DataFrame, limit: int = BROADCAST_BYTES) -> Iterator[Items]:
    """The test items in blocks whose texts have so many bytes at most (but one item at least)."""
    rows = benchmark.select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text")
    block, held = [], 0
    for row in rows.toLocalIterator():
        size = len((row["text"] or "").encode())
        if block and held + size > limit:
            yield Items(block)
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += size
    if block:
        yield Items(block)


def _numbered(texts: list[str | None], vocabulary: dict[str, int]) -> Iterator[tuple]:
    """Texts in parts: word numbers end to end, a 0 after each text, and where each text begins."""
    part, starts, held = [], [], 0
    for text in texts:
        words = words_of(text)
        starts.append(held)
        part.append(np.fromiter((vocabulary.get(w, 0) for w in words), np.int64, len(words)))
        part.append(np.zeros(1, dtype=np.int64))
        held += len(words) + 1
        if held >= PART_WORDS:
            yield np.concatenate(part), np.array(starts)
            part, starts, held = [], [], 0
    if part:
        yield np.concatenate(part), np.array(starts)


def _among(keys: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys`` that are in ``sorted_keys``, and their places there."""
    if not len(sorted_keys):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    at = np.flatnonzero(keys)
    place = np.minimum(np.searchsorted(sorted_keys, keys[at]), len(sorted_keys) - 1)
    same = sorted_keys[place] == keys[at]
    return at[same], place[same]


def pair_counts(docs: DataFrame, items: Items) -> dict[int, int]:
    """How often all documents together have each pair of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(items.keys), dtype=np.int64)
        for batch in batches:
            for ids, _ in _numbered(batch.column(0).to_pylist(), items.vocabulary):
                _, place = _among(items.pair_keys(ids), items.keys)
                np.add.at(total, place, 1)
        some = np.flatnonzero(total)
        for at in range(0, len(some), PART_PAIRS):
            part = some[at : at + PART_PAIRS]
            yield pa.record_batch(
                [pa.array(items.keys[part]), pa.array(total[part])], names=["pair", "n"]
            )
        give_back()

    each = docs.select("text").mapInArrow(run, "pair long, n long")
    counted = each.groupBy("pair").agg(F.sum("n").alias("n"))
    # As many rows as the block's items have pairs at most.
    return {r["pair"]: r["n"] for r in counted.toLocalIterator()}


def candidates(
    ids: np.ndarray, starts: np.ndarray, items: Items,
    seeds: tuple[np.ndarray, np.ndarray, np.ndarray],
) -> Iterator[tuple[int, int, int, int]]:
    """Text, item, and the stretch (start, end) of every place that may hold a copy of the item."""
    keys, bounds, owners = seeds
    pairs = items.pair_keys(ids)
    at, place = _among(pairs, keys)
    if not len(at):
        return
    many = bounds[place + 1] - bounds[place]
    where = np.repeat(at, many)
    shift = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    item = owners[np.repeat(bounds[place], many) + shift]
    order = np.lexsort((where, item))
    where, item = where[order], item[order]
    text = np.searchsorted(starts, where, side="right") - 1
    near = SEEDS - 1
    first = np.flatnonzero(
        (item[near:] == item[:-near]) & (text[near:] == text[:-near])
        & (where[near:] - where[:-near] <= items.spans[item[near:]])
    )
    if not len(first):
        return
    # Around seeds that are close, as far as an alignment could reach; stretches that meet are one.
    i, t = item[first], text[first]
    ends = np.append(starts[1:], len(ids)) - 1
    low = np.maximum(where[first] - items.spans[i], starts[t])
    high = np.minimum(where[first + near] + 2 + items.spans[i], ends[t])
    new = np.append(True, (i[1:] != i[:-1]) | (t[1:] != t[:-1]) | (low[1:] > high[:-1]))
    begins = np.flatnonzero(new)
    stops = np.append(begins[1:], len(new)) - 1
    for a, b in zip(begins, stops):
        one, lo, hi = int(i[a]), int(low[a]), int(high[b])
        held = np.flatnonzero(np.isin(pairs[lo : hi - 1], items.pairs[one]))
        least = int(items.needs[one]) - 1
        if len(held) >= least and (
            held[least - 1 :] - held[: len(held) - least + 1] <= items.spans[one]
        ).any():
            yield int(t[a]), one, lo, hi


def search(texts: list[str | None], items: Items, seeds: tuple) -> Iterator[tuple]:
    """Alignments that score enough: place of the text, item, score, first and last + 1 word."""
    done = 0
    for ids, starts in _numbered(texts, items.vocabulary):
        for text, item, low, high in candidates(ids, starts, items, seeds):
            score, first, last = align(ids[low:high], items.words[item])
            if score >= items.needs[item]:
                begin = low - int(starts[text])
                yield done + text, item, score, begin + first, begin + last
        done += len(starts)


def aligned(docs: DataFrame, items: Items, seeds: tuple) -> DataFrame:
    """The documents' alignments with the items, where the score suffices."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            doc, key, texts = (batch.column(c).to_pylist() for c in range(3))
            rows = [
                (doc[t], key[t], items.ids[i], i, score, len(items.words[i]), first, last)
                for t, i, score, first, last in search(texts, items, seeds)
            ]
            columns = list(zip(*rows)) if rows else [[]] * 8
            return pa.record_batch(
                [pa.array(c, type=pa.int64()) for c in columns],
                names=[c.split()[0] for c in _FOUND.split(", ")],
            )

        return each

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return in_batches(rows, make, _FOUND)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and test item it holds a copy of, with the best alignment.

    Columns: ``doc_id``, ``text_key`` (hash of its text), ``item_id``, ``score``, ``item_words``,
    ``similarity`` (score by item words), ``start_word`` and ``end_word`` of the passage.  NULL and
    empty texts hold none; an item of fewer than four words is never found.  Every alignment of
    enough score is found.  Items of one text under one id are one;
    repeated rows give one answer.  Empty tables give no rows; other columns are ignored.

    Documents are read twice per block of items, to count and to search; no text is kept.
    """
    found = None
    for items in item_blocks(benchmark):
        part = aligned(docs, items, items.seeds(pair_counts(docs, items)))
        found = part if found is None else found.union(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], _FOUND)
    best = F.max(F.struct("score", (-F.col("start_word")).alias("first"), "end_word", "item_words"))
    return found.groupBy("doc_id", "text_key", "item_id").agg(best.alias("b")).select(
        "doc_id",
        "text_key",
        "item_id",
        "b.score",
        "b.item_words",
        (F.col("b.score") / F.col("b.item_words")).alias("similarity"),
        (-F.col("b.first")).alias("start_word"),
        "b.end_word",
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no test item, with the columns they came with."""
    leaks = find_leaks(docs, benchmark).select("doc_id", "text_key").distinct()
    leaks = broadcast_if_small(stored(leaks, "leaks"))
    key = fresh(docs, "_text_key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(leaks["doc_id"]) & (rows[key] == leaks["text_key"])
    return rows.join(leaks, same, "left_anti").drop(key)
