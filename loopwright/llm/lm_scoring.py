"""Masked pseudo-likelihood: a small network predicts every word from both sides.

Words (white-space cut, A-Z in lower case) are numbered by their counts over the corpus; rarer
ones share numbers.  The network takes the two words before and the two after a place and
predicts the number there, first its class, then its member of the class.  Behind a shared number
stands a row of cells with the counts of the words in them over the whole corpus: a rare word's chance is
that of its number times the share of its cell.  A document's score is the sum of the log-probabilities of
all its words, each given its neighbours.  Words that fall into one cell are not told apart.

Training is data-parallel and goes over every place of the corpus once: each round takes a part
of the documents, every trainer goes through those of its own partitions from the same weights, and
the trainers' weights are averaged by distributed sums.  Nothing of the texts is written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import in_batches, stored
from loopwright.llm.shingles import constants, mixed, word_hashes

CLASSES, MEMBERS = 32, 32
NUMBERS = CLASSES * MEMBERS
# Numbers of frequent words; the rest is shared by all other words.
FREQUENT = 768
# Cells that the other words fall into, by hash; each shared number has as many.
CELLS = 1 << 20
SIDE = 2
WIDTH, HIDDEN = 16, 24
ROUNDS, MINIBATCH, RATE = 2, 4096, 0.08
# Windows that a trainer shuffles, and the steps each trainer of a round should have at least.
SHUFFLED, LEAST_STEPS = 1 << 17, 64
PAD = NUMBERS
CHUNK = 1 << 14

_SHAPES = {
    "words": (NUMBERS + 1, WIDTH),
    "mix": (2 * SIDE, WIDTH, HIDDEN),
    "bias": (HIDDEN,),
    "classes": (HIDDEN, CLASSES),
    "class_bias": (CLASSES,),
    "members": (CLASSES, HIDDEN, MEMBERS),
    "member_bias": (CLASSES, MEMBERS),
}

Weights = dict[str, np.ndarray]


def first_weights(seed: int = 5) -> Weights:
    """Small fixed weights to start from."""
    out = {}
    for i, (name, shape) in enumerate(_SHAPES.items()):
        drawn = constants(int(np.prod(shape)), seed + i) / np.float64(2**64) - 0.5
        scale = 0.0 if "bias" in name else 0.2 if name == "words" else 1 / np.sqrt(shape[-2])
        out[name] = (drawn.reshape(shape) * scale).astype(np.float32)
    return out


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[n].ravel() for n in _SHAPES])


def unflat(values: np.ndarray) -> Weights:
    out, at = {}, 0
    for name, shape in _SHAPES.items():
        size = int(np.prod(shape))
        out[name] = values[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def _logs_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The log-softmax of each row at one place of it; ``x`` is used up."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), at]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def _slopes(x: np.ndarray, at: np.ndarray, work: np.ndarray) -> np.float32:
    """Turn ``x`` into the change of the loss of each row's place with it; returns the losses' sum."""
    rows = np.arange(len(x))
    x -= x.max(axis=1, keepdims=True)
    x -= np.log(np.exp(x, out=work).sum(axis=1, keepdims=True))
    loss = -x[rows, at].sum()
    np.exp(x, out=x)
    x[rows, at] -= 1
    return loss


def _by_class(classes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
    """The places class by class, and where in that order each class stands."""
    # Sixteen bits sort by counting.
    order = np.argsort(classes, kind="stable")
    cuts = np.searchsorted(classes[order], np.arange(CLASSES + 1))
    return order, [
        (c, slice(cuts[c], cuts[c + 1])) for c in range(CLASSES) if cuts[c] < cuts[c + 1]
    ]


class Rooms:
    """Work arrays that are used again: fresh ones of this size cost the system's zeroed pages each time."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def __call__(self, name: str, rows: int, width: int) -> np.ndarray:
        if len(self.held.get(name, ())) < rows:
            self.held[name] = np.empty((rows, width), dtype=np.float32)
        return self.held[name][:rows]


class Trainer:
    """Adagrad on minibatches of windows; its weights start from those given."""

    def __init__(self, weights: Weights):
        self.w = {k: v.copy() for k, v in weights.items()}
        self.seen = {k: np.full(v.shape, 1e-6, dtype=np.float32) for k, v in weights.items()}
        self.room = Rooms()

    def step(self, windows: np.ndarray) -> float:
        """One step on windows of word numbers, the middle one being the target; the mean loss."""
        w, n, room = self.w, len(windows), self.room
        around, target = np.delete(windows, SIDE, axis=1), windows[:, SIDE]
        known = room("known", around.size, WIDTH)
        w["words"].take(around.ravel(), axis=0, out=known, mode="clip")
        known = known.reshape(n, -1)
        mix = w["mix"].reshape(-1, HIDDEN)
        hidden = np.matmul(known, mix, out=room("hidden", n, HIDDEN))
        hidden += w["bias"]
        np.tanh(hidden, out=hidden)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        classes, work = target // MEMBERS, room("work", n, max(CLASSES, MEMBERS))
        slope = np.matmul(hidden, w["classes"], out=room("logits", n, CLASSES))
        slope += w["class_bias"]
        loss = _slopes(slope, classes, work[:, :CLASSES])
        grad["classes"], grad["class_bias"] = hidden.T @ slope, slope.sum(axis=0)
        back = np.matmul(slope, w["classes"].T, out=room("back", n, HIDDEN))
        # In the order of their classes, so that each class's places are one slice.
        order, parts = _by_class(classes)
        mine = hidden.take(order, axis=0, out=room("mine", n, HIDDEN), mode="clip")
        slope = room("inner", n, MEMBERS)
        for c, at in parts:
            np.matmul(mine[at], w["members"][c], out=slope[at])
            slope[at] += w["member_bias"][c]
        loss += _slopes(slope, target[order] % MEMBERS, work[:, :MEMBERS])
        pulled = room("inner_back", n, HIDDEN)
        for c, at in parts:
            grad["members"][c] = mine[at].T @ slope[at]
            grad["member_bias"][c] = slope[at].sum(axis=0)
            np.matmul(slope[at], w["members"][c].T, out=pulled[at])
        back[order] += pulled
        hidden *= hidden
        back *= np.subtract(1, hidden, out=hidden)
        grad["bias"] = back.sum(axis=0)
        grad["mix"] = (known.T @ back).reshape(w["mix"].shape)
        pulled = np.matmul(back, mix.T, out=room("pulled", n, len(mix))).reshape(-1, WIDTH)
        # Sixteen bits sort by counting.
        ids = around.ravel().astype(np.int16)
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        firsts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        sorted_pulls = pulled.take(order, axis=0, out=room("sorted", len(order), WIDTH), mode="clip")
        grad["words"][ids[firsts]] = np.add.reduceat(sorted_pulls, firsts, axis=0)
        for k, g in grad.items():
            g /= n
            self.seen[k] += g * g
            w[k] -= RATE * g / np.sqrt(self.seen[k])
        return float(loss / n)


class Scorer:
    """Log-probabilities of all words of sequences, from both sides."""

    def __init__(self, weights: Weights):
        self.w = weights
        self.tables = [weights["words"] @ weights["mix"][p] for p in range(2 * SIDE)]
        self.room = Rooms()

    def sums(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The sum over each sequence; ``ids`` holds them end to end."""
        windows = contexts(ids, counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        out = np.zeros(len(counts))
        for at in range(0, len(ids), CHUNK):
            got = self._logs(windows[at : at + CHUNK])
            out += np.bincount(owner[at : at + CHUNK], weights=got, minlength=len(counts))
        return out

    def _logs(self, windows: np.ndarray) -> np.ndarray:
        w, n, room, target = self.w, len(windows), self.room, windows[:, SIDE]
        hidden, one = room("hidden", n, HIDDEN), room("one", n, HIDDEN)
        hidden[:] = w["bias"]
        for table, column in zip(self.tables, (0, 1, 3, 4)):
            hidden += table.take(windows[:, column], axis=0, out=one, mode="clip")
        np.tanh(hidden, out=hidden)
        classes = target // MEMBERS
        logits = np.matmul(hidden, w["classes"], out=room("logits", n, CLASSES))
        logits += w["class_bias"]
        out = _logs_at(logits, classes)
        order, parts = _by_class(classes)
        mine = hidden.take(order, axis=0, out=one, mode="clip")
        inner = room("inner", n, MEMBERS)
        for c, at in parts:
            np.matmul(mine[at], w["members"][c], out=inner[at])
            inner[at] += w["member_bias"][c]
        out[order] += _logs_at(inner, target[order] % MEMBERS)
        return out


def contexts(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The window around every place; beyond a sequence's ends it holds the padding number."""
    ends = np.cumsum(counts)
    place = np.arange(len(ids)) - np.repeat(ends - counts, counts)
    left = np.repeat(counts, counts) - place - 1
    padded = np.concatenate([np.full(SIDE, PAD), ids, np.full(SIDE, PAD)])
    out = np.empty((len(ids), 2 * SIDE + 1), dtype=np.int16)
    for j in range(-SIDE, SIDE + 1):
        column = padded[SIDE + j : SIDE + j + len(ids)]
        outside = (place + j < 0) if j < 0 else (left - j < 0)
        out[:, j + SIDE] = np.where(outside, PAD, column)
    return out


class Vocabulary:
    """Numbers of hashed words: the frequent ones have their own, others share.

    ``rare`` gives each cell's log share of its number's words.
    """

    def __init__(self, frequent: list[int], rare: np.ndarray | None = None):
        hashes = np.array(frequent, dtype=np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order.astype(np.int16)
        self.rare = np.zeros(CELLS, dtype=np.float32) if rare is None else rare

    def _own(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words have a number of their own, and those numbers."""
        if not len(self.hashes):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int16)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes, self.numbers[at]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        own, numbers = self._own(hashes)
        return np.where(own, numbers, number_of(cell_of(hashes)))

    def inside(self, hashes: np.ndarray) -> np.ndarray:
        """The log share of each word's cell in its shared number; 0 for words with one of their own."""
        own, _ = self._own(hashes)
        return np.where(own, np.float32(0), self.rare[cell_of(hashes)])


def cell_of(hashes: np.ndarray) -> np.ndarray:
    return (mixed(hashes) % np.uint64(CELLS)).astype(np.int64)


def number_of(cells: np.ndarray) -> np.ndarray:
    """The shared number that a cell stands behind."""
    return (FREQUENT + cells % (NUMBERS - FREQUENT)).astype(np.int16)


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[list[bytes | None]]:
    """The texts of a batch in parts of a few megabytes."""
    part, held = [], 0
    for value in batch.column(column):
        text = value.as_py()
        part.append(None if text is None else text.encode())
        held += len(part[-1] or b"")
        if held > 1 << 21:
            yield part
            part, held = [], 0
    if part:
        yield part


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (a hash) and ``n`` over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _texts(batch, 0):
                words, counts = np.unique(word_hashes(part)[0], return_counts=True)
                yield pa.record_batch(
                    [pa.array(words.view(np.int64)), pa.array(counts.astype(np.int64))],
                    names=["word", "n"],
                )

    counted = docs.select("text").mapInArrow(run, "word long, n long")
    return stored(counted.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> list[int]:
    """Hashes of the most frequent words over all documents, the most frequent first."""
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def rare_shares(counts: DataFrame, frequent: list[int]) -> np.ndarray:
    """Log share of each cell among the words behind its number, each cell counting one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.sort(np.array(frequent, dtype=np.int64))
        for batch in batches:
            words, n = batch.column(0).to_numpy(), batch.column(1)
            rest = np.flatnonzero(~np.isin(words, known))
            cells = cell_of(words[rest].view(np.uint64))
            yield pa.record_batch([pa.array(cells), n.take(pa.array(rest))], names=["cell", "n"])

    cells = counts.select("word", "n").mapInArrow(run, "cell long, n long")
    # One row a cell at most, whatever the corpus.
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    held = np.ones(CELLS)
    held[found.column("cell").to_numpy()] += found.column("n").to_numpy()
    numbers = number_of(np.arange(CELLS)).astype(np.int64)
    totals = np.bincount(numbers, weights=held, minlength=NUMBERS)
    return (np.log(held) - np.log(totals[numbers])).astype(np.float32)


def _windows(batches: Iterator[pa.RecordBatch], vocabulary: Vocabulary) -> Iterator[np.ndarray]:
    """Minibatches of the windows around all places, shuffled in blocks of bounded size."""
    held, size, number = [], 0, 0

    def shuffled() -> Iterator[np.ndarray]:
        whole = np.concatenate(held)
        whole = whole[np.random.default_rng(number).permutation(len(whole))]
        for at in range(0, len(whole), MINIBATCH):
            yield whole[at : at + MINIBATCH]

    for batch in batches:
        for part in _texts(batch, 0):
            hashes, counts = word_hashes(part)
            if len(hashes):
                held.append(contexts(vocabulary.ids(hashes), counts))
                size += len(hashes)
            if size >= SHUFFLED:
                yield from shuffled()
                held, size, number = [], 0, number + 1
    if held:
        yield from shuffled()


def trained_round(docs: DataFrame, vocabulary: Vocabulary, weights: Weights, places: int) -> Weights:
    """Weights after one round: the trainers' weights, averaged by the windows each has seen.

    ``places`` is about how many places the documents have; few places get few trainers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(weights), 0
        for windows in _windows(batches, vocabulary):
            trainer.step(windows)
            seen += len(windows)
        if seen:
            values = flat(trainer.w).astype(np.float64) * seen
            yield pa.record_batch(
                [
                    pa.array(np.arange(len(values), dtype=np.int64)),
                    pa.array(values),
                    pa.array(np.full(len(values), seen, dtype=np.int64)),
                ],
                names=["place", "value", "seen"],
            )

    many = max(1, places // (MINIBATCH * LEAST_STEPS))
    rows = (
        docs.select("text")
        .coalesce(many)
        .mapInArrow(run, "place long, value double, seen long")
        .groupBy("place")
        .agg((F.sum("value") / F.sum("seen")).alias("value"))
        .orderBy("place")
        .toArrow()  # one row a weight
    )
    return unflat(rows.column("value").to_numpy()) if rows.num_rows else weights


def train(docs: DataFrame, rounds: int = ROUNDS) -> tuple[Vocabulary, Weights]:
    """The vocabulary, and the weights after so many rounds over parts of the documents."""
    counts = word_counts(docs)
    frequent = frequent_words(counts)
    vocabulary = Vocabulary(frequent, rare_shares(counts, frequent))
    places = counts.agg(F.sum("n")).first()[0] or 0
    weights = first_weights()
    for part in range(rounds):
        own = docs.filter(F.pmod(F.xxhash64("text"), F.lit(rounds)) == part)
        weights = trained_round(own, vocabulary, weights, places // rounds)
    return vocabulary, weights


def score(docs: DataFrame, vocabulary: Vocabulary, weights: Weights) -> DataFrame:
    """Per document: ``doc_id``, ``n_tokens``, ``log_likelihood`` and ``mean_log_prob``.

    Texts without words (NULL, empty) have a likelihood of one (log 0) and no mean.  Repeated
    rows get equal answers; an empty table gives no rows; other columns are ignored.
    """

    given = docs.sparkSession.sparkContext.broadcast((vocabulary, weights))

    def make():
        vocabulary, weights = given.value
        scorer = Scorer(weights)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sums, tokens = [], []
            for part in _texts(batch, 1):
                hashes, counts = word_hashes(part)
                inside = np.bincount(
                    np.repeat(np.arange(len(counts)), counts),
                    weights=vocabulary.inside(hashes),
                    minlength=len(counts),
                )
                sums.append(scorer.sums(vocabulary.ids(hashes), counts) + inside)
                tokens.append(counts)
            total = np.concatenate(sums) if sums else np.zeros(0)
            n = np.concatenate(tokens) if tokens else np.zeros(0, dtype=np.int64)
            means = np.divide(total, n, out=np.zeros(len(n)), where=n > 0)
            return pa.record_batch(
                [
                    batch.column(0),
                    pa.array(n.astype(np.int64)),
                    pa.array(total),
                    pa.array(means, mask=n == 0),
                ],
                names=["doc_id", "n_tokens", "log_likelihood", "mean_log_prob"],
            )

        return each

    return in_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, n_tokens long, log_likelihood double, mean_log_prob double",
    )


def train_and_score(docs: DataFrame) -> DataFrame:
    """Scores of all documents under the model trained on all of them (see ``score``)."""
    return score(docs, *train(docs))
