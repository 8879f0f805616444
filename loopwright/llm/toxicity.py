"""Toxicity by multiple-instance learning: documents have labels, sentences get scores.

A sentence's score is a logistic function of the sum of its words' values, and a word's value is
the sum of the weights of its pieces (the word and its letter n-grams).  Few pieces have a weight: all
places where one of them stands are found by one automaton over the text.  A document is
toxic if any sentence is: its score is the noisy-or of its sentences' scores.  The weights are
trained from document labels alone, by gradients of the documents' log-likelihood; the sentences
that carry a score are found on the way.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import in_batches, stored

# Bounds of the training sample: labelled documents of each class, and the longest one's length.
TRAIN_TOXIC, TRAIN_OTHER, TRAIN_CHARS = 1000, 2000, 50_000
PIECES = 1 << 20
GRAMS = (3, 4, 5)
# A piece is learnt only if its share among toxic and other documents differs by so many
# standard errors; others are noise that long texts would add up.
SCREEN = 6.0
THRESHOLD = 0.3

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def grams(word: str) -> list[tuple[str, int]]:
    """A lower-cased word's pieces, as text and as hashed number: the word and its letter n-grams."""
    marked = f"<{word}>"
    found = {(marked, zlib.crc32(marked.encode()) % PIECES)}
    for n in GRAMS:
        for at in range(len(marked) - n + 1):
            gram = marked[at : at + n]
            found.add((gram, zlib.crc32(gram.encode(), n) % PIECES))
    return sorted(found)


def pieces(word: str) -> list[int]:
    """The hashed numbers of a word's pieces."""
    return [number for _, number in grams(word)]


def sentences(text: str) -> list[list[str]]:
    """The lower-cased words of each sentence that has any; ends are ``.!?`` and line ends."""
    found = [_WORD.findall(s.lower()) for s in _SENTENCE.findall(text)]
    return [words for words in found if words]


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def _association(
    piece: np.ndarray, sizes: np.ndarray, document: np.ndarray, word: np.ndarray, y: np.ndarray
) -> np.ndarray:
    """For every piece the standard errors between its shares in toxic and other documents.

    ``piece`` lists the words' pieces, ``sizes`` how many each word has; ``document`` (ascending)
    and ``word`` say who holds which word.
    """
    first = np.cumsum(sizes) - sizes
    counts = np.zeros((2, PIECES), dtype=np.float32)
    cuts = np.searchsorted(document, np.arange(0, len(y) + 32, 32))
    for low, high in zip(cuts[:-1], cuts[1:]):
        # The pieces of 32 documents, each once a document.
        d, w = document[low:high], word[low:high]
        many = sizes[w]
        spread = np.repeat(first[w] - (np.cumsum(many) - many), many)
        p = piece[np.arange(len(spread)) + spread]
        both = np.unique(np.repeat(d, many) * PIECES + p)
        for label in (0, 1):
            np.add.at(counts[label], both[y[both // PIECES] == label] % PIECES, 1)
    n = np.array([(y == 0).sum(), (y == 1).sum()])
    share = counts.sum(axis=0) / n.sum()
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n[0] + 1 / n[1]))
    return (counts[1] / n[1] - counts[0] / n[0]) / error


class SentenceModel:
    """Weights of the word pieces that were learnt, by their text, and a bias."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def value(self, word: str) -> float:
        """The sum over a word's different pieces."""
        return sum(self.weights.get(g, 0.0) for g in sorted({g for g, _ in grams(word)}))

    @classmethod
    def train(
        cls,
        texts: list[str],
        labels: list[int],
        class_weights: tuple[float, float] = (1.0, 1.0),
        steps: int = 200,
        rate: float = 0.5,
        penalty: float = 1e-4,
    ) -> SentenceModel:
        """Maximum likelihood under noisy-or, by full-batch Adagrad; deterministic.

        Without both classes the model says the base rate, whatever the text.
        """
        number: dict[str, int] = {}
        words, sentence_sizes = array("i"), array("i")
        document_sizes, document_words, kept = array("i"), array("i"), array("i")
        for text, label in dict.fromkeys(zip(texts, labels)):  # a text counts once
            found, before = sentences(text or ""), len(words)
            if not found:
                continue
            for sentence in found:
                sentence_sizes.append(len(sentence))
                words.extend([number.setdefault(w, len(number)) for w in sentence])
            kept.append(label)
            document_sizes.append(len(found))
            document_words.append(len(words) - before)
        y = np.array(kept)
        if not len(y) or y.min() == y.max():
            rate_of = (sum(labels) + 0.5) / (len(labels) + 1.0) if labels else 0.01
            return cls({}, math.log(rate_of / (1 - rate_of)))
        pieces_of, sizes = array("i"), array("i")
        for word in number:
            own = pieces(word)
            pieces_of.extend(own)
            sizes.append(len(own))
        count, vocabulary = len(number), list(number)
        del number
        word_ids, sizes = np.array(words), np.array(sizes)
        held = np.unique(np.repeat(np.arange(len(y)), document_words) * count + word_ids)
        piece = np.array(pieces_of)
        z = _association(piece, sizes, held // count, held % count, y)
        told = np.abs(z)[piece] >= SCREEN
        owner = np.repeat(np.arange(count, dtype=np.int32), sizes)[told]
        piece = piece[told]
        known, named = set(piece.tolist()), {}
        for w in np.unique(owner):
            for gram, n in grams(vocabulary[w]):
                # A short word is also an n-gram: its text has two numbers.
                if n in known:
                    named.setdefault(gram, set()).add(n)
        del held, told, pieces_of, vocabulary
        word_at = np.cumsum([0, *sentence_sizes])[:-1]
        in_sentence = np.repeat(np.arange(len(sentence_sizes), dtype=np.int32), sentence_sizes)
        at = np.cumsum([0, *document_sizes])[:-1]
        in_document = np.repeat(np.arange(len(y), dtype=np.int32), document_sizes)
        weight = np.where(y == 1, class_weights[1], class_weights[0])
        weight = weight / weight.sum()

        theta, bias = np.zeros(PIECES), -4.0
        seen, seen_bias = np.full(PIECES, 1e-8), 1e-8
        for _ in range(steps):
            values = np.bincount(owner, weights=theta[piece], minlength=count)
            z = np.add.reduceat(values[word_ids], word_at) + bias
            total = np.add.reduceat(_softplus(z), at)
            pull = np.where(y == 1, 1.0 / np.expm1(np.clip(total, 1e-9, 50)), -1.0) * weight
            slope = _sigmoid(z) * pull[in_document]
            by_word = np.bincount(word_ids, weights=slope[in_sentence], minlength=count)
            grad = np.bincount(piece, weights=by_word[owner], minlength=PIECES)
            grad -= penalty * theta
            seen += grad * grad
            theta += rate * grad / np.sqrt(seen)
            seen_bias += slope.sum() ** 2
            bias += rate * slope.sum() / math.sqrt(seen_bias)
        return cls({g: float(sum(theta[n] for n in sorted(own))) for g, own in named.items()}, bias)


def finder(weights: dict[str, float]) -> Callable[[list[str]], float]:
    """The sum of the values of a sentence's words, by an automaton of the pieces with weights."""
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for gram, weight in weights.items():
        if weight:
            automaton.add_word(gram, (gram, weight))
    if not len(automaton):
        return lambda words: 0.0
    automaton.make_automaton()

    def total(words: list[str]) -> float:
        shown = "<" + "><".join(words) + ">"
        found = list(automaton.iter(shown))
        if len(found) < 2:
            return found[0][1][1] if found else 0.0
        # A piece counts once in a word, however often it stands there.
        each = {(shown.rfind("<", 0, end + 1), gram): weight for end, (gram, weight) in found}
        return math.fsum(each.values())

    return total


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Rows whose labels are never learnt from."""
    rest = F.crc32(F.col(doc_id).cast("string")) % 4
    return F.coalesce(rest == 2, F.lit(False))


def training_sample(
    docs: DataFrame,
    labels: DataFrame,
    toxic: int = TRAIN_TOXIC,
    other: int = TRAIN_OTHER,
    longest: int = TRAIN_CHARS,
) -> tuple[list[str], list[int], tuple[float, float]]:
    """Texts and labels of a bounded sample of the labelled rows, and what a row of each stands for.

    The bounds are the parameters: so many documents of each class (in the order of a hash of
    their ids), without those longer than ``longest``.
    """
    one = stored(
        labels.filter(~held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter("toxic is not null and doc_id is not null"),
        "labels",
    )
    totals = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = one.filter("toxic = 1").orderBy(*order).limit(toxic).union(
        one.filter("toxic = 0").orderBy(*order).limit(other)
    )
    wanted = F.broadcast(stored(picked, "training-ids"))  # toxic + other rows at most
    rows = (
        docs.select("doc_id", "text")
        .filter(F.length("text") <= longest)
        .join(wanted, "doc_id")
        # Of several texts under one id the one whose hash comes first.
        .groupBy("doc_id", "toxic")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .select("text", "toxic", "doc_id")
        .toPandas()
        .sort_values("doc_id")
    )
    counts = rows["toxic"].value_counts()
    weights = tuple(totals.get(k, 0) / max(1, counts.get(k, 0)) for k in (0, 1))
    return rows["text"].tolist(), [int(t) for t in rows["toxic"]], weights


def score(
    docs: DataFrame, model: SentenceModel, threshold: float = THRESHOLD
) -> DataFrame:
    """Per document: ``doc_id``, ``held_out``, ``score``, ``predicted``, ``offending``.

    ``offending`` lists the sentences whose own score reaches the threshold, as
    ``start:end:score`` in code points, comma-joined; when only all together do, the highest one.
    Texts without words (NULL, empty) score 0: no sentence, no offence.  Whole texts are read.
    Repeated rows get equal answers; other columns are ignored; an empty table gives no rows.
    """
    weights, bias = dict(model.weights), model.bias

    def make():
        values = finder(weights)

        def one(text: str | None) -> tuple[float, str]:
            z = []
            for sentence in _SENTENCE.findall(text or ""):
                words = _WORD.findall(sentence.lower())
                z.append(bias + values(words) if words else -math.inf)
            z = np.array(z)
            with np.errstate(over="ignore"):
                whole = float(-np.expm1(-np.logaddexp(0.0, z).sum())) if len(z) else 0.0
            where = ""
            if whole >= threshold:
                own = _sigmoid(z)
                bad = set(np.flatnonzero(own >= threshold).tolist()) or {int(z.argmax())}
                spans = [m.span() for m in _SENTENCE.finditer(text)]
                where = ",".join(
                    f"{a}:{b}:{own[i]:.3f}" for i, (a, b) in enumerate(spans) if i in bad
                )
            return min(1.0, max(0.0, whole)), where

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [one(t.as_py()) for t in batch.column(2)]
            return pa.record_batch(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([s for s, _ in found], type=pa.float64()),
                    pa.array([int(s >= threshold) for s, _ in found], type=pa.int32()),
                    pa.array([w for _, w in found], type=pa.string()),
                ],
                names=["doc_id", "held_out", "score", "predicted", "offending"],
            )

        return each

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return in_batches(
        rows,
        make,
        "doc_id long, held_out boolean, score double, predicted int, offending string",
    )


def train_and_score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of all documents by a model of the labelled ones (see ``training_sample``, ``score``).

    Without labels of both classes every text with words gets the base rate.
    """
    texts, marks, weights = training_sample(docs, labels)
    return score(docs, SentenceModel.train(texts, marks, weights), threshold)
