"""Alignment of the tokens that two tokenizers cut the same texts into.

Both token streams cover the same bytes.  Byte offsets where tokens of both end cut them into
groups.  Most stretches are one-to-one, so the walk compares the two arrays of token ends at the
current index shift: with steps that double while they agree and halve when they don't, a
one-to-one stretch of n groups costs about 2 log n comparisons of whole slices.  Where the ends
differ, the group is resolved token by token, and the walk goes on at the new shift.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import stored, worker_state
from loopwright.llm.tokens import byte_values, vocabulary_path

# Id pairs whose counts are broadcast; the others' counts are joined.  Bounds the broadcast to
# this many rows of a pair, a count and a mark.
FREQUENT = 1 << 19
# Bins of the histogram that finds the least count of such pairs: 16 a doubling.
BINS = 16

COUNTED = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<int>, times array<int>"
)
GROUPS = "doc_id long, group_no int, start long, end long, a_ids array<int>, b_ids array<int>"


class ByteTokens:
    """Ids of byte-level BPE whose merges are ranked by id, and the bytes of each id."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["id"] for t in spec["added_tokens"]}
        values = byte_values()
        vocabulary = spec["model"]["vocab"]
        ranks = {
            bytes([values[c] for c in word]): i for word, i in vocabulary.items() if i not in special
        }
        if [vocabulary["".join(m)] for m in spec["model"]["merges"]] != list(range(256, len(ranks))):
            raise ValueError(f"{path}: ids are not in the order of the merges")
        self.encoding = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for word, i in ranks.items():
            self.bytes[i] = word

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceTokens:
    """Ids of a sentencepiece model that puts a space before the text, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.bytes = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            one = self.model.is_byte(i)
            self.bytes.append(
                bytes([int(piece[3:5], 16)]) if one else piece.replace("▁", " ").encode()
            )

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return self.model.encode(list(texts), num_threads=1)


@dataclass
class Alignment:
    """One-to-one stretches (a, b, length), other groups (a, a end, b, b end) and their links."""

    runs: list[tuple[int, int, int]]
    odd: list[tuple[int, int, int, int]]
    odd_a: list[int]
    odd_b: list[int]

    @property
    def n_groups(self) -> int:
        return sum(r[2] for r in self.runs) + len(self.odd)

    def groups(self) -> list[tuple[int, int, int, int]]:
        """(a start, a end, b start, b end) of every group, in order."""
        alone = [(i + k, i + k + 1, j + k, j + k + 1) for i, j, n in self.runs for k in range(n)]
        return sorted(alone + self.odd)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all linked tokens: pairs whose bytes overlap, each once."""
        out = []
        for side, odd in ((0, self.odd_a), (1, self.odd_b)):
            runs = np.array(self.runs, dtype=np.int64).reshape(-1, 3)
            first, n = runs[:, side], runs[:, 2]
            at = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
            out.append(np.concatenate([at, np.array(odd, dtype=np.int64)]))
        return out[0], out[1]


def align(ends_a: np.ndarray, ends_b: np.ndarray) -> Alignment:
    """Groups and links of two token streams, given where their tokens end (last ends equal)."""
    raw_a, raw_b = ends_a.astype("<i8").tobytes(), ends_b.astype("<i8").tobytes()
    list_a, list_b = ends_a.tolist(), ends_b.tolist()
    n_a, n_b = len(list_a), len(list_b)
    runs, odd, odd_a, odd_b = [], [], [], []
    i = j = 0
    while i < n_a:
        if list_a[i] == list_b[j]:
            # The diagonal: probe ever longer slices at the shift j - i, then ever shorter ones.
            start, left, step, grows = i, min(n_a - i, n_b - j) - 1, 2, True
            shift = (j - i) * 8
            i += 1
            while left:
                if step > left:
                    step = left
                low, high = i * 8, (i + step) * 8
                if raw_a[low:high] == raw_b[low + shift : high + shift]:
                    i += step
                    left -= step
                    if grows:
                        step += step
                        continue
                if step == 1:
                    break
                grows = False
                step >>= 1
            runs.append((start, j, i - start))
            j += i - start
        else:
            # An irregular group: the side whose token ends first goes on until both end together.
            first_a, first_b = i, j
            end_a, end_b = list_a[i], list_b[j]
            while end_a != end_b:
                odd_a.append(i)
                odd_b.append(j)
                if end_a < end_b:
                    i += 1
                    end_a = list_a[i]
                else:
                    j += 1
                    end_b = list_b[j]
            odd_a.append(i)
            odd_b.append(j)
            i += 1
            j += 1
            odd.append((first_a, i, first_b, j))
    return Alignment(runs, odd, odd_a, odd_b)


class Aligner:
    """Both tokenizers of a worker, with what turns ids into bytes, lengths and decimals."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        self.lengths = [np.array([len(x) for x in t.bytes], dtype=np.int64) for t in (self.a, self.b)]
        # Decimals of ids, and what follows them: inside a group, after A's part, after B's part.
        ids = range(max(self.a.size, self.b.size))
        self.inside, self.after_a, self.after_b = ([f"{i}{mark}" for i in ids] for mark in ",|;")

    def tokens(self, texts: Sequence[str | None]) -> Iterator[tuple[list[int], list[int]]]:
        """Both id lists of each text; none where a stream does not spell space and text."""
        given = [t or "" for t in texts]
        for text, a, b in zip(given, self.a.encode(given), self.b.encode(given)):
            whole = b" " + text.encode()
            spelt = (
                self.a.encoding.decode_bytes(a) == whole
                and b"".join([self.b.bytes[i] for i in b]) == whole
            )
            yield (a, b) if text and spelt else ([], [])

    def align(self, a: list[int], b: list[int]) -> tuple[Alignment, np.ndarray, np.ndarray]:
        ids = np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)
        ends = [np.cumsum(n[x]) for n, x in zip(self.lengths, ids)]
        return align(*ends), *ids

    def spelled(self, found: Alignment, a: list[int], b: list[int]) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of all groups, in order."""
        end_a = list(map(self.after_a.__getitem__, a))
        end_b = list(map(self.after_b.__getitem__, b))
        inside, parts = self.inside, []
        odd, at = found.odd, 0
        # Irregular groups come between stretches, so both lists are walked in order.
        for i, j, n in [*found.runs, (len(a), len(b), 0)]:
            while at < len(odd) and odd[at][0] < i:
                i0, i1, j0, j1 = odd[at]
                at += 1
                if i1 - i0 > 1:
                    parts += [inside[x] for x in a[i0 : i1 - 1]]
                parts.append(end_a[i1 - 1])
                if j1 - j0 > 1:
                    parts += [inside[x] for x in b[j0 : j1 - 1]]
                parts.append(end_b[j1 - 1])
            alone = [""] * (2 * n)
            alone[::2], alone[1::2] = end_a[i : i + n], end_b[j : j + n]
            parts += alone
        return "".join(parts)[:-1]


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """The worker's tokenizers; kept between tasks."""
    return worker_state(f"aligner {byte_path} {piece_path}", lambda: Aligner(byte_path, piece_path))


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def alignment_groups(
    docs: DataFrame, byte_vocabulary: str = "byte_bpe_50k.json", piece_model: str = "piece_bpe_32k.model"
) -> DataFrame:
    """One row a group: ``doc_id``, ``group_no`` (from 0), byte ``start`` and ``end``, both sides' ids.

    Offsets are those of a space and the text.  Texts without tokens (see ``align_tokenizers``)
    have no groups; the groups of repeated rows are repeated.
    """
    paths = vocabulary_path(byte_vocabulary), vocabulary_path(piece_model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = aligner(*paths)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for doc, (a, b) in zip(docs, kit.tokens(batch.column(1).to_pylist())):
                if not a:
                    continue
                groups = kit.align(a, b)[0].groups()
                ends = np.cumsum(kit.lengths[0][a])[[g[1] - 1 for g in groups]]
                yield pa.record_batch(
                    [
                        pa.array([doc] * len(groups), type=pa.int64()),
                        pa.array(range(len(groups)), type=pa.int32()),
                        pa.array(np.concatenate([[0], ends[:-1]])),
                        pa.array(ends),
                        pa.array([a[g[0] : g[1]] for g in groups], type=pa.list_(pa.int32())),
                        pa.array([b[g[2] : g[3]] for g in groups], type=pa.list_(pa.int32())),
                    ],
                    names=["doc_id", "group_no", "start", "end", "a_ids", "b_ids"],
                )

    return _documents(docs).mapInArrow(run, GROUPS)


def counted_links(docs: DataFrame, paths: tuple[str, str], size_b: int) -> DataFrame:
    """Per document its figures, its different linked id pairs and how often each is linked.

    A pair is ``a * size_b + b``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = aligner(*paths)
        schema = pa.schema(
            [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
             ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
        )
        for batch in batches:
            figures, digests, pairs, times = [], [], [], []
            for a, b in kit.tokens(batch.column(1).to_pylist()):
                found, ids_a, ids_b = kit.align(a, b)
                at_a, at_b = found.links()
                different, n = np.unique(ids_a[at_a] * size_b + ids_b[at_b], return_counts=True)
                pairs.append(different.astype(np.int32))
                times.append(n.astype(np.int32))
                figures.append((len(a), len(b), found.n_groups, len(at_a)))
                spelled = kit.spelled(found, a, b).encode()
                digests.append(hashlib.sha256(spelled).hexdigest() if a else "")
            columns = [pa.array(c, type=pa.int64()) for c in zip(*figures)] or [pa.array([], pa.int64())] * 4
            offsets = pa.array(np.cumsum([0, *map(len, pairs)]), type=pa.int32())
            lists = [
                pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, np.int32), *c])))
                for c in (pairs, times)
            ]
            yield pa.record_batch([batch.column(0), *columns, pa.array(digests, pa.string()), *lists], schema=schema)

    return _documents(docs).mapInArrow(run, COUNTED)


def pair_counts(linked: DataFrame, size_b: int) -> DataFrame:
    """``pair``, ``count`` (documents that hold it linked) and ``best`` (the A id's highest count)."""
    counts = linked.select(F.explode("pairs").alias("pair")).groupBy("pair").count()
    counts = stored(counts, "pair-counts")
    of_a = F.floor(F.col("pair") / size_b).cast("int")
    # One row an A id: the vocabulary bounds this broadcast.
    highest = counts.groupBy(of_a.alias("a")).agg(F.max("count").alias("most"))
    return counts.withColumn("a", of_a).join(F.broadcast(highest), "a").select(
        "pair", "count", (F.col("count") == F.col("most")).alias("best")
    )


def least_count(counts: DataFrame, limit: int) -> int:
    """A count that at most ``limit`` pairs reach, from a histogram of some hundred bins."""
    place = F.floor(F.log2("count") * BINS).cast("int")
    bins = counts.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.max("count").alias("top"))
    room = limit
    for row in sorted(bins.collect(), key=lambda r: -r["bin"]):
        room -= row["n"]
        if room < 0:
            return row["top"] + 1
    return 1


def align_tokenizers(
    docs: DataFrame,
    byte_vocabulary: str = "byte_bpe_50k.json",
    piece_model: str = "piece_bpe_32k.model",
    frequent: int = FREQUENT,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``.

    Links are pairs of an A and a B token whose bytes overlap.  The count of an id pair is the
    number of documents that hold it linked; ``n_best`` counts the links whose pair has the highest
    count of its A id (ties included), ``count_sum`` adds up the counts of all links.  NULL and
    empty texts, and texts that one side does not spell byte for byte (one with U+2581, for
    example), have no tokens: zeros and an empty digest.  Every row is a document, also repeated
    ones and those with a NULL id; an empty table gives no rows; other columns are ignored.

    Each document's different pairs are written once.  Counts are partial sums in each task.  At
    most ``frequent`` pairs, the most frequent ones, are looked up by a broadcast of so many rows;
    the occurrences of all others meet their counts in an equi join.
    """
    from sentencepiece import SentencePieceProcessor

    paths = vocabulary_path(byte_vocabulary), vocabulary_path(piece_model)
    size_b = SentencePieceProcessor(model_file=paths[1]).get_piece_size()
    linked = counted_links(docs, paths, size_b).withColumn("row", F.monotonically_increasing_id())
    linked = stored(linked, "linked-pairs")
    counts = stored(pair_counts(linked, size_b), "pair-marks")
    enough = F.col("count") >= least_count(counts, frequent)
    held = linked.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("e")).select(
        "row", F.col("e.pairs").alias("pair"), F.col("e.times").alias("times")
    )
    top = F.broadcast(counts.filter(enough))
    ways = [held.join(top, "pair"), held.join(top, "pair", "left_anti").join(counts.filter(~enough), "pair")]
    sums = [
        way.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times").cast("long")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("count")).alias("count_sum"),
        )
        for way in ways
    ]
    total = sums[0].union(sums[1]).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    figures = linked.drop("pairs", "times").join(total, "row", "left")
    return figures.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )
