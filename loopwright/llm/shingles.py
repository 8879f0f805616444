"""Hashed word shingles of whole texts, made for a batch of texts at a time in numpy."""

from __future__ import annotations

import numpy as np

WORDS = 5
# Marks of the ASCII white space that ends a word.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(count: int, seed: int) -> np.ndarray:
    """``count`` fixed pseudo-random 64-bit numbers."""
    step = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mixed(step + np.uint64(seed * 0xD1342543DE82EF95 % (1 << 64)))


_CHARACTER = constants(256, 1)
_WORD_BASE, _SHINGLE_BASE, _SHORT = (int(x) | 1 for x in constants(3, 2))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.ones(max(count, 1), dtype=np.uint64)
    out[1:] = np.uint64(base)
    return np.multiply.accumulate(out)


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and how many words each text has."""
    joined = b"\n".join([t or b"" for t in texts])
    raw = _LOWER[np.frombuffer(joined, dtype=np.uint8)]
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Each text's place in the joined bytes gives its number of words.
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    counts = np.diff(np.searchsorted(starts, bounds))
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), counts
    lengths = ends - starts
    letters = raw[inside]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters)) - np.repeat(first, lengths)
    terms = _CHARACTER[letters] * _powers(_WORD_BASE, int(lengths.max()))[place]
    return mixed(np.add.reduceat(terms, first) + lengths.astype(np.uint64)), counts


def shingle_sets(texts: list[bytes | None], words: int = WORDS) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text (UTF-8), A-Z in lower case.

    A text with fewer words than a shingle has one for its whole sequence; one without words,
    and NULL, has none.  Batches of texts are cut so that work space stays bounded.
    """
    out: list[np.ndarray] = []
    part, held = [], 0
    for text in texts:
        part.append(text)
        held += len(text or b"")
        if held > 1 << 21:
            out += _sets(part, words)
            part, held = [], 0
    return out + (_sets(part, words) if part else [])


def _sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    powers = _powers(_SHINGLE_BASE, words + 1)
    n = len(hashes)
    rolled = np.zeros(max(0, n - words + 1), dtype=np.uint64)
    for j in range(words):
        rolled += hashes[j : j + len(rolled)] * powers[j]
    rolled = mixed(rolled)
    out, at = [], 0
    for count in counts:
        if count >= words:
            out.append(np.unique(rolled[at : at + count - words + 1]))
        elif count:
            own = (hashes[at : at + count] * powers[:count]).sum(dtype=np.uint64)
            out.append(mixed(own[None] + np.uint64(_SHORT * int(count) % (1 << 64))))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += count
    return out


class MinHasher:
    """Min-hash signatures of sets of 64-bit hashes: ``count`` unsigned 32-bit numbers."""

    def __init__(self, count: int, seed: int = 7):
        made = constants(2 * count, seed)
        self.factors = (made[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        self.shifts = (made[count:] >> np.uint64(32)).astype(np.uint32)

    def signature(self, items: np.ndarray) -> np.ndarray:
        low = None
        for at in range(0, len(items), 4096):
            part = (mixed(items[at : at + 4096]) >> np.uint64(32)).astype(np.uint32)
            found = (part[:, None] * self.factors[None, :] + self.shifts).min(axis=0)
            low = found if low is None else np.minimum(low, found)
        return low


def set_key(items: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed numbers."""
    a = mixed(items ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    b = mixed(items + np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))
