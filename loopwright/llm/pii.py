"""Personal data: fixed patterns, and a conditional random field for what they do not match.

The patterns find e-mail and IP addresses, card and phone numbers.  The field labels words from
their shapes and neighbours; it adds spans such as spelled-out addresses and national phone
numbers.  It decodes whole texts: the places where no label but "outside" can be on the best path are
told by an exact bound, and what lies between them goes through batched Viterbi.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import fresh, in_batches, of_text, worker_state
from loopwright.llm.crf import ChainModel

KINDS = ("email", "ip", "card", "phone")

Span = tuple[int, int, int]  # kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin where a run of digits does, so no run is tried twice.
_IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if place % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        host = _DOMAIN.match(text, at + 1) if start < at else None
        if host:
            found.append((0, start, host.end()))
            free = host.end()
        else:
            free = max(free, start)
        at = text.find("@", max(at + 1, host.end() if host else 0))
    return found


def base_spans(text: str) -> list[Span]:
    """All pattern matches, by kind and then start, in code points; whole text, linear time."""
    found = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() and c.isascii() for c in m.group()) <= 15:
                found.append((3, *m.span()))
    return found


# ---- the field -------------------------------------------------------------------------------

# Label 0 is outside; kind k begins with 1 + 2k and goes on with 2 + 2k.
LABELS = 1 + 2 * len(KINDS)
_WORD = re.compile(r"\S+")
_EDGES = "()[]{}<>\"'.,;:!?#*$%&|=/"

# The labelled table: how each kind is written, what may stand around it, and lines without any.
# %n, %h and %w are invented names, hosts and words, %t a top-level domain, %d a digit, %b a number
# up to 255, %x a hexadecimal group; card numbers get a valid last digit.
FORMS = {
    "email": [
        "%n (at) %h.%t", "%n.%n (at) %h%d.example.%t", "%n (at) %h (dot) %t", "%n [at] %h [dot] %t",
        "%n [at] %h.%t", "%n.%n%d [at] %h.%h.%t", "%n at %h dot %t", "%n%d%d at %h dot %h dot %t",
        "%n dot %n at %h dot %t", "%n {at} %h {dot} %t", "%n(at)%h.%t", "%n[at]%h[dot]%t",
        "%n@localhost", "%n.%n@%h%d", "%n <at> %h.%t", "%n_%n (at) %h-%h.%t", "%n (at) %h dot %t",
    ],
    "phone": [
        "(%d%d%d) %d%d%d-%d%d%d%d", "%d%d%d-%d%d%d-%d%d%d%d", "%d%d%d.%d%d%d.%d%d%d%d",
        "%d%d%d-%d%d%d%d", "0%d%d %d%d%d%d %d%d%d%d", "0%d%d %d%d%d%d%d%d%d", "0%d%d%d %d%d%d%d%d%d%d",
        "0%d%d%d %d%d%d%d%d%d", "0%d%d%d/%d%d%d%d%d%d%d", "00%d%d %d%d %d%d%d%d%d%d%d", "0%d%d-%d%d%d%d%d%d%d",
        "(0%d%d) %d%d%d%d%d%d%d", "(%d%d%d)%d%d%d-%d%d%d%d", "%d%d%d %d%d%d %d%d%d%d",
    ],
    "card": [
        "4%d%d%d_%d%d%d%d_%d%d%d%d_%d%d%d%d", "5%d%d%d/%d%d%d%d/%d%d%d%d/%d%d%d%d",
        "4%d%d%d.%d%d%d%d.%d%d%d%d.%d%d%d%d", "5%d%d%d_%d%d%d%d_%d%d%d%d_%d%d%d%d",
    ],
    "ip": [
        "%x:%x:%x:%x:%x:%x:%x:%x", "fe80::%x:%x:%x:%x",
        "%x:%x::%x", "%x:%x:%x::%x:%x",
    ],
}
CARRIERS = {
    "": [
        "%w %w {} %w %w", "{} %w %w %w", "%w %w %w {}", "%w, {} %w.", "%w. {} %w, %w", "%w %w: {} %w %w",
        "%w %w %w %w, {}, %w %w %w", "the %w {} of %w",
    ],
    "email": ["write to {} for %w", "mail {} %w", "contact {} before %w", "e-mail: {}", "reach %w by {} today", "our address {} is %w"],
    "phone": ["call {} %w %w", "phone: {}", "tel. {} %w", "tel {} or %w", "fax {} %w", "ring {} in the %w", "the number is {} at %w"],
    "card": ["pay with {} %w", "card {} %w %w", "card no. {} was %w"],
    "ip": ["host {} %w", "from {} to %w", "server {} is down", "address {} was blocked", "ip {} %w"],
}
CLEAN = [
    "%w %w %w %w %w %w %w %w", "The %w %w of %w. %w %w, and %w %w", "%w at %w %w %w", "look at %w %w",
    "we meet at the %w and at %w", "%w %w at %w. %w %w", "at %w %w dot %w", "a dot on the %w", "the dot com %w",
    "%w dot %w %w", "%w (at) the %w %w", "%w at home dot", "they are at %w, at %w or at %w", "%w (%w) %w [%w] %w",
    "%w %w at %w %w %w dot %w %w", "come at %w for the %w", "at %w.%t there is %w", "%w.%t is %w", "see %h.%h.%t for %w",
    "on 20%d%d-%d%d-%d%d the %w began", "since %d%d.%d%d.20%d%d we %w", "at 1%d:%d%d or 2%d:%d%d the %w left",
    "it cost 1,%d%d%d.50 or $%d%d.00 in all", "version %d.%d%d.%d and %d.0 of the %w",
    "Licensed under the %w License, Version 2.0.", "Copyright 20%d%d the %w of it", "%w %d %w %d%d %w",
    "token = %xa%x%d%xf%x0%xb%xe%x%d%x", "token = \"%xa%x%d%xf%x0%xb%xe%x%d%x\" %w", "password=%xc%x%d%xd%x of the %w",
    "key AKIA%d%nXYZ%dABC was lost", "api_key: sk_live_%xa%x%d%x in env", "order %d%d%d%d%d%d%d%d%d%d%d%d was sent",
    "invoice 20%d%d-000%d%d%d is open", "number %d%d%d%d%d%d%d%d%d of the list", "id %d%d%d%d%d%d%d and %d%d%d%d%d in a row",
    "section %d.%d.%d.%d.%d and 1.2.3 of it", "build 3%d%d.4%d%d.5%d%d.600 failed", "chapter 12 has 3%d%d pages and %d maps",
    "the 1st and 2nd of 33 in 19%d%d", "1 2 3 4 5 6 7 8 9 10 11 12", "12 | 4%d%d | 33 | 9 | 1024 | %d%d%d",
    "%d%d%d %d%d%d %d%d%d %d%d%d %d%d%d", "see @%n%d and @%n in the thread", "meet me at 5 dot and bring 3",
    "isbn 978-3-16-148410-0 on the %w", "zip 9%d%d%d%d-1%d%d%d in the west", "w0x0 w1x1 w22x22 ab12cd34 x9 are names",
    "In 20%d%d we had 3 cats and 14 dogs in room 1%d%d", "flight LH 1%d%d%d at gate B%d%d and RTX 40%d%d 24GB",
    "from 1%d%d-2%d%d to 3%d%d-4%d%d units", "http://%h.%t/a/1%d?page=2 shows it", "https://m.%h.%t/en/2%d#top there",
    "3.%d of 10 at 9%d.6 and 1e-%d", "de la 1%d%d%d que 9%d und %d", "%w::%w and a::b in %w", "ratio 1:%d:%d of %w",
    "%d%d:%d%d:%d%d %w %w", "lines %d%d-%d%d and %d%d/%d%d", "%w %d%d%d%d-%d%d %w", "4%d%d%d %d%d %d%d%d%d %w",
    "%w-%w %w/%w %w_%w", "a@ %w @ %w", "%w@ the %w", "%w <%w> %w </%w>", "%w{%w} [%d] (%d%d)",
]
# Each form is shown in every carrier of its own and in all others, each clean line so many times.
COPIES = 6
# Features of fewer training words are dropped: names and hosts must not be learnt by heart.
LEAST_SEEN = 4
_DOMAINS = ("com", "org", "net", "de", "io", "fr", "es", "edu", "info", "co")
_SLOT = re.compile(r"%[nhwtdbx]")


def filled(pattern: str, draw: random.Random) -> str:
    """The pattern with invented words and digits."""

    def letters(low: int, high: int) -> str:
        return "".join(draw.choice("abcdefghijklmnoprstuvwyzéäñ"[: 24 if low > 2 else 27]) for _ in range(draw.randint(low, high)))

    def made(match: re.Match) -> str:
        slot = match.group()[1]
        if slot == "d":
            return draw.choice("0123456789")
        if slot == "b":
            return str(draw.randint(0, 255))
        if slot == "x":
            return f"{draw.randint(0, 0xFFFF):x}"
        if slot == "t":
            return draw.choice(_DOMAINS)
        word = letters(3, 9) if slot in "nh" else letters(1, 10)
        return word.capitalize() if draw.random() < 0.15 else word

    return _SLOT.sub(made, pattern)


def example(kind: str, form: str, draw: random.Random) -> str:
    """A form filled in; the last digit of a card number makes it valid."""
    shown = filled(form, draw)
    if kind == "card":
        digits = [c for c in shown if c.isdigit()]
        shown = shown[:-1] + next(d for d in "0123456789" if luhn("".join(digits[:-1]) + d))
    return shown


def placed(kind: str, form: str, carrier: str, draw: random.Random) -> tuple[str, list[Span]]:
    """A carrier with the form in its place, and the span."""
    before, after = (filled(part, draw) for part in carrier.split("{}"))
    shown = example(kind, form, draw)
    return before + shown + after, [(KINDS.index(kind), len(before), len(before) + len(shown))]


def labelled_texts(seed: int = 17) -> list[tuple[str, list[Span]]]:
    """The labelled table filled in: texts and their spans; the same for the same seed."""
    draw, out = random.Random(seed), []
    for kind, forms in FORMS.items():
        for form in forms:
            for carrier in [*CARRIERS[""], *CARRIERS[kind]]:
                out.append(placed(kind, form, carrier, draw))
    return out + [(filled(line, draw), []) for line in CLEAN for _ in range(COPIES)]


_ASCII_SHAPE = {
    c: "9" if chr(c).isdigit() else "a" if chr(c).islower() else "A"
    for c in range(128)
    if chr(c).isalnum()
}


def _shape(word: str) -> str:
    if word.isascii():
        return word.translate(_ASCII_SHAPE)
    return "".join(
        "9" if c.isdigit() else "a" if c.islower() else "A" if c.isalpha() else c for c in word
    )


def _case(word: str) -> str:
    return "a" if word.islower() else "Aa" if word.istitle() else "A" if word.isupper() else "mixed"


def _describe(word: str) -> tuple[list[str], str]:
    """A word's own features, and what its neighbours see of it."""
    core = word.strip(_EDGES)
    opening = "" if word[:1].isalnum() else word[:1]
    mark = opening if opening and opening in "([{<" else ""
    if core.isalpha():
        low = core.lower()
        return [f"alpha={_case(core)}", f"open={opening}", f"w={mark}{low}"], mark + low
    shape = _shape(core)
    squeezed = re.sub(r"(.)\1+", r"\1", shape)
    digits = "".join(c for c in core if c in "0123456789")
    own = [
        f"q={squeezed}",
        f"n={min(len(digits), 20)}",
        f"dots={min(core.count('.'), 5)}",
        f"colons={min(core.count(':'), 8)}",
        f"at={'@' in core}",
        f"runs={'-'.join(str(len(r)) for r in re.findall('9+', shape))}",
        f"open={opening}",
    ]
    if ":" in core:
        own.append(f"hex={all(c in '0123456789abcdefABCDEF:' for c in core)}")
    if "(at)" in core or "[at]" in core:
        own.append("spelled")
    if 13 <= len(digits) <= 19:
        own.append(f"luhn={luhn(digits)}")
    parts = core.split(".")
    if len(parts) == 4 and all(p.isdigit() and p.isascii() for p in parts):
        own.append(f"bytes={all(len(p) < 4 and int(p) <= 255 for p in parts)}")
    return own, mark + squeezed


# What stands before and after a text.
_BEFORE, _AFTER = "^", "$"
_OFFSETS = (-2, -1, 1, 2)


def word_features(words: list[str]) -> list[list[str]]:
    """The features of each word of a text: its own, and what it sees of its neighbours."""
    described = [_describe(w) for w in words]
    seen = [_BEFORE, _BEFORE, *(near for _, near in described), _AFTER, _AFTER]
    out = []
    for i, (own, _) in enumerate(described):
        around = [f"{j}:{seen[i + 2 + j]}" for j in _OFFSETS]
        out.append(["bias", *own, *around, f"<>{seen[i + 1]} {seen[i + 3]}"])
    return out


class Field:
    """The model over whole texts.  What a word is to the model is worked out once and kept.

    Few words matter: of all others only their case or digits do.  So a word is one of a few
    thousand kinds, and only places near a known word get more than their kind's weights.
    """

    KEPT = 150_000
    # Words that are decoded together (but one text at least).
    TOGETHER = 1 << 16

    def __init__(self, model: ChainModel, vocabulary: dict[str, int]):
        self.model, self.vocabulary = model, vocabulary
        weights = model.weights
        # Sights that some feature names: 0 is any other word.
        self.nears = {_BEFORE: 1, _AFTER: 2}
        pairs = {}
        for name, i in vocabulary.items():
            if name.startswith("<>"):
                pairs[tuple(name[2:].split(" "))] = i
            elif (at := name.partition(":"))[1] and at[0] in map(str, _OFFSETS):
                self.nears.setdefault(at[2], len(self.nears) + 1)
        for pair in pairs:
            for near in pair:
                self.nears.setdefault(near, len(self.nears) + 1)
        self.base = len(self.nears) + 1
        self.beside = np.zeros((len(_OFFSETS), self.base, weights.shape[1]))
        for near, number in self.nears.items():
            for column, j in enumerate(_OFFSETS):
                self.beside[column, number] = weights[vocabulary.get(f"{j}:{near}", 0)]
        keyed = sorted((self.nears[a] * self.base + self.nears[b], i) for (a, b), i in pairs.items())
        self.pair_keys = np.array([k for k, _ in keyed], dtype=np.int64)
        self.pair_weights = weights[[i for _, i in keyed]] if keyed else np.zeros((0, weights.shape[1]))
        self.kinds: dict[tuple, int] = {}
        self.own: list[np.ndarray] = []
        self.near_of: list[int] = []
        self.words: dict[str, int] = {}
        self.own_table, self.near_table = np.zeros((0, weights.shape[1])), np.zeros(0, dtype=np.int64)
        self._bounds()

    def _bounds(self) -> None:
        """The most that labels other than 0 can gain by steps: into, inside and out of a stretch."""
        steps = self.model.pairs - self.model.pairs[0, 0]
        self.inside = float(steps[1:, 1:].max())
        self.ends = float(steps[0, 1:].max() + steps[1:, 0].max()) - self.inside

    def kind(self, word: str) -> int:
        """The number of a word's kind."""
        own, near = _describe(word)
        known = self.vocabulary
        key = (*(known[f] for f in ("bias", *own) if f in known), -self.nears.get(near, 0))
        number = self.kinds.setdefault(key, len(self.kinds))
        if number == len(self.own):
            self.own.append(self.model.weights[list(key[:-1])].sum(axis=0))
            self.near_of.append(-key[-1])
        return number

    def _numbers(self, words: list[str]) -> np.ndarray:
        known = self.words
        new = {w: self.kind(w) for w in set(words) if w not in known}
        if not new:
            found = [known[w] for w in words]
        else:
            found = [known[w] if w in known else new[w] for w in words]
            if len(known) < self.KEPT:
                known.update(new)
        if len(self.own_table) < len(self.own):
            self.own_table, self.near_table = np.array(self.own), np.array(self.near_of)
        return np.array(found, dtype=np.int64)

    def emissions(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """What each place's features add to each label, and where the words stand.

        Two places before and two after each text are none of its words.
        """
        sizes = np.array([len(t) for t in texts])
        kinds = self._numbers([w for t in texts for w in t])
        starts = np.cumsum(sizes + 4) - sizes - 2
        at = np.arange(len(kinds)) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        near = np.zeros(len(kinds) + 4 * len(texts), dtype=np.int64)
        near[starts - 1] = near[starts - 2] = self.nears[_BEFORE]
        near[starts + sizes] = near[starts + sizes + 1] = self.nears[_AFTER]
        near[at] = self.near_table[kinds]
        out = np.zeros((len(near), self.model.weights.shape[1]))
        out[at] = self.own_table[kinds]
        some = np.flatnonzero(near)
        for column, j in enumerate(_OFFSETS):
            target = some - j
            inside = (target >= 0) & (target < len(near))
            out[target[inside]] += self.beside[column, near[some[inside]]]
        both = np.flatnonzero((near[:-2] > 0) & (near[2:] > 0)) + 1
        if len(self.pair_keys) and len(both):
            keys = near[both - 1] * self.base + near[both + 1]
            place = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
            same = self.pair_keys[place] == keys
            out[both[same]] += self.pair_weights[place[same]]
        return out, at

    def unsure(self, emit: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The places that may have a label other than 0 on the best path; exact.

        A stretch of other labels between zeros gains at most the sum of ``gain`` over it, and
        ``ends``.  Where no stretch through a place can gain, the place has label 0.
        """
        gain = np.full(len(emit), -np.inf)
        gain[at] = emit[at, 1:].max(axis=1) - emit[at, 0] + self.inside
        # No stretch crosses the places between texts: one costs more than all others can gain.
        wall = 1.0 + abs(self.ends) + gain[at][gain[at] > 0].sum()
        gain[np.isneginf(gain)] = -wall
        total = np.cumsum(gain)
        before = np.concatenate([[0.0], total[:-1]])
        left = total - np.minimum.accumulate(before)
        right = np.maximum.accumulate(total[::-1])[::-1] - before
        found = left + right - gain + self.ends >= -1e-6
        return at[found[at]]

    def labelled(self, texts: list[list[str]]) -> Iterator[list[tuple[int, int]]]:
        """For each text the words (number, label) whose best label is not 0."""
        part, held = [], 0
        for words in texts:
            if part and held + len(words) > self.TOGETHER:
                yield from self._labelled(part)
                part, held = [], 0
            part.append(words)
            held += len(words)
        if part:
            yield from self._labelled(part)

    def _labelled(self, texts: list[list[str]]) -> list[list[tuple[int, int]]]:
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not any(texts):
            return out
        emit, at = self.emissions(texts)
        open_places = self.unsure(emit, at)
        if not len(open_places):
            return out
        # Between provable zeros each stretch is decoded by itself.
        cut = np.flatnonzero(np.diff(open_places) > 1) + 1
        sizes = np.diff(np.concatenate([[0], cut, [len(open_places)]])).tolist()
        path = np.concatenate(self.model.best_paths(emit[open_places], sizes))
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 4) - sizes - 2
        marked = np.flatnonzero(path)
        owner = np.searchsorted(starts, open_places[marked], side="right") - 1
        for place, text, label in zip(open_places[marked], owner, path[marked]):
            out[text].append((int(place - starts[text]), int(label)))
        return out


def _mark(words: list[tuple[int, int]], spans: list[Span]) -> list[int]:
    marks = [0] * len(words)
    for kind, start, end in spans:
        inside = [i for i, (a, b) in enumerate(words) if a < end and b > start]
        for i in inside:
            marks[i] = (1 if i == inside[0] else 2) + 2 * kind
    return marks


def allowed_steps() -> np.ndarray:
    """Outside or a beginning may follow anything; going on follows its own kind only."""
    ok = np.ones((LABELS, LABELS), dtype=bool)
    for kind in range(len(KINDS)):
        going = 2 + 2 * kind
        ok[:, going] = False
        ok[[1 + 2 * kind, going], going] = True
    return ok


@cache
def trained(seed: int = 17) -> tuple[ChainModel, dict[str, int]]:
    """The field trained on the labelled table, and the numbers of its features; deterministic."""
    sequences, marks = [], []
    for text, spans in labelled_texts(seed):
        words = [m.span() for m in _WORD.finditer(text)]
        sequences.append(word_features([text[a:b] for a, b in words]))
        marks.append(_mark(words, spans))
    seen = Counter(f for sequence in sequences for features in sequence for f in features)
    names = sorted(f for f, n in seen.items() if n >= LEAST_SEEN)
    vocabulary = {f: i for i, f in enumerate(names, 1)}
    known = [[[vocabulary[f] for f in features if f in vocabulary] for features in s] for s in sequences]
    return ChainModel.train(known, marks, allowed_steps(), len(names) + 1), vocabulary


_AT, _DOT = r" ?[(\[{<] ?at ?[)\]}>] ?", r"(?: ?[(\[{<] ?dot ?[)\]}>] ?| dot )"
_FORMS = [
    re.compile(
        rf"[^@\s]+@[^@\s]+|\S+?{_AT}\S+?(?:{_DOT}\S+?)*|\S+(?:{_DOT}\S+)* at \S+(?: dot \S+)+", re.I
    ),
    re.compile(r"[0-9]+(?:\.[0-9]+){3}(?::[0-9]+)?|[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}"),
    re.compile(r"[0-9](?:[ _./-]?[0-9])+"),
    re.compile(r"\+?[0-9(](?:[ ()./-]{0,2}[0-9)])+"),
]
_DIGITS = [(0, 1 << 30), (1, 32), (13, 19), (7, 15)]


def plausible(kind: int, shown: str) -> bool:
    """Whether words that the field labels have the form of their kind at all."""
    digits = [c for c in shown if c in "0123456789"]
    least, most = _DIGITS[kind]
    if not (_FORMS[kind].fullmatch(shown) and least <= len(digits) <= most):
        return False
    return kind != 2 or luhn("".join(digits))


def _read(labels: list[tuple[int, int]], text: str) -> list[Span]:
    """The spans that a text's labels stand for, without outer punctuation, if their form fits."""
    words = [m.span() for m in _WORD.finditer(text)]
    out: list[Span] = []
    for place, label in labels:
        a, b = words[place]
        if label % 2:
            out.append(((label - 1) // 2, a, b))
        elif out:
            out[-1] = (out[-1][0], out[-1][1], b)
    found = []
    for kind, a, b in out:
        while a < b and text[a] in _EDGES and text[a] != "(":
            a += 1
        while a < b and text[b - 1] in _EDGES and text[b - 1] not in ")]":
            b -= 1
        if plausible(kind, text[a:b]):
            found.append((kind, a, b))
    return found


def field_of(model: ChainModel, vocabulary: dict[str, int]) -> Field:
    """The worker's field for a model; made anew when the model is another one."""
    held = worker_state("personal data fields", dict)
    key = (model.weights.tobytes(), model.pairs.tobytes())
    if key not in held:
        held.clear()
        held[key] = Field(model, vocabulary)
    return held[key]


def spans_of(texts: list[str | None], field: Field) -> list[tuple[list[Span], list[Span]]]:
    """For each text its pattern spans and all spans, the field's added where none overlap."""
    base = [base_spans(t) if t else [] for t in texts]
    added = [
        _read(labels, text) if labels else []
        for text, labels in zip(texts, field.labelled([(t or "").split() for t in texts]))
    ]
    out = []
    for own, more in zip(base, added):
        whole = list(own)
        taken = sorted((a, b) for _, a, b in own)
        starts = np.array([a for a, _ in taken])
        latest = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        for kind, a, b in more:
            at = int(np.searchsorted(starts, b))
            if at == 0 or latest[at - 1] <= a:
                whole.append((kind, a, b))
        out.append((own, sorted(set(whole)) if more else own))
    return out


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of pattern matches by kind, their digest, and all spans.

    ``n_email``, ``n_ip``, ``n_card`` and ``n_phone`` count the pattern matches, ``base_sha256``
    is the digest of their list ``kind:start:end,...`` and ``spans`` that list with the field's
    spans.  Offsets are code points.  NULL and empty texts have none.  Repeated rows get equal
    answers; an empty table gives no rows; other columns are ignored.
    """
    model, vocabulary = trained()

    def make():
        field = field_of(model, vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = spans_of(batch.column(1).to_pylist(), field)
            counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(4)]
            return pa.record_batch(
                [
                    batch.column(0),
                    *(pa.array(c, type=pa.int64()) for c in counts),
                    pa.array(
                        [hashlib.sha256(written(b).encode()).hexdigest() for b, _ in found],
                        type=pa.string(),
                    ),
                    pa.array([written(s) for _, s in found], type=pa.string()),
                ],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

        return each

    return in_batches(
        docs.select(F.col("doc_id").cast("long"), "text"),
        make,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string",
    )


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones as one."""
    parts, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind].upper()}>"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The rows with personal data masked; ``length``, if there, is set anew where a text changed."""
    (model, vocabulary), masked = trained(), fresh(docs, "_masked")

    def make():
        field = field_of(model, vocabulary)

        def each(column: pa.Array) -> pa.Array:
            texts = column.to_pylist()
            new = [
                redacted(t, spans) if spans else t
                for t, (_, spans) in zip(texts, spans_of(texts, field))
            ]
            return pa.array(new, type=pa.string())

        return each

    rows = docs.withColumn(masked, of_text(text, make, "string"))
    changed = ~F.col(masked).eqNullSafe(F.col(text))
    columns = []
    for c in docs.columns:
        if c == text:
            columns.append(F.col(masked).alias(c))
        elif c == length:
            kind = docs.schema[c].dataType
            columns.append(
                F.when(changed, F.length(masked)).otherwise(F.col(c)).cast(kind).alias(c)
            )
        else:
            columns.append(F.col(f"`{c}`"))
    return rows.select(*columns)
