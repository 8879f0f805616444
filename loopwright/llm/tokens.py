"""Token ids of texts by a public tokenizer, with a cache of words."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np

from loopwright.llm.common import worker_state

# Words whose ids a worker keeps; beyond that, and for longer ones, ids are made anew each time.
CACHE_SIZE = 200_000
CACHE_LENGTH = 40

# Latin-1 as the tokenizer's splitting rule sees it, after lower-casing: contractions, letters,
# single numbers, rest.
_LETTERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
_NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_PARTS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+"
)

# Stands for the end of a word while it is merged; words that hold it go to the tokenizer.
WORD_END = "\0"


def byte_values() -> dict[str, int]:
    """The printable marks of byte-level vocabularies, and the byte that each stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


def _merger(path: str):
    """The vocabulary as byte ranks; a word's end is a byte of its own, which its last one takes first."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    suffix, values, ranks = model["end_of_word_suffix"], byte_values(), {}
    for token, i in model["vocab"].items():
        ends = len(token) > len(suffix) and token.endswith(suffix)
        stem = token.removesuffix(suffix) if ends else token
        if all(c in values for c in stem):
            ranks[bytes([values[c] for c in stem]) + (WORD_END.encode() if ends else b"")] = i
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if merged != list(range(512, 512 + len(merged))):
        raise ValueError(f"{path}: ids are not in the order of the merges")
    # Added tokens are no merges.
    ranks = {word: i for word, i in ranks.items() if i < 512 + len(merged)}
    return tiktoken.Encoding(
        "words", pat_str=f"[^{WORD_END}]*{WORD_END}", mergeable_ranks=ranks, special_tokens={}
    )


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Known(dict):
    """Ids of words or chunks, made by ``make`` when first asked for."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.make(key)
        if len(self) < CACHE_SIZE and len(key) <= CACHE_LENGTH:
            self[key] = ids
        return ids


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordTokenizer:
    """Ids of whole texts, for a byte-level tokenizer whose tokens never span white space.

    A Latin-1 text is cut into words, numbers and marks in one pass, and their ids are looked up;
    new ones go to the tokenizer's model.  Of other texts the chunks between white space are looked
    up; chunks outside Latin-1 go to the tokenizer as they are.  Texts with control characters that
    Python, but not the tokenizer, takes for white space are encoded whole, and so are texts that
    hold one of the tokenizer's added tokens.
    """

    # Characters that str.split takes for white space and the tokenizer does not.
    ODD_SPACE = "\x1c\x1d\x1e\x1f"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.whole = re.compile("|".join(map(re.escape, [*self.ODD_SPACE, *(t.content for t in added)])))
        self.words, self.chunks = _Known(self._word), _Known(self._chunk)
        self.merger = _merger(path)

    def _word(self, word: str) -> tuple[int, ...]:
        if WORD_END in word:
            return tuple(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return tuple(self.merger.encode_ordinary(word + WORD_END))

    def _latin(self, text: str) -> Iterator[int]:
        return chain.from_iterable(map(self.words.__getitem__, _PARTS.findall(text.lower())))

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if _is_latin(chunk):
            return tuple(self._latin(chunk))
        return tuple(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """One array of ids (unsigned 32-bit) a text; NULL is an empty text."""
        out = []
        for text in texts:
            text = text or ""
            if self.whole.search(text):
                ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            elif _is_latin(text):
                ids = list(self._latin(text))
            else:
                ids = list(chain.from_iterable(map(self.chunks.__getitem__, text.split())))
            out.append(np.array(ids, dtype="<u4"))
        return out


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker's tokenizer for a file; kept between tasks."""
    return worker_state(f"tokenizer {path}", lambda: WordTokenizer(path))
