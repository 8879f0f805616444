import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopwright.llm.packing import assign, capacities_of, cost, pack_documents
from loopwright.llm.tokens import WordTokenizer, vocabulary_path


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(vocabulary_path("word_bpe_49k.json"))


def whole(words, text):
    ids = words.tokenizer.encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], dtype="<u4")


def test_cached_ids_are_the_tokenizers(words):
    draw = random.Random(1)
    letters = "abcXYZéßñçÉ'’.,!?-_123²½ºª  \n\t \x1c\x85日ſﬁ́😀"
    texts = ["".join(draw.choice(letters) for _ in range(60)) for _ in range(400)]
    for text, ids in zip(texts, words.encode(texts)):
        assert words.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def test_added_tokens_are_the_tokenizers(words):
    texts = ["cat <|endoftext|> dog", "a<|startoftext|>b c", "<|ENDOFTEXT|> x", "<| endoftext |> y", "z"]
    for text, ids in zip(texts, words.encode(texts)):
        assert words.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()
    assert words.encode(["cat <|endoftext|> dog"])[0].tolist() == [2368, 49407, 1929]


def test_every_ascii_and_latin_character_keeps_its_ids(words):
    texts = [f"x {chr(c)} y{chr(c)}z {chr(c)}{chr(c)}'s" for c in range(256)]
    texts += ["".join(map(chr, range(256))), "".join(map(chr, range(256))) * 3]
    for text, ids in zip(texts, words.encode(texts)):
        assert words.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist(), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text_keeps_its_ids(words, text):
    (ids,) = words.encode([text])
    assert words.tokenizer.encode(text, add_special_tokens=False).ids == ids.tolist()


def greedy(lengths, sizes):
    """The rule spelt out: the longest piece left, the cheapest sequence with room, else a cut."""
    left = sorted((-n, i, 0) for i, n in enumerate(lengths) if n)
    room, spent, out = list(sizes), [0.0] * len(sizes), []
    while left:
        n, i, start = left.pop(0)
        fits = [s for s in range(len(sizes)) if room[s] >= -n]
        if fits:
            s, take = min(fits, key=lambda s: (spent[s], s)), -n
        else:
            s = max(range(len(sizes)), key=lambda s: (room[s], -s))
            take = room[s]
            left = sorted([*left, (n + take, i, start + take)])
        out.append((i, start, take, s, sizes[s] - room[s]))
        room[s] -= take
        spent[s] += cost(take)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 70), max_size=30), st.sampled_from([8, 32, 64]))
def test_assignment_is_the_greedy_one(lengths, capacity):
    sizes = capacities_of(sum(lengths), capacity)
    assert assign(lengths, sizes) == greedy(lengths, sizes)


def test_pieces_go_to_the_cheapest_sequence_with_room():
    placed = assign([5, 4, 3], [6, 6])
    assert placed == [(0, 0, 5, 0, 0), (1, 0, 4, 1, 0), (2, 0, 2, 1, 4), (2, 2, 1, 0, 5)]
    assert cost(10, 1, 1) == 110
    assert capacities_of(2048 * 2 + 13) == [2048, 2048, 8, 4, 1]


def check(words, rows, found, capacity):
    left = sorted(((d, whole(words, t)) for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0))
    pieces = {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        assert 0 < r["length"] <= capacity
    for doc in {d for d, _ in left}:
        ids = [i for d, i in left if d == doc]
        got = sorted(pieces.pop(doc), key=lambda r: r["start"])
        assert sum(r["length"] for r in got) == sum(map(len, ids))
        if len(ids) == 1:
            at = 0
            for r in got:
                part = ids[0][at : at + r["length"]]
                assert (r["start"], r["doc_tokens"]) == (at, len(ids[0]))
                assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
                at += r["length"]
    assert not pieces
    sequences = {}
    for r in found:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)


@pytest.mark.parametrize("group", [1, 64, 1 << 20])
def test_every_id_lies_in_one_piece(llm, words, odd, group):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    found = pack_documents(odd, capacity=64, group_tokens=group).collect()
    check(words, rows, found, 64)


def test_empty_table(none):
    assert pack_documents(none).collect() == []
