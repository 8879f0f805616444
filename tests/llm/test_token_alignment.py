import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopwright.llm.token_alignment import Aligner, align, align_tokenizers, alignment_groups
from loopwright.llm.tokens import vocabulary_path

BYTES, PIECES = vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def kit():
    return Aligner(BYTES, PIECES)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PIECES)


def plain_groups(ends_a, ends_b):
    """Groups by the common ends, links by comparing all spans."""
    groups, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        i2, j2 = ends_a.index(end) + 1, ends_b.index(end) + 1
        groups.append((i, i2, j, j2))
        i, j = i2, j2
    spans = [list(zip([0, *e], e)) for e in (ends_a, ends_b)]
    links = [
        (x, y)
        for x, (s, e) in enumerate(spans[0])
        for y, (s2, e2) in enumerate(spans[1])
        if s < e2 and s2 < e
    ]
    return groups, links


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), max_size=90))
def test_walk_is_the_plain_alignment(cuts):
    # Each place may end a token of A, of B or of both; the last place ends both.
    ends = [[k + 1 for k, c in enumerate(cuts) if c[side]] + [len(cuts) + 1] for side in (0, 1)]
    found = align(np.array(ends[0]), np.array(ends[1]))
    groups, links = plain_groups(*ends)
    assert found.groups() == groups and found.n_groups == len(groups)
    assert sorted(zip(*(x.tolist() for x in found.links()))) == links


def test_long_stretches_and_shifts():
    draw, ends = random.Random(3), ([], [])
    at = 0
    for length in [*range(1, 40), 64, 127, 128, 129, 1000]:
        for _ in range(length):
            at += draw.randint(1, 9)
            ends[0].append(at)
            ends[1].append(at)
        ends[draw.randint(0, 1)].append(at + 1)
        at += 3
        ends[0].append(at)
        ends[1].append(at)
    found = align(np.array(ends[0]), np.array(ends[1]))
    assert found.groups() == plain_groups(*ends)[0]
    assert align(np.zeros(0, int), np.zeros(0, int)).groups() == []


def spelled_bytes(library, text):
    """Ids and bytes of both sides by the libraries alone."""
    a, b = library
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    marks = {chr(x): x for x in shown}
    for byte in range(256):
        if byte not in shown:
            marks[chr(256 + len(marks) - len(shown))] = byte
    bytes_a = [bytes(marks[c] for c in a.id_to_token(i)) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        code = len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">")
        bytes_b.append(bytes([int(piece[3:5], 16)]) if code else piece.replace("▁", " ").encode())
    return ids_a, bytes_a, ids_b, bytes_b


def expected(library, rows):
    made, counts = [], Counter()
    for doc, text in rows:
        ids_a, bytes_a, ids_b, bytes_b = spelled_bytes(library, text or "")
        whole = b" " + (text or "").encode()
        if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
            made.append((doc, 0, 0, [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (bytes_a, bytes_b)]
        groups, links = plain_groups(*ends)
        pairs = [(ids_a[x], ids_b[y]) for x, y in links]
        counts.update(set(pairs))
        text = ";".join(
            ",".join(map(str, ids_a[g[0] : g[1]])) + "|" + ",".join(map(str, ids_b[g[2] : g[3]])) for g in groups
        )
        digest = hashlib.sha256(text.encode()).hexdigest()
        made.append((doc, len(ids_a), len(ids_b), groups, pairs, digest))
    highest = defaultdict(int)
    for (a, _), n in counts.items():
        highest[a] = max(highest[a], n)
    return [
        (d, na, nb, len(g), len(p), sum(counts[x] == highest[x[0]] for x in p), sum(counts[x] for x in p), sha)
        for d, na, nb, g, p, sha in made
    ]


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1], r[-1]))


ODD_TEXTS = [
    "a▁b", "<|endoftext|> and <s> <0x0A> <unk>", "\x00\x01 \x7f\x85\x1c", "  two  spaces \n\n\tend ", " ",
    "😀 日本語 ﬁ é", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "won't I'll 1234567 3.14 ___",
]


@pytest.mark.parametrize("frequent", [1 << 19, 40, 0])
def test_figures_are_the_brute_force_ones(llm, make_docs, odd, library, frequent):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] != 7]
    rows += [(100 + n, t) for n, t in enumerate(ODD_TEXTS)]
    docs = make_docs([(d, t, "en", "s", 0) for d, t in rows])
    found = align_tokenizers(docs, frequent=frequent).collect()
    assert by_key(found) == by_key(expected(library, rows))


def test_very_long_text(llm, odd):
    (row,) = align_tokenizers(odd.filter("doc_id = 7")).collect()
    assert row["n_links"] == row["n_a"] + row["n_b"] - row["n_groups"] > 100_000


def test_ids_of_random_texts_are_the_tokenizers(kit, library):
    draw = random.Random(5)
    letters = "abcXYZ éßñ'’.,!?-_123²½  \n\t\x00\x1c\x85日ſﬁ́😀▁<>|s"
    texts = ["".join(draw.choice(letters) for _ in range(80)) for _ in range(500)]
    for text, (a, b) in zip(texts, kit.tokens(texts)):
        ids_a, bytes_a, ids_b, bytes_b = spelled_bytes(library, text)
        whole = b" " + text.encode()
        same = b"".join(bytes_a) == whole == b"".join(bytes_b)
        assert (a, b) == ((ids_a, ids_b) if same else ([], []))


def test_groups_table(llm, make_docs, kit):
    docs = make_docs([(1, "naïve tokenizers"), (2, None), (3, "a▁b")])
    rows = alignment_groups(docs).orderBy("group_no").collect()
    assert {r["doc_id"] for r in rows} == {1}
    text = " naïve tokenizers".encode()
    for side, table in (("a_ids", kit.a.bytes), ("b_ids", kit.b.bytes)):
        for r in rows:
            assert b"".join(table[i] for i in r[side]) == text[r["start"] : r["end"]]
    assert [r["start"] for r in rows][1:] == [r["end"] for r in rows][:-1]


def test_empty_table(none):
    assert align_tokenizers(none).collect() == [] and alignment_groups(none).collect() == []
