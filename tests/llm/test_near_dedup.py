import random

import numpy as np
import pytest

from loopwright.llm import near_dedup
from loopwright.llm.graphs import components
from loopwright.llm.near_dedup import find_groups, keep_one, least_matches
from loopwright.llm.shingles import MinHasher, shingle_sets


def shingles(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Component of every row by comparing all pairs of texts."""
    sets = {t: shingles(t) for _, t in rows}
    texts = [t for t in sets if sets[t]]
    group = {t: t for t in texts}

    def top(t):
        while group[t] != t:
            t = group[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * len(sets[a] | sets[b]):
                group[top(a)] = top(b)
    names = {}
    for d, t in rows:
        if t in group and d is not None:
            names[top(t)] = min(d, names.get(top(t), d))
    return {(d, t): names.get(top(t)) if t in group else d for d, t in rows}


def family(seed, copies, words, edits, start):
    """A text and copies of it, each with some words changed."""
    draw = random.Random(seed)
    base = [f"{draw.choice('abcdefg')}{draw.randint(0, 400)}" for _ in range(words)]
    rows = []
    for i in range(copies):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(words)] = f"{draw.choice('xyz')}{draw.randint(0, 5)}"
        rows.append((start + i, " ".join(own)))
    return rows


def test_sets_match_brute_force():
    texts = ["A b c d e f", "a B", "", None, " \n", "É x y z w É x y z w É", "q " * 9000]
    for text, found in zip(texts, shingle_sets([None if t is None else t.encode() for t in texts])):
        assert len(found) == len(shingles(text))
    same = shingle_sets([b"A b c d e f", b"a B\tC d e F"])
    assert (same[0] == same[1]).all()


def test_signatures_estimate_similarity():
    items = np.arange(3000, dtype=np.uint64)
    hasher = MinHasher(128)
    a, b = hasher.signature(items[:2000]), hasher.signature(items[400:])
    assert abs((a == b).mean() - 1600 / 3000) < 0.13


def test_bayesian_bound_keeps_what_is_similar():
    draw = np.random.default_rng(1)
    least = [(n, least_matches(n)) for n in range(16, 129, 16)]
    assert all(a[1] < b[1] for a, b in zip(least, least[1:])) and least[-1][1] > 60
    for _ in range(2000):
        equal = draw.random(128) < 0.75
        assert all(equal[:n].sum() >= m for n, m in least)


@pytest.mark.parametrize("edits", [3, 8, 20])
def test_groups_match_brute_force(llm, make_docs, edits):
    rows = family(edits, 90, 80, edits, 100) + family(edits + 1, 40, 30, 3, 500)
    rows += [(900 + i, t) for i, (_, t) in enumerate(rows[:25])] + [(1000, "a b"), (1001, "A  B")]
    found = find_groups(make_docs(rows)).collect()
    expected = brute(rows)
    assert {r["doc_id"]: r["component_id"] for r in found} == {d: c for (d, _), c in expected.items()}


def test_scarce_and_frequent_pairs_match_brute_force(llm, make_docs, monkeypatch):
    """With few shingles listed one by one, the frequent bound must find the same groups."""
    rows = family(5, 80, 60, 9, 0)
    expected = {d: c for (d, _), c in brute(rows).items()}
    every = near_dedup.scarce_shingles
    for most in (1, 3, 1000):
        monkeypatch.setattr(near_dedup, "scarce_shingles", lambda sets, m=most: every(sets, m))
        found = {r["doc_id"]: r["component_id"] for r in find_groups(make_docs(rows)).collect()}
        assert found == expected


def test_repeated_rows_are_compared_once(llm, make_docs, monkeypatch):
    """Two texts, each as many equal rows: one set each, one pair."""
    (_, one), (_, other) = family(4, 2, 80, 1, 0)
    assert one != other
    text = " ".join(f"u{i}" for i in range(40))
    rows = [(1, one)] * 60 + [(2, other)] * 60 + [(3, text)] * 5 + [(2, text), (4, one), (4, other)]
    seen = []
    every = near_dedup.confirmed

    def counted(pairs, sets, percent=75):
        names = [r["node"] for r in sets.select("node").collect()]
        assert len(names) == len(set(names))
        seen.append(pairs.count())
        return every(pairs, sets, percent)

    monkeypatch.setattr(near_dedup, "confirmed", counted)
    found = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in find_groups(make_docs(rows)).collect()}
    assert found[(1, 76)] == found[(2, 76)] == found[(4, 76)] == 1
    assert found[(3, 36)] == found[(2, 36)] == 2
    assert sum(seen) == 1


def test_groups_of_the_given_documents(llm, sf_dir):
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = {d: c for (d, _), c in brute(rows).items()}
    assert {r["doc_id"]: r["component_id"] for r in find_groups(docs).collect()} == expected


def test_odd_rows(odd, none):
    found = [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in find_groups(odd).collect()]
    assert found.count((5, 9, 5, True)) == 2
    assert (6, 9, 5, False) in found and (None, 9, 5, False) in found
    assert (1, 0, 1, True) in found and (None, 0, None, True) in found and (4, 1, 4, True) in found
    assert find_groups(none).collect() == []


def test_one_of_each_group_stays(odd, none):
    kept = keep_one(odd)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == odd.columns
    assert sorted(i for i in ids if i is not None) == [1, 2, 3, 4, 5, 7, 8] and ids.count(None) == 1
    assert keep_one(none).collect() == []


def test_components_of_a_long_chain(llm):
    links = llm.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 400)], "a long, b long")
    found = {r["id"]: r["component"] for r in components(links).collect()}
    assert {found[i] for i in range(301)} == {0} and found[500] == found[400] == 400
