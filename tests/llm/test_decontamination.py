import random

import numpy as np

from loopwright.llm import decontamination
from loopwright.llm.decontamination import (
    Items,
    align,
    drop_leaks,
    find_leaks,
    item_blocks,
    pair_counts,
)

ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def brute(passage, item):
    table, best = np.zeros((len(item) + 1, len(passage) + 1), int), 0
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            same = 1 if item[i - 1] == passage[j - 1] else -1
            table[i, j] = max(0, table[i - 1, j - 1] + same, table[i - 1, j] - 1, table[i, j - 1] - 1)
            best = max(best, table[i, j])
    return best


def test_alignment_matches_brute_force():
    draw = random.Random(3)
    for _ in range(500):
        p = np.array([draw.randint(0, 4) for _ in range(draw.randint(1, 25))])
        q = np.array([draw.randint(1, 4) for _ in range(draw.randint(1, 12))])
        score, start, end = align(p, q)
        assert score == brute(p, q) and (not score or brute(p[start:end], q) == score)


def items(llm, rows):
    return llm.createDataFrame(rows, "item_id long, text string, doc_id string")


def leaks(llm, docs, rows=((1, ITEM, None),)):
    return {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, items(llm, list(rows))).collect()}


def test_exact_edited_and_clean(llm, make_docs):
    edited = ITEM.replace("epsilon", "other").replace("theta iota", "theta extra iota").upper()
    docs = make_docs([
        (1, f"before {ITEM} after"), (2, f"x, {edited}!"), (3, "alpha beta gamma delta and no more"),
        (4, "clean words only"), (5, "kappa " + ITEM[:40]),
    ])
    found = leaks(llm, docs)
    assert set(found) == {(1, 1), (2, 1)}
    assert (found[(1, 1)]["start_word"], found[(1, 1)]["end_word"], found[(1, 1)]["score"]) == (1, 13, 12)
    assert [r["doc_id"] for r in drop_leaks(docs, items(llm, [(1, ITEM, None)])).orderBy("doc_id").collect()] == [3, 4, 5]


def test_an_item_in_most_documents_is_still_found(llm, make_docs):
    docs = make_docs([(i, f"n{i} {ITEM} m{i}") for i in range(400)] + [(900, "other text")])
    assert len(leaks(llm, docs)) == 400


def test_pairs_are_counted_over_all_documents(llm, make_docs, none):
    block = Items([(1, ITEM), (2, "mu alpha beta gamma")])
    number = block.vocabulary
    pair = lambda a, b: number[a] * (len(number) + 1) + number[b]
    docs = make_docs([(i, f"n{i} alpha beta") for i in range(60)] + [(60, "alpha beta mu alpha beta"),
                     (61, None), (62, ""), (60, "alpha beta mu alpha beta")])
    wanted = {pair("alpha", "beta"): 64, pair("mu", "alpha"): 2}
    assert pair_counts(docs, block) == wanted and pair_counts(none, block) == {}


def edits(draw, words, spare):
    """The words with about one in five replaced, left out or preceded by another."""
    out = []
    for word in words:
        kind = draw.choice("=" * 12 + "s-+")
        out += [spare()] * (kind in "s+") + [word] * (kind in "=+")
    return out


def test_edited_copies_match_brute_force(llm, make_docs):
    """Edited copies alone, and beside exact ones: found as often as alignment with all finds them."""
    draw = random.Random(8)
    spare = lambda: draw.choice("of the and other alpha kappa".split())
    for exact in (0, 1, 3):
        pool = [f"t{n}" for n in range(40)]
        lists = [(1, ITEM)] + [(i, " ".join(draw.choices(pool, k=10 + i))) for i in range(2, 9)]
        texts = [t for _, t in lists for _ in range(exact)]
        texts += [" ".join(edits(draw, t.split(), spare)) for _, t in lists for _ in range(12)]
        texts += ["alpha beta x gamma delta x epsilon zeta x eta theta x iota kappa x lambda mu"]
        texts += ["alpha beta gamma x epsilon zeta eta x iota kappa lambda mu"]
        docs = [(i, f"so {t} it") for i, t in enumerate(texts)]
        number = {}
        code = lambda t: [number.setdefault(w, len(number) + 1) for w in t.split()]
        wanted = {}
        for i, t in docs:
            for j, q in lists:
                score, size = brute(code(t), code(q)), len(q.split())
                if score >= max(size / 2, min(8, size)):
                    wanted[(i, j)] = score
        found = leaks(llm, make_docs(docs), [(j, q, None) for j, q in lists])
        assert {k: r["score"] for k, r in found.items()} == wanted and len(wanted) > 20


def test_odd_rows_and_items(llm, odd, none, monkeypatch):
    rows = [(None, ITEM, None), (1, None, None), (2, "", None), (3, "one two three", None),
            (4, "the quick brown fox jumps over the lazy dog", None), (4, "a b c d", None)]
    found = leaks(llm, odd, rows)
    assert set(found) == {(5, 4), (6, 4), (None, 4)}
    assert leaks(llm, none) == {} and leaks(llm, odd, []) == {}
    kept = drop_leaks(odd, items(llm, rows))
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    # Blocks of items give the same answer as one.
    assert len(list(item_blocks(items(llm, rows), limit=1))) > 3
    blocks = decontamination.item_blocks
    monkeypatch.setattr(decontamination, "item_blocks", lambda b: blocks(b, limit=1))
    assert set(leaks(llm, odd, rows)) == set(found)


def test_query_matches_exact_search(llm, sf_dir):
    from loopwright.llm.decontamination import words_of
    from loopwright.llm.queries import QUERIES

    found = {(r["doc_id"], r["item_id"]) for r in QUERIES["op1_seed_align_decontamination"](llm, sf_dir).collect()}
    docs = llm.read.parquet(f"{sf_dir}/documents.parquet").collect()
    tests = llm.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    exact = {
        (d["doc_id"], t["item_id"]) for d in docs for t in tests
        if f" {' '.join(words_of(t['text']))} " in f" {' '.join(words_of(d['text']))} "
    }
    assert exact and exact <= found


def test_null_ids_and_texts_of_one_id(llm, make_docs):
    other = "one question that is asked here with an answer"
    docs = make_docs([(1, f"x {ITEM} y"), (2, f"so {other}"), (3, "clean words only")])
    assert set(leaks(llm, docs, [(None, ITEM, None), (7, ITEM, None), (7, other, None)])) == {
        (1, None), (1, 7), (2, 7)
    }
