import random

import numpy as np
from pyspark.sql import functions as F

from loopwright.llm import lm_scoring
from loopwright.llm.lm_scoring import (
    CELLS,
    FREQUENT,
    NUMBERS,
    PAD,
    Scorer,
    Trainer,
    Vocabulary,
    contexts,
    first_weights,
    frequent_words,
    number_of,
    rare_shares,
    score,
    train,
    train_and_score,
    trained_round,
    word_counts,
)
from loopwright.llm.shingles import word_hashes


def test_contexts_stop_at_the_ends():
    found = contexts(np.array([1, 2, 3, 9]), np.array([3, 0, 1]))
    assert found.tolist() == [
        [PAD, PAD, 1, 2, 3], [PAD, 1, 2, 3, PAD], [1, 2, 3, PAD, PAD], [PAD, PAD, 9, PAD, PAD],
    ]


def test_probabilities_add_up_to_one():
    scorer = Scorer(first_weights())
    windows = np.array([[1, 2, t, 3, 4] for t in range(NUMBERS)])
    assert abs(np.exp(scorer._logs(windows)).sum() - 1) < 1e-4


def test_sums_match_one_by_one():
    scorer, draw = Scorer(first_weights()), np.random.default_rng(1)
    counts = np.array([5, 0, 1, 40])
    ids = draw.integers(0, NUMBERS, counts.sum())
    sums, at = scorer.sums(ids, counts), 0
    for total, n in zip(sums, counts):
        own = contexts(ids[at : at + n], np.array([n]))
        assert abs(total - sum(scorer._logs(own[i : i + 1])[0] for i in range(n))) < 1e-3
        at += n


def test_gradients_match_differences():
    weights = first_weights()
    windows = np.random.default_rng(2).integers(0, NUMBERS, (6, 5))
    trainer = Trainer(weights)
    before = {k: v.copy() for k, v in trainer.w.items()}
    trainer.step(windows)
    loss = lambda w: -float(Scorer(w)._logs(windows).mean())
    assert loss(trainer.w) < loss(before)


def test_training_learns_both_sides(llm, make_docs):
    """The middle word depends on its right neighbour; the model must find that out."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(300):
        pairs = [("red", "apple") if b else ("blue", "sky") for b in draw.integers(0, 2, 60)]
        rows.append((i, " ".join(f"{a} {b}" for a, b in pairs)))
    broken = [(1000 + i, " ".join(["red sky blue apple"] * 30)) for i in range(5)]
    scored = score(make_docs(rows + broken), *train(make_docs(rows)))
    found = {r["doc_id"]: r["mean_log_prob"] for r in scored.collect()}
    assert min(found[i] for i in range(300)) > max(found[1000 + i] for i in range(5)) + 0.5


def test_frequent_words_are_counted_over_all_rows(llm, make_docs):
    docs = make_docs([(i, "often Often rare" if i % 9 else "often x") for i in range(90)])
    hashes = word_hashes([b"often rare x"])[0].view(np.int64)
    counts = word_counts(docs)
    assert frequent_words(counts)[:3] == hashes.tolist()
    assert {r["word"]: r["n"] for r in counts.collect()} == dict(zip(hashes.tolist(), (170, 80, 10)))
    assert Vocabulary(hashes.tolist()).ids(hashes.view(np.uint64)).tolist() == [0, 1, 2]


def test_every_place_is_trained_on_once(llm, make_docs, monkeypatch):
    """All windows of all documents reach a trainer, whatever the rounds and partitions."""
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("abcdefgh") * 3 for _ in range(draw.randint(0, 40)))) for i in range(200)]
    docs = make_docs(rows).repartition(5)
    vocabulary = Vocabulary(frequent_words(word_counts(docs)))
    seen = llm.sparkContext.accumulator(0)

    class Counting(Trainer):
        def step(self, windows):
            seen.add(len(windows))
            return super().step(windows)

    monkeypatch.setattr(lm_scoring, "Trainer", Counting)
    weights = first_weights()
    for part in range(3):
        own = docs.filter(F.pmod(F.xxhash64("text"), F.lit(3)) == part)
        weights = trained_round(own, vocabulary, weights, 100)
    assert seen.value == sum(len(t.split()) for _, t in rows)


def test_rare_words_have_chances_of_their_own(llm, make_docs):
    """Chances inside a shared number add up to one and follow the counts."""
    rows = [(i, "common words here " * 5 + f"rare{i % 50} " * (1 + i % 50) + "twice twice") for i in range(400)]
    docs = make_docs(rows)
    counts = word_counts(docs)
    frequent = frequent_words(counts, 5)
    shares = np.exp(rare_shares(counts, frequent).astype(np.float64))
    numbers = number_of(np.arange(CELLS))
    totals = np.bincount(numbers, weights=shares, minlength=NUMBERS)
    assert abs(totals[FREQUENT:] - 1).max() < 1e-3 and totals[:FREQUENT].sum() == 0
    vocabulary = Vocabulary(frequent, rare_shares(counts, frequent))
    hashes = word_hashes([b"common rare49 rare0"])[0]
    own, often, seldom = vocabulary.inside(hashes)
    assert own == 0 and often > seldom
    junk = [(9000, "common words here zzqxv wqrty plmkt"), (9001, "common words here rare49 rare48 twice")]
    scored = score(make_docs(junk), vocabulary, first_weights()).collect()
    found = {r["doc_id"]: r["log_likelihood"] for r in scored}
    assert found[9001] > found[9000] + 5


def test_odd_rows(odd, none):
    rows = train_and_score(odd).collect()
    assert len(rows) == odd.count()
    blank = [r for r in rows if r["doc_id"] in (1, 2, 3)]
    assert all(r["n_tokens"] == 0 and r["log_likelihood"] == 0 and r["mean_log_prob"] is None for r in blank)
    assert len({r["log_likelihood"] for r in rows if r["doc_id"] == 5}) == 1
    assert train_and_score(none).collect() == []
    assert score(odd, Vocabulary([]), first_weights()).count() == odd.count()


def test_steps_reuse_their_memory_and_small_steps_after_large_ones_are_right():
    draw = np.random.default_rng(4)
    large, small = (draw.integers(0, lm_scoring.NUMBERS, (n, 5)).astype(np.int16) for n in (3000, 70))
    used, fresh = (lm_scoring.Trainer(lm_scoring.first_weights()) for _ in range(2))
    used.step(large)
    before = {k: id(v) for k, v in used.room.held.items()}
    used.step(large[:1000])
    assert before and {k: id(v) for k, v in used.room.held.items()} == before
    used.w = {k: v.copy() for k, v in fresh.w.items()}
    used.seen = {k: v.copy() for k, v in fresh.seen.items()}
    assert used.step(small) == fresh.step(small)
    assert all((used.w[k] == fresh.w[k]).all() for k in fresh.w)
    ids, counts = large[:, 2], np.array([0, 2900, 1, 99])
    scorer = lm_scoring.Scorer(used.w)
    whole = scorer.sums(ids, counts)
    assert np.allclose(scorer.sums(ids[2901:], counts[3:]), whole[3:])
