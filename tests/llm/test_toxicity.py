import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loopwright.llm.toxicity import (
    SentenceModel,
    finder,
    held_out,
    score,
    sentences,
    train_and_score,
    training_sample,
)


def corpus(count, seed):
    """Documents of invented words; toxic ones hold a bad word in one of their sentences."""
    draw = random.Random(seed)
    texts, labels = [], []
    for _ in range(count):
        lines = [" ".join(f"{draw.choice('abcdef')}o{draw.choice('klmn')}a{draw.choice('rst')}"
                          for _ in range(8)) for _ in range(draw.randint(2, 9))]
        toxic = draw.random() < 0.3
        if toxic:
            lines[draw.randrange(len(lines))] += f" {draw.choice(['vileword', 'vilething', 'nastiest'])}"
        texts.append(". ".join(lines))
        labels.append(int(toxic))
    return texts, labels


@pytest.fixture(scope="module")
def model():
    return SentenceModel.train(*corpus(400, 1))


def test_held_out_documents_and_sentences(model, make_docs):
    texts, labels = corpus(200, 2)
    rows = score(make_docs(list(enumerate(texts))), model).collect()
    wrong = [r for r in rows if r["predicted"] != labels[r["doc_id"]]]
    assert len(wrong) <= 6
    for r in rows:
        if r["predicted"] and labels[r["doc_id"]]:
            spans = [tuple(map(float, s.split(":"))) for s in r["offending"].split(",")]
            text = texts[r["doc_id"]]
            assert any(w in text[int(a) : int(b)] for a, b, _ in spans for w in ("vile", "nasti"))


def test_noisy_or_matches_brute_force(model, make_docs):
    text = "Fine words here. a vileword there!\nAnd more"
    own = [model.bias + sum(model.value(w) for w in s) for s in sentences(text)]
    expected = 1 - np.prod([1 - 1 / (1 + np.exp(-z)) for z in own])
    (row,) = score(make_docs([(1, text)]), model).collect()
    assert abs(row["score"] - expected) < 1e-5


def test_automaton_adds_up_the_words_values(model):
    draw = random.Random(4)
    weights = {"<ab>": 1.5, "ab>": 0.25, "aba": -0.5, "bab": 2.0, "abab": 0.125, "zzz": 9.0, "<éa": 3.0}
    small, values = SentenceModel(weights, 0.0), finder(weights)
    for _ in range(500):
        words = ["".join(draw.choice("abzé") for _ in range(draw.randint(1, 9))) for _ in range(draw.randint(1, 6))]
        plain = sum(w for word in words for g, w in weights.items() if g in f"<{word}>")
        assert abs(values(words) - plain) < 1e-9 and abs(sum(map(small.value, words)) - plain) < 1e-9
    trained = finder(model.weights)
    words = "a vileword there nastiest nastiest".split()
    assert abs(trained(words) - sum(map(model.value, words))) < 1e-9
    assert finder({})(["x"]) == 0.0


def test_labels_of_held_out_rows_are_not_learnt(llm, make_docs):
    docs = make_docs([(i, f"text {i}") for i in range(40)])
    labels = llm.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    texts, marks, _ = training_sample(docs, labels)
    out = {r["doc_id"] for r in docs.filter(held_out()).collect()}
    assert out and {int(t.split()[1]) for t in texts} == set(range(40)) - out
    assert all(m == int(t.split()[1]) % 2 for t, m in zip(texts, marks))


def test_odd_rows(llm, model, odd, none):
    rows = score(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r["doc_id"]: r["score"] for r in rows}[1] == 0.0
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert score(none, model).collect() == []


def test_no_labels_say_the_base_rate(llm, odd):
    labels = llm.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in train_and_score(odd, labels).collect()} == {0}
    labels = odd.select("doc_id", F.lit(0).alias("toxic"))
    assert {r["predicted"] for r in train_and_score(odd, labels).collect()} == {0}
