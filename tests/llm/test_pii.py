import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loopwright.llm.crf import ChainModel
from loopwright.llm.pii import (
    CLEAN,
    FORMS,
    KINDS,
    Field,
    base_spans,
    filled,
    find_personal_data,
    labelled_texts,
    luhn,
    placed,
    redact,
    redacted,
    spans_of,
    trained,
    word_features,
)

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    found = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            found.append((kind, *m.span()))
    return found


def test_patterns_match_brute_force():
    draw = random.Random(1)
    for _ in range(20_000):
        text = "".join(draw.choice("aB1234.@+- ()_%é,0") for _ in range(draw.randint(0, 40)))
        assert base_spans(text) == brute(text), repr(text)
    text = "x@y.z,4111 1111-1111 1111 +49 (30) 123456 1.2.3.4 a@b.c.d_e@f.g"
    assert base_spans(text) == brute(text) and len(base_spans(text)) == 6


def test_hostile_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "a@" * 50_000, "+1" * 50_000):
        base_spans(text)


def small_model(seed):
    draw = np.random.default_rng(seed)
    return ChainModel(draw.normal(size=(20, 3)), draw.normal(size=(3, 3)))


def plain_viterbi(emit, pairs):
    """The best labels of one sequence, label 0 before and after it."""
    best, back = emit[0] + pairs[0], []
    for e in emit[1:]:
        scores = best[:, None] + pairs
        back.append(scores.argmax(axis=0))
        best = scores.max(axis=0) + e
    path = [int((best + pairs[:, 0]).argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


def test_viterbi_matches_brute_force():
    draw = random.Random(5)
    for seed in range(30):
        model = small_model(seed)
        sequences = [
            [[draw.randrange(20) for _ in range(2)] for _ in range(draw.randint(1, 5))] for _ in range(7)
        ]
        emits = [np.array([model.weights[f].sum(axis=0) for f in s]) for s in sequences]
        paths = model.best_paths(np.concatenate(emits), [len(e) for e in emits])
        for emit, path in zip(emits, paths):

            def value(p, emit=emit, model=model):
                steps = sum(model.pairs[a, b] for a, b in zip((0, *p), (*p, 0)))
                return steps + sum(e[k] for e, k in zip(emit, p))

            best = max(itertools.product(range(3), repeat=len(emit)), key=value)
            assert abs(value(tuple(path.tolist())) - value(best)) < 1e-9
            assert plain_viterbi(emit, model.pairs) == path.tolist()


def test_training_climbs_to_the_empirical_counts():
    """At the optimum without penalty, expected label counts equal those of the data."""
    features, labels = [[[1], [2]], [[1], [1]], [[2]]] * 5, [[0, 1], [0, 0], [1]] * 5
    model = ChainModel.train(features, labels, np.ones((2, 2), bool), 4, steps=400, penalty=0.0)
    for sequence, marks in zip(features, labels):
        emit = np.array([model.weights[f].sum(axis=0) for f in sequence])
        assert plain_viterbi(emit, model.pairs) == marks


@pytest.fixture(scope="module")
def field():
    return Field(*trained())


# Carriers that the labelled table does not have.
HELD_OUT = [
    "%w %w %w {} and %w %w", "ask %w: {} or %w", "%w; {} %w %w %w", "if you %w then {} will %w",
    "see {} please", "%w %w %w %w {}. %w %w",
]


@pytest.mark.parametrize("kind,form", [(k, f) for k, forms in FORMS.items() for f in forms])
def test_held_out_recall_of_each_form(field, kind, form):
    draw, found, spelled = random.Random(99), 0, 60
    for _ in range(spelled):
        text, (span,) = placed(kind, form, draw.choice(HELD_OUT), draw)
        base, whole = spans_of([text], field)[0]
        found += span in whole or any(a < span[2] and b > span[1] for _, a, b in base)
    assert found >= 0.9 * spelled


def test_held_out_precision(field):
    draw = random.Random(7)
    lines = [filled(line, draw) for line in CLEAN for _ in range(30)]
    wrong = sum(base != whole for base, whole in spans_of(lines, field))
    assert wrong <= 0.02 * len(lines)
    for text in (
        "On 2021-03-04 at 10:15 we sold 1,250 units of version 2.4.1 for $3.50.", "nothing here",
        "we stood at dot and at the dot in it", "write (at) once", "10 at 20 dot 30", "",
    ):
        base, whole = spans_of([text], field)[0]
        assert base == whole, text


def test_documents_keep_clean(field, llm, sf_dir):
    """The field adds nothing to texts without such spans."""
    texts = [r[0] for r in llm.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    assert all(base == whole for base, whole in spans_of(texts, field))


def full_labels(field, words):
    """Viterbi over all words of a text from the named features, without any skipping."""
    if not words:
        return []
    weights, known = field.model.weights, field.vocabulary
    emit = np.array([weights[[known[f] for f in fs if f in known]].sum(axis=0) for fs in word_features(words)])
    return [(i, k) for i, k in enumerate(plain_viterbi(emit, field.model.pairs)) if k]


def test_skipping_is_exact(field):
    """Provable zeros and separate stretches give the labels of the whole text."""
    draw = random.Random(9)
    pool = [w for text, _ in labelled_texts(5) for w in text.split()] + ["été", "Ω7", "x²", "(", "日本"]
    texts = [draw.choices(pool, k=draw.randint(0, 60)) for _ in range(400)]
    texts += [placed(k, f, "%w %w {} %w", draw)[0].split() for k, fs in FORMS.items() for f in fs]
    keeper = Field(*trained())
    keeper.KEPT, keeper.TOGETHER = 150, 700
    found = list(keeper.labelled(texts))
    assert found == [full_labels(field, t) for t in texts]
    assert sum(map(bool, found)) > 40


def test_skipping_is_exact_for_any_weights():
    for seed in range(40):
        draw = np.random.default_rng(seed)
        model, vocabulary = trained()
        noise = draw.normal(size=model.weights.shape) * draw.choice([0.3, 2.0])
        noise[0] = 0  # stands for features that the model does not have
        steps = np.where(model.pairs < -1e5, model.pairs, draw.normal(size=model.pairs.shape) * 2)
        field = Field(ChainModel(model.weights * 0.2 + noise, steps), vocabulary)
        words = random.Random(seed).choices("call 555-1234 at x dot com (at) 1.2.3 foo Bar".split(), k=50)
        assert list(field.labelled([words, [], words[:3]])) == [
            full_labels(field, words), [], full_labels(field, words[:3]),
        ]


def test_unseen_names_far_from_digits(field):
    far = "some words before it, " * 5 + "contact jon (at) quuxly (dot) com before monday"
    start = far.index("jon")
    assert spans_of([far], field)[0][1] == [(0, start, start + len("jon (at) quuxly (dot) com"))]
    found = spans_of(["please mail tom7 (at) host9.example.net or call (415) 555-2671 now"], field)[0][1]
    assert {KINDS[k] for k, *_ in found} == {"email", "phone"}


def test_odd_rows(odd, none, llm, make_docs):
    rows = find_personal_data(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() for r in rows if r["doc_id"] == 1)
    assert find_personal_data(none).collect() == []
    text = "é \U0001f600 mail x@y.z and 4111111111111111"
    (row,) = find_personal_data(make_docs([(1, text)])).collect()
    listed = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in brute(text))
    assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (1, 0, 1, 0)
    assert row["spans"].startswith("email:9:14,card:")


def test_redaction(odd, make_docs):
    assert redacted("a x@y.z b", [(0, 2, 7), (3, 4, 9)]) == "a <EMAIL>"
    docs = make_docs([(1, "write x@y.zz please"), (2, "clean text")])
    rows = {r["doc_id"]: r for r in redact(docs).collect()}
    assert rows[1]["text"] == "write <EMAIL> please" and rows[1]["n_chars"] == 20
    assert rows[2]["text"] == "clean text" and redact(odd).columns == odd.columns
    assert redact(odd).exceptAll(odd).count() == 0
