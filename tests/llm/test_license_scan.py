import random
import re

import pytest

from loopwright.llm.license_scan import PHRASES, TEMPLATES, Phrases, Templates, scan_licenses, words_of

GRANT = TEMPLATES[0][1]


def plain_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute(text, templates, phrases, containment):
    """Every window against every template, and every place against every phrase."""
    words = plain_words(text)
    base = [
        (i, label)
        for phrase, label in phrases.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    found = []
    for label, template in templates:
        wanted = plain_words(template)
        half = 1
        while half < len(wanted):
            half *= 2
        for at in range(0, max(1, len(words)), half):
            block = set(words[at : at + 2 * half])
            share = len(block & set(wanted)) / max(1, len(set(wanted)))
            if wanted and share >= containment - 1e-12:
                found.append((at, min(at + 2 * half, len(words)) - 1, label, round(share, 9)))
    labels = {label for _, label in base}
    best = max([f[3] for f in found], default=0.0)
    return (
        len(words), len(base),
        min(base)[0] if base else None, max(base)[0] if base else None,
        ",".join(sorted(labels)), ",".join(sorted(labels | {f[2] for f in found})),
        1.0 if base else best, sorted(found),
    )


def by_doc(rows):
    out = []
    for r in rows:
        found = [(f["first_word"], f["last_word"], f["label"], round(f["containment"], 9)) for f in r["found"]]
        out.append((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"],
                    r["base_labels"], r["labels"], round(r["score"], 9), sorted(found)))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def compare(make_docs, rows, templates=tuple(TEMPLATES), containment=0.9):
    docs = make_docs([(d, t, "en", "s", 0) for d, t in rows])
    found = by_doc(scan_licenses(docs, templates, PHRASES, containment).collect())
    wanted = [(d, *brute(t, templates, PHRASES, containment)) for d, t in rows]
    wanted = [(*w[:7], round(w[7], 9), w[8]) for w in wanted]
    assert found == sorted(wanted, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    return {f[0]: f for f in found}


def test_notices_in_prose(make_docs, odd):
    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(["the", "of", "software", "permission", "lorem", "ipsum", "copy"]) for _ in range(n))
    edited = GRANT.replace("merge, ", "").replace("charge", "cost")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rows += [
        (20, prose(300) + "\n" + GRANT + "\n" + prose(200)),
        (21, " ".join([prose(77), edited, prose(13)])),
        (22, " ".join(plain_words(GRANT)[::2])),
        (23, "Licensed under CC BY-NC 4.0."),
        (24, "Licensed under the GNU License, Version 2.0"),
        (25, "MIT\nLicense; the mit LICENSE and the Apache--License. GNU General Public License"),
        (26, "mit licenses, smit license, mit 1 license, Mİt license, mité license"),
        (27, "license public general mit"),
        (28, " ".join([prose(50), TEMPLATES[3][1], prose(50), TEMPLATES[2][1]])),
        (29, "license mit license mit license"),
    ]
    found = compare(make_docs, rows)
    assert found[20][6] == found[21][6] == "mit" and found[22][6] == ""
    assert found[23][6] == "cc" and found[24][6] == ""
    assert found[25][2:7] == (4, 0, 10, "apache,gpl,mit", "apache,gpl,mit")
    assert found[28][6] == "bsd,isc"
    assert found[29][2:5] == (2, 1, 3)


@pytest.mark.parametrize("containment", [0.3, 0.5, 0.75, 1.0])
def test_random_templates_at_any_threshold(make_docs, containment):
    draw = random.Random(int(containment * 100))
    letters = "abcdefghijklmnop"
    some = lambda n: " ".join(draw.choice(letters) for _ in range(n))
    templates = [(f"t{k}", some(draw.randint(1, 14))) for k in range(12)] + [("none", "...")]
    rows = [(k, some(draw.randint(0, 60)) + " " + draw.choice(templates)[1]) for k in range(60)]
    found = compare(make_docs, rows, templates, containment)
    assert any(f[8] for f in found.values())


def test_order_is_by_document_counts_and_prefixes_follow_it():
    known = Templates([("x", "a b c d")], 0.5)
    places = known.order({0: 9, 1: 1, 2: 5, 3: 1})
    assert places == [3, 0, 2, 1] and known.prefixes(places) == [[0, 1, 2]]


def test_each_notice_is_found_and_others_are_not(make_docs):
    rows = [(k, text) for k, (_, text) in enumerate(TEMPLATES)]
    found = compare(make_docs, rows)
    for k, (label, _) in enumerate(TEMPLATES):
        assert found[k][6] == label


def test_phrases_overlap_and_words_are_bytes():
    both = Phrases({"a b a": "x", "a": "y"})
    assert sorted(both.places(words_of("A b a b A"))) == [(0, "x"), (0, "y"), (2, "x"), (2, "y"), (4, "y")]


def test_empty_table_and_no_template(make_docs, none):
    assert scan_licenses(none).collect() == []
    compare(make_docs, [(1, "mit license"), (2, "x")], templates=())
