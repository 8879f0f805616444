import collections
import re

from pyspark.sql import functions as F

from loopwright.llm.quality_rules import (
    LENT,
    PARTS,
    keep_good,
    judge,
    leaning,
    merged,
    quantiles,
    repeated_words,
    sketches,
    text_counts,
    Rule,
    with_counts,
)

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text)
    windows = collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {
        j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)
    }
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(covered),
    )


def test_counts_match_brute_force():
    import random

    draw = random.Random(3)
    for _ in range(600):
        text = "".join(draw.choice("ab é#|\n \t 日") for _ in range(draw.randint(0, 160)))
        assert text_counts(text.encode(), len(text))[:5] == brute(text), repr(text)


def test_repeats_in_long_text():
    words = [b"a", b"b", b"c"] * 4000
    assert repeated_words(words) == 12000


def counted_rows(llm, count=4000):
    """Rows whose ratio runs evenly from 0.1 to 40, in groups x (a third) and y."""
    zero = [F.lit(0).alias(c) for c in ("n_repeat_words",)]
    return llm.range(1, count + 1).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("g"),
        F.struct((F.col("id") * 100).alias("n_words"), F.lit(10_000).alias("n_lines"), *zero).alias("s"),
    )


EVEN = Rule("r", "n_words", "n_lines", 0.9, 1, 1)


def test_sketch_quantiles_merge_and_are_close(llm):
    sketch = sketches(counted_rows(llm), "s", ["g"], [EVEN])
    wanted = {"q1": 0.25, "q2": 0.5, "q3": 0.75, "last": 0.99}
    (whole,) = quantiles(merged(sketch, []), [], wanted).collect()
    assert whole["total"] == 4000
    for name, q in wanted.items():
        assert abs(whole[name] / (40 * q) - 1) < 0.02
    assert quantiles(merged(sketch, ["g"]), ["g"], wanted).count() == 2


def test_small_groups_lean_on_the_sketch_above(llm):
    """A group's quantiles are those of its values and of LENT values of the whole, at any size."""
    rows = counted_rows(llm).filter("g = 'y' OR s.n_words % 30000 = 0")
    sketch = sketches(rows, "s", ["g"], [EVEN])
    found = leaning(sketch, merged(sketch, []), ["g"], [])
    half = {r["g"]: r for r in quantiles(found, ["g"], {"half": 0.5}).collect()}
    values = [(r["g"], r["s"]["n_words"] / 10_000) for r in rows.collect()]
    for g in "xy":
        own = sorted(v for k, v in values if k == g)
        weighted = sorted([(v, 1.0) for v in own] + [(v, LENT / len(values)) for _, v in values])
        total, up_to = sum(w for _, w in weighted), 0.0
        for value, weight in weighted:
            up_to += weight
            if up_to >= total / 2:
                break
        assert abs(half[g]["half"] / value - 1) < 0.03
        assert abs(half[g]["total"] / PARTS - len(own) - LENT) < 1


def test_sources_have_fences_of_their_own(make_docs):
    """The same text is kept among its like and dropped where all others differ."""
    def texts(first, count, source, length):
        words = lambda i: " ".join(f"{'x' * length(i)}{k}" for k in range(60))
        return [(first + i, words(i), "en", source, 1) for i in range(count)]

    rows = texts(0, 900, "long", lambda i: 8 + i % 12) + texts(5000, 900, "short", lambda i: 3 + i % 2)
    text = " ".join(f"{'q' * 24}{k}" for k in range(60))
    rows += [(9001, text, "en", "long", 1), (9002, text, "en", "short", 1)]
    kept = {r["doc_id"] for r in keep_good(make_docs(rows)).select("doc_id").collect()}
    assert 9001 in kept and 9002 not in kept and len(kept) == 1801


def junk_and_prose(make_docs):
    prose = [
        (i, " ".join(f"word{(i * 7 + k * k) % 513} of" for k in range(40)), "en", f"s{i % 2}", 1)
        for i in range(600)
    ]
    junk = [(1000 + i, " ".join(f"### {k}$$$%%%&&&" for k in range(40)), "en", "s0", 1) for i in range(60)]
    return make_docs(prose + junk)


def test_outliers_go_and_the_rest_stays(make_docs):
    kept = {r["doc_id"] for r in keep_good(junk_and_prose(make_docs)).select("doc_id").collect()}
    assert kept == set(range(600))


def test_odd_rows_keep_their_columns(odd, none):
    judged, stats = judge(odd)
    rows = judged.collect()
    assert len(rows) == odd.count() and stats == "_rule_counts_"
    verdicts = {(r["doc_id"], r["text"], r["lang"]): r[stats] for r in rows}
    assert verdicts[(1, None, "en")].base_failed and not verdicts[(1, None, "en")].kept
    assert keep_good(odd).columns == odd.columns
    assert keep_good(none).collect() == []


def test_text_can_be_left_out(odd):
    assert "text" not in with_counts(odd, "c", keep_text=False).columns
