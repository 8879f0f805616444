import pytest
from pyspark.sql import functions as F

from loopwright.llm.common import session

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = "score kept shard slot _rule_counts n_words component node item band _masked draw target".split()


@pytest.fixture(scope="session")
def llm(spark):
    return session(spark)


@pytest.fixture(scope="session")
def make_docs(llm):
    """Documents from (doc_id, text) or fuller rows, with columns that clash with inner names."""

    def make(rows):
        full = [(*r, *("en", "s", len(r[1] or ""))[len(r) - 2 :]) for r in rows]
        df = llm.createDataFrame(full, DOCS)
        return df.select("*", *[F.lit(7).alias(c) for c in CLASHES])

    return make


LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))

# NULLs in every column, empty and blank texts, ties, repeated rows, one very long text.
ODD = [
    (1, None, "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, " \n\t ", None, "s", 4),
    (4, "one two three", "en", None, 13),
    (5, "the quick brown fox jumps over the lazy dog and runs away now", "en", "s", None),
    (5, "the quick brown fox jumps over the lazy dog and runs away now", "en", "s", None),
    (6, "the quick brown fox jumps over the lazy dog and runs away now", "de", "t", 1),
    (None, "the quick brown fox jumps over the lazy dog and runs away now", "de", "t", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "s", len(LONG)),
    (8, "Écoute! ça va? naïve word 日本 語 \U0001f600 end. It's 5 o'clock", "fr", "s", 3),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
