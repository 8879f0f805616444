"""Quality rules whose thresholds come from the data: quantile sketches per language and source.

Each document gets a few ratios.  A sketch of a ratio counts the documents that pass the base rule
per logarithmic bin (bins ``RELATIVE_WIDTH`` wide), so sketches merge by adding counts.  A group's
sketch is its own counts and a fixed weight of its language's, which in turn has a fixed weight of
that of all documents: small groups lean on their language, large ones hardly notice it, and no size
is a switch.  From its sketch each ratio gets a fence: the median plus a multiple of the
distance to an outer quantile.  Documents beyond a fence go.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopwright.llm.common import fresh, of_text, stored
from loopwright.session import broadcast_if_small

WINDOW = 5
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

# Width of a sketch bin in relation to its lower end, and the value below which all is zero.
RELATIVE_WIDTH = 0.02
ZERO_BELOW = 1e-4
# Documents that the sketch above a group's counts for in it, and parts of one in which weights count.
LENT, PARTS = 200, 1000

COUNTS = [
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_loud",
]
STATS_SQL = f"struct<{', '.join(f'{c}: bigint' for c in COUNTS)}>"


class Rule(NamedTuple):
    """A ratio, how far from the median it may lie, and which sides are bad.

    ``free`` of the part do not count, so that one or two in a short text are no share.  The fence is
    ``reach`` times the distance from the median to the quantile ``outer``; where more documents than
    that have the very same value, the distance is 0 and counts as ``least``.
    """

    name: str
    part: str
    whole: str
    outer: float
    reach: float
    least: float
    free: int = 0
    both_sides: bool = False


RULES = [
    Rule("word_length", "word_chars", "n_words", 0.9, 18.0, 0.1, both_sides=True),
    # Ordinary text has no symbols, and junk may be a tenth of a source.
    Rule("symbol_share", "n_symbols", "word_chars", 0.75, 5.0, 0.012),
    Rule("dup_line_share", "n_dup_lines", "n_lines", 0.99, 4.0, 0.08, free=1),
    Rule("repeat_share", "n_repeat_words", "n_words", 0.99, 3.0, 0.04, free=25),
    Rule("loud_share", "n_loud", "n_words", 0.99, 5.0, 0.01, free=2),
]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of five words found twice or more; exact."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], dtype=np.int64)
    _, pair, count = np.unique(
        ids[:-1] * len(number) + ids[1:], return_inverse=True, return_counts=True
    )
    twice = np.cumsum(np.concatenate([[0], count[pair] > 1]))
    # A window can only be repeated if all pairs in it are.
    at = np.flatnonzero(twice[window - 1 :] - twice[: -window + 1] == window - 1)
    if not len(at):
        return 0
    code = pair[at] * len(count) + pair[at + 2]
    code = np.unique(code, return_inverse=True)[1] * len(number) + ids[at + 4]
    _, code, count = np.unique(code, return_inverse=True, return_counts=True)
    starts = at[count[code] > 1]
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered)[:n] > 0).sum())


def text_counts(text: bytes | None, points: int | None) -> tuple[int, ...]:
    """The counts of one text (UTF-8) of so many code points, in the order of ``COUNTS``."""
    if not text:
        return (0,) * len(COUNTS)
    # bytes.split cuts at exactly the ASCII white space \x20 and \x09-\x0D.
    words = text.split()
    if not words:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0, 0)
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (
        len(words),
        points - (len(text) - sum(map(len, words))),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(map(bytes.isupper, words)),
    )


def _count(texts: pa.Array) -> pa.Array:
    points = pc.utf8_length(texts).to_pylist()
    found = [text_counts(None if t is None else t.encode(), n) for t, n in zip(texts.to_pylist(), points)]
    columns = [pa.array(c, type=pa.int64()) for c in zip(*found)] or [
        pa.array([], type=pa.int64()) for _ in COUNTS
    ]
    return pa.StructArray.from_arrays(columns, names=COUNTS)


def with_counts(docs: DataFrame, name: str, keep_text: bool = True) -> DataFrame:
    """Add a struct of the counts of ``text``; only the texts go to Python."""
    counted = docs.withColumn(name, of_text("text", lambda: _count, STATS_SQL))
    return counted if keep_text else counted.drop("text")


def base_failed(stats: str) -> Column:
    s = F.col(stats)
    return (s.n_words < MIN_WORDS) | (
        100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words
    )


def _ratio(stats: str, rule: Rule) -> Column:
    part, whole = F.col(stats)[rule.part], F.col(stats)[rule.whole]
    counted = F.greatest(part - rule.free, F.lit(0))
    return F.when(whole > 0, counted / whole).otherwise(F.lit(0.0))


def _bin(value: Column) -> Column:
    width = math.log1p(RELATIVE_WIDTH)
    floor = math.floor(math.log(ZERO_BELOW) / width) - 1
    return F.when(value < ZERO_BELOW, F.lit(floor)).otherwise(F.ceil(F.log(value) / width))


def _middle(index: Column) -> Column:
    """The value that stands for a bin."""
    width = math.log1p(RELATIVE_WIDTH)
    value = F.exp(index * width) * 2 / (2 + RELATIVE_WIDTH)
    return F.when(value < ZERO_BELOW, F.lit(0.0)).otherwise(value)


def sketches(rows: DataFrame, stats: str, groups: list[str], rules: list[Rule]) -> DataFrame:
    """One row a group, rule and filled bin: ``rule``, ``bin``, ``n``.  Sketches merge by sums.

    Documents that fail the base rule count 0, so that their groups still have a row.
    """
    values = F.array(*[
        F.struct(F.lit(r.name).alias("rule"), _bin(_ratio(stats, r)).alias("bin")) for r in rules
    ])
    return (
        rows.select(*groups, base_failed(stats).alias("_failed"), F.explode(values).alias("v"))
        .groupBy(*groups, "v.rule", "v.bin")
        .agg(F.count_if(~F.col("_failed")).alias("n"))
    )


def merged(sketch: DataFrame, groups: list[str]) -> DataFrame:
    return sketch.groupBy(*groups, "rule", "bin").agg(F.sum("n").alias("n"))


def leaning(own: DataFrame, above: DataFrame, groups: list[str], shared: list[str]) -> DataFrame:
    """Each group's sketch with that above it counting as ``LENT`` documents, in ``PARTS`` of one.

    ``above`` is a sketch per ``shared``, a part of ``groups``; weights are whole numbers, so that
    sums do not depend on their order.  A group adds as many rows as the sketch above has bins.
    """
    every = Window.partitionBy(*shared, "rule")
    total = F.sum("n").over(every)
    lent = above.withColumn("n", F.round(F.col("n") * (LENT * PARTS) / total).cast("long"))
    given = own.select(*groups, "rule").distinct().join(lent, [*shared, "rule"])
    columns = [*groups, "rule", "bin", "n"]
    counted = own.withColumn("n", F.col("n") * PARTS).select(*columns)
    return merged(counted.union(given.select(*columns)), groups)


def quantiles(sketch: DataFrame, groups: list[str], fractions: dict[str, float]) -> DataFrame:
    """``total`` and the named quantiles of each group and rule, from its bins alone."""
    each = Window.partitionBy(*groups, "rule")
    running = each.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    counted = sketch.filter("n > 0").select(
        "*", F.sum("n").over(running).alias("_up_to"), F.sum("n").over(each).alias("total")
    )
    at = [F.min(F.when(F.col("_up_to") >= F.col("total") * q, F.col("bin"))) for q in fractions.values()]
    return counted.groupBy(*groups, "rule").agg(
        F.first("total").alias("total"), *[_middle(a).alias(n) for n, a in zip(fractions, at)]
    )


def fences(sketch: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per language and source: a map from rule to its lowest and highest allowed value."""
    both = ["_lang", "_source"]
    every = merged(sketch, [])
    lang = leaning(merged(sketch, ["_lang"]), every, ["_lang"], [])
    whole = leaning(sketch, lang, both, ["_lang"])
    outers = {f"q_{q}".replace(".", "_"): q for r in rules for q in (r.outer, 1 - r.outer)}
    found = quantiles(whole, both, {"middle": 0.5, **outers})
    table = F.lit(None)
    for r in rules:
        high, low = (f"q_{q}".replace(".", "_") for q in (r.outer, 1 - r.outer))
        above, below = F.col(high) - F.col("middle"), F.col("middle") - F.col(low)
        above, below = (F.when(d > 0, d).otherwise(F.lit(r.least)) * r.reach for d in (above, below))
        table = F.when(
            F.col("rule") == r.name,
            F.struct(
                (F.col("middle") - below if r.both_sides else F.lit(-1.0)).alias("low"),
                (F.col("middle") + above).alias("high"),
            ),
        ).otherwise(table)
    limits = found.withColumn("limit", table).groupBy(*both)
    return limits.agg(F.map_from_entries(F.collect_list(F.struct("rule", "limit"))).alias("_limits"))


def judge(
    docs: DataFrame,
    rules: list[Rule] = RULES,
    lang: str = "lang",
    source: str = "source",
) -> tuple[DataFrame, str]:
    """The rows of ``docs`` with a struct column of counts and verdicts, and that column's name.

    The struct has the counts, ``base_failed`` and ``kept``.  NULL text counts as none (and
    fails the base rule); a NULL language or source is a group of its own.  Repeated rows get
    equal verdicts.  An empty table stays empty.  Texts are read once: the rows and their
    counts are written to the shared folder (``judge_counted`` goes without the texts).
    """
    stats = fresh(docs, "_rule_counts")
    return judge_counted(with_counts(docs, stats), stats, rules, lang, source), stats


def judge_counted(
    counted: DataFrame,
    stats: str,
    rules: list[Rule] = RULES,
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """The verdicts for rows that already hold their counts."""
    names = [c for c in counted.columns if c != stats]
    # A language or source that is missing gets a name that none can have.
    keyed = stored(
        counted.select(
            F.struct(*names).alias("_row"),
            F.col(stats).alias("_stats"),
            F.coalesce(F.concat(F.lit("="), F.col(lang)), F.lit("")).alias("_lang"),
            F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")).alias("_source"),
        ),
        "rule-counts",
    )
    sketch = stored(sketches(keyed, "_stats", ["_lang", "_source"], rules), "rule-sketches")
    limits = broadcast_if_small(stored(fences(sketch, rules), "rule-fences"))
    inside = F.lit(True)
    for r in rules:
        value, limit = _ratio("_stats", r), F.col("_limits")[r.name]
        inside = inside & (value >= limit.low) & (value <= limit.high)
    failed = base_failed("_stats")
    # Where no document passes there are no fences, and none is needed.
    return keyed.join(limits, ["_lang", "_source"], "left").select(
        "_row.*",
        F.struct(
            "_stats.*", failed.alias("base_failed"), F.coalesce(~failed & inside, F.lit(False)).alias("kept")
        ).alias(stats),
    )


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns they came with."""
    judged, stats = judge(docs)
    return judged.filter(F.col(stats).kept).select(*docs.columns)
