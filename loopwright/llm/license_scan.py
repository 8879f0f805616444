"""License scans: every block of text that contains enough of a license template.

Blocks are windows of words, so wide and so dense that each stretch as long as a template lies in
one.  A template is found in a block that holds a given share of the template's different words.
The join is that of exact set similarity.  Words are ordered by how many documents hold them,
rarest first; a block can only reach the share if it holds one of the template's first words (the
prefix), if it has enough words (length), and if enough words follow the shared one on both sides
(position).  The pairs that are left are compared in full.

Only words of the templates can be shared, so a block's set is cut to them: the order has one
place a word of the templates.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loopwright.llm.common import stored

# Share of a template's different words that a block has to hold: notices of fewer than ten different
# words, which differ from other families' in one word, must be there whole.
CONTAINMENT = 0.9

# Phrases whose place alone is evidence, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}

# Notices as their publishers word them, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, "
     "publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with "
     "or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms "
     "of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc", "Licensed under CC BY 4.0."),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "blocks array<struct<width:int,block:int,tokens:array<int>>>"
)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8, A-Z in lower case."""
    return _WORD.findall((text or "").encode().lower())


class Templates:
    """Templates as sets of numbered words, and the width of the windows that each is sought in."""

    def __init__(self, templates: Sequence[tuple[str, str]], containment: float):
        if not 0 < containment <= 1:
            raise ValueError("containment must lie in (0, 1]")
        given = [(label, words_of(text)) for label, text in templates]
        given = [(label, words) for label, words in given if words]
        vocabulary = sorted({w for _, words in given for w in words})
        self.number = {w: i for i, w in enumerate(vocabulary)}
        self.labels = [label for label, _ in given]
        self.sets = [sorted({self.number[w] for w in words}) for _, words in given]
        # Windows of twice a power of two not below the number of words, each half over the next.
        self.widths = [2 << (len(words) - 1).bit_length() for _, words in given]
        self.needed = [max(1, int(np.ceil(containment * len(s) - 1e-9))) for s in self.sets]

    def order(self, counts: Mapping[int, int]) -> list[int]:
        """Each word's place by ascending document count; ties by the word."""
        ranked = sorted(range(len(self.number)), key=lambda w: (counts.get(w, 0), w))
        places = [0] * len(ranked)
        for place, word in enumerate(ranked):
            places[word] = place
        return places

    def prefixes(self, places: Sequence[int]) -> list[list[int]]:
        """The first places of each template: a block with enough of its words has one of them."""
        ordered = [sorted(places[w] for w in s) for s in self.sets]
        return [o[: len(o) - need + 1] for o, need in zip(ordered, self.needed)]


class Phrases:
    """Where the words of phrases stand consecutively."""

    def __init__(self, phrases: Mapping[str, str]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]

    def places(self, words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in self.phrases:
            # The last word is the rarest in practice; each of its places is compared in full.
            last, at = phrase[-1], len(phrase) - 2
            while True:
                try:
                    at = words.index(last, at + 1)
                except ValueError:
                    break
                start = at - len(phrase) + 1
                if words[start : at + 1] == phrase:
                    found.append((start, label))
        return found


def windows(places: list[tuple[int, int]], width: int) -> dict[int, set[int]]:
    """Words (numbers) by window; ``places`` has (position, word); windows overlap by a half."""
    out: dict[int, set[int]] = {}
    half = width // 2
    for at, word in places:
        step = at // half
        out.setdefault(step, set()).add(word)
        if step:
            out.setdefault(step - 1, set()).add(word)
    return out


def document_counts(docs: DataFrame, templates: Templates) -> dict[int, int]:
    """How many documents hold each word of the templates; one row a word reaches the driver."""
    number = templates.number

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held = number.keys() & set(words_of(text))
                total[[number[w] for w in held]] += 1
        yield pa.record_batch([pa.array(range(len(number)), pa.int32()), pa.array(total)], names=["word", "n"])

    counted = docs.select("text").mapInArrow(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in counted.collect()}


def scanned_blocks(docs: DataFrame, templates: Templates, places: list[int], phrases: Mapping[str, str]) -> DataFrame:
    """Per document its base finds, and its blocks that hold a word of some template's prefix.

    A block's ``tokens`` are the places of its template words in the global order, ascending.
    """
    number, by_phrase = templates.number, Phrases(phrases)
    starts: dict[int, set[int]] = {}
    for width, prefix in zip(templates.widths, templates.prefixes(places)):
        starts.setdefault(width, set()).update(prefix)
    schema = pa.schema(
        [("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")),
         ("base_labels", pa.list_(pa.string())),
         ("blocks", pa.list_(pa.struct([("width", pa.int32()), ("block", pa.int32()), ("tokens", pa.list_(pa.int32()))])))]
    )

    def scan(text: str | None) -> tuple:
        words = words_of(text)
        found = by_phrase.places(words)
        first, last = (min(found)[0], max(found)[0]) if found else (None, None)
        at = [(i, places[number[w]]) for i, w in enumerate(words) if w in number]
        blocks = []
        for width, prefix in starts.items():
            if prefix.isdisjoint([w for _, w in at]):
                continue
            for block, held in sorted(windows(at, width).items()):
                if not prefix.isdisjoint(held):
                    blocks.append({"width": width, "block": block, "tokens": sorted(held)})
        return len(words), len(found), first, last, sorted({label for _, label in found}), blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [scan(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*made)) if made else [()] * 6
            arrays = [pa.array(c, type=f.type) for c, f in zip(columns, list(schema)[1:])]
            yield pa.record_batch([batch.column(0), *arrays], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCANNED)


def containment_join(blocks: DataFrame, templates: Templates, places: list[int]) -> DataFrame:
    """Every block and template whose containment reaches the threshold: ``row``, ``width``,
    ``block``, ``template`` and ``containment``.

    ``blocks`` has ``row``, ``width``, ``block`` and ``tokens`` (ascending places of the order).
    """
    spark = blocks.sparkSession
    prefixes = templates.prefixes(places)
    entries = [
        (t, templates.widths[t], token, k, len(templates.sets[t]), templates.needed[t], sorted(places[w] for w in templates.sets[t]))
        for t, prefix in enumerate(prefixes)
        for k, token in enumerate(prefix)
    ]
    index = spark.createDataFrame(
        entries, "template int, width int, token int, place int, size int, needed int, words array<int>"
    )
    held = blocks.select("row", "width", "block", "tokens", F.posexplode("tokens").alias("at", "token"))
    # The index has one row a prefix word of the given templates: that bounds the broadcast.
    met = held.join(F.broadcast(index), ["width", "token"])
    length = F.size("tokens") >= F.col("needed")
    # From here on, and counting this word, both sides need as many words as are still missing:
    # the words before it on either side are at most ``place`` and ``at``.
    position = (
        F.least(F.col("size") - F.col("place"), F.size("tokens") - F.col("at"))
        + F.least("place", "at")
        >= F.col("needed")
    )
    # The first shared word stands for the pair, so that each pair is compared once.
    shared = F.array_intersect("words", "tokens")
    first = F.col("token") == F.array_min(shared)
    enough = F.size(shared) >= F.col("needed")
    return met.filter(length & position).filter(first & enough).select(
        "row", "width", "block", "template", (F.size(shared) / F.col("size")).alias("containment")
    )


def scan_licenses(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = tuple(TEMPLATES),
    phrases: Mapping[str, str] = PHRASES,
    containment: float = CONTAINMENT,
) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``,
    ``base_labels``, ``labels``, ``score`` and ``found``.

    Base finds are the places where a phrase's words stand consecutively: their number, smallest
    and largest start (NULL without any) and labels.  ``found`` lists each block that holds
    ``containment`` of a template's different words: its ``first_word`` and ``last_word``, the
    template's ``label`` and the ``containment``.  ``labels`` holds the labels of both, ``score`` the
    largest containment, or 1 where a phrase was found, else 0.  Labels are distinct, sorted and
    joined by commas.  NULL and empty texts have no words and score 0.  Every row is a document,
    also repeated ones and those with a NULL id; an empty table gives no rows; templates without
    words are left out; other columns are ignored.

    Texts are read twice: for the words' order, then for blocks.  Blocks without a word of a
    prefix go no further; the others are exploded and joined with the index of prefixes.
    """
    known = Templates(templates, containment)
    places = known.order(document_counts(docs, known))
    scanned = scanned_blocks(docs, known, places, phrases)
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "license-blocks")
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    met = containment_join(blocks, known, places)
    label = F.element_at(F.array(*[F.lit(x) for x in known.labels] or [F.lit("")]), F.col("template") + 1)
    start = F.col("block") * F.col("width") / 2
    by_row = met.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct(
            start.cast("long").alias("first_word"),
            (start + F.col("width") - 1).cast("long").alias("last_word"),
            label.alias("label"),
            "containment",
        ))).alias("found"),
        F.max("containment").alias("best"),
    )
    joined: Column = F.col("base_labels")
    return (
        scanned.drop("blocks").join(by_row, "row", "left")
        .withColumn("found", F.coalesce("found", F.array().cast("array<struct<first_word:long,last_word:long,label:string,containment:double>>")))
        .select(
            "doc_id", "n_words", "n_base", "first_word", "last_word",
            F.array_join(joined, ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union(joined, F.col("found.label"))), ",").alias("labels"),
            F.greatest(F.coalesce("best", F.lit(0.0)), (F.col("n_base") > 0).cast("double")).alias("score"),
            # A window may reach past the last word.
            F.transform("found", lambda f: f.withField("last_word", F.least(f["last_word"], F.col("n_words") - 1))).alias("found"),
        )
    )
